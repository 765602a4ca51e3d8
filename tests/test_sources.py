import datetime as dt
import json

import pyarrow as pa
from pyspark.sql import functions as F

from almanack.plans import extraction, pipeline
from almanack.schema import as_events
from almanack.sources import objects, profiles
from almanack.sources import pages as P
from almanack.sources import tree as page_tree

REF = dt.date(2026, 10, 7)
EVENT = lambda u: u.rlike(r"/events/[\w-]+/\d{6}")
profiles.register_profile(profiles.Profile("series", "Skillbox", ("https://series.test/events",), r"series\.test/event/[\w-]+", follow=(r"/events\?page=\d+",), national=True, pages=8, enabled=False))

HTML = """<html><head><title>Jazz &amp; Blues</title><meta property="og:title" content="First"><meta property="og:title" content="Second"><link rel="canonical" href="https://x.test/e/1">
<script type="application/ld+json">{"@graph": [{"@type": "MusicEvent", "name": "Big Jazz Night", "startDate": "2026-10-11T19:30:00+05:30", "url": "https://x.test/e/1",
 "location": {"name": "Hall One", "address": {"streetAddress": "1 Main Rd", "addressLocality": "Pune"}}, "offers": [{"price": "499"}, {"price": "999"}], "organizer": {"name": "Org"},},]}</script>
<script>window.__STATE__ = {"list": [{"eventCode": "ET00012345", "title": "Solo Act", "displayDate": "Sat, 10 Oct", "type": "event", "venueName": "Dome", "price": "₹ 300 onwards", "slug": "solo"}]};</script>
</head><body><nav><a href="/home">Home</a></nav><h1>Big <b>Jazz</b> Night</h1><!-- no --><p>Hindi, English | 16+ | 2 hrs</p><div>Organised by</div><div>The Company</div><p>Duration: 2 hours</p><p>Tickets from ₹ 499 onwards</p>
<a href="/events/solo-act/123456">Solo <i>Act</i></a><a href="../events/solo-act/123456?utm_source=x">again</a><a href="mailto:x@y">mail</a></body></html>"""


def page(spark, html=HTML):
    return spark.createDataFrame([("https://x.test/city/list", html), ("https://x.test/none", None), ("https://x.test/empty", "")], "url string, html string")


def test_links_and_heads(spark):
    found = P.links(page(spark)).orderBy("pos").collect()
    assert [(x.text, x.url) for x in found] == [("Home", "https://x.test/home"), ("Solo Act", "https://x.test/events/solo-act/123456"), ("again", "https://x.test/events/solo-act/123456?utm_source=x"), ("mail", "")]
    one = P.distinct_event_links(P.links(page(spark)), EVENT).collect()
    assert [(x.url, x.title) for x in one] == [("https://x.test/events/solo-act/123456", "Solo Act")]
    assert [x.title for x in P.guessed_event_links(P.links(page(spark))).collect()] == ["Solo Act"]  # one address, tracking left out
    head = P.heads(page(spark), "url").where("url like '%list'").first()
    assert (head.title, head.h1, head.canonical, head.meta["og:title"]) == ("Jazz & Blues", "Big Jazz Night", "https://x.test/e/1", "First")


def test_lines_and_facts(spark):
    lines = P.text_lines(page(spark)).cache()
    assert [x.line for x in lines.orderBy("pos").collect()][:3] == ["Jazz & Blues", "Home", "Big Jazz Night"]
    assert {x.fact: x.value for x in P.labelled_facts(lines).collect()} == {"organizer": "The Company", "duration": "2 hours"}
    facts = P.pipe_facts(lines).first()
    assert (facts.language, facts.age_limit, facts.duration, facts.categories) == ("Hindi, English", "16+", "2 hrs", [])
    price = P.page_price(lines).first()
    assert (price.price_min, price.price_max, price.is_free) == (499.0, None, False)


def test_more_facts(spark):
    def lines(*told):
        return spark.createDataFrame([("p", i, x) for i, x in enumerate(told)], "page string, pos int, line string")

    assert {x.fact: x.value for x in P.labelled_facts(lines("Presented by Big Shows", "Venue", "Location: x", "Age limit - 16+", "Organiser: View more", "Language", "Venue", "Category | Jazz")).collect()} == {"organizer": "Big Shows", "venue": "Location: x", "age_limit": "16+", "genre": "Jazz"}
    facts = P.pipe_facts(lines("one | two", "₹ 5 | Hindi", "Comedy Shows | Hindi, English | 16yrs + | 1hr 30mins")).first()
    assert (facts.language, facts.age_limit, facts.duration, facts.categories) == ("Hindi, English", "16yrs +", "1hr 30mins", ["Comedy Shows"])
    assert P.page_price(lines("Free entry", "x", "Tickets ₹ 300 - ₹ 500")).first().price_max == 500.0 and P.page_price(lines("Price: Free")).first().is_free
    by = [P.register_by(lines("no", told), REF).first() for told in ("Registrations close on 10 Oct", "Last date to register: 12/10/2026", "Book by Friday", "Registration deadline is 9 Oct 2026, 5 pm")]
    assert [x and x.register_by for x in by] == [dt.datetime(2026, 10, 10), dt.datetime(2026, 10, 12), None, dt.datetime(2026, 10, 9, 17)]


def ld(spark, *told, base="https://in.bookmyshow.com/explore/x"):
    html = "".join(f"<script type='application/ld+json'>{json.dumps(x) if not isinstance(x, str) else x}</script>" for x in told)
    rows = spark.createDataFrame([(base, html)], "url string, html string")
    return sorted(objects.ld_events(objects.objects(objects.blocks(rows)), REF).collect(), key=lambda x: (x.pos, x.ord))


def test_jsonld_objects(spark):
    """Things before lists before events inside; what is told twice on a page counts once; broken writing is read."""
    shelf = {"@type": ["CollectionPage", "ItemList"], "itemListElement": [{"@type": "TheaterEvent", "name": "Lantern Play"}, {"position": 2, "item": {"@type": "Festival", "name": "River Fair", "subEvents": {"@type": "Event", "name": "Boat Parade"}}}]}
    mixed = {"@graph": [shelf, {"@type": "Place", "name": "Quay"}], "@type": "Event", "name": "Season"}
    twice = [{"@type": "DanceEvent", "name": "Step by Step", "url": "/s"}, {"url": "/s", "name": "Step by Step", "@type": "DanceEvent"}, {"@type": "DanceEvent", "name": "Step by Step", "url": "/t"}]
    got = ld(spark, mixed, twice, '<!-- {"@type": "Event", "name": "Two\nlines", "offers": [{"price": "5",},],} -->', '{"@type": "Event", "name": "Cut')
    assert [x.title for x in got] == ["Lantern Play", "River Fair", "Boat Parade", "Season", "Step by Step", "Step by Step", "Two lines"]


def test_jsonld_fields(spark):
    house = {"@type": "MusicVenue", "name": "Old Mill Stage", "address": {"streetAddress": "7 Canal Street", "addressLocality": "Pune", "addressRegion": "pune", "postalCode": "411001"}}
    told = {
        "@type": "TheaterEvent", "name": "The Lantern Play", "url": "/events/lantern/ET00077001", "startDate": "2026-11-21T18:15:00+05:30", "endDate": "2026-11-21T20:45:00+05:30", "eventStatus": "EventRescheduled", "location": house,
        "offers": {"lowPrice": 350, "highPrice": "1,250", "validThrough": "2026-11-19"}, "organizer": [{"name": "Zomato"}, {"name": "Mill Company"}], "performer": [{"name": "Mira"}, "Tarun"],
        "inLanguage": ["Marathi", "English"], "duration": "PT1H30M", "description": "A play<br>with <i>old</i> lamps.", "keywords": ["Family"], "subEvent": [{"startDate": "2026-11-22"}, {"startDate": "2026-11-21"}],
    }
    x = ld(spark, told)[0]
    assert (x.title, x.url, x.start, x.has_time, x.end) == ("The Lantern Play", "https://in.bookmyshow.com/events/lantern/ET00077001", dt.datetime(2026, 11, 21, 18, 15), True, dt.datetime(2026, 11, 21, 20, 45))
    assert (x.venue, x.address, x.price_min, x.price_max, x.organizer, x.performers) == ("Old Mill Stage", "7 Canal Street, Pune, 411001", 350.0, 1250.0, "Mill Company", ["Mira", "Tarun"])
    assert (x.language, x.status, x.register_by) == ("Marathi, English", "Rescheduled", dt.datetime(2026, 11, 19)) and "Family" in x.categories and x.description == "A play with old lamps." and {*x.session_dates} == {dt.date(2026, 11, 21), dt.date(2026, 11, 22)}


def test_offers(spark):
    offers = {"none": None, "free": {"price": 0}, "one": {"price": "270"}, "gone": [{"price": 40, "availability": "SoldOut"}, {"price": 60, "availability": "http://schema.org/SoldOut"}], "tiers": [{"name": "Stalls", "price": 150}, {"name": "Box", "price": "820"}], "deep": {"offers": [{"price": 31}, {"price": 17}]}}
    got = {x.title.split()[-1]: x for x in ld(spark, *({"@type": "Event", "name": f"Offer {k}", "offers": v} for k, v in offers.items()))}
    assert {k: (x.price_min, x.price_max) for k, x in got.items()} == {"none": (None, None), "free": (0.0, None), "one": (270.0, None), "gone": (40.0, 60.0), "tiers": (150.0, 820.0), "deep": (17.0, 31.0)}
    assert got["free"].is_free and got["gone"].status == "Sold out" and got["tiers"].status == "" and {tuple(t) for t in got["tiers"].ticket_types} == {("Stalls", 150.0), ("Box", 820.0)}


def test_online_and_places(spark):
    got = {x.title: x for x in ld(spark, {"@type": "Event", "name": "Call in", "location": [{"@type": "VirtualLocation"}]}, {"@type": "Event", "name": "Stream too", "eventAttendanceMode": "OnlineEventAttendanceMode", "location": "Corn Hall"})}
    assert (got["Call in"].online, got["Call in"].venue, got["Stream too"].online, got["Stream too"].venue) == (True, "", True, "Corn Hall")


def walked(spark, html, **more):
    rows = spark.createDataFrame([("https://in.bookmyshow.com/explore/plays-x", html)], "url string, html string")
    return sorted(objects.walked_events(objects.objects(objects.blocks(rows)), REF, **more).collect(), key=lambda x: x.title)


def test_objects_in_any_json(spark):
    """Names in any spelling, blocks of each kind, and objects that are none of an event."""
    deep = {"code": "x", "groups": {"evening": [{"event_title": "Clay Workshop", "event_id": "W-2041", "start_date": "2026-12-03", "time": "6:45 pm", "place": {"name": "Kiln Yard", "address": "Hill Road, Pune"}, "min_price": "₹220", "max_price": 480, "tags": ["Craft", "7"], "lang": "Marathi",
      "hosted_by": {"name": "Kiln Collective"}, "ticket_types": [{"label": "Day", "amount": 220}, {"label": "Week", "amount": "480"}], "min_age": 12, "run_time": 75, "registrationDeadline": "2026-12-01", "part": {"title": "Glazing", "date": "2026-12-04"}}]},
      "menu": [{"title": "Home"}, {"@type": "Organization", "name": "Somebody", "date": "2026-12-03"}]}
    html = f"""<script type='application/json'>{json.dumps(deep)}</script><script>initialState = {{"k": {{"heading": "Brace }} inside", "dateString": "5 Dec 2026",}}}}; go()</script><script>window.__DATA_X__ = '{{"title": "Quoted once", "datetime": "2026-12-06T10:00"}}';</script>
      <script>self.__next_f.push([1,"0:[\\"a\\"]\\n7:X {{\\"show\\": {{\\"name\\": \\"In two parts\\", \\"eventDate\\": \\"2026-"])</script><script>self.__next_f.push([1,"12-07\\"}}}}\\n"])</script><script type="text/plain">{{"name": "Plain text", "date": "2026-12-08"}}</script>"""
    got = {x.title: x for x in walked(spark, html, ident=r"W-\d+")}
    assert {*got} == {"Clay Workshop", "Brace } inside", "Quoted once", "In two parts"}
    x = got["Clay Workshop"]
    assert (x.source_id, x.start, x.has_time, x.venue, x.address, x.price_min, x.price_max) == ("W-2041", dt.datetime(2026, 12, 3, 18, 45), True, "Kiln Yard", "Hill Road, Pune", 220.0, 480.0)
    assert ([tuple(t) for t in x.ticket_types], x.organizer, x.categories, x.language, x.age_limit, x.duration, x.register_by) == ([("Day", 220.0), ("Week", 480.0)], "Kiln Collective", ["Craft"], "Marathi", "12+", "75 mins", dt.datetime(2026, 12, 1))
    assert got["Brace } inside"].start == dt.datetime(2026, 12, 5) and got["Quoted once"].has_time and got["In two parts"].start == dt.datetime(2026, 12, 7)


def test_objects_with_event_addresses(spark):
    told = [{"heading": "By slug", "permalink": "by-slug", "date": "2026-12-03"}, {"heading": "By link", "link": "/plays/by-link/ET00099002"}, {"heading": "Elsewhere", "link": "/offers/ET00099003", "date": "2026-12-03"}, {"heading": "By code?", "id": "ET00099004"}]
    p = profiles.known()["bookmyshow"]
    got = walked(spark, f'<script type="application/json">{json.dumps({"rows": told})}</script>', event=p.is_event, ident=p.json_id, slug_url="https://in.bookmyshow.com/events/{slug}/ET00099001", id_url=p.made_url)
    assert {x.title: x.url.split(".com")[1] for x in got} == {"By slug": "/events/by-slug/ET00099001", "By link": "/plays/by-link/ET00099002", "By code?": "/plays/by-code/ET00099004"}


def test_spans_do_not_grow_with_depth(spark):
    """What comes out of a nested text stays within three times the text, at any depth."""
    for depth in (1, 10, 35):
        node = [{"name": f"leaf {i}", "n": i} for i in range(300)]
        for level in range(depth):
            node = {"level": level, "venue": node}
        text = json.dumps(node)
        rows = objects.objects(spark.createDataFrame([("p", "state", 0, text)], "page string, kind string, pos int, text string")).collect()
        assert len(rows) == 300 + depth and sum(len(k) + len(v) for x in rows for k, v in x.fields.items()) < 3 * len(text)
        assert all(json.loads(text[x.begin : x.end]) for x in rows)


def test_lenient_json():
    from almanack.sources.spans import Spans

    def read(text, at=0):
        s = Spans(text)
        root = s.scan(at)
        return None if root is None else json.loads(s.shown(root, 99))

    for value in ({}, [], [[], {"a": [1, -2.5e3, "x\\"]}], "s", None, {"k": {"k": [True, False, None]}}):
        assert read(json.dumps(value)) == value
    assert read('{"a": [1, 2,], "b": "x\ny",} rest') == {"a": [1, 2], "b": "x\ny"} and read("go({1: 2})", 3) is None
    assert [read(x) for x in ('{"a" 1}', '{"a": 1 "b": 2}', "[1,,2]", '{"a": ]', "[1", '{"a": "b": 1}', "[}")] == [None] * 7


def test_tree(spark):
    """Intervals of left-open elements, attributes in any form, references, and text that is no markup."""
    html = """<body><p>one<p>two &amp; <b>three<ul><li><a href=/x/1?a=1&amp;b title='a > b'>first</a><li>second <a HREF = "https&#58;//y.test/">link</a></ul><textarea><a href="no"></textarea><!-- <a href="no"> --><script>"<a href='no'>"</script></i></body><img alt="open"""
    nodes = page_tree.nodes(page(spark, html), "url").where("url like '%list'").orderBy("n").collect()
    assert [x.n for x in nodes] == [*range(len(nodes))] and all(x.parent < x.n <= x.last <= (nodes[x.parent].last if x.parent >= 0 else len(nodes)) for x in nodes)
    assert [(x.attrs["href"], x.attrs.get("title")) for x in nodes if x.tag == "a"] == [("/x/1?a=1&b", "a > b"), ("https://y.test/", None)]
    inside = lambda tag: [[y.text.strip() for y in nodes if y.tag == "" and x.n < y.n <= x.last] for x in nodes if x.tag == tag]
    assert inside("p") == [["one"], ["two &", "three"]] and inside("li") == [["first"], ["second", "link"]] and inside("textarea") == [['<a href="no">']]


def test_nested_cards(spark):
    """A card is the largest element with one event in it, whatever is nested inside; a heading of the page is no part of it."""
    card = lambda i, more: f"<div><div><a href=/events/n/{i}{i}{i}{i}{i}{i}><img alt='Show of {i} Rivers'></a></div><section><div><p>1{i} Dec 2026</div><div>Room {i}<div>₹ {i}00</div></div></section>{more}</div>"
    html = f"<body><section><h2>Tonight</h2>{card(1, '<a href=/about>About</a>')}{card(2, '')}<article>{card(3, '<p>Seats left</p>')}</article></section></body>"
    got = {x.title: x for x in P.card_events(P.cards(page(spark, html), EVENT), REF).collect()}
    assert {t: (x.start.day, x.venue, x.price_min) for t, x in got.items()} == {f"Show of {i} Rivers": (10 + i, f"Room {i}", 100.0 * i) for i in (1, 2, 3)}


def test_cards_of_one_address_stored_twice(spark):
    """Each text is read for itself, copies too; a second link to the event is in its card, a link elsewhere is not."""
    card = lambda i: f"<div><a href=/events/n/{i}{i}{i}{i}{i}{i}><b>Show of {i} Rivers</b></a><p>1{i} Dec 2026<p>Room {i}<p>₹ {i}00<a href=/events/n/{i}{i}{i}{i}{i}{i}>at seven</a><a href=/about>About</a></div>"
    rows = [("https://x.test/list", x) for x in ("<body>" + card(1) + card(2), "<ul><li>" + card(3), "<ul><li>" + card(3), None, "")]
    got = {(x.title, x.date_text, x.venue, x.price_text, *x.lines[-1:]) for x in P.cards(spark.createDataFrame(rows, "url string, html string"), EVENT).collect()}
    assert got == {(f"Show of {i} Rivers", f"1{i} Dec 2026", f"Room {i}", f"₹ {i}00", "at seven") for i in (1, 2, 3)}


def test_profiles(spark):
    seeds = profiles.seeds(spark, ["bookmyshow", "district", "ncpa", "eventbrite"])
    assert seeds.where("source = 'district' and city = 'Delhi NCR' and template = 0").count() == 5 and {x.city for x in seeds.where("source = 'ncpa'").collect()} == {"Mumbai"}
    assert seeds.where("source = 'bookmyshow' and city = 'Delhi NCR' and template = 1").first().url == "https://in.bookmyshow.com/explore/plays-national-capital-region-ncr" and {x.key for x in profiles.chosen()} & {"explara", "series"} == set()
    pages = seeds.select("url", F.when(F.col("alternative") == 0, 404).otherwise(200).alias("status"), F.lit(3).alias("n_events"))
    assert {x.alternative for x in profiles.first_working(seeds.where("city = 'Bengaluru' and source = 'eventbrite' and template = 0"), pages).collect()} == {1}
    profiles.register_profile(profiles.Profile("mine", "Mine", ("https://mine.test/{slug}",), r"/e/\d+", follow=(r"^https://mine\.test/{slug}\?p=\d+$",), slugs={"pune": ("pune",)}, enabled=False))
    start = profiles.seeds(spark, ["mine"], ["Pune"])
    links = spark.createDataFrame([("https://mine.test/pune", 0, "https://mine.test/pune?p=3"), ("https://mine.test/pune", 1, "https://mine.test/pune?p=2"), ("https://mine.test/pune?p=2", 0, "https://mine.test/pune?p=4"), ("https://mine.test/pune?p=2", 1, "https://mine.test/e/1"), ("https://mine.test/pune", 2, "https://mine.test/goa?p=1")], "page string, pos int, url string")
    out = profiles.frontier(start, links).orderBy("place").collect()
    assert [(x.url[-4:], x.depth) for x in out] == [("pune", 0), ("?p=3", 1), ("?p=2", 1), ("?p=4", 2)]
    assert profiles.frontier(start, links, budget=2).count() == 2
    dry = spark.createDataFrame([("https://mine.test/pune", 4), ("https://mine.test/pune?p=3", 0), ("https://mine.test/pune?p=2", 0)], "page string, new int")
    assert [x.url[-4:] for x in profiles.frontier(start, links, found=dry, stop_after=2).orderBy("place").collect()] == ["pune", "?p=3", "?p=2"]
    try:
        profiles.chosen(["mine", "nobody"])
        raise AssertionError
    except ValueError as problem:
        assert "nobody" in str(problem)


def test_event_addresses(spark):
    def check(key, cases):
        rows = spark.createDataFrame([(u,) for u in cases], "u string")
        assert {x.u: x.y for x in rows.select("u", profiles.known()[key].is_event(F.col("u")).alias("y")).collect()} == cases

    check("bookmyshow", {"https://in.bookmyshow.com/mumbai/events/x/ET00000001": True, "https://in.bookmyshow.com/activities/x/ET00000001": False, "https://in.bookmyshow.com/explore/events-mumbai": False})
    check("district", {"https://www.district.in/events/upcoming-events-in-pune": False, "https://www.district.in/events/big-gala-oct11-2026-buy-tickets": True, "https://www.district.in/events/jazz-in-pune-oct12-2026": True, "https://www.district.in/events/jazz-gala": True, "https://www.district.in/events/best-of-comedy": False})
    check("skillbox", {"https://www.skillboxes.com/events/indie-night": True, "https://www.skillboxes.com/events/page": False})
    p = profiles.known()["bookmyshow"]
    row = spark.createDataFrame([("https://in.bookmyshow.com/events/x/ET00000001",)], "u string").select(p.id_of(F.col("u")).alias("i"), p.alternates(F.col("u")).alias("a"), profiles.platform_of(F.col("u")).alias("p")).first()
    assert (row.i, row.a, row.p) == ("ET00000001", ["https://in.bookmyshow.com/plays/x/ET00000001", "https://in.bookmyshow.com/sports/x/ET00000001"], "BookMyShow") and p.domains() == ["in.bookmyshow.com"]
    plain = spark.createDataFrame([("a", 2, "plain"), ("b", 9, "plain"), ("c", 1, "plain")], "url string, n_events int, html string")
    shown = spark.createDataFrame([("a", 8, "shown"), ("b", 20, "shown"), ("d", 3, "shown")], "url string, n_events int, html string")
    assert {x.url: x.html for x in profiles.loaded(plain, shown).collect()} == {"a": "shown", "b": "plain", "c": "plain", "d": "shown"}


def test_cards_and_microdata(spark):
    html = r"""<div><a href="/events/one/111111"><img></a><h3>The First Show of All</h3><p>Sat, 10 Oct</p><p>Hall One</p><p>₹ 300 onwards</p></div><div><a href="/about">x</a></div><div><a href="/events/two/222222">Second</a><p>Free</p></div>
<div itemscope itemtype="https://schema.org/MusicEvent"><span itemprop="name">Micro <b>Night</b></span><meta itemprop="startDate" content="2026-10-13"><a itemprop="url" href="https://x.test/m">m</a></div><div itemscope itemtype="http://schema.org/Event"><i itemprop="name">No date</i></div>"""
    pages = page(spark, html)
    found = {x.url[-6:]: x for x in P.cards(pages, EVENT).collect()}
    assert (found["111111"].title, found["111111"].date_text, found["111111"].venue, found["111111"].price_text) == ("The First Show of All", "Sat, 10 Oct", "Hall One", "₹ 300 onwards")
    assert (found["222222"].title, found["222222"].price_text) == ("Second", "Free")
    assert [(x.title, x.start_text, x.url) for x in P.microdata(pages).collect()] == [("Micro Night", "2026-10-13", "https://x.test/m")]


def test_card_after_a_long_script(spark):
    html = f"<div><a href='/events/one/111111'>First Show</a><script>{'var x = 1; ' * 3000}</script><p>Sat, 10 Oct</p><p>Hall One</p><p>₹ 300 onwards</p></div>"
    x = P.cards(page(spark, html), EVENT).first()
    assert (x.date_text, x.venue, x.price_text, x.lines) == ("Sat, 10 Oct", "Hall One", "₹ 300 onwards", ["First Show", "Sat, 10 Oct", "Hall One", "₹ 300 onwards"])


def test_cards_one_by_one(spark):
    html = """<main><h1>What is on in Pune</h1><div class='chips'><a href='/explore/comedy-pune'>Comedy</a><a href='/explore/music-pune'>Music</a></div><div class='grid'>
      <div class='card'><a href='/events/ravi/111111'><img alt='Ravi and the Tides' src='a.jpg'></a><div>Sat, 10 Oct</div><div>Harbour Steps: Pune</div><div>₹ 640 onwards</div><span>Fast filling</span></div>
      <div class='card'><a href='/events/jazz/222222'><h3>Jazz Night</h3><p>Sun, 11 Oct</p><p>Music</p><p>Copper Room</p><p>Free</p></a><a href='/about'>About us</a></div><a href='/events/ravi/111111'>Book now</a></div></main>"""
    got = {x.title: x for x in P.card_events(P.cards(page(spark, html), EVENT), REF).collect()}
    a, b = got["Ravi and the Tides"], got["Jazz Night"]
    assert {*got} == {"Ravi and the Tides", "Jazz Night"} and (a.start, a.venue, a.price_min, a.price_max, a.categories) == (dt.datetime(2026, 10, 10), "Harbour Steps: Pune", 640.0, None, [])
    assert (b.start, b.venue, b.is_free, b.categories) == (dt.datetime(2026, 10, 11), "Copper Room", True, ["Music"])


LISTING = """<script type="application/ld+json">[{"@type": "MusicEvent", "name": "Big Jazz Night", "startDate": "2026-10-11", "url": "/mumbai/big-jazz/1234567"}]</script>
<div><a href="/mumbai/big-jazz/1234567">Big Jazz Night</a><p>Sun, 11 Oct</p><p>Copper Room</p><p>₹ 499 onwards</p></div><div><a href="/mumbai/solo-act/7654321"><img alt="Solo Act Evening"></a><p>Mon, 12 Oct</p></div><a href="/mumbai/all?page=2">more</a>"""
DETAIL = """<link rel="canonical" href="https://allevents.in/mumbai/solo-act-live/7654321"><meta property="og:title" content="Solo Act Evening"><meta property="og:description" content="One act alone for a whole evening of it.">
<script type="application/ld+json">[{"@type": "Event", "name": "Solo Act Evening", "startDate": "2026-10-12T19:00", "location": {"name": "Dome", "address": "Worli, Mumbai"}, "offers": {"price": 700}}, {"@type": "Event", "name": "Solo Act Evening", "startDate": "2026-10-14T19:00", "location": {"name": "Dome", "address": "Worli, Mumbai"}, "offers": [{"price": 500}, {"price": 900}], "organizer": {"name": "Solo Co"}},
 {"@type": "Event", "name": "Solo Act Evening", "startDate": "2026-10-13T19:00", "location": {"name": "Hall", "address": "Pune"}}, {"@type": "Event", "name": "Another Thing", "startDate": "2026-10-01"}]</script>
<p>Comedy | Hindi | 16+</p><p>Duration: 90 mins</p><p>Registrations close on 11 Oct</p>"""


def test_pages_to_calendar(spark):
    listing = spark.createDataFrame([("allevents", "Mumbai", 0, "https://allevents.in/mumbai/all", LISTING), ("allevents", "Mumbai", 1, "https://allevents.in/mumbai/all?page=2", LISTING)], "source string, city string, place int, url string, html string")
    rows = pipeline.written(extraction.all_listed(listing, REF, ["allevents"]), "rows")
    got = {x.title: x for x in rows.collect()}
    big, solo = got["Big Jazz Night"], got["Solo Act Evening"]
    assert len(got) == 2 and (big.start, big.venue, big.price_min, big.source, big.city, big.source_id, big.platforms, big.links) == (dt.datetime(2026, 10, 11), "Copper Room", 499.0, "allevents", "Mumbai", "1234567", ["AllEvents"], {"AllEvents": big.url})
    pages = spark.createDataFrame([("allevents", solo.url, None, DETAIL), ("allevents", "https://allevents.in/mumbai/unasked/1111111", None, DETAIL)], "source string, url string, final_url string, html string")
    more = pipeline.written(extraction.all_details(pages, rows, REF, ["allevents"]), "details")
    d = more.first()
    assert more.count() == 1 and (d.start, d.end, d.price_min, d.price_max, d.organizer, d.venue) == (dt.datetime(2026, 10, 12, 19), dt.datetime(2026, 10, 14, 19), 500.0, 900.0, "Solo Co", "Dome")
    assert (d.session_dates, d.language, d.age_limit, d.duration, d.register_by, d.description, d.verified) == ([dt.date(2026, 10, 12), dt.date(2026, 10, 14)], "Hindi", "16+", "90 mins", dt.datetime(2026, 10, 11), "One act alone for a whole evening of it.", True)
    assert d.own_url == "https://allevents.in/mumbai/solo-act-live/7654321" and d.categories == ["Comedy"]
    kept, _ = pipeline.calendar(as_events(rows.withColumn("ord", F.xxhash64("url")), "ord"), pipeline.RunParams(dt.date(2026, 10, 8), dt.date(2026, 10, 31), ["Mumbai"]), more)
    out = {x.title: x for x in kept.collect()}
    assert out["Solo Act Evening"].url == d.own_url and out["Solo Act Evening"].links == {"AllEvents": d.own_url} and out["Solo Act Evening"].activity_type == "Comedy" and out["Solo Act Evening"].link_verified
    assert out["Big Jazz Night"].tier == "Standard" and out["Big Jazz Night"].activity_type == "Music"


def test_a_single_candidate_and_other_pages(spark):
    asked = spark.createDataFrame([("https://in.bookmyshow.com/events/x/ET00000001", "Wholly Other Name", "ET00000001", "")], "url string, title string, source_id string, city string")
    html = '<script type="application/ld+json">{"@type": "Event", "name": "Renamed Show", "startDate": "2026-10-12"}</script>'
    p = profiles.known()["bookmyshow"]
    asked = asked.unionByName(spark.createDataFrame([("https://in.bookmyshow.com/events/y/ET00000002", "Gone Show", "ET00000002", "")], asked.schema))
    stored = spark.createDataFrame([("https://in.bookmyshow.com/events/x/ET00000001", html), ("https://in.bookmyshow.com/events/y/ET00000002", "<p>gone</p>")], "url string, html string")
    rows = extraction.details(stored, asked, p, REF).collect()
    assert [(x.title, x.own_url) for x in rows] == [("Renamed Show", "")]
    one = as_events(spark.createDataFrame([("https://in.bookmyshow.com/events/x/ET00000001", "bookmyshow", ["BookMyShow", "Meetup"], {"Meetup": "https://m.test/1"})], "url string, source string, platforms array<string>, links map<string,string>"))
    assert [(x.other, x.other_site) for x in pipeline.other_pages(one).orderBy("pos").collect()] == [("https://in.bookmyshow.com/plays/x/ET00000001", False), ("https://in.bookmyshow.com/sports/x/ET00000001", False), ("https://m.test/1", True)]


def test_whole_listings_need_no_page(spark):
    whole = dict(url="u", start=dt.datetime(2026, 10, 10, 19), has_time=True, venue="Hall", price_min=5.0, description="x" * 40)
    rows = as_events(spark.createDataFrame([(*whole.values(),)], "url string, start timestamp_ntz, has_time boolean, venue string, price_min double, description string"))
    assert [rows.select(profiles.needs_detail(F.lit(named)).alias("y")).first().y for named in (True, False)] == [True, False]


def test_objects_are_handed_out_together():
    """Objects of many small blocks leave a task in one batch, each with its own block's page."""
    texts = [f'{{"k": {i}, "b": [{{"k": {-i}}}]}}' for i in range(3000)] + ["no json"]
    rows = pa.RecordBatch.from_pydict({"page": [*range(3001)], "kind": ["state"] * 3001, "pos": [0] * 3001, "text": texts})
    (found,) = objects._handed_out(iter([rows]))
    assert {(r["page"], r["ord"], dict(r["fields"])["k"]) for r in found.to_pylist()} == {(i, o, str(-i if o else i)) for i in range(3000) for o in (0, 1)}


def test_links_alone_are_those_of_the_tree(spark):
    html = "<a href=' /a '>one <b>two</b></a><a name=x>none</a><p><a HREF=\"/b?x=1&amp;y=2\"><img alt=i></a> between <a href='/c'>three<a href=/d>four</a> five<a href='/e>"
    pages = page(spark, html)
    tree = page_tree.anchors(page_tree.nodes(pages, "url"), "url").orderBy("url", "n").collect()
    alone = page_tree.links(pages, "url").orderBy("url", "pos").collect()
    assert [(r.url, r.href, r.text) for r in alone] == [(r.url, r.href, r.text) for r in tree] == [("https://x.test/city/list", h, t) for h, t in (("/a", "one two"), ("/b?x=1&y=2", ""), ("/c", "three"), ("/d", "four"))]
    assert [r.pos for r in alone] == [0, 1, 2, 3]


def test_first_names_and_members(spark):
    """The preferred name that an object has, spelled so before any capitals; the first member that is not empty."""
    rows = spark.createDataFrame([({"Title": '"low"', "event_name": '"named"'}, {"title": '"low"', "event_name": '"named"'}, '{"contentUrl": "", "value": 3, "text": "t"}'), ({"TITLE": '"low"'}, {"title": '"low"'}, "{}")], "fields map<string,string>, lows map<string,string>, v string")
    got = rows.select(objects.pick(objects.KEYS["title"]).alias("p"), objects.member(F.col("v"), *objects.TEXT_OF).alias("m")).collect()
    assert [(r.p, r.m) for r in got] == [('"named"', "3"), ('"low"', None)]


def test_made_pages_lie_in_all_partitions(spark):
    from almanack.plans.page_queries import card_pages

    assert card_pages(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
