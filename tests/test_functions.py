import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanack.functions import classify, dates, money, places, text, urls

REF = dt.date(2026, 10, 7)


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def at(y, m, d, h=0, mi=0):
    return dt.datetime(y, m, d, h, mi)


def test_dates(spark):
    cases = {
        "2026-10-11T19:30:00+05:30": (at(2026, 10, 11, 19, 30), True), "2026-10-11T14:00:00Z": (at(2026, 10, 11, 19, 30), True), "2026-10-11": (at(2026, 10, 11), False), "2026-02-30": (None, False),
        "Sat, 10 Oct": (at(2026, 10, 10), False), "15 Feb onwards": (at(2027, 2, 15), False), "Oct 12, 2026": (at(2026, 10, 12), False), "12/10/2026": (at(2026, 10, 12), False), "1791669600": (at(2026, 10, 11, 3, 30), True),
        "1791999000000": (at(2026, 10, 14, 23), True), "12": (None, False), "2026-10-11T20:00:00.123456789+0530": (dt.datetime(2026, 10, 11, 20, 0, 0, 123456), True), "Friday, October 9 at 7:00 PM": (at(2026, 10, 9, 19), True), "15th Jan": (at(2027, 1, 15), False),
        "Today, 8:00 PM": (at(2026, 10, 7, 20), True), "Tomorrow": (at(2026, 10, 8), False), "10/11/2026": (at(2026, 11, 10), False), "10/25/2026": (at(2026, 10, 25), False), "Book now": (None, False), "Marathon 5": (None, False), "31 Apr 2026": (None, False),
        "11 Oct 2026 7:30 pm +2400": (at(2026, 10, 11, 19, 30), True), "11 Oct 2026 +530": (at(2026, 10, 11), False), "11 Oct, 2026 | 7:00 PM | Call +91 98200 12345": (at(2026, 10, 11, 19), True), "12 Oct 26": (at(2026, 10, 12), False), "Oct 2026": (at(2026, 10, 1), False),
        "tomorrow 7 pm": (at(2026, 10, 8, 19), True), "12 October 2026, 7:30 PM": (at(2026, 10, 12, 19, 30), True), "nothing": (None, False), "": (None, False),
    }
    got = column(spark, [*cases], lambda x: dates.date_range(x, REF))
    for (said, (start, timed)), r in zip(cases.items(), got, strict=True):
        assert (r.start, r.end, r.has_time) == (start, None, timed), said


def test_ranges(spark):
    cases = {
        "10 - 12 Oct": (at(2026, 10, 10), at(2026, 10, 12)), "10-12 Oct": (at(2026, 10, 10), at(2026, 10, 12)), "Sat, 10 Oct - Sun, 11 Oct": (at(2026, 10, 10), at(2026, 10, 11)), "28 Dec - 3 Jan": (at(2026, 12, 28), at(2027, 1, 3)),
        "10 Oct to 12 Nov 2026": (at(2026, 10, 10), at(2026, 11, 12)), "30 - 2 Nov": (at(2026, 10, 30), at(2026, 11, 2)),
        "10-12 Oct 2026": (at(2026, 10, 10), at(2026, 10, 12)), "Oct 30 - Nov 2": (at(2026, 10, 30), at(2026, 11, 2)), "28 Dec - 3 Jan 2027": (at(2026, 12, 28), at(2027, 1, 3)), "Dec 30 – Jan 2": (at(2026, 12, 30), at(2027, 1, 2)),
        "Oct 10 | 7:00 PM - 10:00 PM": (at(2026, 10, 10, 19), None), "31 - 2 Nov": (at(2026, 10, 31), at(2026, 11, 2)), "2026-10-10": (at(2026, 10, 10), None),
    }
    got = column(spark, [*cases], lambda x: dates.date_range(x, REF))
    for (said, (start, end)), r in zip(cases.items(), got, strict=True):
        assert (r.start, r.end) == (start, end), said


def test_clock_duration_and_deadline(spark):
    assert column(spark, ["7 pm", "at 19:05", "12 am", "25:00", None], dates.clock_minutes) == [1140, 1145, 0, None, None]
    assert column(spark, ["PT1H30M", "PT2H", "PT45M", "2 hours", "P"], dates.duration_text) == ["1 hr 30 mins", "2 hrs", "45 mins", "2 hours", "P"]
    rows = spark.createDataFrame([(1, at(2026, 10, 10), None, True, None), (2, at(2026, 10, 10), at(2026, 10, 20), True, at(2026, 12, 1)), (3, at(2026, 10, 10), None, True, at(2026, 10, 8)), (4, at(2026, 9, 1), None, False, None)], "i int, start timestamp_ntz, end timestamp_ntz, known boolean, by timestamp_ntz")
    got = rows.select("i", dates.settled_register_by(F.col("start"), F.col("end"), F.col("known"), F.col("by"), dt.date(2026, 10, 1)).alias("r")).orderBy("i").collect()
    assert [(x.r.register_by, x.r.inferred) for x in got] == [(at(2026, 10, 10), True), (at(2026, 10, 20), False), (at(2026, 10, 8), False), (at(2026, 10, 1), True)]


@pytest.mark.parametrize("bare, cases", [
    (False, {"₹ 499 onwards": (499, None, False), "Rs. 1,50,000": (150000, 150000, False), "₹500 - ₹2,500": (500, 2500, False), "Free": (0, None, True), "Free – ₹500": (0, 500, True), "₹99 with free drink": (99, 99, False), "499": (None, None, False), "₹0": (0, None, True), "": (None, None, False), "₹9,00,000": (None, None, False)}),
    (True, {"499": (499, 499, False), "1,200.50": (1200.5, 1200.5, False), "from 300": (300, None, False)}),
])
def test_prices(spark, bare, cases):
    got = column(spark, [*cases], lambda x: money.price_of_text(x, bare))
    for (said, want), r in zip(cases.items(), got, strict=True):
        assert (r.price_min, r.price_max, r.is_free) == want, said


def test_price_texts(spark):
    assert column(spark, [0.0, 999.0, 1000.0, 150000.0, 12345678.0, 2.5, 3.5, -1500.0], money.format_inr, "double") == ["₹0", "₹999", "₹1,000", "₹1,50,000", "₹1,23,45,678", "₹2", "₹4", "-₹1,500"]
    rows = spark.createDataFrame([(1, 800.0, 2500.0, False), (2, 499.0, None, False), (3, 0.0, None, True), (4, 0.0, 500.0, True), (5, None, None, False), (6, 700.0, 700.0, False)], "i int, lo double, hi double, free boolean")
    got = rows.select("i", money.format_price_range(F.col("lo"), F.col("hi"), F.col("free")).alias("y")).orderBy("i").collect()
    assert [x.y for x in got] == ["₹800 – ₹2,500", "₹499 onwards", "Free", "Free – ₹500", "", "₹700"]
    assert [tuple(r) for r in column(spark, [[0.0, 5.0, 9.0], [], [600000.0]], money.price_of_values, "array<double>")] == [(0.0, 9.0, True), (None, None, False), (None, None, False)]


def test_titles(spark):
    assert column(spark, ["Book tickets for Jazz Night | BookMyShow", "Comedy Nite Tickets", '"Quoted"', "A &amp; B"], text.clean_title) == ["Jazz Night", "Comedy Nite", "Quoted", "A & B"]
    assert [sorted(x) for x in column(spark, ["Sunburn Arena ft. Alan 2026 Mumbai", "दिल्ली", "The Show"], text.title_tokens)] == [["alan", "arena", "sunburn"], [], []]
    pairs = [("Sunburn Arena Alan", "Sunburn Arena Alan Walker Live", True), ("Jazz", "Jazz Night", True), ("Jazz", "Jazz Rock Pop", False), ("दिल्ली", "दिल्ली", False)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [x.y for x in rows.select("i", text.titles_match(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()] == [p[2] for p in pairs]


def test_texts(spark):
    assert column(spark, ["a   b​c\n d", "&lt;x&gt; &eacute;", None], lambda x: text.clean_text(x, entities=True)) == ["a bc d", "<x> é", ""]
    assert column(spark, ["<p>Hi <b>you</b></p>", "a < b"], text.strip_html) == ["Hi you", "a < b"]
    assert column(spark, ["**Bold** 🎉 text !", "𝗳𝗮𝗻𝗰𝘆"], text.plain_text) == ["Bold text!", "fancy"]
    assert column(spark, ["About the event: Queen vs. ABBA is here. More follows.", "Book tickets for X. A night of jazz and blues.", "Live! With the whole band tonight.", "w" * 50 + " " + "x" * 200, ""], text.one_line) == ["Queen vs. ABBA is here.", "A night of jazz and blues.", "Live! With the whole band tonight.", "w" * 50 + "…", ""]
    assert column(spark, ["short", "One one one. Two two two. " * 9], lambda x: text.first_sentences(x, 30)) == ["short", "One one one. Two two two."]
    assert column(spark, ["Stand-Up: Live!"], text.slugify) == ["stand-up-live"] and column(spark, ["english|hindi"], text.languages) == ["English, Hindi"] and column(spark, ["S. No. 1"], text.norm_header) == ["sno"]


def test_urls(spark):
    cases = {"HTTPS://WWW.X.test//a//b/?utm_source=q&id=5&ref=z#frag": "https://www.x.test/a/b?id=5", "http://x.test": "http://x.test/", "https://x.test:8080/a/": "https://x.test:8080/a", "": ""}
    assert column(spark, [*cases], urls.canonical_url) == [*cases.values()]
    assert column(spark, ["http://A.test:80/x", "nothing", None], urls.host_of) == ["a.test:80", "", ""]
    hrefs = {"/x": "https://h.test/x", "y": "https://h.test/a/y", "../z": "https://h.test/z", "//o.test/q": "https://o.test/q", "mailto:a@b": "", "#t": "", "https://k.test/": "https://k.test/", "": ""}
    assert column(spark, [*hrefs], lambda x: urls.absolute_url(F.lit("https://h.test/a/b"), x)) == [*hrefs.values()]
    assert column(spark, ["m.x.test", "x.test", "badx.test"], lambda x: urls.domain_rank(x, [("x.test", "X")])) == ["X", "X", None]
    assert column(spark, ["https://x.test/events/big-night-out/ET00412345", "https://x.test/e/jazz-trio-tickets-991?x=1", "https://x.test/e/solo-act-1234567/", "https://x.test"], text.title_from_url)[:3] == ["Big Night Out", "Jazz Trio", "Solo Act"]


def test_robots(spark):
    from almanack.operators.tables import robots, robots_rules

    text = "User-agent: *\nDisallow: /\n\nUser-agent: mybot\nUser-agent: other\nDisallow: /private # not this\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow: /same\nAllow: /same\nDisallow:\n"
    files = spark.createDataFrame([("a.test", text), ("b.test", "User-agent: *\r\nDisallow: /x\r\n"), ("c.test", "Disallow: /none\n"), ("d.test", "")], "host string, text string")
    paths = {"/private/x": False, "/private/open/1": True, "/a/b.pdf": False, "/a/b.pdfx": True, "/": True, "/same": True}
    rows = spark.createDataFrame([("a.test", p) for p in paths] + [("b.test", "/x/1"), ("c.test", "/none"), ("e.test", "/x")], "host string, path string")
    out = {(x.host, x.path): x.allowed for x in robots(rows, robots_rules(files, "MyBot/1.0")).collect()}
    assert out == {("a.test", p): ok for p, ok in paths.items()} | {("b.test", "/x/1"): False, ("c.test", "/none"): True, ("e.test", "/x"): True}
    assert {x.allowed for x in robots(rows.where("host = 'a.test'"), robots_rules(files, "stranger")).collect()} == {False}


def test_tiers(spark):
    cases = [(0.0, None, True, "Standard"), (499.0, None, False, "Standard"), (500.0, None, False, "Premium"), (1549.0, None, False, "Premium"), (1550.0, 9000.0, False, "Luxury"), (5000.0, None, False, "Ultra Premium"), (None, None, False, "TBC"), (None, 700.0, False, "Premium")]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, lo double, hi double, free boolean")
    pick = lambda basis: [x.y for x in rows.select("i", classify.tier(F.col("lo"), F.col("hi"), F.col("free"), basis).alias("y")).orderBy("i").collect()]
    assert pick("min") == [c[3] for c in cases]
    assert pick("max")[4] == "Ultra Premium" and pick("avg")[4] == "Ultra Premium"


def test_activities(spark):
    cases = [([], "Stand-up by Someone", "", "Comedy"), (["music-shows"], "Navratri Nights with Garba", "", "Culture"), ([], "Pottery Workshop", "", "Workshops"), (["Music"], "An evening", "", "Music"), ([], "India vs Australia", "", "Sports to Watch"), ([], "City Half Marathon", "", "Recreational Sports"), ([], "Wine tasting", "", "F&B"), ([], "The Musical", "", "Theatre"), (["performances"], "Untold", "an art exhibition", "Culture"), (["entertainment"], "Untold", "an art exhibition", "Art"), ([], "Something", "", "Other"), ([], "Grand Festival", "", "Culture"), ([], "Oktoberfest live music", "", "F&B"), ([], "Volleyball finals", "", "Sports to Watch"), ([], "Certificate course in design", "", "Workshops"), ([], "Odissi by Sujata", "", "Culture"), (["Sports"], "Tata Mumbai Marathon 2027", "", "Recreational Sports"),
        (["Music Shows", "Concerts"], "Dream Theater – 40th Anniversary Tour India", "", "Music"), (["Sports"], "India vs Brazil – International Friendly", "", "Sports to Watch"), (["Kids"], "Peppa Pig Live", "", "Other"), ([], "Mana Run Hyderabad 2026", "Popular city run event.", "Recreational Sports"),
        ([], "Hemis Festival 2026 – Ladakh", "Rare Buddhist masked dance festival.", "Culture"), ([], "Women's Indian Open Golf 2026", "", "Recreational Sports"), ([], "Commonwealth Youth Games", "", "Sports to Watch"), ([], "Mixed martial arts gala", "", "Other")]
    rows = spark.createDataFrame([(i, c, t, d) for i, (c, t, d, _) in enumerate(cases)], "i int, c array<string>, t string, d string")
    got = [x.y for x in rows.select("i", classify.activity(F.col("c"), F.col("t"), F.col("d"), F.lit("")).alias("y")).orderBy("i").collect()]
    assert got == [c[3] for c in cases]
    assert column(spark, [["http://schema.org/MusicEvent"], ["Event", "Festival"], ["Thing"]], classify.schema_category, "array<string>") == ["Music", "Culture", None]


def test_places(spark):
    cases = {"Mumbai Masala, Koregaon Park, Pune": "Pune", "Andheri, Mumbai": "Mumbai", "HSR Layout": "Bengaluru", "Sector 5, Noida": "Delhi NCR", "Delhi Road, Bangalore": "Bengaluru", "Anytown": None, "": None}
    assert column(spark, [*cases], places.detect_city) == [*cases.values()]
    assert column(spark, ["Candolim, Goa", "Goa, Mumbai", "x"], places.detect_other_town) == ["Goa", None, None]
    assert column(spark, ["Bangalore", "delhi", "Pune", "?"], places.city_of_name) == ["Bengaluru", "Delhi NCR", "Pune", None]
    assert column(spark, ["Navi Mumbai 400614", "Bandra West"], places.is_city_name) == [True, False]
    assert column(spark, ["x1", "ABBA", "1984", "Untitled", "Oct 11", "Jazz night", ""], places.is_placeholder_title) == [True, False, True, True, True, False, True]
    rows = spark.createDataFrame([(1, True, "", "t"), (2, True, "Hall", "t"), (3, False, "Online Event", "t"), (4, False, "Hall", "Virtual reality day"), (5, False, "Hall", "A webinar")], "i int, o boolean, v string, t string")
    assert [x.y for x in rows.select("i", places.is_online(F.col("o"), F.col("v"), F.col("t")).alias("y")).orderBy("i").collect()] == [True, False, True, False, True]


def test_a_date_text_is_read_once(monkeypatch):
    """A worker reads a text once, in whichever list it stands."""
    seen, real = [], dates.read_range
    monkeypatch.setattr(dates, "read_range", lambda s, ref: seen.append(s) or real(s, ref))
    lists, ref = [["nothing"], ["3 Nov 1996", "2 Nov 1996"]], dt.date(1996, 2, 29)
    assert [dates._first_of(lists, ref)[0] for _ in range(3)] == [dt.datetime(1996, 11, 2)] * 3 and seen == ["nothing", "3 Nov 1996", "2 Nov 1996"]
