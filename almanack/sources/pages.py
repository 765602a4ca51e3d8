"""Readers over stored pages (url, html): one row in, rows out, in the JVM wherever a pattern can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions import dates, money, urls
from almanack.functions.text import clean_text, clean_title, once, title_from_url
from almanack.plans.steps import written
from almanack.schema import as_events
from almanack.sources import tree as page_tree

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|main|title|dl|dt|dd|form|option)\b[^>]*>"
SILENT = r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>|<!--.*?-->"


def inner_text(c: Column) -> Column:
    return clean_text(F.regexp_replace(c, r"(?s)<[^>]*>", " "))


def links(pages: DataFrame, page: str = "url", base: Column | None = None) -> DataFrame:
    """(page, pos, href, text, url): links in page order with absolute addresses, seen from `base`, else from the page column."""
    rows = pages.select(F.col(page).alias("page"), (F.col(page) if base is None else base).alias("base"), "html")
    found = page_tree.links(rows, "page", "base")
    found = found.select("page", "base", "pos", clean_text(F.col("href")).alias("href"), clean_text(F.col("text")).alias("text"))
    return once(found.withColumn("url", urls.absolute_url(F.col("base"), F.col("href"))).drop("base"), "url")


def heads(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with title, h1, canonical address and first-wins meta tags by lower-case name."""
    name = r"(?is)<meta\b[^>]*?\b(?:property|name|itemprop)\s*=\s*[\"']([^\"']+)[\"'][^>]*?\bcontent\s*=\s*[\"']([^\"']*)[\"']"
    keys, values = F.regexp_extract_all("html", F.lit(name), F.lit(1)), F.regexp_extract_all("html", F.lit(name), F.lit(2))
    low = F.transform(keys, F.lower)
    once = F.array_distinct(low)
    first = F.transform(once, lambda k: clean_text(F.get(values, F.array_position(low, k).cast("int") - 1)))
    part = lambda rx: inner_text(F.regexp_extract("html", rx, 1))
    return pages.select(
        *keep, part(r"(?is)<title\b[^>]*>(.*?)</title>").alias("title"), part(r"(?is)<h1\b[^>]*>(.*?)</h1>").alias("h1"),
        clean_text(F.regexp_extract("html", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("canonical"), F.map_from_arrays(once, first).alias("meta"),
    )


#: Lines that speak to browsers.
NOISE = r"(?i)enable javascript|javascript is (?:disabled|required)|your browser"


def text_lines(pages: DataFrame, page: str = "url") -> DataFrame:
    """(page, pos, line): the visible lines of a page."""
    seen = F.regexp_replace(F.regexp_replace("html", SILENT, " "), BLOCK, "\n")
    lines = F.filter(F.transform(F.split(seen, "\n"), inner_text), lambda x: (x != "") & ~x.rlike(NOISE))
    return pages.select(F.col(page).alias("page"), F.posexplode(lines).alias("pos", "line"))


#: Labels of facts on event pages, lines that name an organiser outright, values that are none, and how deadlines are announced.
LABELS = {
    "organizer": r"organi[sz]ed\s+by|organi[sz]ers?|event\s+organi[sz]er|presented\s+by|hosted\s+by|promoted\s+by|produced\s+by|curated\s+by|brought\s+to\s+you\s+by|host(?:ed)?\s+by",
    "language": r"languages?",
    "duration": r"duration|run\s*time|show\s+duration",
    "age_limit": r"age\s+limit|age\s+restriction|age\s+group|ages|suitable\s+for|entry\s+age|age",
    "genre": r"genres?|category|event\s+type",
    "venue": r"venue",
}
NAMED_BY = r"(?i)^\s*(?:organi[sz]ed|presented|hosted|promoted|produced|curated)\s+by\s+(.{2,80})$"
NO_FACT = r"(?i)^(?:view|know|read|see|show|follow|more|click|book|share|less)\b|₹|https?://"
DEADLINES = [
    r"\b(?:registrations?|entries|enrol?l?ments?|bookings?|rsvps?|ticket sales|sales|applications?)\s+(?:will\s+)?(?:close|closes|closing|end|ends|ending|shut|shuts)\s*(?:on|by|at)?\s*[:\-–]?\s*(.{4,60})",
    r"\b(?:last|final)\s+date\s+(?:to|for|of)\s+(?:register|registration|registrations|apply|application|booking|book|enrol\w*|submission|entry|entries)\s*(?:is|:|\-|–)?\s*(.{4,60})",
    r"\b(?:register|book|rsvp|apply|enrol\w*|sign up)\s+(?:before|by|latest by|no later than|on or before)\s*:?\s*(.{4,60})",
    r"\b(?:registration|booking|rsvp|application)\s+deadline\s*(?:is|:|\-|–)?\s*(.{4,60})",
]
#: Languages, and how ages, durations and prices are written on a line of facts.
LANGUAGES = [
    "hindi", "english", "marathi", "gujarati", "bengali", "bangla", "tamil", "telugu", "kannada", "malayalam", "punjabi", "urdu", "hinglish", "sanskrit", "konkani", "odia", "assamese", "multi-language", "multilingual", "french",
    "spanish", "japanese", "korean",
]
AGE = r"(?i)^(?:\d{1,2}\s*(?:yrs?|years?)?\s*\+|\d{1,2}\s*\+\s*(?:yrs?|years?)?|all ages?(?: groups?)?|(?:u|ua|a)\s*\d*\+?|\d{1,2}\s*-\s*\d{1,2}\s*(?:yrs?|years?))$"
SPAN = r"(?i)^\d+\s*(?:hrs?|hours?|h)(?:\s*\d+\s*(?:mins?|minutes?|m))?$|^\d+\s*(?:mins?|minutes?)$"
BOX_PRICE = r"(?i)(?:₹|rs\.?\s|inr\s)\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:-|–|to)\s*(?:₹|rs\.?\s|inr\s)?\s*\d[\d,]*)?(?:\s*(?:onwards|\+))?"


def labelled_facts(lines: DataFrame) -> DataFrame:
    """(page, fact, value): the first value of each label, on its line after a colon or dash or on the next line; lines up to 120 characters, the first 4000 of a page."""
    near = lines.where("pos < 4000").withColumn("next", F.lead("line").over(Window.partitionBy("page").orderBy("pos"))).where(F.length("line") <= 120)
    edge = lambda c: F.regexp_replace(c, r"^[ :\-–|]+|[ :\-–|]+$", "")
    any_label = "(?i)^\\s*(?:" + "|".join(LABELS.values()) + r")\s*(?:[:\-–|].*)?$"
    by = F.regexp_extract("line", NAMED_BY, 1)
    fact, value = F.when((by != "") & ~by.rlike(NO_FACT), "organizer"), F.when((by != "") & ~by.rlike(NO_FACT), edge(by))
    for name, words in LABELS.items():
        rx = rf"(?i)^\s*(?:{words})\s*(?:[:\-–|]\s*(.*))?$"
        here = F.col("line").rlike(rx)
        own = edge(F.regexp_extract("line", rx, 1))
        fact, value = fact.when(here, name), value.when(here, F.when(own != "", own).otherwise(edge(F.coalesce("next", F.lit("")))))
    rows = near.select("page", "pos", fact.alias("fact"), value.alias("value")).where(F.col("fact").isNotNull() & F.length("value").between(2, 80) & ~F.col("value").rlike(NO_FACT) & ~F.col("value").rlike(any_label))
    return rows.groupBy("page", "fact").agg(F.min_by("value", "pos").alias("value"))


def pipe_facts(lines: DataFrame, most: int = 120) -> DataFrame:
    """(page, language, age_limit, duration, categories) of the first line of two to six short texts between bars of which one is a language, an age or a duration, and
    another says more."""
    tokens = F.filter(F.transform(F.split("line", r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    words = lambda t: F.filter(F.transform(F.split(F.lower(t), "[,/&]"), lambda w: F.trim(w)), lambda w: w != "")
    tongue = lambda t: (F.size(words(t)) > 0) & (F.size(F.array_except(words(t), F.array(*map(F.lit, LANGUAGES)))) == 0)
    kind = lambda t: F.when(tongue(t), "language").when(t.rlike(AGE), "age_limit").when(t.rlike(SPAN), "duration").when((F.length(t) <= 40) & ~t.rlike(r"\d{4}|₹|:"), "category")
    told = lines.where((F.col("pos") < most) & F.contains("line", F.lit("|")) & (F.length("line") <= 160) & ~F.contains("line", F.lit("₹")))
    told = told.withColumn("t", F.transform(tokens, lambda t: F.struct(t.alias("t"), kind(t).alias("k")))).where(F.size("t").between(2, 6))
    hits = F.size(F.filter("t", lambda x: x.k.isin("language", "age_limit", "duration")))
    told = told.where((hits >= 1) & ((hits >= 2) | F.exists("t", lambda x: x.k == "category")))
    first = told.groupBy("page").agg(F.min_by("t", "pos").alias("t"))
    last = lambda k: F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("t", lambda x: x.k == k), lambda x: x.t)), -1), F.lit("")).alias(k)
    return first.select("page", last("language"), last("age_limit"), last("duration"), F.transform(F.filter("t", lambda x: x.k == "category"), lambda x: x.t).alias("categories"))


def page_price(lines: DataFrame, most: float = money.MOST) -> DataFrame:
    """(page, price_min, price_max, is_free) of the first line in the first 150 that speaks of a ticket's price, else of free entry; amounts above `most` are none."""
    near = lines.where("pos < 150")
    box = F.regexp_extract("line", BOX_PRICE, 0)
    told = F.col("line").rlike(r"(?i)\b(?:onwards|starting|from|price|tickets?)\b") & (box != "")
    free = F.col("line").rlike(r"(?i)^(?:price\s*:?\s*)?free(?:\s+entry)?$")
    best = near.where(told | free).groupBy("page").agg(F.min_by(F.when(told, box).otherwise("free"), F.struct(~told, "pos")).alias("box"))
    return best.select("page", money.price_of_text(F.col("box"), most=most).alias("p")).select("page", "p.*")


def register_by(lines: DataFrame, ref: dt.date) -> DataFrame:
    """(page, register_by): the first announced deadline with a real date, in the first 500 lines of up to 300 characters."""
    near = lines.where((F.col("pos") < 500) & (F.length("line") <= 300))
    told = F.filter(F.array(*(F.regexp_extract("line", f"(?i){rx}", 1) for rx in DEADLINES)), lambda t: t.rlike(r"\d"))
    rows = near.select("page", "pos", told.alias("told")).where(F.size("told") > 0)
    rows = rows.select("page", "pos", dates.first_dated(F.transform("told", lambda t: F.array(t)), ref)["start"].alias("by")).where("by is not null")
    return rows.groupBy("page").agg(F.min_by("by", "pos").alias("register_by"))


def distinct_event_links(found: DataFrame, event: Callable[[Column], Column], numbers: bool = False) -> DataFrame:
    """(page, url, text, title): the first link to each event address, its title from the text or else from the address (numbers: as title_from_url has it)."""
    rows = once(found.withColumn("url", urls.canonical_url(F.col("url"))), "url").where(event(F.col("url")))
    one = rows.groupBy("page", "url").agg(F.coalesce(F.min_by(F.nullif("text", F.lit("")), F.when(F.col("text") != "", F.col("pos"))), F.lit("")).alias("text"), F.min("pos").alias("pos"))
    return one.withColumn("title", F.when(F.length("text") >= 2, F.col("text")).otherwise(title_from_url(F.col("url"), numbers)))


#: Words in paths that lead to no event, and words that lead to one.
NO_EVENT_PATH = (
    r"(?i)about|contact|career|membership|member|donat|login|log-in|sign|register|privacy|terms|faq|gallery|press|media|news|blog|shop|store|visit|hire|rental|venue|team|policy|support|subscribe|newsletter|"
    r"facebook|instagram|twitter|youtube|linkedin|whatsapp|cart|account|search|archive|past|history"
)
EVENT_PATH = r"(?i)event|programme|program|show|play|performance|concert|whats-on|calendar|festival|exhibition|screening|recital|talk|workshop"


def guessed_event_links(found: DataFrame, most: int = 40) -> DataFrame:
    """(page, url, pos, title): links of the page's own host that look like events where no pattern is known: two path parts or more, a speaking path, a text of 4 to 120 characters; the first
    `most` of a page."""
    rows = once(found.withColumn("url", urls.canonical_url(F.col("url"))), "url").where((F.col("url") != "") & (F.col("url") != urls.canonical_url(F.col("page"))))
    own = urls.host_of(F.col("url")) == urls.host_of(F.col("page"))
    path = F.array_join(urls.path_segments(F.col("url")), "/")
    rows = rows.where(own & (F.size(urls.path_segments(F.col("url"))) >= 2) & F.length("text").between(4, 120) & ~path.rlike(NO_EVENT_PATH) & path.rlike(EVENT_PATH))
    first = rows.groupBy("page", "url").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("title"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).where(F.col("r") <= most).drop("r")


#: Words on a card that are no title, and labels of kinds of events.
BADGES = (
    r"(?i)^(?:book(?:\s+now)?|buy(?:\s+now)?|selling fast|fast filling|filling fast|new|featured|sponsored|promoted|sold out|trending|popular|bestseller|best seller|limited seats|few seats left|exclusive|premiere|view details|know more|interested|going|online|"
    r"\d+% off|offer|save|share|\+\d+ more)$"
)
KINDS = [
    "comedy", "comedy shows", "stand up", "stand-up", "standup", "music", "music shows", "concerts", "concert", "gigs", "workshops", "workshop", "theatre", "theater", "plays", "kids", "food & drinks", "food and drinks", "food", "nightlife",
    "parties", "party", "exhibitions", "exhibition", "art", "arts", "sports", "performances", "spirituality", "talks", "meetups", "screenings", "screening", "adventure", "fitness", "festivals", "festival", "dance", "open mic", "poetry",
    "storytelling", "fests & fairs", "social mixers", "conferences", "awards", "holi", "new year", "garba", "experiences", "tours", "classical", "bollywood", "edm", "techno", "hip hop", "jazz", "rock",
]
DATED = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b|\btoday\b|\btomorrow\b|\btonight\b|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"
PRICED = r"(?i)₹|\brs\.?\s*\d|\binr\b|\bonwards\b|^free$"


def may_title(line: Column) -> Column:
    """Whether a line can be a title: not a badge, a date, a price or a kind."""
    return F.length(line).between(3, 200) & ~line.rlike(BADGES) & ~line.rlike(PRICED) & ~line.rlike(DATED) & ~F.lower(line).isin(*KINDS)


def card_boundaries(links: DataFrame, event: Callable[[Column], Column], *page: str) -> DataFrame:
    """(page, url, link, card) for each link (tree.bounded_links) to an event: the element that is its card. An element holds no other event if it begins after the last link before, and ends before
    the first link behind, that leads elsewhere; the card is the largest of a link's elements that do so, else the link itself."""
    c = F.col
    found = once(links.where("href is not null").withColumn("url", urls.absolute_url(c("page"), c("href"))), "url")
    found = once(found.withColumn("url", urls.canonical_url(c("url"))), "url").where(event(c("url"))).select(*page, "url", "link", "up")
    in_page = Window.partitionBy(*page).orderBy("link")
    found = found.withColumns({"was": F.lag("url").over(in_page), "next": F.lead("url").over(in_page), "was_at": F.lag("link").over(in_page), "next_at": F.lead("link").over(in_page)})
    before = F.last(F.when(c("was") != c("url"), c("was_at")), ignorenulls=True).over(in_page)
    behind = Window.partitionBy(*page).orderBy(c("link").desc())
    after = F.last(F.when(c("next") != c("url"), c("next_at")), ignorenulls=True).over(behind)
    found = found.withColumns({"before": F.coalesce(before, F.lit(-1)), "after": F.coalesce(after, F.lit(1 << 30))})
    alone = F.filter("up", lambda x: (x.n > c("before")) & (x.end < c("after")))
    return found.select(*page, "url", "link", F.coalesce(F.try_element_at(alone, F.lit(-1)).n, "link").alias("card"))


def cards(pages: DataFrame, event: Callable[[Column], Column], page: str = "url", most_lines: int = 12, most_chars: int = 700) -> DataFrame:
    """(page, pos, url, title, date_text, price_text, categories, venue, lines): a card for each link to an address that `event` takes for an event's, in the element that `card_boundaries`
    finds, other links' texts left out; links of one address in one card make one. The title is what the link's own attributes, heading, picture or text say, else a heading or picture of the card, else the
    longest of the first three lines left; date and price are the first lines that read so; lines that name a kind are categories; the first line left over is the venue.

    Pages are read twice, once for the links and once for what their cards hold, and should be a stored table. Only links and cards leave the tasks."""
    c = F.col
    stored = pages.select(c(page).alias("page"), F.xxhash64("html").alias("copy"), "html")
    key = ["page", "copy"]  # an address may be stored with several texts
    found = card_boundaries(page_tree.bounded_links(stored, *key, most_lines=most_lines, most_chars=most_chars), event, *key)
    found = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("link", "url", "card"))).alias("x")).select(*key, "x.link", "x.url", "x.card")
    out = page_tree.held(stored.join(found, key), "page")
    lines = F.transform("lines", page_tree.squeezed)
    out = out.withColumn("lines", F.slice(F.filter(lines, lambda x: x != ""), 1, most_lines))
    out = out.withColumn("lines", F.aggregate("lines", F.array().cast("array<string>"), lambda a, x: F.when(F.length(F.array_join(a, " ")) + F.length(x) <= most_chars, F.concat(a, F.array(x))).otherwise(a)))
    line = lambda rx: F.coalesce(F.get(F.filter("lines", lambda x: x.rlike(rx) & ~x.rlike(BADGES)), F.lit(0)), F.lit(""))
    out = once(once(once(out, "lines").withColumn("date_text", line(DATED)), "date_text").withColumn("price_text", line(PRICED)), "price_text")
    rest = F.filter("lines", lambda x: ~x.rlike(BADGES) & (x != F.col("date_text")) & (x != F.col("price_text")) & ~F.lower(x).isin(*KINDS))
    names = F.transform("told", lambda x: page_tree.squeezed(F.coalesce(x, F.lit(""))))
    longest = F.reduce(F.slice("rest", 1, 3), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    out = once(once(out.withColumn("rest", rest), "rest").withColumn("title", F.coalesce(F.get(F.filter(names, may_title), F.lit(0)), longest)), "title")
    out = once(out.withColumn("title", clean_title(F.col("title"))), "title")
    venue = F.get(F.filter("rest", lambda x: (x != F.col("title")) & F.length(x).between(3, 140)), F.lit(0))
    return out.select("page", "pos", "url", "title", "date_text", "price_text", F.filter("lines", lambda x: F.lower(x).isin(*KINDS)).alias("categories"), F.coalesce(venue, F.lit("")).alias("venue"), "lines").where("title != ''")


def card_events(found: DataFrame, ref: dt.date) -> DataFrame:
    """Event rows of cards(), with page and pos."""
    rows = found.select("page", "pos", "url", "title", "venue", "categories", F.col("price_text").alias("told"), dates.date_range(F.col("date_text"), ref).alias("d"), money.price_of_text(F.col("price_text")).alias("p"))
    priced = F.col("p.price_min").isNotNull()
    return as_events(rows.select("*", "d.start", "d.end", "d.has_time", "p.price_min", "p.price_max", "p.is_free", F.when(priced, F.col("told")).otherwise("").alias("price_text")), "page", "pos")


def microdata(pages: DataFrame, page: str = "url") -> DataFrame:
    """(page, pos, title, start_text, end_text, url, venue, price_text, low_text, high_text, description): items of an Event type that name themselves and a start; the first value of a property counts."""
    parts = F.posexplode(F.filter(F.split("html", r"(?i)(?=<[a-z]+\b[^>]*\bitemtype\s*=\s*[\"'][^\"']*schema\.org/[A-Za-z]*(?:Event|Festival)[\"'])"), lambda x: x.rlike(r"(?i)^<[a-z]+\b[^>]*\bitemtype\s*=\s*[\"'][^\"']*schema\.org/[A-Za-z]*(?:Event|Festival)[\"']"))).alias("pos", "part")
    rows = pages.select(F.col(page).alias("page"), parts)

    def prop(name: str) -> Column:
        tag = rf"(?is)<[a-z0-9]+\b[^>]*\bitemprop\s*=\s*[\"']{name}[\"'][^>]*>"
        value = F.regexp_extract(F.regexp_extract("part", tag, 0), r"(?is)\b(?:content|datetime|href)\s*=\s*[\"']([^\"']*)[\"']", 1)
        return F.when(value != "", clean_text(value)).otherwise(inner_text(F.regexp_extract("part", tag + r"(.*?)</", 1)))

    out = rows.select("page", "pos", prop("name").alias("title"), prop("startDate").alias("start_text"), prop("endDate").alias("end_text"), prop("url").alias("url"), prop("location").alias("venue"), prop("price").alias("price_text"), prop("lowPrice").alias("low_text"), prop("highPrice").alias("high_text"), prop("description").alias("description"))
    return out.where("title != '' and start_text != ''")
