"""Window semantics, drop reasons, date settling, notes: what turns merged events into calendar rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions import classify, dates, places, text

LONG_RUNNING = r"(?i)\b(?:exhibitions?|exhibit|museum|gallery|installation|retrospective|art show|immersive|experience centre|showcase)\b"
#: Venue texts that are none, section names that say no more than the activity, and a phrase for each activity.
JUNK_VENUE = r"(?i)^(?:sales end soon|sales ended|sold out|almost full|going fast|selling fast|few tickets left|free|book now|register|tickets?|.*\bonwards\b|₹.*|\$.*|tba|tbd|to be announced)$"
GENERIC = [
    "events", "event", "experiences", "shows", "show", "entertainment", "activities", "comedy shows", "comedy", "music shows", "music", "concerts", "plays", "theatre", "theater", "sports",
    "food & drinks", "food and drinks", "food", "workshops", "workshop", "talks", "exhibitions", "exhibition", "performances", "kids", "nightlife", "art", "arts", "culture", "festivals",
    "spirituality", "meetups", "screenings", "adventure", "fitness", "parties", "party", "other", "f&b",
]
PHRASES = {
    "Comedy": "comedy show", "Music": "live music", "Theatre": "theatre play", "F&B": "food and drinks event", "Art": "art event", "Culture": "cultural event", "Sports to Watch": "sports match",
    "Recreational Sports": "sports activity", "Workshops": "workshop",
}


def prefilter(first: dt.date, last: dt.date) -> Column:
    """What may still fall in the window before details are read: undated rows and past rows without an end pass."""
    return F.coalesce(~(F.to_date("start") > F.lit(last)), F.lit(True)) & F.coalesce(~(F.to_date("end") < F.lit(first)), F.lit(True))


def in_window(first: dt.date, last: dt.date) -> Column:
    day, end = F.to_date("start"), F.to_date(F.coalesce("end", "start"))
    session = F.exists("session_dates", lambda d: d.between(F.lit(first), F.lit(last)))
    return F.coalesce(((day <= F.lit(last)) & (end >= F.lit(first))) | (day.isNotNull() & session), F.lit(False))


def settled(events: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """events with start, end and end_known settled, and `stays`: nights over midnight are one day, series start in the window, long spans keep an end only if an exhibition's own page gives it."""
    end = F.when(F.col("end") < F.col("start"), None).otherwise(F.col("end"))
    night = (F.to_date(end) > F.to_date("start")) & (end - F.col("start") < F.expr("interval 24 hours")) & (F.hour(end) * 3600 + F.minute(end) * 60 + F.second(end) <= 6 * 3600)
    end = F.when(F.coalesce(night, F.lit(False)), None).otherwise(end)
    inside = F.array_sort(F.array_distinct(F.filter("session_dates", lambda d: d.between(F.lit(first), F.lit(last)))))
    early = F.to_date("start") < F.lit(first)
    session = F.get(inside, F.lit(0))
    clock = F.col("start") - F.date_trunc("day", "start").cast("timestamp_ntz")
    moved = F.when(early & session.isNotNull(), session.cast("timestamp_ntz") + F.when(F.col("has_time"), clock).otherwise(F.expr("interval 0 seconds"))).otherwise(F.col("start"))
    rows = events.withColumns({"__end": end, "__start": moved})
    long = F.coalesce(F.datediff(F.to_date("__end"), F.to_date("__start")) > 31, F.lit(False))
    shown = F.col("detail_fetched") & F.concat_ws(" ", "title", F.array_join("categories", " ")).rlike(LONG_RUNNING)
    lost = long & ~shown & (F.to_date("__start") < F.lit(first))
    dated = F.col("start").isNotNull()
    return rows.withColumns({
        "stays": F.coalesce(~(dated & lost), F.lit(True)),
        "end_known": F.when(dated, ~long | shown).otherwise(F.col("end_known")),
        "end": F.when(~dated, F.col("end")).when(~long | shown, F.col("__end")),
        "start": F.col("__start"),
    }).drop("__end", "__start")


def drop_reason(first: dt.date, last: dt.date, cities: list[str] | None = None, include_online: bool = False, include_undated: bool = False, flags: tuple[str, ...] = ("nowhere", "away")) -> Column:
    """Why a row is left out, the first reason that holds; null if it stays. Rows carry `stays` of settled() and those of the flags: nowhere (no covered city is named) and away (the
    address names another town)."""
    reasons = [
        ("city not one of ours", F.col("nowhere") if "nowhere" in flags else F.lit(False)),
        ("other city", (F.col("away") if "away" in flags else F.lit(False)) | (F.lit(False) if cities is None else ~F.col("city").isin(cities))),
        ("online", F.lit(not include_online) & places.is_online(F.col("online"), F.col("venue"), F.col("title"))),
        ("abroad", places.is_abroad(F.col("venue"), F.col("address"), F.col("title"))),
        ("placeholder title", places.is_placeholder_title(F.col("title"))),
        ("no date", F.lit(not include_undated) & F.col("start").isNull()),
        ("long series", ~F.col("stays")),
        ("outside the window", F.col("start").isNotNull() & ~in_window(first, last)),
    ]
    out = F.lit(None).cast("string")
    for name, bad in reversed(reasons):
        out = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(out)
    return out


def notes() -> Column:
    """One line on what an event is: its first sentence, or what kind in which language with whom; its status leads."""
    line = F.nullif(text.one_line(F.col("description"), plain=False), F.lit(""))
    kinds = F.slice(F.filter(F.transform("categories", text.tag_words), lambda w: (w != "") & ~F.lower(w).isin(*GENERIC)), 1, 2)
    phrase = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in PHRASES.items() for x in p)), F.col("activity_type")), F.lit(""))
    kind = F.when(F.size(kinds) > 0, F.array_join(kinds, ", ")).otherwise(phrase)
    language = text.languages(F.col("language"))
    made = F.when(language == "", kind).when(kind == "", language).otherwise(F.concat_ws(" in ", kind, language))
    who = F.array_join(F.slice(F.filter("performers", lambda p: (p != "") & ~F.contains(F.lower("title"), F.lower(p))), 1, 2), " and ")
    made = F.when(who == "", made).when(made == "", F.concat(F.lit("Featuring "), who)).otherwise(F.concat_ws(" featuring ", made, who))
    made = F.when(made != "", F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, 2, 1 << 20), F.lit("."))).otherwise("")
    out = F.coalesce(line, made)
    return F.when(F.col("status") != "", F.trim(F.concat(F.upper("status"), F.lit(". "), out))).otherwise(out)


def finished(events: DataFrame, first: dt.date, basis: str = "min") -> DataFrame:
    """Kept events with their derived columns: venue without junk, activity, tier, register-by, organiser, notes."""
    out = events.withColumn("venue", F.when(F.trim("venue").rlike(JUNK_VENUE), "").otherwise(F.col("venue")))
    out = out.withColumns({
        "activity_type": classify.activity(F.col("categories"), F.col("title"), F.col("description"), F.col("venue")),
        "tier": classify.tier(F.col("price_min"), F.col("price_max"), F.col("is_free"), basis),
        "organizer": F.when(F.col("organizer") != "", F.col("organizer")).when(F.size("platforms") > 0, F.concat(F.lit("Source: "), F.array_join("platforms", " / "))).otherwise(""),
        "__by": dates.settled_register_by(F.col("start"), F.col("end"), F.col("end_known"), F.col("register_by"), first),
    })
    out = out.withColumns({"register_by": F.col("__by.register_by"), "register_by_inferred": F.col("__by.inferred")}).drop("__by")
    return out.withColumn("notes", notes())
