"""Cities in addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.text import let

#: Covered cities (name, key, aliases). The first two aliases name the city, the others lie in it.
CITIES: list[tuple[str, str, list[str]]] = [
    ("Mumbai", "mumbai", ["mumbai", "bombay", "navi mumbai", "thane", "andheri", "bandra", "powai", "worli", "juhu", "colaba", "lower parel", "goregaon", "malad", "borivali", "vashi", "kharghar", "bandra kurla complex", "bkc", "mahalaxmi", "nariman point", "dadar", "chembur"]),
    ("Pune", "pune", ["pune", "pimpri", "chinchwad", "hinjewadi", "kharadi", "koregaon park", "viman nagar", "baner", "wakad", "hadapsar", "kalyani nagar", "shivajinagar"]),
    ("Delhi NCR", "delhi", ["delhi ncr", "new delhi", "delhi", "ncr", "gurgaon", "gurugram", "noida", "greater noida", "faridabad", "ghaziabad", "saket", "connaught place", "aerocity", "vasant kunj", "hauz khas", "pragati maidan", "bharat mandapam"]),
    ("Bengaluru", "bengaluru", ["bengaluru", "bangalore", "whitefield", "koramangala", "indiranagar", "hsr layout", "jayanagar", "electronic city", "yelahanka", "hebbal", "marathahalli"]),
    ("Kolkata", "kolkata", ["kolkata", "calcutta", "howrah", "salt lake", "new town", "rajarhat", "bidhannagar", "park street"]),
    ("Ahmedabad", "ahmedabad", ["ahmedabad", "gandhinagar", "sg highway", "bodakdev", "navrangpura", "sabarmati"]),
    ("Chennai", "chennai", ["chennai", "madras", "nungambakkam", "t nagar", "t. nagar", "adyar", "velachery", "anna nagar", "guindy", "mylapore", "egmore"]),
]
#: Towns that are city names too, and towns outside.
NEAR_TOWNS = ["delhi", "ncr", "gurugram", "gurgaon", "noida", "greater noida", "faridabad", "ghaziabad", "navi mumbai", "thane", "howrah", "gandhinagar", "secunderabad", "hyderabad"]
OTHER_TOWNS = [
    "hyderabad", "secunderabad", "goa", "panaji", "jaipur", "lucknow", "chandigarh", "kochi", "cochin", "thiruvananthapuram", "trivandrum", "coimbatore", "mysuru", "mysore", "mangaluru", "mangalore",
    "nagpur", "nashik", "surat", "vadodara", "baroda", "rajkot", "indore", "bhopal", "bhubaneswar", "guwahati", "patna", "ranchi", "visakhapatnam", "vizag", "vijayawada", "madurai", "dehradun",
    "amritsar", "ludhiana", "udaipur", "jodhpur", "agra", "varanasi", "shillong", "lonavala", "alibaug", "pondicherry", "puducherry", "dubai", "abu dhabi", "singapore", "london", "bangkok",
]
#: Places abroad, and words for events without a place.
ABROAD = (
    r"(?i)\b(?:australia|united kingdom|england|scotland|united states|usa|u\.s\.a|canada|singapore|dubai|abu dhabi|united arab emirates|uae|qatar|doha|saudi arabia|riyadh|malaysia|"
    r"kuala lumpur|thailand|bangkok|nepal|kathmandu|sri lanka|colombo|london|new york|toronto|sydney|melbourne|worcester)\b"
)
ONLINE = r"(?i)\b(?:online|virtual(?! reality)|webinars?|zoom|google meet|livestream|live stream)\b"


def city_rank(name: Column) -> Column:
    out = F.lit(len(CITIES))
    for i, (label, _, _) in reversed(list(enumerate(CITIES))):
        out = F.when(name == label, i).otherwise(out)
    return out


def alternatives(names: list[str]) -> str:
    """A pattern of whole names, longer ones first."""
    return "(?<![a-z])(?:" + "|".join(re.escape(a).replace(r"\ ", " ") for a in sorted(names, key=len, reverse=True)) + ")(?![a-z])"


def last_place(text: Column, names: list[str]) -> Column:
    """Where the last of the names starts in text (0: nowhere): the text in front of it is what a greedy match leaves."""
    found = F.regexp_extract(text, f"(?s)^(.*){alternatives(names)}", 1)
    return F.when(text.rlike(alternatives(names)), F.length(found) + 1).otherwise(0)


def detect_city(*texts: Column) -> Column:
    """The covered city that the texts name, the last mention winning; localities decide only where no city is named. Null: none."""
    blob = F.lower(F.array_join(F.filter(F.array(*(F.coalesce(t, F.lit("")) for t in texts)), lambda t: t != ""), " | "))

    def last_named(b: Column, cut: int | None) -> Column:
        found = F.array(*(F.struct(last_place(b, aliases[:cut]).alias("at"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, _, aliases) in enumerate(CITIES)))
        return let(F.array_max(found), lambda x: F.when(x.at > 0, x["name"]))  # the earlier city on ties

    return let(blob, lambda b: F.coalesce(last_named(b, 2), last_named(b, None)))


def detect_other_town(address: Column) -> Column:
    """The last outside town of an address in which no covered city is named; null otherwise."""
    town = F.regexp_extract(F.lower(F.coalesce(address, F.lit(""))), f"(?s)^.*({alternatives(OTHER_TOWNS)})", 1)
    return F.when(detect_city(address).isNull() & (town != ""), F.initcap(town))


def city_of_name(value: Column) -> Column:
    """A city by its key, name or alias, in that order; null if unknown."""
    v = F.lower(F.trim(value))
    out = F.lit(None).cast("string")
    for pick in (lambda c: c[2], lambda c: [c[0].lower()], lambda c: [c[1]]):
        for c in reversed(CITIES):
            out = F.when(v.isin(*pick(c)), c[0]).otherwise(out)
    return out


def is_city_name(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\d\s-]+$", ""), r"^[ .]+|[ .]+$", "")
    return bare.isin(*{a for _, _, aliases in CITIES for a in aliases[:2]} | {*NEAR_TOWNS})


def locality(address: Column, venue: Column) -> Column:
    """The last part of an address that is neither a city nor the venue; '' if there is none."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~is_city_name(p) & (F.lower(p) != F.lower(venue)) & ~p.rlike(r"(?i)^(?:india|\d{6}|maharashtra|karnataka|gujarat|tamil nadu|west bengal|haryana|uttar pradesh)$"))
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))


def is_online(online: Column, venue: Column, title: Column) -> Column:
    v = F.trim(F.coalesce(venue, F.lit("")))
    return (online & ((v == "") | v.rlike(ONLINE))) | v.rlike(r"(?i)^(?:online|virtual)(?: event)?$") | F.coalesce(title, F.lit("")).rlike(ONLINE)


def is_abroad(venue: Column, address: Column, title: Column) -> Column:
    return F.concat_ws(" ", venue, address).rlike(ABROAD) | F.coalesce(title, F.lit("")).rlike(r"\bin [A-Z][a-z]+, [A-Z]{2}\b")


def is_placeholder_title(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    upper = (t == F.upper(t)) & t.rlike("[A-Z]")
    return ((F.length(t) <= 4) & ~upper) | F.lower(t).isin("post", "test", "event", "events", "other org", "tbd", "tba", "untitled") | t.rlike(r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2}$")
