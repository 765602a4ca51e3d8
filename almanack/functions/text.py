"""Text functions: a Column in, a Column out. Missing text is the empty string, as everywhere at the listing boundary."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a title that do not tell events apart.
TITLE_STOP_WORDS = [
    "live", "tour", "india", "show", "shows", "concert", "the", "a", "an", "ft", "feat", "featuring", "presents", "present", "presented", "by", "and", "with", "in", "at", "of", "x", "edition",
    "season", "official", "tickets", "ticket", "event", "on", "for", "to", "mumbai", "pune", "delhi", "new", "ncr", "gurugram", "gurgaon", "noida", "bengaluru", "bangalore", "kolkata", "ahmedabad",
    "chennai", "night", "nights", "experience",
]
#: Platform names that end a page title, and how a title is led in and out.
TITLE_SUFFIX = (
    r"(?i)\s*(?:[|\-–—:]\s*)?(?:buy\s+)?(?:event\s+)?tickets?(?:\s+online)?(?:\s+(?:at|on)\s+[\w .]+)?$|"
    r"\s*[|\-–—]\s*(?:bookmyshow|district(?: by zomato)?|zomato district|allevents(?:\.in)?|eventbrite|meetup|fever|skillbox(?:es)?|sortmyscene|insider|explara)\b.*$"
)
TITLE_PREFIX = r"(?i)^(?:book|buy)\s+tickets?\s+(?:for|to)\s+"
#: Abbreviations that do not end a sentence, openings and filler of descriptions.
ABBREVIATIONS = ("vs", "Vs", "ft", "Ft", "feat", "Dr", "Mr", "Mrs", "Ms", "St", "No")
INTRO = r"(?i)^(?:about(?: the)?(?: event| show)?|event (?:details|description)|description|overview)\s*[:\-–]\s*"
FILLER = r"(?i)^(?:(?:join|attend)\b.*\bon \w+ \d{1,2}, \d{4}|looking for things to do\b|book (?:online )?tickets? for\b|get your (?:\w+ )?tickets\b|.*\bis hosting this\b|don'?t miss\b.*\bon \w+ \d{1,2}, \d{4})"
SENTENCE_END = "".join(rf"(?<!\b{x}\.)" for x in ABBREVIATIONS) + r"(?<=[.!?])\s+(?=[A-Z0-9\"'“(])"
ILLEGAL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: what is read often inside an expression would else be copied at each place."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def once(rows: DataFrame, name: str) -> DataFrame:
    """rows, with a column that is made once for each: a condition on it is not turned into one on what it is made of, which would be worked out again at each place that names it."""
    return rows.withColumn(name, F.explode(F.array(name)))


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squash(c: Column) -> Column:
    """White space (Unicode) runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def xml_safe(c: Column) -> Column:
    return F.regexp_replace(c, ILLEGAL, "")


def clean_text(c: Column, entities: bool = False) -> Column:
    """One line of readable text. entities: resolve HTML entities by the full table (an Arrow UDF); else only the five of XML, in the JVM."""
    c = text_of(c)
    if entities:
        c = F.when(F.contains(c, F.lit("&")), _unescaped(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)  # the others reach Python as nulls
    else:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(char))
    return squash(F.translate(xml_safe(c), "\u00a0\u200b", " "))


def strip_html(c: Column) -> Column:
    c = text_of(c)
    marked = F.contains(c, F.lit("<")) & F.contains(c, F.lit(">"))
    return clean_text(F.when(marked, F.regexp_replace(c, r"(?s)<[^>]*>", " ")).otherwise(c), entities=True)


@F.pandas_udf(T.StringType())
def _plain(s: pd.Series) -> pd.Series:
    odd = {"So", "Sk", "Co", "Cs", "Cf"}
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKC", x) if unicodedata.category(ch) not in odd and not 0xFE00 <= ord(ch) <= 0xFE0F))


def plain_text(c: Column) -> Column:
    """Words alone: compatibility letters folded (an Arrow UDF, as Spark has no NFKC), markup and symbols gone, no space before punctuation."""
    c = F.regexp_replace(clean_text(c, entities=True), r"<[^>]+>|\*\*|__|#{1,6}(?=\s)|\\(?=[|*_#\[\]])|`", " ")
    return F.regexp_replace(squash(_plain(c)), r"\s+([.,!?;:])", "$1")


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, SENTENCE_END), lambda s: F.trim(s) != "")


def shortened(c: Column, most: int) -> Column:
    """At most `most` characters, cut at a word, with an ellipsis."""
    cut = F.substring(c, 1, most - 1)
    word = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.when(F.contains(cut, F.lit(" ")), word).otherwise(cut), r"[,;:\-– ]+$", ""), F.lit("…")))


def one_line(c: Column, most: int = 140, plain: bool = True) -> Column:
    """The first sentence that says something; a very short one takes the next along."""
    s = F.filter(sentences(F.regexp_replace(plain_text(c) if plain else clean_text(c), INTRO, "")), lambda x: ~F.trim(x).rlike(FILLER))
    first, second = F.trim(F.get(s, F.lit(0))), F.trim(F.get(s, F.lit(1)))
    both = (F.length(first) < 20) & (F.size(s) > 1) & (F.length(first) + 1 + F.length(second) <= most)
    return F.coalesce(shortened(F.when(both, F.concat_ws(" ", first, second)).otherwise(first), most), F.lit(""))


def first_sentences(c: Column, most: int = 200) -> Column:
    """Whole sentences up to `most` characters."""
    c = clean_text(c)
    grown = F.aggregate(sentences(c), F.struct(F.lit("").alias("t"), F.lit(False).alias("done")), lambda a, s: F.struct(
        F.when(a.done | (F.length(F.trim(F.concat_ws(" ", a.t, s))) > most), a.t).otherwise(F.trim(F.concat_ws(" ", a.t, s))).alias("t"),
        (a.done | (F.length(F.trim(F.concat_ws(" ", a.t, s))) > most)).alias("done")), lambda a: a.t)
    return F.when(F.length(c) <= most, c).when(grown != "", grown).otherwise(shortened(c, most))


def clean_title(c: Column) -> Column:
    c = clean_text(c, entities=True)
    for _ in range(2):
        c = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, TITLE_SUFFIX, "")), TITLE_PREFIX, ""))
    return F.regexp_replace(c, "^[ \"'“”|\\-–—]+|[ \"'“”|\\-–—]+$", "")


def title_tokens(c: Column) -> Column:
    """The distinct ASCII words of a title that tell events apart; years are left out."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(clean_text(c)), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(words, lambda w: ~w.isin(*TITLE_STOP_WORDS) & ~w.rlike(r"^20\d\d$"))


def tokens_match(a: Column, b: Column) -> Column:
    """All of the smaller set of two words or more is shared, or three fifths of the union; never for empty sets."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return (least > 0) & (((least >= 2) & (both == least)) | (both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) >= 0.6))


def sets_match(a: Column, b: Column) -> Column:
    """tokens_match of words that no side repeats: how many must be shared follows from the two sizes, so the sets meet once."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    need = F.ceil((small + large) * 3 / 8)
    return (small > 0) & (small >= F.when(small >= 2, F.least(small, need)).otherwise(need)) & (F.size(F.array_intersect(a, b)) >= F.when(small >= 2, F.least(small, need)).otherwise(need))


def titles_match(a: Column, b: Column) -> Column:
    return tokens_match(title_tokens(a), title_tokens(b))


def match_key(title: Column, city: Column, start: Column) -> Column:
    return F.concat_ws("|", F.array_join(F.array_sort(title_tokens(title)), " "), F.lower(text_of(city)), F.coalesce(F.date_format(start, "yyyy-MM-dd"), F.lit("")))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_from_url(url: Column, numbers: bool = False) -> Column:
    """The last path part that is no id, without ticket endings and long numbers, as words with capitals. numbers: a long number stays where the path ends with an id of its own."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike(r"(?i)^(?:ET)?\d+$"))
    last = F.coalesce(F.get(F.reverse(parts), F.lit(0)), F.lit(""))
    slug = F.regexp_replace(last, r"-buy-tickets$|-tickets-\d+$|-\d{6,}$", "")
    if numbers:
        slug = F.when(path.rlike(r"(?i)/(?:ET)?\d+/*$"), F.regexp_replace(last, r"-buy-tickets$|-tickets-\d+$", "")).otherwise(slug)
    return clean_title(F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))


def norm_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), "[^a-z]", "")


def tag_words(c: Column) -> Column:
    c = F.trim(c)
    return F.when(c.rlike(r"(?i)^(?:age-bucket|outdoor-events|indoor-events|physical$|all$)"), "").otherwise(F.translate(c, "-_", "  "))


def languages(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(text_of(c), r"[|,/]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), ", ")
