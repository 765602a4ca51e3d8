"""Fill-in-the-middle transformation by overlapping chunks.

A text is cut into units wherever two adjacent characters meet a predicate: one class before the boundary, one after it. Whether a place is a boundary thus depends on
two characters alone, so a text may be looked at in chunks that overlap by one character: each chunk counts its own boundaries, independently of all others, a
running sum over the counts says which chunk owns the boundary of a given rank, and only the one or two owning chunks are scanned again for the place itself. Chunks are
elements of an array inside the row, cut by one linear pass; nothing is shuffled, and no Python runs.

Cases: a null text counts as an empty one; empty texts and texts that hold a marker stay plain; a text of any length is one row with as many chunks as it takes; repeated
rows are each transformed, equal rows alike; an empty table gives no rows; a null id hashes as an empty string; other columns are carried along, and columns of
clashing names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import fresh

#: Code points of a chunk, without the one that it shares with the next.
CHUNK = 1 << 16
#: The markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Units:
    """Two character classes: a unit ends between a character of `before` and one of `after`, and at the end of the text."""

    before: str
    after: str

    @property
    def boundary(self) -> str:
        return f"(?s)(?<={self.before})(?={self.after})"


#: A line with its line feed, a word with the white space after it, a character.
LINES = Units(r"\n", ".")
WORDS = Units(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")
CHARACTERS = Units(".", ".")


def chunks(text: Column, size: int = CHUNK) -> Column:
    """The text in chunks of `size` code points, each with the first one of the next chunk at its end."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size + 1}}})).{{1,{size}}}"), 1)


def counted(parts: Column, units: Units = LINES) -> Column:
    """Boundaries of each chunk (the end of the text is none)."""
    return F.transform(parts, lambda c: F.regexp_count(c, F.lit(units.boundary)))


def owner(counts: Column, rank: Column) -> Column:
    """(chunk, left): the chunk, from 1, that owns the boundary of this rank, and the rank inside it; chunk 0 if no chunk does."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("chunk"), rank.cast("int").alias("left"))
    found = F.aggregate(
        counts,
        start,
        lambda s, n: F.struct(
            (s["at"] + 1).alias("at"),
            F.when((s["chunk"] == 0) & (s["left"] <= n), s["at"] + 1).otherwise(s["chunk"]).alias("chunk"),
            F.when((s["chunk"] == 0) & (s["left"] > n), s["left"] - n).otherwise(s["left"]).alias("left"),
        ),
    )
    return F.struct(found["chunk"].alias("chunk"), found["left"].alias("left"))


def place(text: Column, parts: Column, owned: Column, rank: Column, n: Column, units: Units, size: int) -> Column:
    """Code points before the boundary of this rank: 0 for rank 0, the whole text for rank n; else the owning chunk is scanned again."""
    head = F.slice(F.split(F.element_at(parts, owned["chunk"]), units.boundary, owned["left"] + 1), 1, owned["left"])
    inside = (owned["chunk"] - 1).cast("bigint") * size + F.length(F.array_join(head, ""))
    return F.when(rank == 0, F.lit(0)).when(rank == n, F.length(text)).otherwise(inside).cast("bigint")


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the sha256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(count)]


def infilled(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, units: Units = LINES, size: int = CHUNK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output, the text in that form. rate of 100 texts are transformed, spm of 100
    of those suffix first; the seed and the key alone decide."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    t, parts, counts, draw, low, high, low_at, high_at, at, to = fresh(docs, "whole", "parts", "counts", "draw", "low", "high", "low_at", "high_at", "at", "to")
    out = docs.drop(*names).withColumns({t: F.coalesce(F.col(text), F.lit("")), draw: F.array(*draws(F.col(key), seed))})
    out = out.withColumn(parts, chunks(F.col(t), size)).withColumn(counts, counted(F.col(parts), units))
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x) + F.when(F.col(t) != "", 1).otherwise(0)
    out = out.withColumn("n", total.cast("bigint"))
    first, second = (F.col(draw)[i] % (F.col("n") + 1) for i in (0, 1))
    marked = F.lit(False)
    for m in MARKERS:
        marked |= F.contains(t, F.lit(m))
    plain = (F.col(t) == "") | marked | (F.col(draw)[2] % 100 >= rate)
    out = out.withColumns({"form": F.when(plain, "plain").when(F.col(draw)[3] % 100 < spm, "spm").otherwise("psm"), low: F.least(first, second), high: F.greatest(first, second)})
    out = out.withColumns({low_at: owner(F.col(counts), F.col(low)), high_at: owner(F.col(counts), F.col(high))})
    out = out.withColumns({x: place(F.col(t), F.col(parts), F.col(owned), F.col(rank), F.col("n"), units, size) for x, owned, rank in ((at, low_at, low), (to, high_at, high))})
    a, b = F.col(at).cast("int"), F.col(to).cast("int")
    prefix, middle, suffix = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t))
    p, s, m = (F.lit(x) for x in MARKERS)
    shown = F.when(F.col("form") == "plain", F.col(t)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    chars = {"prefix_chars": F.col(at), "middle_chars": F.col(to) - F.col(at)}
    out = out.withColumns({k: F.when(F.col("form") != "plain", v) for k, v in chars.items()} | {"output": shown})
    return out.select(*(c for c in docs.columns if c not in names), *names)


def restored(form: Column, output: Column) -> Column:
    """The text that a form was made of. A transformed text holds each marker once, as texts that hold one stay plain."""
    p, s, m = MARKERS
    rest, begun, last = F.substring(output, F.lit(1 + len(p)), F.length(output)), F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(rest, s, 1), last, F.substring_index(begun, s, -1))
    spm = F.concat(F.substring_index(begun, p, -1), last, F.substring_index(rest, p, 1))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
