"""Substring dedup by level-wise doubling over word windows.

Windows that repeat at one length alone are extended to (at most) twice that length, until the wanted length is reached: 9, 18, 35 words
by default. Below the wanted length only anchors are counted: of the short windows inside each long one, the one with the least hash
stands for it. Equal long windows have equal contents and so equal anchors, hence a long window can repeat only if its anchor does; nothing
is lost and about 7 of 100 short windows are shuffled. At the wanted length every surviving window is counted by 128 bits of its words.

Equal texts are handled once: if a text of at least `window` words occurs twice, each of its words is covered, whatever the number of copies.

Cases: null and empty texts, and texts shorter than the window, lose nothing; repeated rows are copies of each other; a window that repeats
inside one text, overlapping itself or not, counts; an empty table gives no rows; a null doc_id is carried along, as doc_id is not used as a
key; only doc_id and text are read, so clashing extra columns do no harm. A text is handled whole, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import NOT_SPACE, SEEN, Texts, fresh, once, semi, steps, text_key, window_hashes, written


def lengths(window: int, least: int = 8) -> list[int]:
    """window, and before it the half lengths (rounded up) that are at least `least`, shortest first."""
    out = [window]
    while -(-out[0] // 2) >= least:
        out.insert(0, -(-out[0] // 2))
    return out


def sliding_least(key: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` consecutive values."""
    if len(key) < span:
        return key[:0]
    out, have = key, 1
    while have * 2 <= span:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    more = span - have
    return np.minimum(out[:-more], out[more:]) if more else out


def anchors(t: Texts, words: np.ndarray, short: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one text; the start of the short window that stands for each; hashes of all short windows."""
    h = window_hashes(words, short)
    at = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << max(24, int(len(h)).bit_length())) - 1)
    least = sliding_least((h & ~low) | at, window - short + 1)  # ties go to the first
    start = np.arange(len(words) - window + 1) if len(words) >= window else np.zeros(0, dtype=np.int64)
    text = np.searchsorted(t.first, start, side="right") - 1
    whole = start + window <= t.first[text + 1]
    return start[whole], (least[whole] & low).astype(np.int64), h


def _lists(values: list[np.ndarray], counts: list[int], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, kind))


def _digest(docs: DataFrame, short: int, window: int) -> DataFrame:
    """doc_id, k1, k2, n_words, sha256 of all words, and the anchors (place, hash) of a text's first row in its task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (1, 2))
            for lo, hi, t in steps(batch.column(3), NOT_SPACE, False):
                words = t.word_hashes()
                start, stands, h = anchors(t, words, short, window)
                chosen = np.unique(stands)
                cut = np.searchsorted(chosen, t.first)
                place, hashes, counts, sha = [], [], [], []
                for i in range(hi - lo):
                    raw = t.buf[t.offs[i] : t.offs[i + 1]].tobytes()
                    sha.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                    key = (int(k1[lo + i]), int(k2[lo + i]))
                    if key in seen:
                        counts.append(0)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    own = chosen[cut[i] : cut[i + 1]]
                    place.append(own - t.first[i])
                    hashes.append(h[own].view(np.int64))
                    counts.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(np.diff(t.first), pa.int64()), pa.array(sha), _lists(place, counts, pa.int32()), _lists(hashes, counts, pa.int64())],
                    names=["doc_id", "k1", "k2", "n_words", "sha", "place", "hash"],
                )

    return docs.select("doc_id", *text_key(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, n_words bigint, sha string, place array<int>, hash array<bigint>")


def _repeated(rows: DataFrame, hashes: list[str]) -> DataFrame:
    """k1, k2 and the places of the windows whose hash occurs twice. Counts are summed before the shuffle; the hashes are written and come back by a
    shuffle whose hot partitions Spark may split, since nothing but the join reads it."""
    twice = written(rows.groupBy(*hashes).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*hashes), "substring-twice")
    return rows.join(twice, hashes, "left_semi").groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))


def _next(texts: DataFrame, short: int, longer: int, window: int, last: bool) -> DataFrame:
    """(k1, k2, place, h1, h2) of the windows of `longer` words that a repeated short anchor leaves possible; anchors of them unless last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, hi, t in steps(batch.column(2), NOT_SPACE, False):
                words = t.word_hashes()
                start, stands, _ = anchors(t, words, short, window)
                ok = np.zeros(len(words) + 1, dtype=bool)
                places = batch.column(3).slice(lo, hi - lo)
                here = np.repeat(t.first[:-1], places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                ok[here + places.flatten().to_numpy()] = True
                for i in range(hi - lo):  # one row stands for all copies of a text
                    key = (int(k1[lo + i]), int(k2[lo + i]))
                    if key in seen:
                        ok[t.first[i] : t.first[i + 1]] = False
                    else:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                keep = ok[stands]
                if last:
                    out = start[keep]
                else:
                    start2, stands2, _ = anchors(t, words, longer, window)
                    out = np.unique(stands2[keep])
                text = np.searchsorted(t.first, out, side="right") - 1
                h1, h2 = window_hashes(words, longer), window_hashes(words, longer, salt=0x5851F42D4C957F2D) if last else None
                cols = [k1[lo + text], k2[lo + text], (out - t.first[text]).astype(np.int32), h1[out].view(np.int64), (h2 if last else h1)[out].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["k1", "k2", "place", "h1", "h2"])

    return texts.select("k1", "k2", "text", "places").mapInArrow(run, "k1 bigint, k2 bigint, place int, h1 bigint, h2 bigint")


def repeated_windows(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The digest of all rows (doc_id, k1, k2, n_words, sha); the keys of texts that occur twice and are long enough; the texts (k1, k2,
    text) that have a repeated anchor; and of those k1, k2 and the places of all windows that repeat."""
    level = lengths(window)
    base = written(_digest(docs, level[0], window), "substring-digest")
    copies = written(base.where(F.col("n_words") >= window).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"), "substring-copies")
    rows = base.select("k1", "k2", F.explode(F.arrays_zip("place", "hash")).alias("a")).select("k1", "k2", "a.place", F.col("a.hash").alias("h1"))
    live = written(_repeated(rows, ["h1"]), "substring-level")
    texts = written(once(semi(docs.select(*text_key(), "text"), live.select("k1", "k2"), ["k1", "k2"])), "substring-texts")
    for short, longer in zip(level, level[1:], strict=False):
        last = longer == window
        found = _next(texts.join(live, ["k1", "k2"]), short, longer, window, last)
        live = written(_repeated(found, ["h1", "h2"] if last else ["h1"]), "substring-level")
    return base.drop("place", "hash"), copies, texts, live


def _cut(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """k1, k2, n_removed, kept_sha256 and, with_text, the text without the covered words (of texts whose windows repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, sha, texts = [], [], []
            for text, places in zip(batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                kept = np.ones(len(words), dtype=bool)
                mark = np.zeros(len(words) + 1, dtype=np.int32)
                places = np.asarray(places.values.to_numpy(), dtype=np.int64)
                np.add.at(mark, places, 1)
                np.add.at(mark, places + window, -1)
                kept = np.cumsum(mark[:-1]) == 0
                rest = b" ".join(w for w, k in zip(words, kept, strict=True) if k)
                gone.append(len(words) - int(kept.sum()))
                sha.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest.decode("utf-8", "surrogatepass") if with_text else None)
            cols = [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "n_removed", "kept_sha256", "kept"])

    return texts.select("k1", "k2", "text", "places").mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, kept_sha256 string, kept string")


def removals(docs: DataFrame, window: int = 35) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    base, copies, texts, live = repeated_windows(docs, window)
    parts = written(_cut(texts.join(live, ["k1", "k2"]).join(copies, ["k1", "k2"], "left_anti"), window, False).select("k1", "k2", "n_removed", "kept_sha256"), "substring-cut")
    none = hashlib.sha256(b"").hexdigest()
    whole = copies.select("k1", "k2", F.lit(None).cast("bigint").alias("n_removed"), F.lit(none).alias("kept_sha256"))
    changed = parts.unionByName(whole).withColumn("hit", F.lit(True))
    return base.join(changed, ["k1", "k2"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("hit"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs with the covered words gone from text: a text that loses words becomes its kept words joined by one space, '' if none is left;
    a text that loses none stays as it is. n_chars, where docs has it, follows the new text. All rows stay."""
    _, copies, texts, live = repeated_windows(docs, window)
    parts = _cut(texts.join(live, ["k1", "k2"]).join(copies, ["k1", "k2"], "left_anti"), window, True).select("k1", "k2", "kept")
    changed = written(parts.unionByName(copies.select("k1", "k2", F.lit("").alias("kept"))), "substring-kept")
    few = changed.agg(F.coalesce(F.sum(F.octet_length("kept") + 64), F.lit(0))).first()[0] <= 8 << 20
    a, b, kept = fresh(docs, "k1", "k2", "kept")
    out = docs.withColumns(dict(zip((a, b), text_key(), strict=True)))
    keyed = changed.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("kept").alias(kept))
    out = out.join(F.broadcast(keyed) if few else keyed, [a, b], "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.char_length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
