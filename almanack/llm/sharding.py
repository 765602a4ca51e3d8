"""Sharding by histogram sort.

Rows are ordered by a 128-bit key: 64 bits of the text, then 64 bits of the document, so equal texts lie side by side. Splitters for near equal
bytes are found by rounds of exact counts: each round counts the bytes and rows below a few probes in every open interval, over all
partitions, and closes in until a probe is within tolerance of its target or nothing lies between. Probes stay on text boundaries, so groups of
equal texts stay whole, until the interval is one text; only a text whose copies hold more than `group_share` of a shard is cut, by document. Rows
are then exchanged once, by fine ranges (several to a shard), and numbered inside each with the offset that the last counts give.

Law `bytes`: sizes (UTF-8 bytes plus 8; null: 8) near equal; grown_shard is null.

Cases: null texts count as 8 bytes and sort as one text; repeated rows tie on the whole key and are told apart only inside their fine range, but for rows of
one document that hold more than `group_share` of a shard, which are counted and dealt again as numbered copies; an empty
table gives no rows; a null doc_id is a document of its own hash; texts of any length are one row; other columns are carried along, and columns of clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.common import fresh, written

_TOP = 1 << 64


def _signed(x: int) -> int:
    return x - (1 << 63)


def _slots(high: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the ascending keys (high, low) are not above each (a, b)."""
    at, end = np.searchsorted(high, a, side="left"), np.searchsorted(high, a, side="right")
    same = np.flatnonzero(at < end)  # the row's text is a key's: the low part decides
    begin = at[same]
    for s in np.unique(begin):
        rows = same[begin == s]
        at[rows] += np.searchsorted(low[s : end[rows[0]]], b[rows], side="right")
    return at


def _counts(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """(bytes, rows) whose key lies below each probe (128-bit, ascending). One row a probe and task is summed in Spark."""
    high = np.array([_signed(p >> 64) for p in probes], dtype=np.int64)
    low = np.array([_signed(p & (_TOP - 1)) for p in probes], dtype=np.int64)
    sent = keys.sparkSession.sparkContext.broadcast((high, low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = sent.value
        total = np.zeros((2, len(high) + 1), dtype=np.int64)
        for batch in batches:
            a, b, size = (batch.column(i).to_numpy() for i in range(3))
            at = _slots(high, low, a, b)
            total[0] += np.bincount(at, weights=size, minlength=len(high) + 1).astype(np.int64)
            total[1] += np.bincount(at, minlength=len(high) + 1)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0][some]), pa.array(total[1][some])], names=["slot", "bytes", "rows"])

    parts = keys.select("a", "b", "size").mapInArrow(run, "slot int, bytes bigint, rows bigint").groupBy("slot").agg(F.sum("bytes"), F.sum("rows")).collect()
    own = np.zeros((2, len(probes) + 1), dtype=np.int64)
    for slot, size, rows in parts:
        own[:, slot] = size, rows
    return [(int(x), int(y)) for x, y in np.cumsum(own, axis=1)[:, : len(probes)].T]


def splitters(keys: DataFrame, parts: int, tolerance: float = 0.001, group_share: float = 0.1, fan: int = 16, group: int = 1) -> tuple[list[int], list[tuple[int, int]], tuple[int, int]]:
    """parts - 1 keys that cut the rows into near equal bytes, the bytes and rows below each, and those of all rows. tolerance and group_share are
    shares of `group` parts together (a shard of `group` fine ranges)."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ideal = total[0] / parts
    near, most = tolerance * ideal * group, group_share * ideal * group
    wanted = [ideal * (k + 1) for k in range(parts - 1)]
    lo, hi = [(0, (0, 0))] * (parts - 1), [(_TOP * _TOP, (total[0], total[1]))] * (parts - 1)
    done: dict[int, tuple[int, tuple[int, int]]] = {}

    def closer(k: int) -> tuple[int, tuple[int, int]]:
        return min(lo[k], hi[k], key=lambda x: abs(x[1][0] - wanted[k]))

    while len(done) < parts - 1:
        asked: dict[int, list[int]] = {}
        for k in range(parts - 1):
            if k in done:
                continue
            (a, (below, rows)), (b, (above, more)) = lo[k], hi[k]
            best = closer(k)
            one_text = b - a <= _TOP
            whole_text = b - a == _TOP and a % _TOP == 0
            if abs(best[1][0] - wanted[k]) <= near or more - rows <= 1 or b - a <= 1 or whole_text and above - below <= most:
                done[k] = best
                continue
            unit = 1 if one_text else _TOP
            guess = a + int((b - a) * ((wanted[k] - below) / (above - below)))  # hashes are even, so this is near
            spread = [a + (b - a) * i // fan for i in range(1, fan)]
            width = (b - a) / max(4, (more - rows) ** 0.5)
            tight = [guess + int(width * s) for s in (-2, -1, -0.5, -0.2, 0, 0.2, 0.5, 1, 2)]
            asked[k] = sorted({p // unit * unit for p in (*spread, *tight) if a < p // unit * unit < b} or {(a // unit + 1) * unit})
        if not asked:
            break
        probes = sorted({p for x in asked.values() for p in x})
        found = dict(zip(probes, _counts(keys, probes), strict=True))
        for k in asked:
            for p, count in found.items():
                if lo[k][0] < p and count[0] <= wanted[k]:
                    lo[k] = max(lo[k], (p, count))
                elif p < hi[k][0] and count[0] > wanted[k]:
                    hi[k] = min(hi[k], (p, count))
    cuts = [done[k] for k in range(parts - 1)]
    for k in range(1, len(cuts)):  # targets ascend, and so must the cuts chosen on either side of them
        cuts[k] = max(cuts[k], cuts[k - 1])
    return [c[0] for c in cuts], [c[1] for c in cuts], (total[0], total[1])


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, group_share: float = 0.1, range_bytes: int = 64 << 20) -> DataFrame:
    """docs (columns of the names used here replaced) with size, text_crc32, law, shard, slot (gapless from 0 in each shard, in key order) and
    grown_shard. A fine range holds about range_bytes at most, unless one document is larger."""
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    a, b, part, copy = fresh(docs, "a", "b", "fine", "copy")
    keyed = docs.drop(*names).withColumns({a: F.xxhash64("text"), b: F.xxhash64("doc_id", F.lit("shard")), "size": size})
    keys = written(keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), "size"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ties = keys.groupBy("a", "b").agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("all") * shards > group_share * total))
    ties = written(ties.select(F.col("a").alias(a), F.col("b").alias(b)), "shard-ties")  # at most shards / group_share rows
    if not ties.isEmpty():
        same = keyed.join(F.broadcast(ties), [a, b], "left_semi").groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias(copy))
        same = same.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).withColumn(b, F.xxhash64(b, copy)).drop(copy)
        keyed = keyed.join(F.broadcast(ties), [a, b], "left_anti").select(*keyed.columns).unionByName(same)
        keys = written(keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), "size"), "shard-keys")
    per = max(1, -(-total // (shards * range_bytes)))
    cuts, below, _ = splitters(keys, shards * per, tolerance, group_share, group=per)
    starts = [0, *(rows for _, rows in below)]
    first = [starts[k // per * per] for k in range(shards * per)]
    high, low = (np.array([_signed(x) for x in xs], dtype=np.int64) for xs in zip(*((c >> 64, c & (_TOP - 1)) if c < _TOP * _TOP else (_TOP - 1, _TOP - 1) for c in cuts), strict=True)) if cuts else (np.zeros(0, np.int64),) * 2
    sent = docs.sparkSession.sparkContext.broadcast((high, low))

    @F.pandas_udf("int")
    def fine(a, b):
        high, low = sent.value
        return pd.Series(_slots(high, low, a.to_numpy(), b.to_numpy()).astype(np.int32))

    offset = F.element_at(F.array(*(F.lit(starts[k] - first[k]).cast("bigint") for k in range(shards * per))), F.col(part) + 1)
    out = keyed.withColumns({"text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary")), part: fine(a, b)})
    out = out.withColumn("slot", F.row_number().over(Window.partitionBy(part).orderBy(a, b)).cast("bigint") - 1 + offset)
    out = out.withColumns({"law": F.lit("bytes"), "shard": (F.col(part) / per).cast("int"), "grown_shard": F.lit(None).cast("int")})
    return out.select(*(c for c in docs.columns if c not in names), *names)
