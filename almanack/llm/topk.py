"""Exact top-k inner products over integer vectors, by norm-sorted blocks with SVD-rotated partial sums.

Each component x becomes floor(scale * x). All vectors are rotated by the eigenvectors of their Gram matrix (right singular vectors), which moves
most of an inner product into the first components. Candidates are taken in descending order of length, block by block; for a query with current
k-th best score s, a block is passed over if |q| * (greatest length in it) < s, and a candidate if the sum over the first components plus the
product of the residual lengths (Cauchy-Schwarz) is below s. What is left is scored exactly in integers. Bounds get a margin for floating point.

The queries are sent out in blocks of a fixed number; the first scores come from the longest candidates. Every block of queries meets every
candidate's block, a stated query set against all rows.

Cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different dimensions are compared within their
dimension; ties go to the smaller vec_id; fewer candidates than k give all; a query is no candidate of its own, but other rows with equal vectors are;
rows that repeat a vec_id are one vector (the first in order of its components), or with `every_row`, as in the query, each a candidate of its own; a null vec_id takes no part; an empty table gives no rows;
components and scores beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.common import written

_EXACT = 1 << 52


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x and y (whole numbers held as doubles)."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most < _EXACT:
        return (x @ y.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in y] for u in x], dtype=object).reshape(len(x), len(y))


class _Index:
    """Candidates sorted by length, with rotated heads and residual lengths."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, rotation: np.ndarray, head: int):
        length = np.sqrt((v * v).sum(axis=1))
        o = np.lexsort((ids, -length))
        self.ids, self.v, self.length = ids[o], v[o], length[o]
        r = self.v @ rotation
        self.head, self.rest = r[:, :head], np.sqrt((r[:, head:] ** 2).sum(axis=1))

    def best(self, q_ids: np.ndarray, q: np.ndarray, q_head: np.ndarray, q_rest: np.ndarray, floor: np.ndarray, k: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query number, candidate number, score) that can be among the k best; floor: scores known to be reached, raised on the way."""
        q_len = np.sqrt((q * q).sum(axis=1))
        for lo in range(0, len(self.ids), block):
            part = slice(lo, lo + block)
            live = np.flatnonzero(q_len * self.length[lo] * (1 + 1e-9) + 1 >= floor)
            if not len(live):
                return
            bound = q_head[live] @ self.head[part].T + np.outer(q_rest[live], self.rest[part])
            bound += 1 + 1e-9 * np.outer(q_len[live], self.length[part])
            ok = bound >= floor[live, None]
            ok &= q_ids[live, None] != self.ids[None, part]
            rows, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            if not len(rows):
                continue
            score = _products(q[live[rows]], self.v[lo + cols])
            score = np.where(ok[np.ix_(rows, cols)], score.astype(np.float64) if score.dtype != object else score, -np.inf)
            kk = min(k, score.shape[1])
            kth = -np.partition(-score, kk - 1, axis=1)[:, kk - 1] if kk == k else np.full(len(rows), -np.inf)
            kth = kth.astype(np.float64) if score.dtype != object else np.nextafter(kth.astype(np.float64), -np.inf)  # never above the score
            now = np.maximum(floor[live[rows]], kth)
            i, j = np.nonzero((score >= now[:, None]) & (score > -np.inf))
            yield live[rows][i], lo + cols[j], score[i, j]
            floor[live[rows]] = now


def _tops(q: np.ndarray, c: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the entries that are among the k best of their query (ties: smaller id)."""
    o = np.lexsort((ids[c], -score, q))
    q = q[o]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, dtype=bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else np.zeros(0)
    return o[rank < k]


def vectors(embeddings: DataFrame, scale: int = 256, every_row: bool = False) -> DataFrame:
    """(vec_id, d, v): one whole vector of each vec_id (the least; with every_row each row's own), its components floor(scale * x) as doubles."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("double"))
    fit = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = embeddings.where((F.size("embedding") > 0) & F.col("vec_id").isNotNull()).where(fit).select("vec_id", F.size("embedding").alias("d"), x.alias("v"))
    return rows if every_row else rows.groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("x")).select("vec_id", "x.d", "x.v")


def _rotation(of: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix of all vectors, greatest first; d * d numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column(0))
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(g.ravel())], names=["i", "g"])

    g = np.zeros(d * d)
    for i, x in of.select("v").mapInArrow(run, "i bigint, g double").groupBy("i").agg(F.sum("g")).collect():
        g[i] = x
    g = g.reshape(d, d)
    scale = float(np.abs(g).max(initial=0))
    if not np.isfinite(scale) or not scale:
        return np.eye(d)
    return np.linalg.eigh(g / scale)[1][:, ::-1].copy()


def top_k(embeddings: DataFrame, query_every: int = 50, k: int = 5, scale: int = 256, query_block: int = 4096, block: int = 512, seed_rows: int = 4096, every_row: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for the queries vec_id % query_every == 0. every_row: rows that repeat a vec_id stay, each a candidate and a query of its id."""
    spark = embeddings.sparkSession
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = written(vectors(embeddings, scale, every_row).repartitionByRange(length.desc()).sortWithinPartitions(length.desc(), "vec_id"), "topk-vectors")
    out = None
    for (d,) in rows.select("d").distinct().orderBy("d").collect():
        own = rows.where(F.col("d") == d)
        rotation = _rotation(own, d)
        head = max(1, d // 4)
        asked = own.where(F.col("vec_id") % query_every == 0).select("vec_id", "v")
        blocks = max(1, -(-asked.count() // query_block))
        longest = own.orderBy(length.desc(), "vec_id").limit(seed_rows).select("vec_id", "v").toArrow()  # at most seed_rows vectors
        seed = _Index(longest.column(0).to_numpy(), _matrix(longest.column(1)), rotation, head)
        for b in range(blocks):
            q = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).toArrow()
            if not q.num_rows:
                continue
            q_ids, qv = q.column(0).to_numpy(), _matrix(q.column(1))
            floor = np.full(len(q_ids), -np.inf)
            r = qv @ rotation
            q_head, q_rest = r[:, :head], np.sqrt((r[:, head:] ** 2).sum(axis=1))
            for _ in seed.best(q_ids, qv, q_head, q_rest, floor, k, seed_rows):
                pass
            sent = spark.sparkContext.broadcast((q_ids, qv, q_head, q_rest, floor, rotation))
            part = own.select("vec_id", "v").mapInArrow(_scanner(sent, k, head, block), "query_id bigint, vec_id bigint, score bigint")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanner(sent, k: int, head: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, qv, q_head, q_rest, floor, rotation = sent.value
        floor = floor.copy()  # raised over all batches of the task
        for batch in batches:
            if not batch.num_rows:
                continue
            index = _Index(batch.column(0).to_numpy(), _matrix(batch.column(1)), rotation, head)
            found = list(index.best(q_ids, qv, q_head, q_rest, floor, k, block))
            q, c, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
            keep = _tops(q, c, score, index.ids, k)
            cols = [pa.array(q_ids[q[keep]], pa.int64()), pa.array(index.ids[c[keep]], pa.int64()), pa.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in score[keep]], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    return run
