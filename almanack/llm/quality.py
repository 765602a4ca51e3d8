"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: of its bytes (1 to 3) and of its words' kinds (1 to 4: which characters a word has, its
length, whether it repeats the word before). Each indicator is scaled by its log-count ratio between the classes, and a linear model with
squared hinge loss is fitted by dual coordinate descent. A held-back part of the sample gives the sigmoid from margins to probabilities, weighted to the
classes' shares among all learning labels.

Only the sample is bounded: at most per_class labelled documents of each class, those with the least hashes. Scoring reads every whole text in one Arrow
pass; the model sent out has 2**bits numbers.

Cases: null and empty texts have no feature and get the score of the bias; documents without a label are scored, labels without a document do not
train; a document with both labels trains with both; with one class or none learned, all scores are that class's share, or 0.5; an empty table gives no
rows; repeated rows are scored each for itself and learned from once, by their least text; only doc_id, text and quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm import grams
from almanack.llm.common import NOT_SPACE, Texts, steps
from almanack.llm.language import held_out

BITS = 16


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, seen: np.ndarray) -> float:
        z = self.slope * (float(self.weights[seen].sum()) + self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _flags(t: Texts, count: int) -> Iterator[np.ndarray]:
    kinds = grams.word_kinds(t)
    for i in range(count):
        yield grams.flags(t.buf[t.offs[i] : t.offs[i + 1]], kinds[t.first[i] : t.first[i + 1]], BITS)


def _examples(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[pa.Table, dict[int, int]]:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {q: n for q, n in known.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, min(1.0, (1.3 * per_class + 8) / max(1, counts.get(1, 0)))).otherwise(min(1.0, (1.3 * per_class + 8) / max(1, counts.get(0, 0))))
    mark = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40))
    near = known.distinct().where(mark / (1 << 40) < share)
    some = near.withColumn("r", F.row_number().over(Window.partitionBy("quality").orderBy(mark, "doc_id"))).where(F.col("r") <= per_class).select("doc_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi, t in steps(batch.column(1), NOT_SPACE, False):
                found += [np.flatnonzero(x).astype(np.int32) for x in _flags(t, hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["quality", "buckets"])

    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most 2 * per_class rows, however often an id is repeated
    return rows.select("quality", "text").mapInArrow(run, "quality int, buckets array<int>").toArrow(), counts


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge linear model over rows (buckets, each valued values[bucket], and a constant 1), y in -1, 1."""
    w, b = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(rows))
    x = [values[r] for r in rows]
    diagonal = 0.5 / cost
    norm = np.array([float(v @ v) + 1 + diagonal for v in x])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ x[i]) + b) - 1 + diagonal * alpha[i]
            new = max(0.0, alpha[i] - gradient / norm[i])
            if (d := new - alpha[i]) != 0:
                w[rows[i]] += d * y[i] * x[i]
                b += d * y[i]
                alpha[i] = new
                most = max(most, abs(d) * norm[i])
        if most < 1e-3:
            break
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, cost: float = 0.01, epochs: int = 30, smooth: float = 1.0) -> Model:
    got, counts = _examples(docs, labels, per_class)
    weights, all_labels = np.zeros(1 << BITS), sum(counts.values())
    rows = [got["buckets"][i].values.to_numpy() for i in range(got.num_rows)]
    y = np.where(got["quality"].to_numpy() == 1, 1, -1) if rows else np.zeros(0)
    if len({*y.tolist()}) < 2:
        share = counts.get(1, 0) / all_labels if all_labels else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(weights, 0.0, 1.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(11)
    order = rng.permutation(sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i].tobytes())))
    back, use = order[: len(order) // 4], order[len(order) // 4 :]
    if len({*y[use].tolist()}) < 2 or len({*y[back].tolist()}) < 2:
        back, use = order, order
    ratio = []
    for sign in (1, -1):
        n = np.bincount(np.concatenate([rows[i] for i in use if y[i] == sign]), minlength=1 << BITS) + smooth
        ratio.append(np.log(n / n.sum()))
    ratio = ratio[0] - ratio[1]
    w, b = dual_descent([rows[i] for i in use], ratio, y[use], cost, epochs, rng)
    model = Model(w * ratio, b, 1.0, 0.0)
    z = np.array([model.weights[rows[i]].sum() + b for i in back])
    share = {s: counts[max(s, 0)] / all_labels / max(1, int((y[back] == s).sum())) for s in (1, -1)}
    model.slope, model.shift = _sigmoid(z, y[back] > 0, np.array([share[s] for s in y[back]]))
    return model


def _sigmoid(z: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on the weighted log loss, with a small ridge."""
    scale = max(1e-9, float(np.abs(z).mean()))
    x, weight = np.c_[z / scale, np.ones(len(z))], weight / weight.sum()
    target = np.where(good, 1 - 1 / (len(z) + 2), 1 / (len(z) + 2))
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-3 * c
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        c -= np.clip(step, -2, 2)
    return float(c[0] / scale), float(c[1])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = []
            for lo, hi, t in steps(batch.column(1), NOT_SPACE, False):
                found += [model.score(x) for x in _flags(t, hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
