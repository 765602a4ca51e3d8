"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte grams (1 to 4 bytes within framed words). Embeddings and softmax are
trained together by stochastic gradient descent in numpy, on whole sampled texts and on short spans drawn from them, so that short texts are
met too. A held-back part of the sample gives the temperature that calibrates the probabilities and the score below which a text is rejected.

The sample is the only bounded thing: at most per_lang rows of each language (the least hashes of the row), fewer of each where there are over
max_langs languages, so that all of them are learned and the sample stays as large. Prediction scores every whole text in one Arrow pass; mean and softmax being linear up to the last step, embeddings and
softmax are multiplied out to one weight per bucket and language beforehand, 2**bits * languages numbers, which is what is sent out.

Cases: a text that is null or has no letter is `und` with score 0 and rejected; an empty table gives no rows; with no labelled rows every
text is `und`; a null lang does not train; repeated rows are judged each for itself; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.llm import grams
from almanack.llm.common import NOT_SPACE, steps, written

BITS, DIM = 16, 16


def held_out(column: str = "doc_id"):
    """crc32 of the id as text leaves 0 modulo 5 (a null id: as the empty text, whose crc32 is 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    floor: float  # texts that score less are rejected

    def probabilities(self, buckets: np.ndarray) -> np.ndarray:
        z = (self.weights[buckets].mean(axis=0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _sample(docs: DataFrame, per_lang: int, max_langs: int) -> DataFrame:
    """(lang, part, seed, text) of the learning rows, at most per_lang of each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~held_out()).select("lang", "text", F.xxhash64("doc_id", F.octet_length("text"), "text").alias("seed"))
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n_langs = counts.count()
    per_lang = per_lang if n_langs <= max_langs else max(8, per_lang * max_langs // n_langs)
    near = rows.join(F.broadcast(counts) if n_langs <= 250_000 else counts, "lang")
    near = near.where((F.pmod("seed", F.lit(1 << 40)) / (1 << 40)) < F.least(F.lit(1.0), 1.3 * per_lang / F.col("n") + 8 / F.col("n"))).drop("n")  # about 1.3 times the bound
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("seed", F.lit(1 << 40)), "seed"))
    return near.withColumn("r", rank).where(F.col("r") <= per_lang).drop("r")


def _examples(sample: DataFrame) -> pa.Table:
    """(lang, kind, buckets, counts): a whole text (kind 0) and two short spans of it (kind 1) for each sampled row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, kind, buckets, counts = [], [], [], []
            for lo, hi, t in steps(batch.column(1), NOT_SPACE, False):
                for i in range(hi - lo):
                    raw = t.buf[t.offs[i] : t.offs[i + 1]]
                    rng = np.random.default_rng(abs(batch.column(2)[lo + i].as_py()))
                    spans = [raw]
                    if (n := t.first[i + 1] - t.first[i]) > 1:
                        for _ in range(2):
                            a = t.first[i] + int(rng.integers(n))
                            b = min(t.first[i + 1], a + int(rng.integers(1, 12)))
                            spans.append(t.buf[t.starts[a] : t.ends[b - 1]])
                    for k, s in enumerate(spans):
                        ids, n_ids = np.unique(grams.subwords(s, BITS), return_counts=True)
                        lang.append(batch.column(0)[lo + i])
                        kind.append(min(k, 1))
                        buckets.append(ids.astype(np.int32))
                        counts.append(n_ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "kind", "buckets", "counts"])

    return sample.select("lang", "text", "seed").mapInArrow(run, "lang string, kind int, buckets array<int>, counts array<int>").toArrow()


def train(docs: DataFrame, per_lang: int = 700, max_langs: int = 200, epochs: int = 6, rate: float = 0.5, reject_share: float = 0.001) -> Model | None:
    """A model of the learning rows' languages; None if there are none. reject_share: of rightly judged whole texts, how many may be rejected."""
    got = _examples(_sample(docs, per_lang, max_langs))
    if not got.num_rows:
        return None
    names = got["lang"].to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    y = np.array([place[x] for x in names])
    rows = [(b.values.to_numpy(), c.values.to_numpy()) for b, c in zip(got["buckets"], got["counts"], strict=True)]  # views of the table
    kinds = got["kind"].to_numpy()
    order = np.argsort([f"{a}{len(b)}{b[:4].tolist()}" for a, (b, _) in zip(names, rows, strict=True)], kind="stable")  # any order of tasks gives one model
    rng = np.random.default_rng(7)
    order = rng.permutation(order)
    back, use = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(use):
        back, use = order, order
    emb = (rng.standard_normal((1 << BITS, DIM)) / DIM).astype(np.float32)
    soft, bias = np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    total, done = epochs * len(use), 0
    for _ in range(epochs):
        for i in rng.permutation(use):
            ids, n = rows[i]
            w = n.astype(np.float32)
            w /= w.sum()
            x = w @ emb[ids]
            z = x @ soft + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            step = rate * (1 - done / total)
            dx = soft @ g
            soft -= step * np.outer(x, g)
            bias -= 0.1 * step * g
            dx *= min(1.0, 1.0 / (float(np.sqrt(dx @ dx)) + 1e-9))
            emb[ids] -= (0.3 * step / float(w @ w) * w)[:, None] * dx  # long texts move as far as short ones
            done += 1
    model = Model(langs, emb @ soft, bias, 1.0, 0.0)
    share = lambda n: n.astype(np.float32) / n.astype(np.float32).sum()
    z = np.array([share(rows[i][1]) @ model.weights[rows[i][0]] + bias for i in back])
    best = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(z / t, y[back]))
    model.temperature = float(best)
    p = np.exp(z / best - (z / best).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[(p.argmax(axis=1) == y[back]) & (kinds[back] == 0)]
    model.floor = float(min(0.5, np.quantile(right, reject_share))) if len(right) else 0.0
    return model


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    top = z.max(axis=1)
    return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(y)), y]).mean())


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, lang_pred, score (calibrated probability of lang_pred) and rejected, for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)
    schema = T.StructType([*(T.StructField(k, docs.schema[k].dataType) for k in keep), *T.StructType.fromDDL("lang_pred string, score double, rejected boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            lang, score = [], []
            for lo, hi, t in steps(batch.column(n), NOT_SPACE, False):
                ascii_letter = np.cumsum(np.r_[0, grams._KINDS[t.buf] & 3 > 0])
                for i in range(hi - lo):
                    some = ascii_letter[t.offs[i + 1]] > ascii_letter[t.offs[i]] or grams.has_letter(batch.column(n)[lo + i].as_py() or "")
                    if model is None or not some:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    p = model.probabilities(grams.subwords(t.buf[t.offs[i] : t.offs[i + 1]], BITS))
                    lang.append(model.langs[int(p.argmax())])
                    score.append(float(p.max()))
            out = [*(batch.column(i) for i in range(n)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([a == "und" or b < (model.floor if model else 0) for a, b in zip(lang, score, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select(*(F.col(k) for k in keep), F.col("text").alias("__text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows that the model rejects; all columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return predict(rows, model, ("__row",)).where("not rejected").select("__row.*")
