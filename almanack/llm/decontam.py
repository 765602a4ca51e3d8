"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts and documents are normalised alike: A-Z lower-cased, words are runs of 0-9, a-z and non-ASCII characters. Every 13 consecutive
words of an item (all of a shorter item) are a key of one automaton, whose symbols are words and not characters, so it has a sixth of the nodes; a document is
scanned once, and each occurrence is mapped back to word numbers and, on demand, to character offsets of the original text.

Cases: null and empty texts have no words and are clean; items without words give no window; equal windows of several items count for
each; an item that has a null item_id marks words but is not listed; an empty benchmark or document table gives clean or no rows;
repeated rows are judged each for itself; only doc_id, item_id and text are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.llm.common import Texts, byte_table, written

WORD = byte_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})
_CLEAN = bytes(b + 32 if 65 <= b < 91 else b if WORD[b] else 32 for b in range(256))
_built: dict[str, Windows] = {}


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


class Windows:
    """The automaton over all windows of the items: keys are runs of word numbers (from 1, in the order met), values (number of words, ids of the items that have it)."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in normalised(text)]
            k = min(size, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                found.setdefault(tuple(words[i : i + k]), set()).add(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in found.items():
            self.tree.add_word(w, (len(w), frozenset(x for x in ids if x is not None)))
        self.tree.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in an occurrence (None: none does), and the items that occur."""
        if not len(self.tree) or not words:
            return None, set()
        line = tuple(map(self.number.get, words, repeat(0)))  # 0: a word that no item has
        marks, ids = None, set()
        for end, (n, found) in self.tree.iter(line):
            if marks is None:
                marks = np.zeros(len(words) + 1, dtype=np.int32)
            marks[end + 1] -= 1
            marks[end + 1 - n] += 1
            ids |= found
        return (None, ids) if marks is None else (np.cumsum(marks[:-1]) > 0, ids)


def char_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text: each maximal run of hit words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    t = Texts(raw, np.array([0, len(raw)]), WORD, lower=True)
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return [(int(chars[t.starts[a]]), int(chars[t.ends[b - 1]])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = 1 << 20, spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), with
    spans also the original's character ranges `hit_spans`.

    The benchmark reaches the executors as broadcast blocks of about block_bytes of text, its size being summed first; a larger
    benchmark makes more blocks, each a pass over the documents whose marks are carried on in a written table.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    state = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("marks"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([(r.item, r.text) for r in own.toLocalIterator()])
        last = k == blocks - 1
        state = _scan(state, sent, window, share, last, spans)
        if not last:
            state = written(state, "decontam")
    return state


def clean(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """docs without the contaminated rows; all columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    return decontaminate(rows, benchmark, **more).where("not contaminated").select("doc_id.*")


def _scan(state: DataFrame, sent, window: int, share: int, last: bool, spans: bool) -> DataFrame:
    more = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean" + ", hit_spans array<struct<start: int, `end`: int>>" * spans if last else "text string, marks binary, items array<string>"
    schema = T.StructType([T.StructField("doc_id", state.schema["doc_id"].dataType), *T.StructType.fromDDL(more)])

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:  # once for each worker process
            _built.clear()
            _built[name] = Windows(sent.value, window)
        a = _built[name]
        for batch in batches:
            out: list[tuple] = []
            for text, was, seen in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text, was = text.as_py(), was.as_py()
                words = normalised(text or "")
                hit, ids = a.hits(words)
                ids |= set(seen.as_py() or ())
                if was is not None:
                    before = np.frombuffer(was, dtype=bool)
                    hit = before if hit is None else before | hit
                if not last:
                    out.append((text, None if hit is None else hit.tobytes(), sorted(ids)))
                    continue
                n = 0 if hit is None else int(hit.sum())
                row = (len(words), n, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n > 0 and share * n >= len(words))
                out.append((*row, [{"start": x, "end": y} for x, y in char_spans(text, hit)] if n else []) if spans else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))] if last else [pa.string(), pa.binary(), pa.list_(pa.string())]
            kinds = kinds if spans or not last else kinds[:-1]
            cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[] for _ in kinds], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *(["n_words", "n_hit", "n_items", "items_sha256", "contaminated"] + ["hit_spans"] * spans if last else ["text", "marks", "items"])])

    return state.mapInArrow(run, schema)
