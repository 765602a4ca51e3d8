"""Shared helpers: a written table in the shared folder, whole-text numpy scans, a size-checked semi join."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step takes; a longer text makes a step of its own.
STEP_BYTES = 1 << 18
#: Text keys that a task remembers, to pass over further copies of a text before a shuffle.
SEEN = 200_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: While a step is written: its shuffle files go as soon as its table is there, and whole texts reach Python in small batches.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", _BATCH: "1000"}
_LONG_WORD = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_WORD_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one on a single machine (tests), and an error on a cluster, whose
    executors would each write to their own disk."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not (master := spark.conf.get("spark.master", "")).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="almanack-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


#: The tables that the running chain of steps wrote on its way; each thread has its own.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that `written` made."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_scratch(spark: SparkSession, last: bool = False) -> None:
    """Delete the tables written since the last call, and keep count of those written from now on. For a chain of steps that each write their result before the
    next one starts: what an earlier step wrote on its way is then of no use. With last the count ends. Without a call nothing is ever deleted: a query's result is
    read from such tables, so only its caller knows when they may go. It also makes the session's Arrow batches small, since the caller runs each
    step's last stage on whole rows."""
    spark.conf.set(_BATCH, _STEP[_BATCH])
    dropped(spark, *(_scratch.get() or ()))
    _scratch.set(None if last else [])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def written(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, so a lost executor costs one task's rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scratch and (own := _scratch.get()) is not None:
        own.append(path)
    was = {k: spark.conf.get(k, None) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def semi(df: DataFrame, keys: DataFrame, on: list[str], broadcast_rows: int = 250_000) -> DataFrame:
    """Rows of df whose key is in keys (a written table): by broadcast up to broadcast_rows, by a shuffle beyond."""
    few = keys.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def text_key(column: str = "text") -> list:
    """128 bits of a text, computed in the JVM: equal texts have equal keys."""
    return [F.xxhash64(column).alias("k1"), F.xxhash64(F.lit("almanack"), F.col(column)).alias("k2")]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * STEP_BYTES), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves each output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(word: str | set[int]) -> np.ndarray:
    """256 flags: which UTF-8 bytes belong to words."""
    t = np.zeros(256, dtype=bool)
    t[list(word)] = True
    return t


#: Words of any byte but the six ASCII white-space characters.
NOT_SPACE = byte_table({b for b in range(256) if b not in b" \t\n\v\f\r"})
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """A run of whole texts in one byte buffer with the places of their words.

    buf: bytes; offs: where each text starts, and the end; starts, ends: of each word; first: each text's first word, and the number of words.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, word: np.ndarray, lower: bool):
        self.offs = offs
        self.buf = LOWER[buf] if lower else buf
        inside = word[self.buf]
        head = np.zeros(len(buf) + 1, dtype=bool)
        head[offs] = True
        was = np.zeros(len(buf) + 1, dtype=bool)
        was[1:] = inside
        now = np.zeros(len(buf) + 1, dtype=bool)
        now[:-1] = inside
        self.starts = np.flatnonzero(now & (~was | head))
        self.ends = np.flatnonzero(was & (~now | head))
        self.first = np.searchsorted(self.starts, offs)

    def word_hashes(self) -> np.ndarray:
        """64 bits of each word's bytes."""
        p = powers(_BASE, len(self.buf) + 1)
        s = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
        h = mix((s[self.ends] - s[self.starts]) * powers(_BASE_INV, len(self.buf) + 1)[self.starts])
        for i in np.flatnonzero(self.ends - self.starts > _LONG_WORD):  # the sum above is weak on long periodic words
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return h


def window_hashes(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """64 bits of each run of `size` consecutive word hashes (runs over the end of a text included; callers mask them)."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    if salt:
        h = mix(h ^ np.uint64(salt))
    s = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_WORD_BASE, len(h)), out=s[1:])
    return mix((s[size:] - s[:-size]) * powers(_WORD_BASE_INV, len(h))[: len(h) - size + 1] + np.uint64(size))


def steps(column: pa.Array, word: np.ndarray, lower: bool, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """The texts of an Arrow column (null: empty) in runs of about `limit` bytes: first row, row after the last, Texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offs = np.frombuffer(where, dtype=kind, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Texts(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], word, lower)
        lo = hi


def once(texts: DataFrame) -> DataFrame:
    """k1, k2, text without the further copies that a task meets (the last SEEN keys are remembered), before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    return texts.mapInArrow(run, texts.schema)
