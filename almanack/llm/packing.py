"""Packing by power-of-two decomposition.

Each document's ids (tokenizer ids, then one end id) are cut into pieces whose lengths are powers of two: whole pieces of
`max_len` first, then the binary digits of the rest, largest first. A piece is a sequence of its own, so no sequence crosses
documents and none is padded; sequences of one length form a bucket, from which batches are drawn.

Cases: a null or empty text packs as its end id alone; equal or repeated rows are packed each for itself; an empty table gives no
rows; a null doc_id stays null; other columns are not read. Texts of any length are taken whole, one at a time.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_encoders: dict[tuple[str, bool], Callable[[str], list[int]]] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: printable Latin-1 for itself, the other bytes from U+0100 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, special: bool = False) -> Callable[[str], list[int]]:
    """text -> ids of the tokenizer file at `path`, no special tokens added; their strings in a text are ordinary text, or with `special` their ids, as the file has it.

    A byte-level BPE file whose ids follow its merge order runs on tiktoken's engine with the ranks of that file, about four times
    as fast; texts with characters that the two libraries' Unicode tables might class differently, and any other file, run on `tokenizers`.
    """
    key = path, special
    if key not in _encoders:
        plain = []  # loaded for the first text that needs it

        def slow(text: str) -> list[int]:
            if not plain:
                from tokenizers import Tokenizer

                plain.append(Tokenizer.from_file(path))
                plain[0].encode_special_tokens = not special
            return plain[0].encode(text, add_special_tokens=False).ids

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model.get("vocab", {})
        merges = [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", [])]
        in_order = [vocab.get(a + b) for a, b in merges] == [*range(256, 256 + len(merges))]
        if model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None and in_order:
            import public_tokenizers
            import regex
            import tiktoken

            alphabet = _byte_alphabet()
            added = {x["content"] for x in spec["added_tokens"]}
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in added}
            fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            unusual = regex.compile(r"[^\x00-ͯΑ-ωА-я‐-›€ぁ-ん一-龥]")
            told = added if special else ()
            _encoders[key] = lambda text: slow(text) if any(x in text for x in told) or not text.isascii() and unusual.search(text) else fast.encode_ordinary(text)
        else:
            _encoders[key] = slow
    return _encoders[key]


def pieces(n: int, max_len: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the binary pieces of n ids."""
    start = 0
    while n - start >= max_len:
        yield start, max_len
        start += max_len
    rest = n - start
    while rest:
        length = 1 << (rest.bit_length() - 1)
        yield start, length
        start += length
        rest -= length


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 1024, end_id: int = 0, with_ids: bool = True, special: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0: a sequence is one piece), bucket
    (the length), and with with_ids its ids. sequence_id orders by bucket first, so a range of it is one bucket.

    One pass, no shuffle: the plan is a scan and one Arrow stage, whatever the skew.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint"), ("bucket", "int")]
    fields += [("ids", "array<int>")] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = encoder(tokenizer_path, special), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, start, length, crc, total, seq, ids = [], [], [], [], [], [], []

            def flush():
                n = len(rows)
                cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(length, pa.int32())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                out = pa.RecordBatch.from_arrays(cols, names=[k for k, _ in fields])
                for x in (rows, start, length, crc, total, seq, ids):
                    x.clear()
                return out

            for i in range(batch.num_rows):
                own = np.array([*encode(batch.column(1)[i].as_py()), end_id], dtype="<u4")
                for at, k in pieces(len(own), max_len):
                    piece = own[at : at + k]
                    rows.append(i)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
                    seq.append((k.bit_length() - 1) << 58 | part << 36 | made)
                    made += 1
                    if with_ids:
                        ids.append(piece.view("<i4"))
                if len(rows) >= 10_000:
                    yield flush()
            if rows:
                yield flush()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ", ".join(f"`{a}` {b}" for a, b in fields))
