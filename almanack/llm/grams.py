"""Hashed n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from almanack.llm.common import NOT_SPACE, Texts

#: ASCII letters lower-cased, other ASCII taken as a gap; bytes of other characters stay.
_LETTERS = np.array([b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
_KINDS = np.array([1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 4 if 48 <= b < 58 else 8 if b >= 128 else 0 if NOT_SPACE[b] == 0 else 16 if chr(b) in ".,;:'\"?()-" else 32 for b in range(256)], dtype=np.uint8)


def gram_buckets(symbols: np.ndarray, orders: tuple[int, ...], bits: int, salt: int) -> np.ndarray:
    """Buckets (0 .. 2**bits - 1) of all n-grams of the symbols, n in orders."""
    out, h = [], np.full(len(symbols), salt, dtype=np.uint32)
    x = symbols.astype(np.uint32)
    for n in range(1, max(orders) + 1):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in orders:
            out.append((h * np.uint32(0x85EBCA77) ^ np.uint32(n)) >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def subwords(raw: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the 1- to 4-byte grams of the letters, words framed by gaps, runs of gaps as one."""
    x = _LETTERS[raw]
    x = np.concatenate([[32], x, [32]]).astype(np.uint8)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return gram_buckets(x[keep], (1, 2, 3, 4), bits, 1)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def word_kinds(t: Texts) -> np.ndarray:
    """A code for each word: which kinds of characters it has, whether it is the word before it, how long it is."""
    if not len(t.starts):
        return np.zeros(0, dtype=np.int64)
    kinds = np.bitwise_or.reduceat(_KINDS[t.buf], t.starts).astype(np.int64)
    h = t.word_hashes()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    heads = t.first[:-1]
    same[heads[heads < len(h)]] = False
    length = np.minimum(np.log2(t.ends - t.starts).astype(np.int64), 5)
    return kinds | same.astype(np.int64) << 6 | length << 7


def flags(raw: np.ndarray, kinds: np.ndarray, bits: int) -> np.ndarray:
    """Which buckets hold a gram of a text: bytes as they are (1 to 3), kinds of words (1 to 4)."""
    seen = np.zeros(1 << bits, dtype=bool)
    seen[gram_buckets(raw, (1, 2, 3), bits, 2)] = True
    seen[gram_buckets(kinds, (1, 2, 3, 4), bits, 3)] = True
    return seen
