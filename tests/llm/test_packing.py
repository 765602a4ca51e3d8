import random
import unicodedata
import zlib

import numpy as np
import pytest

from almanack.llm import packing
from almanack.llm.queries import tokenizer_path

TEXTS = ["", None, "Hello  world\n\n 123's don't <|endoftext|> x", "é è ü　  \x1c\x85 nbsp end ", "a " * 3000, "word" * 2000, " \n\t ", "日本語 текст ελληνικά 👩‍👩‍👧 𝒜"]


def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_encoder_is_the_tokenizer():
    fast, slow, r = packing.encoder(tokenizer_path()), plain(), random.Random(1)
    for t in TEXTS:
        assert fast(t or "") == slow(t or "")
    alphabet = [chr(c) for c in range(0x250)] + ["\n", " ", "'s", "12", "\r\n"] * 20 + [chr(r.randrange(0x3000)) for _ in range(60)]
    for _ in range(1500):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(1, 40)))
        assert fast(t) == slow(t), [unicodedata.name(c, hex(ord(c))) for c in t]


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_pieces_are_powers_of_two(n):
    own = list(packing.pieces(n, 1024))
    assert sum(k for _, k in own) == n and all(k & (k - 1) == 0 and k <= 1024 for _, k in own)
    assert [a for a, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))]


def test_round_trip(spark):
    docs = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (2, TEXTS[2], "x", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, bucket string, start int").repartition(3)
    out = packing.pack(df, tokenizer_path()).collect()
    assert len({x.sequence_id for x in out}) == len(out) and {x.offset for x in out} == {0}
    slow = plain()
    for key in {d[0] for d in docs}:
        texts = [d[1] or "" for d in docs if d[0] == key]
        mine = sorted((x for x in out if x.doc_id == key), key=lambda x: x.start)
        want = [*slow(texts[0]), 0]
        assert all(x.doc_tokens == len(want) and x.bucket == x.length for x in mine)
        once = {x.start: x for x in mine}
        assert [i for a in sorted(once) for i in once[a].ids] == want and len(mine) == len(once) * len(texts)
        assert all(x.ids_crc32 == zlib.crc32(np.array(x.ids, dtype="<u4").tobytes()) for x in mine)
    assert packing.pack(df.limit(0), tokenizer_path(), with_ids=False).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, tokenizer_path(), max_len=1000)


def test_special_strings_as_the_file_has_them():
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path(), special=True)
    for t in [x or "" for x in TEXTS] + ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext"]:
        assert fast(t) == own.encode(t, add_special_tokens=False).ids
