import random

import pytest

from almanack.llm import substring
from tests.llm import brute

COLS = "doc_id bigint, text string, source string, k1 string"


def rows(n=60, seed=1):
    r = random.Random(seed)
    w = lambda k: [r.choice("abcdefghij") + str(r.randint(0, 300)) for _ in range(k)]
    passage, texts = w(80), []
    for i in range(n):
        kind, t = i % 6, w(r.choice([1, 20, 60, 300]))
        if kind == 0:
            t = t[: len(t) // 2] + passage[: r.choice([34, 35, 36, 80])] + t[len(t) // 2 :]
        elif kind == 1 and texts:
            t = list(r.choice(texts))
        elif kind == 2 and texts:
            t = list(r.choice(texts))
            t[r.randrange(len(t))] = "edited"
        elif kind == 3:
            t = w(40) * 3
        texts.append(t)
    out = [(i, r.choice([" ", "\n", "\t", "  "]).join(t)) for i, t in enumerate(texts)]
    return [*out, (None, out[0][1]), (n, None), (n + 1, ""), (n + 2, "x " * 5000), (n + 3, "y"), out[3], (n + 4, " é b c " * 40)]


@pytest.mark.parametrize("window", [35, 9, 20])
def test_against_brute_force(spark, window):
    data = rows()
    df = spark.createDataFrame([(*x, "s", "c") for x in data], COLS).repartition(3)
    got = sorted((tuple(x) for x in substring.removals(df, window).collect()), key=str)
    assert got == sorted((x[:4] for x in brute.substring(data, window)), key=str)


def test_text_without_repeats(spark):
    data = rows(seed=2)
    df = spark.createDataFrame([(*x, "s", "c") for x in data], COLS).repartition(3)
    got = sorted((tuple(x) for x in substring.without_repeats(df).select("doc_id", "text").collect()), key=str)
    want = [(k, kept if gone else text) for (k, text), (_, _, gone, _, kept) in zip(data, brute.substring(data), strict=True)]
    assert got == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], COLS)
    assert substring.removals(df).count() == 0 and substring.without_repeats(df).count() == 0
