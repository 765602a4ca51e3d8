import math
import random

from almanack.llm import topk


def brute(rows, every, k):
    v = {}
    for key, x in rows:
        if key is not None and x and all(c is not None and math.isfinite(c) for c in x):
            own = [math.floor(256 * c) for c in x]
            v[key] = min(v.get(key, own), own)
    out = []
    for q in sorted(v):
        if q % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(v[q], x, strict=True)), c) for c, x in v.items() if c != q and len(x) == len(v[q])))[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return out


def run(spark, rows, every=5, k=5, **more):
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id bigint, embedding array<double>, rank int").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(df, every, k, **more).collect())
    assert got == sorted(brute(rows, every, k))


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) * (3 if i % 7 == 0 else 1) for _ in range(16)]) for i in range(400)]
    rows += [(400, rows[5][1]), (401, rows[5][1]), (5, rows[5][1]), (402, None), (403, []), (404, [None] * 16), (405, [float("nan")] * 16), (406, [float("inf")] * 16), (None, rows[1][1]), (410, [1.0, 2.0]), (415, [0.5, 0.5]), (420, [0.0] * 16)]
    run(spark, rows)
    run(spark, rows, block=16, seed_rows=8, query_block=20)


def test_few_and_none(spark):
    run(spark, [])
    run(spark, [(0, [1.0, 1.0]), (1, [2.0, 0.0])])
    run(spark, [(i, [0.0, 0.0]) for i in range(12)])
    run(spark, [(i, [1e6 + i, -1e6]) for i in range(12)], k=3)


def test_rows_that_repeat_an_id(spark):
    rows = [(i % 12, [float(i % 5), float(i % 3) - 1]) for i in range(30)] + [(3, [2.0, 2.0])] * 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(df, 5, 4, every_row=True).collect())
    want = []
    for q in (0, 5, 10):
        best = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(x, y, strict=True)), c) for i, x in rows if i == q for c, y in rows if c != q)[:4]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == want
