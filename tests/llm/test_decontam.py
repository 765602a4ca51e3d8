import random

import pytest

from almanack.llm import decontam
from tests.llm import brute

COLS = "doc_id bigint, text string, n_words string, items int"


def data(seed=1):
    r = random.Random(seed)
    w = lambda k: [r.choice("abcdefgh") + str(r.randint(0, 40)) + r.choice(["", "é", "-x", "."]) for _ in range(k)]
    items = [(i, " ".join(w(r.choice([1, 3, 13, 14, 40])))) for i in range(12)]
    items += [(12, items[4][1]), (12, items[5][1]), (13, None), (14, ""), (15, "..."), (None, " ".join(w(20)))]
    docs = []
    for i in range(60):
        t = " ".join(w(r.choice([2, 30, 200])))
        if i % 2:
            own = (r.choice(items)[1] or "").split()
            a = r.randrange(len(own) + 1)
            t += "  " + " , ".join(own[a : a + r.choice([13, 60])]).upper() + "\n" + " ".join(w(5))
        docs.append((i, t))
    return [*docs, (None, docs[1][1]), (60, None), (61, ""), (62, "!?"), docs[3], (63, "z " * 20000)], items


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_against_brute_force(spark, block):
    docs, items = data()
    df = spark.createDataFrame([(*x, "s", 1) for x in docs], COLS).repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, extra int")
    got = sorted((tuple(x) for x in decontam.decontaminate(df, bench, block_bytes=block).collect()), key=str)
    assert got == sorted(brute.decontam(docs, items), key=str)
    clean = decontam.clean(df, bench, block_bytes=block)
    assert clean.columns == df.columns and clean.count() == sum(not x[5] for x in brute.decontam(docs, items))
    assert decontam.decontaminate(df, bench.limit(0)).where("n_hit > 0").isEmpty() and decontam.decontaminate(df.limit(0), bench).isEmpty()


def test_spans_are_places_in_the_original(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "é! ONE, two--three. four one two three")], "doc_id bigint, text string")
    row = decontam.decontaminate(df, bench, spans=True).first()
    text = df.first().text
    assert [text[a:b] for a, b in row.hit_spans] == ["ONE, two--three", "one two three"] and row.n_hit == 6


def test_large_benchmark_within_a_workers_memory(spark):
    """5 MB of benchmark in blocks; a block's automaton, measured here, stays under 150 MB."""
    import resource

    r = random.Random(2)
    words = [f"w{i}" for i in range(20_000)]
    items = [(str(i), " ".join(r.choice(words) for _ in range(100))) for i in range(1_700)]
    assert 900_000 < sum(len(t) for _, t in items) < 1_100_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    tree = decontam.Windows(items, 13)
    assert len(tree.tree) == 1_700 * 88 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000
    del tree
    more = [(i, " ".join(r.choice(words) for _ in range(100))) for i in range(8_500)]
    docs = [(i, f"before {more[i * 800][1][40:400]} after") for i in range(10)] + [(10, "w1 w2 w3")]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(more, "item_id bigint, text string")
    got = {x.doc_id: x.contaminated for x in decontam.decontaminate(df, bench).collect()}
    assert got == {**dict.fromkeys(range(10), True), 10: False}
