import random
import zlib
from collections import Counter, defaultdict

from almanack.llm import sharding

COLS = "doc_id bigint, text string, slot string, shard int"


def check(spark, data, **more):
    df = spark.createDataFrame([(*x, "s", 7) for x in data], COLS).repartition(3)
    got = sharding.shard(df, **more).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in got) == sorted((str(a), str(b)) for a, b in data)
    slots, size = defaultdict(list), Counter()
    for x in got:
        raw = (x.text or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        slots[x.shard].append(x.slot)
        size[x.shard] += x.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return got, size


def test_even_and_whole_groups(spark):
    r = random.Random(1)
    data = [(i, "x" * r.randint(0, 300) + str(i // 2 if i % 3 else i)) for i in range(6000)] + [(i, None) for i in range(6000, 6010)] + [(None, "q"), (5, "q"), (5, "q")]
    got, size = check(spark, data)
    assert set(size) == set(range(24))
    mean = sum(size.values()) / 24
    assert all(abs(x - mean) < 0.02 * mean for x in size.values())
    where = defaultdict(set)
    for x in got:
        where[x.text].add(x.shard)
    assert all(len(x) == 1 for x in where.values())


def test_hot_text_and_fine_ranges(spark):
    data = [(i, "hot text " * 20) for i in range(3000)] + [(i, f"text {i} " * 20) for i in range(3000, 6000)]
    _, size = check(spark, data, range_bytes=10_000)
    mean = sum(size.values()) / 24
    assert all(abs(x - mean) < 0.02 * mean for x in size.values())


def test_many_equal_rows(spark):
    """Rows of one document and text are dealt over shards too, and stay whole in number; one very long text is one row."""
    _, size = check(spark, [(7, "hot text " * 20)] * 3000 + [(i, f"text {i} " * 20) for i in range(3001)])
    mean = sum(size.values()) / 24
    assert set(size) == set(range(24)) and all(abs(x - mean) < 0.02 * mean for x in size.values())
    check(spark, [(1, "long " * 100_000), (2, "a"), (3, "b")])


def test_names_of_its_own(spark):
    df = spark.createDataFrame([(i, f"t{i}", i, "mine", i) for i in range(50)], "doc_id bigint, text string, a int, __b string, fine int")
    got = sharding.shard(df, shards=3).collect()
    assert {(x.a, x["__b"], x.fine) for x in got} == {(i, "mine", i) for i in range(50)}


def test_small(spark):
    assert check(spark, [])[0] == []
    check(spark, [(1, "a")])
    check(spark, [(1, "a"), (1, "a"), (2, None)], shards=3)
