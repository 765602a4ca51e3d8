import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from almanack.llm import infill, queries


def brute(key, text, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.MARKERS):
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows():
    r = random.Random(3)
    odd = [(None, None), (1, None), (2, ""), (3, "<P>x\n"), (4, "a<S>"), (5, "\n\n\n"), (6, "\r\n \n"), (7, "a" * 300 + "\n" + "é" * 50), (7, "a" * 300 + "\n" + "é" * 50), (8, "😀\n" * 40), (9, "<P\n>< S>\n<M")]
    return odd + [(i, "".join(r.choice("ab\n é😀<>PSM") for _ in range(r.randint(0, 60)))) for i in range(10, 300)]


def test_chunks_of_any_size_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string")
    for size in (1, 2, 7, infill.CHUNK):
        got = infill.infilled(df, size=size).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
        assert [(x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got] == [brute(*r) for r in rows()]
        assert [x.back for x in got] == [t or "" for _, t in rows()]


def test_only_the_owning_chunk_is_scanned_again(spark):
    df = spark.createDataFrame([("x\n" * 10 + "y" * 20 + "\n" + "z\n" * 5,)], "text string")
    parts = infill.chunks(F.col("text"), 8)
    counts = infill.counted(parts)
    row = df.select(counts.alias("counts"), *(infill.owner(counts, F.lit(k)).alias(f"r{k}") for k in (1, 4, 5, 11, 15))).first()
    assert sum(row.counts) == 15 and row.counts[:3] == [4, 4, 2]
    assert [tuple(row[f"r{k}"]) for k in (1, 4, 5, 11, 15)] == [(1, 1), (1, 4), (2, 1), (6, 1), (7, 1)]


def test_other_units(spark):
    data = [(i, "  ab cd\n\tef " * (i % 4) + "x") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    for units, pattern in ((infill.WORDS, r"\s*\S+\s*|\s+"), (infill.CHARACTERS, r"(?s).")):
        got = infill.infilled(df, units=units, size=5).collect()
        for x, (key, text) in zip(got, data, strict=True):
            want = re.findall(r"^\s+(?=\S)|\S+\s*|\s+" if units is infill.WORDS else pattern, text)
            n, form, p, m, out = brute(key, text, r"^\s+(?=\S)|\S+\s*|\s+" if units is infill.WORDS else pattern)
            assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == (len(want), form, p, m, out)


def test_very_long_text_clashing_names_and_none(spark):
    text = "line of some words\n" * 200_000
    df = spark.createDataFrame([(1, text, "a", "b", 3)], "doc_id bigint, text string, whole string, `n` string, draw int")
    x = infill.infilled(df).first()
    assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == brute(1, text) and (x.whole, x.draw) == ("a", 3)
    assert infill.infilled(df.limit(0)).collect() == []
    assert {x.form for x in infill.infilled(spark.createDataFrame(rows(), "doc_id bigint, text string"), rate=0).collect()} == {"plain"}


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.op11_fill_in_middle(spark, sf)
    want = c.sql(queries.OP11_SQL)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
