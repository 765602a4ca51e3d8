import random
import zlib

from pyspark.sql import functions as F

from almanack.llm import language, quality

VOCABULARY = {"xx": ["balo", "keru", "nimo", "salu", "toka"], "yy": ["straß", "wurch", "gelt", "durft", "schon"]}


def corpus(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice([*VOCABULARY])
        rows.append((i, " ".join(r.choice(VOCABULARY[lang]) + r.choice(["", "a", "en"]) for _ in range(r.choice([1, 5, 40]))), lang))
    return rows


ODD = [(None, "balo keru", "xx"), (9000, None, "xx"), (9001, "", None), (9002, "123 !!", None), (9003, "Balo", None), (9003, "Balo", None), (9004, "é" * 40000, None)]


def test_language(spark):
    rows = corpus() + ODD
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id bigint, text string, lang string, score string").repartition(3)
    model = language.train(df, per_lang=150)
    out = language.predict(df, model).withColumn("held_out", language.held_out()).collect()
    assert len(out) == len(rows)
    want = {i: lang for i, _, lang in corpus()}
    held = [x for x in out if x.doc_id in want and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert held and all(x.held_out for x in held)
    assert sum(x.lang_pred == want[x.doc_id] for x in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and (x.lang_pred in model.langs or x.lang_pred == "und") for x in out)
    assert {x.lang_pred for x in out if x.doc_id in (9000, 9001, 9002)} == {"und"}
    kept = language.accepted(df, model)
    assert kept.columns == df.columns
    ids = {x.doc_id for x in kept.collect()}
    assert not ids & {9000, 9001, 9002} and len(ids & set(want)) >= 0.98 * len(want)


def test_training_does_not_read_held_out_rows(spark):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "lie") for i, t, lang in corpus()]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_lang=150)
    assert model.langs == ["xx", "yy"]


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "balo", None)], "doc_id bigint, text string, lang string")
    assert language.train(df) is None
    assert [x.lang_pred for x in language.predict(df, None).collect()] == ["und"]
    none = df.where(F.lit(False))
    assert language.predict(none, language.train(none)).count() == 0 and quality.scores(none, quality.train(none, none.select("doc_id", F.lit(1).alias("quality")))).count() == 0


def test_quality_sample_is_bounded_by_documents(spark):
    """Ids that many rows repeat count once."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:12]
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in ids for k in range(300 if i in ids[:2] else 1)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id bigint, quality int")
    got, _ = quality._examples(docs, labels, 5)
    assert got.num_rows <= 10


def test_quality(spark):
    r = random.Random(3)
    texts = []
    for i in range(500):
        good = i % 4 != 0
        words = [r.choice(VOCABULARY["xx"]) for _ in range(r.choice([5, 60]))]
        texts.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(9000, None), (9001, ""), (None, "x"), (9002, "q " * 30000)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in texts] + [(None, 1, 0), (7, None, 0), (70000, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.scores(docs, quality.train(docs, labels, per_class=120)).collect()
    assert len(out) == 504 and all(0 <= x.score <= 1 for x in out)
    score = {x.doc_id: x.score for x in out}
    held = [(i, q) for i, _, q in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((score[i] >= 0.3) == bool(q) for i, q in held) >= 0.95 * len(held)


def test_dual_descent_separates():
    import numpy as np

    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w, b = quality.dual_descent(rows, np.ones(4), np.array([1, 1, -1, -1]), 10.0, 100, np.random.default_rng(0))
    assert all(np.sign(w[r].sum() + b) == s for r, s in zip(rows, (1, 1, -1, -1), strict=True))


def test_every_language_is_learned(spark):
    rows = [(i * 3 + j, f"{w} {w}{i % 7} {w}", f"l{j}") for i in range(60) for j, w in enumerate(("alpha", "birne", "citron"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.train(df, per_lang=30, max_langs=2, epochs=1).langs == ["l0", "l1", "l2"]
    assert language._sample(df, 30, 2).groupBy("lang").count().where("count > 20").count() == 0


def grams_of(symbols, orders, bits, salt):
    """Buckets by plain integer arithmetic."""
    out, whole = [], (1 << 32) - 1
    for n in orders:
        for i in range(len(symbols) - n + 1):
            h = salt
            for x in symbols[i : i + n]:
                h = ((h ^ x) * 0x9E3779B1) & whole
                h ^= h >> 15
            out.append((((h * 0x85EBCA77) & whole) ^ n) >> (32 - bits))
    return out


def test_language_scores_against_plain_arithmetic(spark):
    import math

    rows = corpus(120) + ODD[:6] + [(5, "Salu, tokaen  é1", "xx")] * 2
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, lang string, `__row` int, rejected int")
    model = language.train(df, per_lang=60, epochs=2)
    got = language.predict(df.select("doc_id", "text"), model, ("doc_id", "text")).collect()
    assert len(got) == len(rows) and language.accepted(df, model).columns == df.columns
    for x in got:
        if not any(c.isalpha() for c in x.text or ""):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
            continue
        low = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in x.text.encode())
        framed = [32, *low, 32]
        framed = [b for i, b in enumerate(framed) if not i or b != 32 or framed[i - 1] != 32]
        ids = grams_of(framed, (1, 2, 3, 4), language.BITS, 1)
        z = [(sum(float(model.weights[i][k]) for i in ids) / len(ids) + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(p)), key=lambda k: p[k])
        assert abs(p[best] / sum(p) - x.score) < 1e-4 and (model.langs[best] == x.lang_pred or sorted(p)[-2] > 0.999)


def test_two_languages_that_tie():
    import numpy as np

    model = language.Model(["aa", "bb"], np.zeros((1 << language.BITS, 2)), np.zeros(2), 1.0, 0.0)
    assert model.langs[int(model.probabilities(np.array([1, 2])).argmax())] == "aa"  # the first by name


def test_quality_scores_against_plain_arithmetic(spark):
    import math

    r = random.Random(9)
    texts = [(i, " ".join(r.choice(VOCABULARY["xx"]) if i % 3 else r.choice("QXZ") * 3 for _ in range(12)), i % 3 > 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t, 0.5, "q") for i, t, _ in texts] + [(900, None, 0.5, "q"), (3, texts[3][1], 0.5, "q")], "doc_id bigint, text string, score double, quality string")
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in texts] * 2 + [(4, 0), (4, 1)], "doc_id bigint, quality int")  # repeated labels, and one document with both
    model = quality.train(docs, labels, per_class=60)
    got = quality.scores(docs, model).collect()
    assert len(got) == 152
    kinds = lambda w: sum({1 if 97 <= b < 123 else 2 for b in w.encode()}) | min(int(math.log2(len(w))), 5) << 7
    plain = {None: math.nan}
    for i, t, _ in texts:
        words = t.split()
        codes = [kinds(w) | (k > 0 and w == words[k - 1]) << 6 for k, w in enumerate(words)]
        seen = {*grams_of([*t.encode()], (1, 2, 3), quality.BITS, 2), *grams_of(codes, (1, 2, 3, 4), quality.BITS, 3)}
        plain[i] = 1 / (1 + math.exp(-(model.slope * (sum(float(model.weights[k]) for k in seen) + model.bias) + model.shift)))
    plain[900] = 1 / (1 + math.exp(-(model.slope * model.bias + model.shift)))
    assert all(abs(x.score - plain[x.doc_id]) < 1e-9 for x in got)


def test_dual_descent_reaches_the_optimum():
    """Against the primal: no small step away from the weights lowers the squared hinge loss."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    y, values, cost = np.where(rng.random(60) < 0.5, 1, -1), rng.standard_normal(12), 0.5
    w, b = quality.dual_descent(rows, values, y, cost, 2000, np.random.default_rng(0))
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = values[r], 1
    loss = lambda v: 0.5 * v @ v + cost * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    own = np.r_[w, b]
    assert all(loss(own) <= loss(own + s * 1e-2 * np.eye(13)[k]) + 1e-6 for k in range(13) for s in (1, -1))
