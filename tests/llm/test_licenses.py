import random
from difflib import SequenceMatcher

from almanack.llm import licenses

MIT = licenses.TEMPLATES[[x[0] for x in licenses.TEMPLATES].index("MIT") + 1][1]


def scan(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id bigint, text string, license string").repartition(2)
    return {x.doc_id: x for x in licenses.scan(df, **more).collect()}


def test_every_template_is_found_in_any_surroundings(spark):
    texts = [f"prose before\n{t}\nprose after" for _, t, _ in licenses.TEMPLATES] + [f"some words, {t.upper()} and more words" for _, t, _ in licenses.TEMPLATES]
    got = scan(spark, texts)
    for i, (name, _, _) in enumerate(licenses.TEMPLATES * 2):
        assert name in got[i].licenses.split(","), (name, texts[i], got[i])


def test_wording_decides(spark):
    got = scan(spark, ["Licensed under CC BY 3.0.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 4.", "no license to speak of", MIT.replace("free of charge", "at no charge"), MIT[: len(MIT) // 2]])
    assert [got[i].license for i in range(6)] == [None, "GPL-2.0-only", None, None, "MIT", None]
    assert got[4].n_differ > 0 and got[0].n_candidates == 1


def test_long_notice_over_several_lines(spark):
    words = MIT.split()
    text = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    assert scan(spark, [text])[0].licenses == "MIT"


def test_every_template_wrapped_at_each_word(spark):
    texts, want = [], []
    for name, t, _ in licenses.TEMPLATES:
        words = t.split()
        for i in range(1, len(words)):
            one, two = " ".join(words[:i]), " ".join(words[i:])
            texts += [f"{one}\n{two}", f"{'prose ' * 100}{one}\n    # {two} {'prose ' * 100}"]
            want += [name] * 2
    got = scan(spark, texts)
    assert [(texts[i], got[i].licenses, got[i].n_confirmed) for i, name in enumerate(want) if (got[i].licenses, got[i].n_confirmed) != (name, 1)] == []


def test_neighbours_stay_apart(spark):
    got = scan(spark, ["Released under the MIT License.\nno license to speak of", "Released under the MIT License. Licensed under CC\nBY 4.0.", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.1."], spans=True)
    assert [(got[i].n_candidates, got[i].n_confirmed, got[i].licenses) for i in range(3)] == [(2, 1, "MIT"), (1, 2, "CC-BY-4.0,MIT"), (1, 0, "")]
    twice = "\n".join(MIT.split()[i] for i in range(len(MIT.split()))) + "\n"
    assert scan(spark, [twice * 2])[0].n_confirmed == 2


def test_odd_rows(spark):
    got = scan(spark, [None, "", "plain", "license " * 5000, "Released under the MIT License.\n" * 3], spans=True)
    assert [(got[i].n_candidates, got[i].license) for i in range(3)] == [(0, None)] * 3
    assert (got[3].n_candidates, got[3].n_confirmed) == (1, 0)
    assert got[4].n_confirmed == 3 and [x.start for x in got[4].candidates] == [0, 32, 64]
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_ranking_decides(spark, monkeypatch):
    """Texts on which several templates lie, within what may differ: the one that saves most is given, and without the ranking another one is."""
    by = lambda name, n: [t for x, t, _ in licenses.TEMPLATES if x == name and len(t) > n][0]
    names = ["AGPL-3.0-or-later", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "BSD-2-Clause", "BSD-3-Clause"]
    texts = [by(x, 100) for x in names] + ["Licensed under the Apache License, Version 2.0 and so on", by("Apache-2.0", 100), "// SPDX-License-Identifier: MIT-0"]
    want = [*names, "Apache-2.0", "Apache-2.0", "MIT-0"]
    got = scan(spark, texts)
    assert [(got[i].licenses, got[i].n_differ) for i in range(len(texts))] == [(x, 0) for x in want]
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert [scanner.scan(t)[0][1] for t in texts] == want
    monkeypatch.setattr(licenses.Scanner, "reduced", lambda self, block, number: (1000, 1000))
    blind = licenses.Scanner(licenses.TEMPLATES)
    assert [blind.scan(t)[0][1] for t in texts] != want
    monkeypatch.setattr(licenses.Scanner, "reduced", lambda self, block, number: (0, 1000))
    assert all(not licenses.Scanner(licenses.TEMPLATES).scan(t)[0][1] for t in texts)


def test_common_notices(spark):
    got = scan(spark, ["# SPDX-License-Identifier: MIT", "Licensed under the GPL-3.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: GPL-2.0-only+", "SPDX-License-Identifier: BSD-3-Clause-Clear"])
    assert [got[i].license for i in range(5)] == ["MIT", "GPL-3.0-only", "CC-BY-4.0", None, None]


def brute(text):
    """Names of the licenses that lie at any place of the text: all templates by all places, words compared one by one; of two at one place the one with more words less twice what differs, then the first by name."""
    have, found = licenses.words(text), []
    for name, t, differ in licenses.TEMPLATES:
        want = licenses.words(t)
        most = int(differ * len(want))
        for lo in range(len(have)):
            if not most and have[lo : lo + len(want)] == want:
                found.append((len(want), lo, lo + len(want), name))
            elif most and have[lo : lo + 1] == want[:1]:
                m = [x for x in SequenceMatcher(None, have[lo : lo + len(want) + most], want, autojunk=False).get_matching_blocks() if x.size]
                ends = [(len(want) - 2 * sum(x.size for x in m[:k]) + m[k - 1].a + m[k - 1].size, m[k - 1].a + m[k - 1].size) for k in range(1, len(m) + 1)]
                d, end = min(ends, default=(len(want), 0))  # the end with the fewest differences
                if d <= most:
                    found.append((len(want) - 2 * d, lo, lo + end, name))
    ahead = lambda x, y: (-y[0], y[3]) < (-x[0], x[3])
    return sorted({x[3] for x in found if not any(ahead(x, y) and y[1] < x[2] and x[1] < y[2] for y in found)})


def test_against_brute_force(spark):
    r, texts = random.Random(5), []
    prose = lambda n: " ".join(r.choice(["balo", "keru", "nimo", "salu", "the", "software", "work", "terms"]) for _ in range(n))
    for _ in range(60):
        parts = [prose(r.choice([0, 3, 200]))]
        for _ in range(r.choice([1, 2, 3])):
            _, t, differ = r.choice(licenses.TEMPLATES)
            w = t.split()
            if differ:
                for i in r.sample(range(1, len(w)), r.choice([0, 2, 20])):
                    w[i] = "zzz"
            elif r.random() < 0.2:
                w.insert(r.randrange(1, len(w)), "zzz")
            parts += [r.choice([" ", "\n"]).join(w), prose(r.choice([1, 40]))]
        texts.append(r.choice([" ", "\n", ". "]).join(parts))
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        assert (got[i].licenses.split(",") if got[i].licenses else []) == brute(t), t


def test_long_line_and_equal_rows(spark):
    r = random.Random(6)
    prose = [r.choice(["balo", "keru", "nimo", "salu"]) + str(r.randint(0, 99)) for _ in range(60_000)]
    texts = []
    for n in (1_000, 5_000, 20_000, 60_000):
        half = n // 2
        texts.append(" ".join([*prose[:half], "Released under the MIT License.", *prose[half:n]]))
    got = scan(spark, [*texts, texts[0], texts[0]])
    assert [got[i].licenses for i in range(6)] == ["MIT"] * 6 and got[4] == got[5].__class__(**{**got[5].asDict(), "doc_id": 4})


def test_templates_that_tie_rank_by_name(spark):
    same = [("B-1.0", "Released under one license.", 0.0), ("A-1.0", "Released under one license.", 0.0)]
    assert scan(spark, ["Released under one license."], templates=same)[0].license == "A-1.0"
