import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from almanack.llm import conversations, queries
from almanack.llm.conversations import END, Piece

COLS = "conv_id bigint, turn bigint, role string, text string, kind string, gid int"
LAST = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def cheapest(letters):
    """Least (cost, audit) over all edits, by plain recursion on whole strings."""

    @cache
    def best(i, state, left):
        found = [(0, "", ())] if i == len(letters) and state in "-a" else []
        to = "a" if state == "u" else "u"
        if left:
            c, e, r = best(i, to, left - 1)
            found.append((c + 2, "I" + e, (to, *r)))
        if i < len(letters):
            kind, fault = letters[i]
            c, e, r = best(i + 1, state, 2)
            found.append((c + 3, "D" + e, r))
            if fault != "gone":
                cut = int(fault == "cut")
                if kind == to or kind == "s" and state == "-":
                    c, e, r = best(i + 1, kind, 2)
                    found.append((c + cut, "K" + e, (kind, *r)))
                c, e, r = best(i + 1, to, 2)
                found.append((c + 2 + cut, "R" + e, (to, *r)))
        return min(found, default=(10**9, "", ()))

    return best(0, "-", 2)


def brute(rows):
    out = {}
    by = {}
    for conv, turn, role, text in damaged(rows):
        by.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    for conv in {r[0] for r in rows}:
        line = sorted(by.get(conv, []))
        turns = [t for has, t, *_ in line if has]
        n, seen, letters = {"blank": 0, "gone": 0, "cut": 0}, set(), []
        for _, _, role, text in line:
            ends = LAST.findall(text)
            fault = "blank" if not ends else "gone" if (role, text) in seen else "cut" if ends[-1] not in ".!?" else "fine"
            seen.add((role, text))
            n[fault] = n.get(fault, 0) + 1
            letters.append((role[:1], "gone" if fault == "blank" else fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
        cost, audit, roles = cheapest(tuple(letters))
        said, at, k = [], 0, 0
        for e in audit:
            if e == "I":
                said.append(("user" if roles[k] == "u" else "assistant") + ":")
            elif e != "D":
                said.append((line[at][2] if e == "K" else "user" if roles[k] == "u" else "assistant") + ":" + line[at][3])
            at, k = at + (e != "I"), k + (e != "D")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["gone"], n["cut"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def some(seed, convs=120):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randint(0, 9)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ["user", "assistant"][t % 2]
            role = "system" if t == 0 and r.random() < 0.4 else r.choice([None, "tool", "", "uncle", "s"]) if r.random() < 0.05 else role
            text = r.choice(["Yes.", "No!", "same.", "open", "end? ", " \n", "", None, f"é {r.random()}.", "a.\n\v"])
            rows.append((c if c else None, t * r.choice([1, 1, 1, 3]) if r.random() > 0.05 else None, role, text))
    return rows


def run(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(*x, "mine", 1) for x in rows], COLS).repartition(3)
    monkeypatch.setattr(queries, "_t", lambda *_: df)
    return {x[0]: tuple(x)[1:] for x in queries.op12_conversation_repair(spark, "").collect()}


def test_pieces_against_plain_recursion():
    r = random.Random(1)
    for _ in range(1500):
        letters = "".join(r.choice("suaxSUAX0123uauaua") for _ in range(r.randint(0, 7)))
        fault = {c: "fine" if c in conversations.KINDS else "cut" if c in conversations.CUT else "gone" for c in conversations.KIND}
        cost, audit, _ = cheapest(tuple((conversations.KIND[c], fault[c]) for c in letters))
        assert Piece(letters, None).solved(0)[:2] == (cost, audit)
        assert min(Piece(letters, tuple(0 if s == e else conversations.NEVER for s in range(4))).cost(0, 0, 2) + END[e] for e in range(4)) == cost
    assert Piece("uA" * 20_000, None).solved(0)[0] == 20_000


@pytest.mark.parametrize("size", [1, 2, 4, 1024])
def test_pieces_of_any_size_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "PIECE", size)
    rows = some(size)
    assert run(spark, rows, monkeypatch) == brute(rows)


def test_long_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 16)
    monkeypatch.setattr(conversations, "BLOCK", 7)
    r = random.Random(2)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "tool"]), r.choice([f"{t}.", f"{t}", "same."])) for t in range(120)] + [(2, 5, "user", "again.")] * 50 + [(2, 6, "assistant", "yes.")] + [(3, 1, "user", "word " * 50_000 + ".")]
    assert run(spark, rows, monkeypatch) == brute(rows)


def test_messages_have_the_roles(spark):
    df = spark.createDataFrame([(*x, "mine", 1) for x in some(9, 60)], COLS)
    said = {}
    for x in sorted(conversations.repaired(df).messages.collect(), key=lambda x: (x.conv, x.piece, x.nth)):
        said[x.conv] = said.get(x.conv, "") + x.role[0]
    assert said and all(re.fullmatch("(s?(ua)+)?", x) for x in said.values())


def test_small(spark, monkeypatch):
    assert run(spark, [], monkeypatch) == {}
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, gone, "user", "Dropped."), (2, None, None, None), (None, None, "user", "Hi.")]
    got = run(spark, rows, monkeypatch)
    assert got == brute(rows) and got[1] == (0,) * 6 + ("", hashlib.sha256().hexdigest())
