"""Repair of conversation structure by signature deduplication.

Each message becomes one letter for its role and fault, a conversation a string of letters. Long conversations are strings of pieces (`PIECE` messages at most), so that no
task needs a whole one. Each distinct string is solved once, by memoised recursion over (place, state, inserts left), for every state in which it can be entered and for the
costs of the states in which it can be left; the audits come back by a join, a walk over the pieces of each conversation (a row for a piece) picks one of four, and the edits
are replayed on the messages by row number.

A repaired conversation has the roles (system? (user assistant)+)? by their first letters. Edits: Keep, 0; Rerole to user or assistant, 2; Delete, 3, the only one for blank and duplicate
messages; Insert an empty user or assistant message, 2; a truncated message that stays adds 1. Of the cheapest edits those count whose letters come first in ASCII: from one
state no two edits share a letter, so the first letter in which two cheapest lists differ decides, and no lists are kept.

Cases: nulls of role and text are one space, so such a text is blank; null turns come first and make no gaps; a null conv_id is a conversation; messages of one turn are ordered by
role, then text; equal messages are counted before they are exchanged and dealt in blocks of copies, all but the first of them duplicates; texts of any length are one row;
an empty table gives no rows; of other columns nothing is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import written

#: Messages of a piece at most. A power of two, so that pieces never reach over the ranges of row numbers.
PIECE = 1024
#: Copies of equal messages that are dealt together.
BLOCK = 1000
SPACE = " \t\n\x0b\x0c\r"
#: Letters of a message: its role's (x: any other); capital if truncated; a digit if it must go.
KINDS, CUT, GONE = "suax", "SUAX", "0123"
KIND = {c: KINDS[i % 4] for i, c in enumerate(KINDS + CUT + GONE)}
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. Where a role leads, and what a user or assistant message must be there.
STEP = {(0, "s"): 1, **{(s, "u"): 2 for s in (0, 1, 3)}, (2, "a"): 3}
NEXT = (2, 2, 3, 2)
NEVER = 1 << 40
#: Costs of ending a conversation in each state.
END = (0, 4, 2, 0)
STRIDE = 100


@cache
def _edits(letter: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits of one message, in ASCII order."""
    out, cut = [("D", 3, state)], int(letter in CUT)
    if letter not in GONE:
        if (to := STEP.get((state, KIND[letter]))) is not None:
            out.append(("K", cut, to))
        out.append(("R", 2 + cut, NEXT[state]))
    return tuple(out)


class Piece:
    """The cheapest edits of a string of letters. goal: the cost of what follows for each state, None at the end of a conversation (only there may inserts come last; elsewhere they
    come first in the next piece)."""

    def __init__(self, letters: str, goal: tuple[int, ...] | None):
        self.letters, self.goal, self.memo = letters, goal, {}
        for i in range(len(letters), 0, -STRIDE):  # from the end, so that recursion stays shallow
            for state in range(4):
                self.cost(i, state, 2)

    def choices(self, i: int, state: int, left: int) -> list[tuple[str, int, tuple[int, int, int] | None]]:
        """(letter, cost, where it leads), in ASCII order; the empty letter ends the string."""
        insert = [("I", 2, (i, NEXT[state], left - 1))] if left else []
        if i < len(self.letters):
            edits = [(e, c, (i + 1, to, 2)) for e, c, to in _edits(self.letters[i], state)]
            return [edits[0], *insert, *edits[1:]]
        if self.goal is not None:
            return [("", self.goal[state], None)]
        return [("", 0 if state in (0, 3) else NEVER, None), *insert]

    def cost(self, i: int, state: int, left: int) -> int:
        key = i, state, left
        if key not in self.memo:
            self.memo[key] = min(c + (self.cost(*to) if to else 0) for _, c, to in self.choices(*key))
        return self.memo[key]

    def solved(self, state: int) -> tuple[int, str, str, int]:
        """(cost without what follows, edits, the role letter that each leaves or '-', state at the end) if entered in this state."""
        key, cost, audit, roles = (0, state, 2), 0, [], []
        while True:
            best = self.cost(*key)
            edit, c, to = next(x for x in self.choices(*key) if x[1] + (self.cost(*x[2]) if x[2] else 0) == best)
            if to is None:
                return cost, "".join(audit), "".join(roles), key[1]
            cost += c
            audit.append(edit)
            roles.append("-" if edit == "D" else "-sua"[to[1]])
            key = to


def illegal(letters: str) -> int:
    kinds = [KIND[c] for c in letters]
    return sum(a + b not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that crc32(`conv_id:turn`) % 20 asks for: 0 no row, 1 no text, 2 no stops, 3 the row twice, 4 role user."""
    space = F.lit(" ")
    what = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    out = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), what.alias("what")).where("what != 0")
    changed = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(times).alias("time")).drop("time")


def conversation(column: str = "conv_id") -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and the facts of each message, numbered in order (gid) and written. Equal messages are counted, then dealt as blocks, so a range holds few of them."""
    space = F.lit(" ")
    own = rows.select(conversation().alias("conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    counts = own.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK))))
    key = ["conv", "turn", "role", "text", "block"]
    dealt = blocks.repartitionByRange(*key).sortWithinPartitions(*key)
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK)))
    end, first = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)), F.left("role", F.lit(1))
    facts = {
        "kind": F.when(first.isin(*"sua"), first).otherwise("x"), "k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit("role"), "text", "role"),
        "blank": end == "", "open": ~end.isin(*".!?"),
    }
    return written(dealt.withColumns(facts).withColumn("copy", copies).drop("n", "block", "copy").withColumn("gid", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """gid, conv, turn, kind, blank, duplicate, truncated, letter: a duplicate is any but the first message of its conversation, role and text. No text is read."""
    narrow = turns.select("gid", "conv", "turn", "kind", "k1", "k2", "blank", "open")
    firsts = narrow.groupBy("conv", "k1", "k2").agg(F.min("gid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.col("gid") > F.col("first"), F.lit(False))
    out = narrow.join(firsts, ["conv", "k1", "k2"], "left").select("gid", "conv", "turn", "kind", "blank", (~F.col("blank") & again).alias("duplicate"), "open")
    out = out.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("duplicate")).drop("open")
    gone, cut = F.translate("kind", KINDS, GONE), F.translate("kind", KINDS, CUT)
    return written(out.withColumn("letter", F.when(F.col("blank") | F.col("duplicate"), gone).when(F.col("truncated"), cut).otherwise(F.col("kind"))), "turn-faults")


def counts(flagged: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, over turns first, so that a long conversation is summed in many tasks."""
    kinds = ("blank", "duplicate", "truncated")
    turns = flagged.groupBy("conv", "turn").agg(*(F.count_if(k).alias(k) for k in kinds))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    return turns.groupBy("conv").agg(gaps.alias("gaps"), *(F.sum(k).alias(k) for k in kinds))


def _transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for letters in batch["letters"]:
            sides = [Piece(letters, tuple(0 if s == end else NEVER for s in range(4))) for end in range(4)]
            out.append([min(NEVER, side.cost(0, state, 2)) for state in range(4) for side in sides])
        yield pd.DataFrame({"letters": batch["letters"], "costs": out})


def _goals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For pieces of whole conversations in descending order: the costs of what follows, as text ('' at the end)."""
    conv, ahead = None, END
    for batch in batches:
        out = []
        for c, costs in zip(batch["conv"], batch["costs"], strict=True):
            last = c != conv
            if last:
                conv, ahead = c, END
            least = min(ahead)
            out.append("" if last else ",".join(str(x - least) for x in ahead))
            if costs is not None:
                ahead = tuple(min(int(costs[4 * s + e]) + ahead[e] for e in range(4)) for s in range(4))
        yield pd.DataFrame({**{c: batch[c] for c in ("conv", "piece", "start", "letters")}, "goal": out})


def _solutions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for letters, goal in zip(batch["letters"], batch["goal"], strict=True):
            piece = Piece(letters, tuple(map(int, goal.split(","))) if goal else None)
            out.append([dict(zip(("cost", "audit", "roles", "leaves"), piece.solved(s), strict=True)) for s in range(4)])
        yield pd.DataFrame({"letters": batch["letters"], "goal": batch["goal"], "ways": out, "illegal": [illegal(x) for x in batch["letters"]]})


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For pieces of whole conversations in order: the way of the state that the piece before leaves, and the pair of roles over their border."""
    conv, state, before = None, 0, ""
    for batch in batches:
        out = []
        for c, letters, ways, bad in zip(batch["conv"], batch["letters"], batch["ways"], batch["illegal"], strict=True):
            if c != conv:
                conv, state, before = c, 0, ""
            way = ways[state]
            out.append((int(way["cost"]), way["audit"], way["roles"], int(bad) + (bool(before) and KIND[before] + KIND[letters[0]] not in LEGAL)))
            state, before = int(way["leaves"]), letters[-1]
        done = pd.DataFrame(out, columns=["cost", "audit", "roles", "illegal"])
        yield pd.concat([batch[["conv", "piece", "start"]].reset_index(drop=True), done], axis=1)


def solved(flagged: DataFrame) -> DataFrame:
    """conv, piece, start (gid of its first message), cost, audit, roles, illegal of every piece."""
    pieces = flagged.groupBy("conv", F.floor(F.col("gid") / PIECE).alias("piece")).agg(F.min("gid").alias("start"), F.array_sort(F.collect_list(F.struct("gid", "letter"))).alias("all"))
    pieces = written(pieces.withColumn("letters", F.array_join(F.transform("all", lambda x: x["letter"]), "")).drop("all"), "turn-pieces")
    # only a piece at the head of its block of row numbers can have a piece before it, which needs to know what it costs
    later = pieces.where(F.col("start") % PIECE == 0).select("letters").distinct()
    costs = later.mapInPandas(_transfers, "letters string, costs array<bigint>")
    chain = pieces.join(costs, "letters", "left").repartition("conv").sortWithinPartitions("conv", F.desc("piece"))
    goals = written(chain.select("conv", "piece", "start", "letters", "costs").mapInPandas(_goals, "conv string, piece bigint, start bigint, letters string, goal string"), "turn-goals")
    ways = goals.select("letters", "goal").distinct().mapInPandas(_solutions, "letters string, goal string, ways array<struct<cost:bigint,audit:string,roles:string,leaves:int>>, illegal bigint")
    back = goals.join(ways, ["letters", "goal"]).repartition("conv").sortWithinPartitions("conv", "piece")
    return written(back.mapInPandas(_walk, "conv string, piece bigint, start bigint, cost bigint, audit string, roles string, illegal bigint"), "turn-audits")


def replayed(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv, piece, nth (order inside the piece), role, text of every repaired message. Kept messages come back by row number, a key without hot values."""
    each = chosen.select("conv", "piece", "start", "audit", "roles", F.posexplode(F.split("audit", "")).alias("nth", "edit")).where("edit not in ('D', '')")
    each = each.withColumn("before", F.translate(F.substring(F.col("audit"), F.lit(1), F.col("nth")), "I", ""))
    each = each.select("conv", "piece", "nth", "edit", (F.col("start") + F.length("before")).alias("gid"), F.substring(F.col("roles"), F.col("nth") + 1, F.lit(1)).alias("to"))
    role = F.when(F.col("to") == "u", "user").otherwise("assistant")
    new = each.where("edit = 'I'").select("conv", "piece", "nth", role.alias("role"), F.lit("").alias("text"))
    old = each.where("edit != 'I'").join(turns.select("gid", F.col("role").alias("was"), "text"), "gid")
    return old.select("conv", "piece", "nth", F.when(F.col("edit") == "R", role).otherwise(F.col("was")).alias("role"), "text").unionByName(new)


@dataclass(frozen=True)
class Repair:
    """audits: a row for each conversation; messages: the repaired ones, in order of piece and nth."""

    audits: DataFrame
    messages: DataFrame


def repaired(rows: DataFrame) -> Repair:
    """The repair of conversations (conv_id, turn, role, text). audits: conv (see `conversation`), gaps, blank, duplicate, truncated, illegal, cost, audit."""
    turns = ordered(rows)
    flagged = faults(turns)
    chosen = solved(flagged)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    audits = counts(flagged).join(chosen.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), text.alias("audit")), "conv")
    return Repair(audits, replayed(turns, chosen))


def digests(messages: DataFrame) -> DataFrame:
    """conv, sha256 of the repaired `role:text`, newline-joined. A hash takes its bytes in order, so each conversation streams through one task, message by message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, h = None, None
        for batch in batches:
            out = []
            for c, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
                if c != conv:
                    if h is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield pd.DataFrame(out, columns=["conv", "sha256"])
        if h is not None:
            yield pd.DataFrame([(conv, h.hexdigest())], columns=["conv", "sha256"])

    rows = messages.repartition("conv").sortWithinPartitions("conv", "piece", "nth").select("conv", "role", "text")
    return rows.mapInPandas(run, "conv string, sha256 string")
