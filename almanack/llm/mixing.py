"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order, null last, take their weights in turn; they share a budget, a multiple of all words, and a source's target stops at a multiple of its own words,
the excess going to the others by weight until none is above (`targets`: each round is one sum over the table of sources). Each source then queues its documents in
a shuffled order, pass after pass, cut into packets of at most `share` of its target, so that a long document neither blocks its source nor overshoots. A packet's virtual
finish time is the words queued up to its end divided by the source's target. All packets are range-sorted by finish time and the mix is cut at
the budget: lower ranges are taken whole, the range that holds the line is summed row by row, and the packet on the line is taken in part.

No source is gathered anywhere: running sums are taken inside ranges of (source, shuffled order), to which the sums of the ranges before are added, and equal rows are counted
before they are dealt as blocks of copies. Nothing but one number a range reaches the driver.

Cases: a null text has no words, and takes none; a null source is a source, the last; equal rows are copies in a row of the queue; documents of one key tie by size and
copy; a table without words gives targets and takes of 0; an empty table no rows; texts of any length are one document in many packets; other columns play no part
and names cannot clash, since only key, source and size are read. Reruns agree, for the order is a hash of seed and key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.common import written

#: Copies of equal rows that are dealt together.
BLOCK = 1000


@dataclass(frozen=True)
class Mix:
    """Weights in turn, the budget as a share of all words, the most passes over a document, the largest packet as a share of its source's target."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    passes: int = 2
    share: float = 0.01
    seed: int = 13


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def ranges(rows: DataFrame, order: list, value: Column) -> DataFrame:
    """rows in ranges of `order`, written, with the range's number (_range) and the value (_v)."""
    return written(rows.withColumn("_v", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-range")


def prefix_sums(rows: DataFrame, order: list, value: Column, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with `name`: the sum of value over the rows before in `order` (which starts with the columns `within`) of the same `within`: sums inside a range, plus those of the
    ranges before, one row a range and group."""
    ranged = ranges(rows, order, value)
    sums = ranged.groupBy("_range", *within).agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select(F.col("_range").alias("_of"), *(F.col(c).alias(f"_{c}") for c in within), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")), "mix-starts")
    inside = Window.partitionBy("_range", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn(name, F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_of")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(starts, same).select(*rows.columns, (F.col(name) + F.col("_start")).alias(name))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """sizes (source, source_size) with rank, weight and target. Rounds go on while a share passes its source's limit; the state between rounds is three numbers."""
    ranked = prefix_sums(sizes, [F.col("source").isNull(), "source"], F.lit(1), "rank")
    weight = F.element_at(F.array(*(F.lit(w) for w in mix.weights)), (F.col("rank") % len(mix.weights) + 1).cast("int"))
    ranked = written(ranked.withColumns({"weight": weight.cast("bigint"), "limit": F.col("source_size") * mix.passes}), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("limit") <= F.lit(level) * F.col("weight")
        spent, rest, n = ranked.agg(F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == full or not rest:
            break
        level, full = (mix.budget * total - (spent or 0)) / rest, n
    return written(ranked.withColumn("target", F.when(above, F.col("limit").cast("double")).otherwise(F.lit(level) * F.col("weight"))), "mix-targets")


def queued(docs: DataFrame, mix: Mix, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row for each block of equal documents: doc_id, source, size, block, copies, source_size, target and queued, the words before it in one pass of its source's queue."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    groups = written(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-groups")
    sizes = written(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "mix-sources")
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK))))
    turn = F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("block") > 0, F.col("block").cast("string")))
    blocks = blocks.withColumns({"copies": F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK), "turn": F.md5(turn)}).drop("n")
    line = prefix_sums(blocks, ["source", "turn", "doc_id", "size", "block"], F.col("size") * F.col("copies"), "queued", ("source",))
    goal = targets(sizes, mix).select(F.col("source").alias("_source"), "rank", "source_size", "target")
    return written(line.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "turn"), "mix-queue")


def packets(line: DataFrame, mix: Mix) -> DataFrame:
    """Every document of the queue with its packets, an array of (finish, rank, at, words, pass, start): at is the words of its source before the packet, in all passes, start
    those of the document in this pass. Packets that cannot be reached are left out: the packets that begin before virtual time 1 hold the budget, and the last of them ends
    within one packet of it, so none that begins later than the longest packet after 1 can precede one of them."""
    quantum = F.greatest(F.lit(1), F.floor(F.col("target") * mix.share)).cast("bigint")
    reach = line.where("target > 0").agg(F.max(quantum / F.col("target"))).first()[0] or 0.0
    each = line.withColumns({"quantum": quantum, "copy": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))}).withColumn("before", F.col("queued") + F.col("copy") * F.col("size"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.col("quantum"))

    def cut(turn: Column) -> Column:
        def packet(start: Column) -> Column:
            at, size = F.col("before") + turn * F.col("source_size") + start, F.least(F.col("quantum"), F.col("size") - start)
            fields = {"finish": (at + size) / F.col("target"), "rank": F.col("rank"), "at": at, "words": size, "pass": turn, "start": start}
            return F.struct(*(v.alias(k) for k, v in fields.items()))

        return F.filter(F.transform(starts, packet), lambda p: p["at"] <= F.col("target") * (1 + reach))

    some = (F.col("size") > 0) & (F.col("target") > 0)
    kind = "array<struct<finish:double,rank:bigint,at:bigint,words:bigint,pass:int,start:bigint>>"
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(mix.passes - 1)), cut))
    return each.withColumn("packets", F.when(some, cuts.cast(kind)).otherwise(F.array().cast(kind)))


def line_of(made: DataFrame, budget: int) -> tuple[float, int, int, int] | None:
    """(finish, rank, at) of the packet on which the budget ends, and the words taken of it; None if the packets hold no more than the budget."""
    stream = ranges(made.select(F.explode("packets").alias("p")).select("p.finish", "p.rank", "p.at", "p.words"), ["finish", "rank", "at"], F.col("words"))
    before = 0
    for part, total in sorted(tuple(r) for r in stream.groupBy("_range").agg(F.sum("words")).collect()):
        if before + total >= budget:
            break
        before += total
    else:
        return None
    inside = Window.partitionBy("_range").orderBy("finish", "rank", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = stream.where(F.col("_range") == part).withColumn("sum", F.coalesce(F.sum("words").over(inside), F.lit(0)) + before)
    x = rows.where((F.col("sum") < budget) & (F.col("sum") + F.col("words") >= budget)).first()
    return x["finish"], x["rank"], x["at"], budget - x["sum"]


def mixed(docs: DataFrame, mix: Mix = Mix(), **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document, and packets: those that the mix takes, the last one in part. The mix is all packets by finish, rank, at."""
    line = queued(docs, mix, **columns)
    budget = int(mix.budget * (line.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0))
    made = packets(line, mix)
    last = line_of(made, budget) if budget else None
    taken = F.col("packets")
    if last is not None:
        here = F.struct(*(F.lit(v).cast(k).alias(n) for v, k, n in zip(last, ("double", "bigint", "bigint"), ("finish", "rank", "at"), strict=False)))
        key = lambda p: F.struct(p["finish"], p["rank"], p["at"])
        taken = F.filter(taken, lambda p: key(p) <= here)
        taken = F.transform(taken, lambda p: F.when(key(p) == here, p.withField("words", F.lit(last[3]).cast("bigint"))).otherwise(p))
    out = made.withColumn("packets", taken)
    return out.select("doc_id", "source", "size", "source_size", "target", F.aggregate("packets", F.lit(0).cast("bigint"), lambda s, p: s + p["words"]).alias("taken"), "packets")
