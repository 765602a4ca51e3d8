"""Operators over plain listing tables: windows, runs, cross-tabs, anti-joins, enrichment, robots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.urls import robots_pattern
from almanack.plans.steps import own_names, written


def not_in_master(new: DataFrame, master: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new that master has by none of the keys: one anti join for each, never one join on an OR, which would be a nested loop."""
    return reduce(lambda rows, k: rows.join(master.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti"), keys, new)


def first_added(rows: DataFrame, index: DataFrame, key: str = "identity", when: str = "added_on") -> DataFrame:
    """rows with the date they were first added; of repeated index rows the last counts."""
    last = index.groupBy(key).agg(F.max_by(when, "seq").alias(when))
    return rows.join(last, key, "left")


def enriched(listing: DataFrame, detail: DataFrame, key: str, columns: list[str], prefer_detail: bool = True) -> DataFrame:
    """Left outer by key: a detail's values win, or fill gaps only."""
    names = [F.col(c).alias(f"__{c}") for c in columns]
    out = listing.join(detail.select(key, *names), key, "left")
    pick = (lambda c: F.coalesce(f"__{c}", c)) if prefer_detail else (lambda c: F.coalesce(c, f"__{c}"))
    return out.withColumns({c: pick(c) for c in columns}).drop(*(f"__{c}" for c in columns))


def fallback(rows: DataFrame, links: Column, detail: DataFrame, key: str, url: str = "url") -> DataFrame:
    """For each row the detail of the first of its further links that has one (links: array; the first link is its own)."""
    asked = rows.select(key, F.posexplode(links).alias("pos", url)).where("pos > 0")
    found = asked.join(detail, url)
    return found.groupBy(key).agg(F.min_by(F.struct(*detail.columns), "pos").alias("d"), F.min("pos").alias("pos")).select(key, "pos", "d.*")


def nearest_first(rows: DataFrame, source: str, start: str, budget: int, tie: str) -> DataFrame:
    """The `budget` earliest rows of each source, undated ones last."""
    order = Window.partitionBy(source).orderBy(F.asc_nulls_last(start), tie)
    return rows.withColumn("queue", F.row_number().over(order)).where(F.col("queue") <= budget)


def runs_of(rows: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """rows with `streak`, how many bad rows in a row end here (0 after a good one): gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(bad, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__island", island)
    inside = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum(F.when(bad, 1).otherwise(0)).over(inside)).drop("__island")


def breaker(rows: DataFrame, key: str, order: list[str], bad: Column, after: int = 3) -> DataFrame:
    """For each key when its breaker opened (the first row that ends `after` bad ones), its bad rows and its longest streak."""
    seen = runs_of(rows, key, order, bad)
    return seen.groupBy(key).agg(F.min(F.when(F.col("streak") >= after, F.col(order[0]))).alias("opened"), F.count_if(bad).alias("refused"), F.max("streak").alias("longest"))


def crosstab(rows: DataFrame, by: str, column: str, values: list[str], totals: bool = False) -> DataFrame:
    """Counts of values by row label, 0 where there are none; with totals a column `total` and a row 'Total'."""
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    if not totals:
        return rows.groupBy(by).agg(*cells)
    out = rows.where(F.col(column).isin(values)).rollup(by).agg(F.grouping(by).alias("__all"), *cells, F.count(F.lit(1)).alias("total"))
    return out.withColumn(by, F.when(F.col("__all") == 1, "Total").otherwise(F.col(by))).drop("__all")


def counts_by(rows: DataFrame, array: str, name: str) -> DataFrame:
    return rows.select(F.explode(array).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def fill_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, rows, rate) of each column, one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns))
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns)))
    return one.select("rows", parts.alias("p")).select("p.field", "p.filled", "rows", F.round(F.when(F.col("rows") > 0, F.col("p.filled") / F.col("rows")).otherwise(0.0), 4).alias("rate"))


def serials(rows: DataFrame, order: list[Column], start: int = 0) -> DataFrame:
    """rows with a gapless serial in the given order (which should be total). The rows are ranged over partitions by the whole order and written, counted, and numbered in each partition from
    its offset, so no task holds a city or the table; only a row for each partition is gathered."""
    part, before, n = own_names(rows, "part", "before", "n")
    ranged = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "serials")
    size = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    offset = size.withColumn(before, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(part, before)
    number = F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col(before) + start
    return ranged.join(F.broadcast(offset), part).withColumn("serial", number.cast("bigint")).select(*(c for c in rows.columns if c != "serial"), "serial")


def bands(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `band`, whether a row is the first of its group in the order, and `in_group`, how many the group has: one aggregate that combines before the shuffle, and a join with its few rows."""
    (first,) = own_names(rows, "first")
    heads = rows.groupBy(group).agg(F.min(F.struct(*order)).alias(first), F.count(F.lit(1)).alias("in_group"))
    return rows.join(heads, group).withColumn("band", F.struct(*order) == F.col(first)).drop(first)


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, rule, allow) that hold for an agent, from robots files (host, text): the groups that name it (a part of its name will do), else those for any."""
    lines = files.select("host", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    lines = lines.where(F.contains("line", F.lit(":"))).select("host", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    own = Window.partitionBy("host").orderBy("pos")  # the lines of one file
    opens = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(own) != "user-agent", F.lit(True))
    lines = lines.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(own)).where("group > 0")
    names = lines.where("key = 'user-agent'").select("host", "group", F.lower("value").alias("name"))
    rank = F.when((F.col("name") != "*") & F.contains(F.lit(agent.lower()), F.col("name")), 2).when(F.col("name") == "*", 1).otherwise(0)
    groups = names.groupBy("host", "group").agg(F.max(rank).alias("rank")).where("rank > 0")
    best = groups.groupBy("host").agg(F.max("rank").alias("rank"))
    groups = groups.join(best, ["host", "rank"])
    rules = lines.where("key in ('allow', 'disallow') and value != ''").select("host", "group", F.col("value").alias("rule"), (F.col("key") == "allow").alias("allow"))
    return rules.join(groups, ["host", "group"]).select("host", "rule", "allow").distinct()


def robots(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path) with allowed: of their host's rules (host, rule, allow) the longest that fits decides, allow wins ties, no rule allows. Rules meet rows by host; a rule without * and $
    is a plain prefix, and only the others are patterns."""
    own = rules.groupBy("host").agg(F.collect_list(F.struct("rule", "allow")).alias("__rules"))  # one file's rules

    def fits(r: Column) -> Column:
        return F.when(r.rule.rlike(r"\*|\$$"), F.regexp_like("path", robots_pattern(r.rule))).otherwise(F.startswith("path", r.rule))

    best = F.array_max(F.transform(F.filter("__rules", fits), lambda r: F.struct(F.length(r.rule).alias("n"), r.allow.alias("allow"))))
    return rows.join(own, "host", "left").withColumn("allowed", F.coalesce(best.allow, F.lit(True))).drop("__rules")


def newest(rows: DataFrame, key: str, when: str) -> DataFrame:
    """The newest row of each key: what an upsert into a keyed table leaves. An aggregate, so it combines before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), when).alias("r")).select(key, "r.*")


def fresh(cache: DataFrame, when: str, now: Column, seconds: int) -> DataFrame:
    return cache.where(F.col(when) >= now - F.make_dt_interval(secs=F.lit(seconds)))


#: Marks of pages that refuse: anywhere; on a small page of an error; on a tiny page of any answer.
STRONG = ["cf-chl-", "cf_chl_opt", "/cdn-cgi/challenge-platform", "_incapsula_resource", "px-captcha", "captcha-delivery.com", "geo.captcha-delivery", "perimeterx", "challenges.cloudflare.com/turnstile"]
WEAK = [
    "access denied", "you don't have permission to access", "attention required! | cloudflare", "just a moment...", "request unsuccessful", "please verify you are a human", "are you a robot", "unusual traffic",
    "enable javascript and cookies to continue", "checking your browser", "bot detection", "too many requests",
]
CHALLENGE = ["just a moment...", "attention required! | cloudflare", "checking your browser", "please verify you are a human", "are you a robot", "request unsuccessful"]


def looks_blocked(status: Column, body: Column) -> Column:
    """Whether an answer is a refusal: by its status, by a strong mark in its first 60,000 characters, by a weak one on an error page under 25,000, or by a challenge on another page under 8,000."""
    body = F.coalesce(body, F.lit(""))
    head, size = F.lower(F.substring(body, 1, 60_000)), F.length(body)
    has = lambda marks: reduce(lambda a, b: a | b, (F.contains(head, F.lit(m)) for m in marks))
    return status.isin(401, 403, 429) | has(STRONG) | ((status >= 400) & (size < 25_000) & has(WEAK)) | ((status < 400) & (size < 8_000) & has(CHALLENGE))


def source_stats(events: DataFrame, requests: DataFrame, discovered: DataFrame, most_errors: int = 25) -> DataFrame:
    """A row for each source: how many events it found (discovered: source, n), how many of the kept ones it lists, its pages read and failed by kind, and its distinct errors, at most `most_errors` of
    them. requests: (source, kind listing or detail, ok, rendered, error, host_off: why its host was switched off)."""
    kept = events.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    found = discovered.groupBy("source").agg(F.sum("n").alias("discovered"))
    told = lambda c: F.slice(F.array_sort(F.collect_set(F.nullif(c, F.lit("")))), 1, most_errors)
    read = requests.groupBy("source").agg(
        F.count_if((F.col("kind") == "detail") & F.col("ok")).alias("details_read"), F.count_if((F.col("kind") == "detail") & ~F.col("ok")).alias("details_failed"), F.count_if((F.col("kind") == "listing") & F.col("ok")).alias("listings_read"),
        F.count_if((F.col("kind") == "listing") & F.col("ok") & F.col("rendered")).alias("listings_rendered"), told("error").alias("errors"), told("host_off").alias("blocked"),
    )
    rows = found.join(read, "source", "full").join(kept, "source", "left")
    numbers = ["discovered", "details_read", "details_failed", "listings_read", "listings_rendered", "kept"]
    none = F.array().cast("array<string>")
    return rows.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), *(F.coalesce(c, none).alias(c) for c in ("errors", "blocked")))


def failed_sources(stats: DataFrame) -> DataFrame:
    """Sources of source_stats() that cannot be trusted to have nothing: a host was switched off, or there were errors and no event."""
    return stats.where((F.size("blocked") > 0) | ((F.size("errors") > 0) & (F.col("discovered") == 0))).select("source")


def run_totals(events: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: events, those with a checked link, and the pages that were read."""
    pages = stats.agg(F.coalesce(F.sum(F.col("listings_read") + F.col("details_read")), F.lit(0)).alias("pages"))
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_if("link_verified").alias("verified")).crossJoin(F.broadcast(pages))  # one row each
