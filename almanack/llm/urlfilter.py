"""URL filters: rules first, then link-graph propagation over hosts.

Hosts are nodes, links between pages of different hosts are weighted edges. Trust is personalised PageRank from the hosts whose pages rules
allow, distrust the same over reversed edges from the hosts whose pages rules block; seeds weigh by their pages. A host is blocked when its share of
distrust, distrust / (trust + distrust), is above `threshold`; a host that neither reaches is allowed. All of it is DataFrame work: edges
and seeds are summed before they are shuffled, and each round's scores are a written table.

A link is an href attribute, quoted or not, outside comments, scripts and styles; its host ends where a quote, white space or `>` does at the latest.

Cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; null html has no links; relative links and links
within a host are no edges; a link whose host is empty is dropped; html of any length is read whole; repeated pages count each for itself; an empty table gives no rows; only page_id,
url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
Rules = list[tuple[str, str, str]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(tail, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (nulls: none fits). The list is a parameter and becomes one CASE."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


#: Parts of a page that hold no links (Java and RE2 alike).
SILENT = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)"
#: Absolute links.
LINK = r"(?i)[\s\"'/]href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]*)"


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) of links between different hosts; pages has host and html."""
    link = F.explode(F.regexp_extract_all(F.regexp_replace("html", SILENT, " "), F.lit(LINK), F.lit(1)))
    links = pages.where(F.contains(F.col("html"), F.lit("//"))).select(F.col("host").alias("src"), link.alias("to"))
    dst, _ = host_and_path(F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")))
    return links.select("src", dst.alias("dst")).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float, close: float) -> DataFrame:
    """(host, s): personalised PageRank, the seeds (host, s) being shares; what reaches a host without links out is not handed back. Rounds go on until
    the scores move by no more than `close`; each moves at most `damping` of what the one before moved."""
    start = written(seeds.select("host", (F.col("s") * (1 - damping)).alias("s")), "rank-seeds")
    out = written(edges.join(edges.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", (damping * F.col("w") / F.col("all")).alias("w")), "rank-edges")
    now = start
    while True:
        moved = now.join(out, now.host == out.src).select(F.col("dst").alias("host"), (F.col("s") * F.col("w")).alias("s"))
        new = written(start.unionByName(moved).groupBy("host").agg(F.sum("s").alias("s")), "rank")
        gap = new.alias("x").join(now.alias("y"), "host", "full").agg(F.sum(F.abs(F.coalesce("x.s", F.lit(0.0)) - F.coalesce("y.s", F.lit(0.0))))).first()[0] or 0.0
        now = new
        if gap <= close:
            return now


def judged(pages: DataFrame, rules: Rules, threshold: float = 0.5, damping: float = 0.85, close: float = 1e-9, broadcast_rows: int = 250_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", "host", "path", name.alias("rule"), verdict.alias("own"))
    counts = written(ruled.where("host != '' and own is not null").groupBy("host", "own").agg(F.count(F.lit(1)).cast("double").alias("n")), "rank-counts")
    edges = written(host_edges(pages), "rank-links")

    def seeds(kind: str) -> DataFrame:
        own = counts.where(F.col("own") == kind)
        return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("all")))).select("host", (F.col("n") / F.col("all")).alias("s"))  # one row

    trust = propagated(seeds("allow"), edges, damping, close).select("host", F.col("s").alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagated(seeds("block"), back, damping, close).select("host", F.col("s").alias("distrust"))
    share = F.coalesce("distrust", F.lit(0.0)) / (F.coalesce("trust", F.lit(0.0)) + F.coalesce("distrust", F.lit(0.0)))
    bad = written(trust.join(distrust, "host", "full").where(share > threshold).select("host", F.lit(True).alias("bad")), "rank-blocked")
    few = bad.limit(broadcast_rows + 1).count() <= broadcast_rows
    out = ruled.join(F.broadcast(bad) if few else bad, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
