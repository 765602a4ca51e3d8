"""python -m almanack EVENTS BOOK --window 1m [--cities Pune,Mumbai] [--sources a,b] [--pages DETAILS] [--find TERM] [--dry-run]: one run over a stored event table, or over stored listing pages, (Parquet) into a book of
tables. EVENTS has event columns, or source, city, place, url and html of listing pages; --pages names stored detail pages (source, url, final_url, html). Options come from --settings (JSON) where they are not given."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from almanack.functions.places import CITIES
from almanack.operators.sinks import Book
from almanack.operators.tables import failed_sources, source_stats
from almanack.plans import extraction, pipeline
from almanack.schema import as_events
from almanack.sources import profiles

VERSION = "0.2"
#: What a settings file may hold; other keys in it are passed over.
SETTINGS = {"window": "1m", "first": "", "last": "", "cities": "", "sources": "", "tier_basis": "min", "include_online": False, "include_undated": False, "city_tabs": False, "summary": False, "keep_backups": 15}


def settings(path: str | None) -> dict:
    """The settings of a JSON file over the defaults; an unreadable file is an error."""
    if not path:
        return dict(SETTINGS)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    if not isinstance(told, dict):
        raise ValueError(f"no settings in {path}")
    return SETTINGS | {k: v for k, v in told.items() if k in SETTINGS}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 2: wrong options; 3: nothing found and a source failed, so nothing was written."""
    p = argparse.ArgumentParser(prog="almanack", description=__doc__)
    p.add_argument("events")
    p.add_argument("book")
    p.add_argument("--settings")
    p.add_argument("--save-settings", metavar="FILE")
    p.add_argument("--window", choices=sorted(pipeline.PRESETS))
    p.add_argument("--from", dest="first")
    p.add_argument("--to", dest="last")
    p.add_argument("--cities")
    p.add_argument("--sources")
    p.add_argument("--tier-basis", dest="tier_basis")
    p.add_argument("--include-online", dest="include_online", action="store_true", default=None)
    p.add_argument("--include-undated", dest="include_undated", action="store_true", default=None)
    p.add_argument("--city-tabs", dest="city_tabs", action="store_true", default=None)
    p.add_argument("--summary", action="store_true", default=None)
    p.add_argument("--pages", default="", help="stored detail pages")
    p.add_argument("--requests", default="", help="stored request log (source, kind, ok, rendered, error, host_off)")
    p.add_argument("--find", default="")
    p.add_argument("--diagnose", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--today", default=dt.date.today().isoformat())
    p.add_argument("--version", action="version", version=f"almanack {VERSION}")
    a = p.parse_args(args)
    log = logging.getLogger("almanack")
    log.setLevel(logging.DEBUG if a.verbose else logging.INFO)
    try:
        s = settings(a.settings)
        s |= {k: v for k in SETTINGS if (v := getattr(a, k, None)) is not None}
        if a.save_settings:
            with open(a.save_settings, "w", encoding="utf-8") as f:
                json.dump(s, f, indent=1, sort_keys=True)
        today = dt.date.fromisoformat(a.today)
        first, last = pipeline.window(s["window"], today, s["first"], s["last"])
        listed = lambda x: [c.strip() for c in (x.split(",") if isinstance(x, str) else x) if c.strip()]
        params = pipeline.RunParams(first, last, listed(s["cities"]) or [name for name, _, _ in CITIES], s["tier_basis"], s["include_online"], s["include_undated"])
        keys = listed(s["sources"]) or None
        profiles.chosen(keys)  # unknown names
    except (ValueError, OSError) as problem:
        log.error("%s", problem)
        return 2
    spark = spark or SparkSession.builder.appName("almanack").getOrCreate()
    rows = spark.read.parquet(a.events)
    if "html" in rows.columns:
        rows = extraction.all_listed(rows, today, keys)
    elif keys is not None:
        rows = rows.where(F.col("source").isin(keys))
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.xxhash64(*[c for c in ("platform", "source_id", "url", "city", "title") if c in rows.columns]))
    events = pipeline.written(as_events(rows, "ord"), "run-events")
    more = None
    if a.pages:
        more = pipeline.written(extraction.all_details(spark.read.parquet(a.pages), events, today, keys), "run-details")
    kept, left = pipeline.calendar(events, params, more)
    kept = pipeline.written(kept, "run-kept")
    if a.find:
        pipeline.watched(kept.select("title", "city", F.lit("kept").alias("reason")).unionByName(left.select("title", "city", "reason")), a.find).show(truncate=False)
    n, reasons = kept.count(), {r["reason"]: r["count"] for r in left.groupBy("reason").count().collect()}
    log.info("%s events from %s to %s; left out: %s", n, first, last, reasons)
    stats = None
    if a.requests:
        stats = pipeline.written(source_stats(kept, spark.read.parquet(a.requests), events.groupBy("source").agg(F.count(F.lit(1)).alias("n"))), "run-stats")
        failed = sorted(r.source for r in failed_sources(stats).collect())  # one row a source
        if failed:
            log.warning("failed sources: %s", ", ".join(failed))
        if failed and not n:
            log.error("nothing was found; the tables stay as they are")
            return 3
    if a.dry_run or not n:
        return 0
    book = Book(spark, a.book)
    book.create()
    now = dt.datetime.combine(today, dt.time())
    if s["keep_backups"]:
        book.keep_backups("master", int(s["keep_backups"]))
    added = book.append_to_master(kept, now)
    book.rebuild_rolling(kept, by_city=s["city_tabs"], window=(first, last))
    if s["summary"]:
        book.summarise(kept)
    if a.diagnose and stats is not None:
        book.health(events, stats).show(100, truncate=False)
    made = ["rolling", *(["by_city"] if s["city_tabs"] else []), *(["by_tier", "by_activity", "by_platform"] if s["summary"] else []), "health", "page_dump"]
    book.drop_stale(made)
    book.log_run(run_at=now, first=first.isoformat(), last=last.isoformat(), events=n, added=added)
    book.report({"events": n, "added": added, "left_out": reasons})
    return 0


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    raise SystemExit(main())
