"""Sinks: an append-only master with its index, a rebuilt rolling calendar, a run log, a keyed page cache. Tables are named by the versions of one commit log, so readers see all of a
step or nothing; folders under the root that no version names (a user's tables, older books) are read as they are."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.functions import money, places, text
from almanack.functions.classify import ACTIVITIES, TIERS, UNKNOWN_TIER
from almanack.operators.commits import Conflict, Log
from almanack.operators.resolve import unseen_titles
from almanack.operators.tables import counts_by, crosstab, fresh, serials
from almanack.schema import buy_link, identity

CALENDAR = ["event_name", "activity_type", "tier", "start_date", "end_date", "city", "venue", "organizer", "price_range", "platforms", "notes", "register_by", "link", "region"]
#: The fixed value of a listing's region.
REGION = "India"
#: The rolling calendar shows no price and no organiser.
ROLLING = [c for c in CALENDAR if c not in ("price_range", "organizer")]
#: Kinds of the tables that a new book starts with.
TABLES = {
    "master": ", ".join(["serial bigint", *(f"{c} {'date' if c in ('start_date', 'register_by') else 'string'}" for c in CALENDAR), "added_on date"]),
    "master_index": "identity string, link string, match_key string, event_name string, city string, start_date date, added_on date, seq double",
}


def calendar_rows(events: DataFrame) -> DataFrame:
    """Display columns: TBC where nothing is known, venue with its locality, 'Multiple dates' for runs without a reliable end."""
    place = places.locality(F.col("address"), F.col("venue"))
    named = (place != "") & ~F.contains(F.lower("venue"), F.lower(place))
    tbc = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("TBC"))
    return events.select(
        F.col("title").alias("event_name"), "activity_type", "tier", F.to_date("start").alias("start_date"),
        F.when(~F.col("end_known"), "Multiple dates").otherwise(F.date_format(F.coalesce("end", "start"), "yyyy-MM-dd")).alias("end_date"), "city",
        tbc(F.when(named & (F.col("venue") != ""), F.concat_ws(", ", "venue", place)).otherwise(F.col("venue"))).alias("venue"), tbc(F.col("organizer")).alias("organizer"),
        tbc(money.format_price_range(F.col("price_min"), F.col("price_max"), F.col("is_free"))).alias("price_range"), F.array_join("platforms", " / ").alias("platforms"), "notes",
        F.to_date("register_by").alias("register_by"), buy_link().alias("link"), F.lit(REGION).alias("region"), identity().alias("identity"), text.match_key(F.col("title"), F.col("city"), F.col("start")).alias("match_key"),
    )


class Book:
    """The tables master, master_index, rolling, run_log and others under a root that every executor reaches. Tables that are made anew are named in a register; a name that is not in it belongs
    to the user and is left alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._hadoop(name)
        return name in self.log.state()[1] or fs.exists(path)

    def read(self, name: str) -> DataFrame | None:
        if (rows := self.log.read(name)) is not None:
            return rows
        fs, path = self._hadoop(name)
        return self.spark.read.option("mergeSchema", "true").parquet(self._path(name)) if fs.exists(path) else None

    def create(self) -> None:
        """The empty tables of a new book; those that are there stay."""
        for name, kinds in TABLES.items():
            if not self.exists(name):
                self.replace(name, self.spark.createDataFrame([], kinds))

    def generated(self) -> list[str]:
        """Names of the tables that this engine made anew and may replace."""
        return sorted(r.name for r in self.read("_generated").collect()) if self.exists("_generated") else []  # a row a table

    def publish(self, name: str, rows: DataFrame, by: list[str] | None = None) -> str:
        """Replace a generated table; beside a user's table of that name under a name with a number. Returns the name."""
        own, free, k = self.generated(), name, 1
        while free not in own and self.exists(free):
            k += 1
            free = f"{name}_{k}"
        new = {free: {"parts": [self.log.written(free, rows, by)]}}
        if free not in own:
            new["_generated"] = {"parts": [self.log.written("_generated", self._names([*own, free]))]}
        self.log.change(lambda entries: entries.update(new))
        return free

    def drop_stale(self, keep: list[str]) -> list[str]:
        """Delete generated tables that are not to be kept; returns their names."""
        own = self.generated()
        gone = [x for x in own if x not in keep]
        if gone:
            register = self.log.written("_generated", self._names([x for x in own if x in keep]))

            def edit(entries: dict) -> None:
                for x in gone:
                    entries.pop(x, None)
                entries["_generated"] = {"parts": [register]}

            self.log.change(edit)
            for x in gone:  # of an older book
                fs, path = self._hadoop(x)
                fs.delete(path, True)
        return gone

    def _names(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in names], "name string")

    def replace(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        """Write aside, then commit: readers see the old table or the new one at every moment. by: columns that become folders."""
        part = self.log.written(name, rows, by)
        self.log.change(lambda entries: entries.update({name: {"parts": [part]}}))

    def append_to_master(self, events: DataFrame, run_at: dt.datetime, tries: int = 8) -> int:
        """Add what no earlier run added (by identity, link, match key, or title on a day in a city), also if it was deleted from the master since. Returns how many. Master and index grow by one
        commit; if another writer comes first, what is new is found again."""
        rows = calendar_rows(events)
        once = rows.groupBy("identity").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "identity")), "start_date").alias("r")).select("identity", "r.*")
        for _ in range(tries):
            base, entries = self.log.state()
            new = self._new_rows(once, run_at)
            batch = self.log.written("batch", new)  # numbered once: both tables are cut from the same rows
            new = self.spark.read.schema(new.schema).parquet(self._path(batch["path"]))
            n = new.count()
            if n:
                index = new.select("identity", "link", "match_key", "event_name", "city", "start_date", "added_on", F.lit(run_at.timestamp()).alias("seq"))
                parts = {"master": self.log.written("master", new.select("serial", *CALENDAR, "added_on")), "master_index": self.log.written("master_index", index)}
                for name, part in parts.items():
                    old = entries.get(name, {"parts": [{"path": name}] if self.exists(name) else []})  # an older book's folder counts as the first part
                    entries[name] = {"parts": [*old["parts"], part]}
            fs, path = self._hadoop(batch["path"])
            fs.delete(path, True)
            try:
                if n:
                    self.log.commit(base, entries)
                return n
            except Conflict:
                continue
        raise Conflict("no end of other writers")

    def _new_rows(self, once: DataFrame, run_at: dt.datetime) -> DataFrame:
        """The rows that the index does not know, numbered on from the master's greatest serial."""
        index = self.read("master_index")
        if index is not None:
            for key in ("identity", "link", "match_key"):
                once = once.join(index.select(key).where(F.col(key) != "").distinct(), key, "left_anti")
            seen = index.select("city", "start_date", text.title_tokens(F.col("event_name")).alias("tokens"))
            mine = once.withColumn("tokens", text.title_tokens(F.col("event_name")))
            once = unseen_titles(mine, seen, ["city", "start_date"]).drop("tokens")
        master = self.read("master")
        last = 0 if master is None else master.agg(F.coalesce(F.max("serial"), F.lit(0))).first()[0]
        order = [places.city_rank(F.col("city")), F.asc_nulls_last("start_date"), F.lower("event_name"), F.col("identity")]
        return serials(once, order, last).withColumn("added_on", F.lit(run_at.date()))

    def rebuild_rolling(self, events: DataFrame, by_city: bool = False, window: tuple[dt.date, dt.date] | None = None) -> None:
        """The calendar city by city in date order. What began before the window stands at its first day, what has no date at its last."""
        rows = calendar_rows(events)
        index = self.read("master_index")
        if index is not None:
            rows = rows.join(index.groupBy("identity").agg(F.max_by("added_on", "seq").alias("added_on")), "identity", "left")
        shown = F.col("start_date")
        if window is not None:
            shown = F.when(shown.isNull(), F.lit(window[1])).otherwise(F.greatest(shown, F.lit(window[0])))
        order = [places.city_rank(F.col("city")), shown.asc_nulls_last(), F.asc_nulls_last("start_date"), F.lower("event_name"), F.col("identity")]
        out = serials(rows, order).join(rows.groupBy("city").agg(F.count(F.lit(1)).alias("in_city")), "city")
        out = out.select("serial", *ROLLING, *(["added_on"] if index is not None else []), "in_city")
        self.publish("rolling", out)
        if by_city:
            self.publish("by_city", out, ["city"])

    def summarise(self, events: DataFrame) -> None:
        """Events by city and tier, by city and activity, and by platform, with totals."""
        tiers = [t for t, _ in TIERS] + [UNKNOWN_TIER]
        self.publish("by_tier", crosstab(events, "city", "tier", tiers, totals=True))
        self.publish("by_activity", crosstab(events, "city", "activity_type", ACTIVITIES, totals=True))
        self.publish("by_platform", counts_by(events, "platforms", "platform"))

    def dump_pages(self, pages: DataFrame, most: dict[str, int] | None = None) -> None:
        """The first pages of each source and kind (pages: source, kind, place, url, html), 60 listings and 12 details unless said otherwise."""
        most = most or {"listing": 60, "detail": 12}
        row = F.row_number().over(Window.partitionBy("source", "kind").orderBy("place", "url"))
        bound = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in most.items() for x in kv)), F.col("kind")), F.lit(0))
        self.publish("page_dump", pages.withColumn("r", row).where(F.col("r") <= bound).drop("r"))

    def health(self, events: DataFrame, stats: DataFrame, per_source: int = 3) -> DataFrame:
        """(source, field, filled, rows, rate, discovered, errors, healthy): which fields the first `per_source` events of each source have, and what its pages gave. A source is healthy if it has events, nothing refused it and titles and starts are there."""
        fields = ["title", "start", "venue", "city", "price_min", "organizer", "description", "url"]
        first = events.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("start"), "url"))).where(F.col("r") <= per_source)
        filled = first.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in fields))
        whole = stats.select("source", "discovered", F.size("errors").alias("errors"), F.size("blocked").alias("refusals")).join(filled, "source", "left")
        healthy = (F.col("discovered") > 0) & (F.col("refusals") == 0) & (F.coalesce("title", F.lit(0)) > 0) & (F.coalesce("start", F.lit(0)) > 0)
        parts = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(c, F.lit(0)).alias("filled")) for c in fields)))
        out = whole.withColumn("healthy", healthy).select("source", parts.alias("p"), F.coalesce("rows", F.lit(0)).alias("rows"), "discovered", "errors", "healthy")
        rate = F.when(F.col("rows") > 0, F.col("p.filled") / F.col("rows")).otherwise(0.0)
        self.publish("health", out.select("source", "p.field", "p.filled", "rows", rate.alias("rate"), "discovered", "errors", "healthy"))
        return self.read("health")

    def log_run(self, **facts) -> None:
        """One row more; newer columns are merged into older logs on reading."""
        kind = {int: "bigint", float: "double", str: "string", bool: "boolean", dt.datetime: "timestamp"}
        schema = ", ".join(f"{k} {kind[type(v)]}" for k, v in facts.items())
        self.spark.createDataFrame([tuple(facts.values())], schema).coalesce(1).write.mode("append").parquet(self._path("run_log"))

    def report(self, facts: dict) -> None:
        self.spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(self._path("last_run"))

    def upsert_pages(self, pages: DataFrame) -> None:
        """The newest row of each url counts (columns: url, ..., fetched_at). What is written grows with these pages, not with the cache."""
        self.log.upsert("pages", pages, "url", "fetched_at")

    def prune_pages(self, before: dt.datetime) -> None:
        """Pages that were fetched before go."""
        self.log.pruned("pages", before.strftime("%Y-%m-%d %H:%M:%S"))

    def cached_pages(self, urls_: DataFrame, now: Column, seconds: int) -> DataFrame | None:
        """The stored pages of these urls that are not older than so many seconds."""
        rows = self.log.looked_up("pages", urls_)
        return None if rows is None else fresh(rows, "fetched_at", now, seconds)

    def keep_backups(self, name: str, keep: int) -> list[str]:
        """Copy a table aside under a numbered name and keep the last `keep`; returns their names."""
        fs, _ = self._hadoop("")
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(""))
        own = sorted(s.getPath().getName() for s in fs.listStatus(top) if s.getPath().getName().startswith(f"backup-{name}-"))
        number = int(own[-1].rsplit("-", 1)[1]) + 1 if own else 1
        self.read(name).write.parquet(self._path(f"backup-{name}-{number:06d}"))
        own.append(f"backup-{name}-{number:06d}")
        for old in own[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(old)), True)
        return own[-keep:]


def evolved(rows: DataFrame, drop: list[str] = (), before: dict[str, tuple[str, str]] | None = None, last: dict[str, str] | None = None) -> DataFrame:
    """A table in a newer shape: columns dropped, new ones (name: (type, column it stands before)) and last ones (name: type) added where missing. Idempotent."""
    columns = [c for c in rows.columns if c not in drop]
    add = {}
    for name, (kind, follower) in (before or {}).items():
        if name not in columns:
            columns.insert(columns.index(follower), name)
            add[name] = F.lit(None).cast(kind)
    for name, kind in (last or {}).items():
        if name not in columns:
            columns.append(name)
            add[name] = F.lit(None).cast(kind)
    return rows.withColumns(add).select(*columns) if add else rows.select(*columns)
