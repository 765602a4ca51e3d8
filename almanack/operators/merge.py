"""Merging the rows of one listing: the earliest row leads, later rows fill its gaps (or, preferred, overwrite it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.schema import EVENT

FILLED = ["title", "venue", "address", "organizer", "description", "language", "age_limit", "duration", "image", "status", "date_text", "price_text", "ticket_url"]
UNIONED = ["categories", "performers", "ticket_types", "session_dates", "platforms", "sources"]
ANY = ["is_free", "link_verified", "detail_fetched"]
LEADS = ["url", "source", "platform", "city", "activity_type", "tier", "notes", "register_by_inferred", "end_known"]


def _first(value: Column, order: Column, when: Column, last: bool = False) -> Column:
    return (F.max_by if last else F.min_by)(F.when(when, value), F.when(when, order))


def merged(rows: DataFrame, keys: list[str], order: str = "ord", prefer_later: bool = False) -> DataFrame:
    """One event for each key. Scalars are min_by/max_by aggregates, so they are combined before the shuffle; only lists and the (start, end) pairs,
    which follow from each other, travel as small arrays that are folded in order. `order` must be unique within a key."""
    o = F.col(order)
    aggs: list[Column] = [_first(F.col(c), o, F.col(c) != "", prefer_later).alias(c) for c in FILLED]
    aggs += [F.min_by(c, o).alias(c) for c in LEADS] + [F.bool_or(c).alias(c) for c in ANY]
    aggs += [_first(F.col(c), o, F.col(c).isNotNull(), prefer_later).alias(c) for c in ("register_by", "price_min", "price_max")]
    aggs += [
        F.sort_array(F.collect_list(F.when(F.col("start").isNotNull() | F.col("end").isNotNull(), F.struct(o.alias("o"), "start", "end", "has_time")))).alias("__dates"),
        F.min_by("has_time", o).alias("__timed"), F.min_by("online", o).alias("__online"), F.min(o).alias("__o"),
        F.min(F.when(F.col("venue") != "", o)).alias("__venue"), F.sort_array(F.collect_set(F.when(F.col("online"), o))).alias("__onlines"),
        F.sort_array(F.collect_list(F.when(F.col("source_id") != "", F.struct(o.alias("o"), "source_id", "platform")))).alias("__ids"),
    ]
    aggs += [F.sort_array(F.collect_list(F.when(F.size(c) > 0, F.struct(o.alias("o"), F.col(c).alias("x"))))).alias(f"__{c}") for c in (*UNIONED,)]
    aggs += [F.sort_array(F.collect_list(F.when(F.size("links") > 0, F.struct(o.alias("o"), F.map_entries("links").alias("x"))))).alias("__links")]
    out = rows.groupBy(*keys).agg(*aggs)

    lead = F.lit(prefer_later)
    dates = F.aggregate(
        "__dates",
        F.struct(F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"), F.col("__timed").alias("has_time")),
        lambda a, r: F.when(
            r.start.isNotNull() & (lead | a.start.isNull()),
            F.struct(r.start.alias("start"), F.coalesce(r.end, F.when(a.end >= r.start, a.end)).alias("end"), r.has_time.alias("has_time")),
        ).otherwise(F.struct(a.start.alias("start"), F.coalesce(a.end, r.end).alias("end"), a.has_time.alias("has_time"))),
    )
    ids = F.filter("__ids", lambda r: (r.o == F.col("__o")) | r.platform.isin("") | (r.platform == F.col("platform")))
    later = F.filter("__onlines", lambda x: (x > F.col("__o")) & (lead | F.col("__venue").isNull() | (x < F.col("__venue"))))
    entries = F.flatten(F.transform("__links", lambda r: r.x))
    names = F.array_distinct(F.transform(entries, lambda e: e.key))
    new = {
        "start": dates.start, "end": dates.end, "has_time": dates.has_time,
        "online": F.col("__online") | (F.size(later) > 0),
        "source_id": F.coalesce(F.get(ids, F.lit(0)).source_id, F.lit("")),
        "links": F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(entries, lambda e: e.key == n), F.lit(0)).value)),
    }
    new |= {c: F.coalesce(c, F.lit("")) for c in FILLED}
    new |= {c: F.array_distinct(F.flatten(F.transform(f"__{c}", lambda r: r.x))) for c in UNIONED}
    out = out.withColumns(new)
    return out.select(*(k for k in keys if k not in EVENT.names), *(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields), F.col("__o").alias(order))
