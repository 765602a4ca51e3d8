"""Listings as a stream: files of events come in, the master grows by what is new; page requests come in, hosts are switched off and on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from almanack.operators.sinks import Book
from almanack.schema import EVENT


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).parquet(folder)


def append_new(stream: DataFrame, book: Book, checkpoint: str, clock: Callable[[], dt.datetime]) -> StreamingQuery:
    """Each batch appends what no earlier batch added, also if it was deleted from the master since; a batch that is run again adds nothing."""
    return stream.writeStream.foreachBatch(lambda rows, _: book.append_to_master(rows, clock())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, when: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows in tumbling windows of event time; rows later than the watermark are left out."""
    timed = stream.withColumn("__at", F.col(when).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(stream: DataFrame, when: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = stream.withColumn("__at", F.col(when).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.session_window("__at", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def open_breakers(requests: DataFrame, after: int = 3) -> DataFrame:
    """(host, streak, open) of a stream of requests (host, at, refused) by host state: a run of `after` refusals opens the breaker, a success closes it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("at")
        for refused in rows["refused"]:
            streak = streak + 1 if refused else 0
        state.update((int(streak),))
        yield pd.DataFrame({"host": [key[0]], "streak": [streak], "open": [streak >= after]})

    return requests.groupBy("host").applyInPandasWithState(step, "host string, streak long, open boolean", "streak long", "update", GroupStateTimeout.NoTimeout)
