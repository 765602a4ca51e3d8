import datetime as dt

from almanack.operators.sinks import Book
from almanack.schema import as_events
from almanack.streaming import incremental


def test_master_grows_by_what_is_new(spark, tmp_path):
    def put(n, *titles):
        rows = spark.createDataFrame([(t, "Pune", "Meetup", f"https://x.test/{t}", dt.datetime(2026, 10, 10)) for t in titles], "title string, city string, platform string, url string, start timestamp_ntz")
        as_events(rows).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.append_new(incremental.event_stream(spark, str(tmp_path / "in")), book, str(tmp_path / "cp"), lambda: dt.datetime(2026, 10, n)).awaitTermination()

    book = Book(spark, str(tmp_path / "book"))
    put(1, "alpha concert gala", "beta opera duo")
    put(2, "beta opera duo", "gamma choir trio")
    out = book.read("master").orderBy("serial").collect()
    assert [(x.serial, x.added_on.day) for x in out] == [(1, 1), (2, 1), (3, 2)]


def test_windows_sessions_and_breakers(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 10, 10, 12) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([("a", at(0), True), ("a", at(5), True), ("a", at(90), True), ("b", at(1), True), ("b", at(2), False), ("z", at(1000), False)], "host string, at timestamp, refused boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", incremental.arrivals(stream, "at", "host"), "complete"), ("s", incremental.sessions(stream, "at", "host"), "complete"), ("b", incremental.open_breakers(stream), "update")):
        df.writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(x.n for x in spark.table("t_w").where("host = 'a'").collect()) == [1, 2]
    assert sorted(x.n for x in spark.table("t_s").where("host = 'a'").collect()) == [1, 2]
    assert {x.host: x.open for x in spark.table("t_b").collect()} == {"a": True, "b": False, "z": False}
