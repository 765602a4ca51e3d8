import datetime as dt

from almanack.__main__ import main
from almanack.operators.sinks import Book


def test_a_run_and_its_repeat(spark, tmp_path, capsys):
    rows = [("Jazz Trio Evening", "Pune", "Meetup", "https://x.test/1", dt.datetime(2026, 10, 10)), ("Opera Gala Dinner", "Pune", "Meetup", "https://x.test/2", dt.datetime(2026, 9, 10))]
    spark.createDataFrame(rows, "title string, city string, platform string, url string, start timestamp_ntz").write.parquet(str(tmp_path / "events"))
    args = [str(tmp_path / "events"), str(tmp_path / "book"), "--today", "2026-10-01", "--find", "opera gala"]
    assert main([*args, "--dry-run"], spark) == 0 and not Book(spark, str(tmp_path / "book")).exists("master")
    assert "outside the window" in capsys.readouterr().out
    assert main(args, spark) == 0 and main(args, spark) == 0
    book = Book(spark, str(tmp_path / "book"))
    assert [x.event_name for x in book.read("master").collect()] == ["Jazz Trio Evening"] and sorted(x.added for x in book.read("run_log").collect()) == [0, 1]
    assert main([*args, "--from", "nonsense"], spark) == 2
