from pyspark.sql import functions as F

from lodeframe.streaming import feed

KIND = "run string, seq long, kind string, body string"


def log(spark, path, rows):
    spark.createDataFrame(rows, KIND).write.mode("append").parquet(path)


def test_a_reader_goes_on_where_it_was_cut_and_ends_with_the_run(spark, tmp_path):
    path, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [("a", i, "step", f"{i}\nmore") for i in range(1, 8)] + [("b", i, "step", "") for i in range(1, 50)]
    log(spark, path, rows)
    seen = lambda: sorted(r.seq for r in spark.read.parquet(out).collect())
    feed.deliver(feed.feed(spark, path, "a", ["done"], after=2), out, cp).awaitTermination()
    feed.deliver(feed.feed(spark, path, "a", ["done"], after=2), out, cp).awaitTermination()
    assert seen() == [3, 4, 5, 6, 7]
    # An event that isn't the next one isn't given before those that it follows; none is given after the run's end.
    log(spark, path, [("a", 9, "done", "x"), ("a", 10, "step", "late")])
    feed.deliver(feed.feed(spark, path, "a", ["done"], after=2), out, cp).awaitTermination()
    assert seen() == [3, 4, 5, 6, 7]
    log(spark, path, [("a", 8, "step", "y")])
    for _ in range(2):
        feed.deliver(feed.feed(spark, path, "a", ["done"], after=2), out, cp).awaitTermination()
    assert seen() == [3, 4, 5, 6, 7, 8, 9]
    assert {r.message for r in spark.read.parquet(out).where("seq = 3 OR seq = 9").collect()} == {"id: 3\ndata: 3\ndata: more\n\n", "id: 9\ndata: x\n\n"}


def test_progress(spark):
    rows = [("a", 1, "step", ""), ("a", 2, "done", ""), ("a", 3, "step", ""), ("b", 1, "step", None)]
    got = feed.progress(spark.createDataFrame(rows, KIND), ["done"]).collect()
    assert {tuple(r) for r in got} == {("a", 2, "done", True, 2), ("b", 1, "step", False, 1)}
    assert feed.progress(spark.createDataFrame(rows, KIND).where(F.lit(False)), ["done"]).collect() == []
