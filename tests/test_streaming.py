from lodeframe.streaming import events as ev


def test_numbers_have_no_gaps_and_nothing_twice(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    first = spark.createDataFrame([(1, 7, 10.0), (2, 7, 20.0), (3, 8, 5.0)], "event_id long, user_id long, ts double")
    first.write.parquet(src)
    for more in ([(4, 7, 30.0), (2, 7, 20.0)], [(5, 8, 1.0)]):
        ev.follow(ev.stream_of(spark, src, first), log, str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame(more, first.schema).write.mode("append").parquet(src)
    ev.follow(ev.stream_of(spark, src, first), log, str(tmp_path / "cp")).awaitTermination()
    rows = {(r.user_id, r.seq): r.event_id for r in spark.read.parquet(log).collect()}
    assert rows == {(7, 1): 1, (7, 2): 2, (7, 3): 4, (8, 1): 3, (8, 2): 5}
    assert [r.seq for r in ev.tail(spark.read.parquet(log), "user_id", 7, 1).collect()] == [2, 3]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    src, log, cp = str(tmp_path / "in"), str(tmp_path / "log"), tmp_path / "cp"
    like = "event_id long, user_id long, ts double"
    for batch in ([(1, 7, 10.0), (2, 8, 20.0)], [(3, 7, 5.0), (1, 7, 10.0)]):
        spark.createDataFrame(batch, like).write.mode("append").parquet(src)
        ev.follow(ev.stream_of(spark, src, spark.createDataFrame([], like)), log, str(cp)).awaitTermination()
    # As if the driver had been lost before it noted that the last batch was done.
    done = max((p for p in (cp / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    done.unlink()
    (cp / "commits" / f".{done.name}.crc").unlink(missing_ok=True)
    spark.createDataFrame([(4, 7, 1.0)], like).write.mode("append").parquet(src)
    ev.follow(ev.stream_of(spark, src, spark.createDataFrame([], like)), log, str(cp)).awaitTermination()
    assert sorted((r.user_id, r.seq, r.event_id) for r in spark.read.parquet(log).collect()) == [(7, 1, 1), (7, 2, 3), (7, 3, 4), (8, 1, 2)]
