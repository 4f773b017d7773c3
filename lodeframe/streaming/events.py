"""Run events: gapless numbers for each run, resumable tails, and ingestion that publishes each document once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def sequence(events: DataFrame, run_col: str, ts_col: str, id_col: str) -> DataFrame:
    """Adds seq: 1, 2, ... in each run by time, then id."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run_col).orderBy(ts_col, id_col)))


def tail(events: DataFrame, run_col: str, run, cursor: int, limit: int = 100) -> DataFrame:
    """The next events of a run after the cursor, so many at the most."""
    return events.where((F.col(run_col) == run) & (F.col("seq") > cursor)).orderBy("seq").limit(limit)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a file is below the path; that a batch was begun there isn't enough to read a schema from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(store.exists(at) and store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "*.parquet")))


class Numbering(StatefulProcessor):
    """Numbers the events of a run on from its counter, and leaves out those it has numbered before.

    Counter and numbered ids are kept by run in the state store, so a batch costs what it brings, not what there
    already is. A run's events of one batch are ordered in memory: the trigger's size bounds them.
    """

    def __init__(self, ts_col: str, id_col: str, id_type: str):
        self.ts_col, self.id_col, self.id_type = ts_col, id_col, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")
        self.numbered = handle.getMapState("numbered", f"id {self.id_type}", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = pd.concat(list(rows), ignore_index=True).drop_duplicates(self.id_col)
        given = given[[not self.numbered.containsKey((i,)) for i in given[self.id_col].tolist()]]
        if given.empty:
            return
        given = given.sort_values([self.ts_col, self.id_col], kind="stable").reset_index(drop=True)
        first = self.last.get()[0] if self.last.exists() else 0
        given["seq"] = range(first + 1, first + 1 + len(given))
        for i, seq in zip(given[self.id_col].tolist(), given["seq"].tolist(), strict=True):
            self.numbered.updateValue((i,), (seq,))
        self.last.update((first + len(given),))
        yield given

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which holds more than memory does."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def numbered(source: DataFrame, run_col: str, ts_col: str, id_col: str) -> DataFrame:
    """A stream of events with seq, 1, 2, ... in each run by batch, then time, then id; an event delivered again has none.

    Events without an id are one event; a null run is a run of its own.
    """
    kind = source.schema[id_col].dataType.simpleString()
    schema = T.StructType([*source.schema.fields, T.StructField("seq", T.LongType())])
    return source.groupBy(run_col).transformWithStateInPandas(Numbering(ts_col, id_col, kind), schema, "Append", "None")


def follow(source: DataFrame, path: str, checkpoint: str, run_col: str = "user_id", ts_col: str = "ts", id_col: str = "event_id"):
    """Drains a streaming source into the log at path and stops.

    State and log go by batch number: a batch that is run again, as after a restart, starts from the counters before it
    and isn't added to the log twice.
    """
    with _rocksdb(source.sparkSession):
        return numbered(source, run_col, ts_col, id_col).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest(source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "fingerprint"):
    """Documents in, built rows out, each fingerprint once whatever is delivered again."""

    def publish(batch: DataFrame, _: int) -> None:
        new = build(batch).dropDuplicates([key])
        if _written(batch.sparkSession, path):
            new = new.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums by event time and type, with a watermark; batch frames work alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    by = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """An extension: sessions of users by a gap in event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A directory of Parquet files as a stream."""
    return spark.readStream.schema(like.schema).parquet(path)
