"""A run's events as a stream that can be taken up after any of them and ends when the run does.

A Python data source over a log of numbered events: the offset is the last number given
out, so a reader that was cut off goes on with the next one, and a batch that is asked for again
has the same events. Numbers have no gaps, so a batch is cut into ranges of them, each
read by a task of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

#: Events that a task reads.
RANGE = 10_000
_EVENTS = "seq long, kind string, body string"


class _Range(InputPartition):
    def __init__(self, after: int, upto: int):
        super().__init__((after, upto))
        self.after, self.upto = after, upto


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"], options["run"]
        self.after, self.terminal = int(options.get("after", "0")), frozenset(json.loads(options["terminal"]))

    def _log(self) -> ds.Dataset:
        files, base = fs.FileSystem.from_uri(self.path)
        return ds.dataset(base, filesystem=files, format="parquet", ignore_prefixes=["_", "."])

    def _of_run(self, after: int, upto: int) -> pc.Expression:
        return (ds.field("run") == self.run) & (ds.field("seq") > after) & (ds.field("seq") <= upto)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last number before a gap, at the most that of the run's first terminal event."""
        found = self._log().to_table(columns=["seq", "kind"], filter=self._of_run(self.after, 1 << 62))
        seq, kind = found.column("seq").to_numpy(), found.column("kind")
        ended = seq[pc.is_in(kind, pa.array(sorted(self.terminal), pa.string())).to_numpy(zero_copy_only=False)]
        seq = np.unique(seq)
        gapless = self.after + int(np.argmin(np.append(seq == self.after + 1 + np.arange(len(seq)), False)))
        return {"seq": min(gapless, int(ended.min())) if len(ended) else gapless}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(a, min(a + RANGE, end["seq"])) for a in range(start["seq"], end["seq"], RANGE)]

    def read(self, partition: _Range) -> Iterator:
        scanner = self._log().scanner(columns=["seq", "kind", "body"], filter=self._of_run(partition.after, partition.upto))
        yield from scanner.to_batches()


class RunEvents(DataSource):
    """Options: path of the log (columns run string, seq long, kind string, body string), run, after, terminal (a JSON array of kinds)."""

    @classmethod
    def name(cls) -> str:
        return "lodeframe_run"

    def schema(self) -> str:
        return _EVENTS

    def streamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(dict(self.options))


def feed(spark: SparkSession, path: str, run: str, terminal: list[str], after: int = 0) -> DataFrame:
    """The events of a run after the given one, as a stream: (seq, kind, body), up to the first of a terminal kind."""
    spark.dataSource.register(RunEvents)
    options = {"path": path, "run": run, "terminal": json.dumps(terminal), "after": str(after)}
    return spark.readStream.format("lodeframe_run").options(**options).load()


def message(seq: Column, body: Column) -> Column:
    """A server-sent event: its number as the id, after which a reader asks for more; a body of several lines is several data lines."""
    data = F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n|\r|\n", "\ndata: ")
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\ndata: "), data, F.lit("\n\n"))


def progress(events: DataFrame, terminal: list[str]) -> DataFrame:
    """(run, seq, kind, ended, events) of rows (run, seq, kind): how far each run is, nothing after its first terminal event counted."""
    ends = F.min(F.when(F.col("kind").isin(*terminal), F.struct("seq", "kind")))
    last = events.groupBy("run").agg(ends.alias("end"), F.max(F.struct("seq", "kind")).alias("last"))
    at = F.coalesce("end", "last")
    return last.select("run", at["seq"].alias("seq"), at["kind"].alias("kind"), F.col("end").isNotNull().alias("ended"), at["seq"].alias("events"))


def deliver(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the messages of a feed to a Parquet log, each once, until what there is has been given out."""
    rows = stream.select("seq", message(F.col("seq"), F.col("body")).alias("message"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
