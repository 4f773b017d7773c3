"""Scratch tables and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder.

    The folder is ``spark.checkpoint.dir``. Only where the session has none, as in
    local tests, a temporary folder becomes the checkpoint folder of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            base = own.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_passing: list[list[str]] = []


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Writes df below the shared folder and reads it back, which cuts its lineage.

    Within ``passing`` the table goes with the others at the end, unless it is ``lasting``.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if _passing and not lasting:
        _passing[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables that are written within once all is done; what is still read must be lasting."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; Spark keeps a worker for later tasks, and so at its end what is free goes back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)

    return whole


def rows_of(batch: pa.RecordBatch, *names: str, most: int = 256) -> Iterator[tuple]:
    """The batch's rows, of which few are Python objects at a time."""
    for i in range(0, len(batch), most):
        part = batch.slice(i, most)
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def slices(rows: Iterator[tuple], size, most: int) -> Iterator[list[tuple]]:
    """Lists of consecutive rows whose sizes add up to about ``most`` at the most."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        n = size(row)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held
