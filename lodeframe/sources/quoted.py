"""Quoted CSV read and written in parallel, with every record in its place.

A line end within quotes doesn't end a record, so whether a line begins one depends on all the
quotes before it. Each block of a file (whatever Spark reads as one) says, without knowing that,
what it would do in either case: how many records begin in it, and whether it leaves
the file within quotes. Composing these over the blocks of a file, a row each, gives the case
that holds and the number of records before; then each block cuts its own records. Only records
that cross a block's end travel, to be joined.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.errors import FileError, require
from lodeframe.operators.profile import normalize_headers
from lodeframe.scratch import scratch
from lodeframe.sources.files import COLUMNS, detect_delimiter, peek
from lodeframe.sources.sinks import cell, formula_safe

#: Up to so many blocks (about 100 bytes each) go to the workers with the plan; more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000
ORDINAL = "__ordinal"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line) of UTF-8 files in the order of each block; a line keeps its carriage return."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The parts of a batch that are of one block; lines of a block come one after the other."""
    if batch.num_rows:
        block, file = batch.column("block").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            yield batch.column("file")[a].as_py(), int(block[a]), batch.slice(a, b - a)


def _within(lines: pa.Array, quote: str, inside: int) -> tuple[np.ndarray, int]:
    """Whether each line begins within quotes, and whether the last one ends there."""
    parity = np.cumsum(pc.count_substring(lines, quote).to_numpy(zero_copy_only=False)) + inside
    return np.append(inside, parity[:-1]) % 2 == 1, int(parity[-1]) % 2


def transitions(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, block, odd, outside, inside): whether a block turns the case, and how many records begin in it in either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for file, block, part in _runs(batch):
                at = held.setdefault((file, block), [0, 0, 0])
                began, end = _within(part.column("line"), quote, at[0])
                n = int(began.sum())
                at[0], at[1], at[2] = end, at[1] + len(began) - n, at[2] + n
        if held:
            rows = [(f, b, bool(odd), outside, inside) for (f, b), (odd, outside, inside) in held.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "odd", "outside", "inside"), r, strict=True)) for r in rows])

    return lines.mapInArrow(run, "file string, block long, odd boolean, outside long, inside long")


def placed(blocks: DataFrame) -> DataFrame:
    """(file, block, within, first): the case at a block's begin, and the records that begin before it in its file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cased = blocks.withColumn("within", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    cased = cased.withColumn("records", F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")))
    return cased.select("file", "block", "within", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first"))


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, ordinal, record) of UTF-8 CSV files: ordinals are dense from 0 in each file, a record keeps its line ends but the last.

    A file whose last quote isn't closed is rejected (``csv_quote_open``). A byte-order mark is left out.
    """
    lines = physical_lines(spark, path)
    at = scratch(spark, "csv-blocks")
    transitions(lines, quote).write.parquet(at)
    blocks = spark.read.parquet(at)
    odd = blocks.groupBy("file").agg(F.sum(F.col("odd").cast("int")).alias("n")).where("n % 2 = 1").limit(1).count()
    require(not odd, "csv_quote_open", FileError)
    if blocks.count() <= BROADCAST_BLOCKS:
        joined = lines.join(F.broadcast(placed(blocks)), ["file", "block"])
    else:
        # The shuffle brings a block's lines together; their numbers bring back their order.
        joined = lines.withColumn("at", F.monotonically_increasing_id()).join(placed(blocks).hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "at")
    kind = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the block, and the lines of its record that isn't ended yet

        def rows(found: list[tuple], file: str, block: int) -> pa.RecordBatch:
            ordinals, whole, texts = zip(*found, strict=True)
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(ordinals, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(whole), pa.array(texts, pa.string())], schema=kind)

        def close() -> Iterator[pa.RecordBatch]:
            """What is open at a block's end goes to the block that began it; nothing else is left of the block."""
            if now is not None and held:
                yield rows([(ordinal, False, "\n".join(held))], *now)

        for batch in batches:
            for file, block, part in _runs(batch):
                if (file, block) != now:
                    yield from close()
                    now, held = (file, block), []
                    inside, ordinal = int(part.column("within")[0].as_py()), int(part.column("first")[0].as_py()) - 1
                    foreign = bool(inside)  # the lines are still those of another block's record
                began, inside = _within(part.column("line"), quote, inside)
                found = []
                for start, line in zip(began.tolist(), part.column("line").to_pylist(), strict=True):
                    if not start:
                        if held:
                            found.append((ordinal, not foreign, "\n".join(held)))
                        foreign, held, ordinal = False, [], ordinal + 1
                    held.append(line)
                if not inside and held:
                    found.append((ordinal, not foreign, "\n".join(held)))
                    held = []
                    foreign = False
                if found:
                    yield rows(found, file, block)
        yield from close()

    cut = joined.select("file", "block", "line", "within", "first").mapInArrow(run, "file string, ordinal long, block long, whole boolean, record string")
    parts = cut.where("NOT whole").groupBy("file", "ordinal").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
    whole = cut.where("whole").select("file", "ordinal", "record").unionByName(parts.select("file", "ordinal", F.array_join("parts.record", "\n").alias("record")))
    ended = F.regexp_replace(F.when(F.col("ordinal") == 0, F.regexp_replace("record", "^\\uFEFF", "")).otherwise(F.col("record")), "\\r$", "")
    return whole.select("file", "ordinal", ended.alias("record"))


def cells(record: Column, names: list[str], sep: str = ",", quote: str = '"') -> Column:
    """A record as a struct of texts: missing cells and empty ones are null, surplus ones are left out."""
    ddl = ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in names)
    return F.from_csv(record, ddl, {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true", "mode": "PERMISSIVE", "nullValue": "", "columnNameOfCorruptRecord": "__corrupt"})


def table(spark: SparkSession, path: str, names: list[str] | None = None, sep: str | None = None) -> DataFrame:
    """The rows of a CSV file as text columns, and ORDINAL, their order: whatever the file's size, no task reads it whole.

    Without names the first record that has a value is the header, and what is before it isn't data. A
    folder of files needs names and a separator; ordinals then count in each file.
    """
    first = 0
    if names is None or sep is None:
        head = peek(spark, path).decode("utf-8-sig", "ignore")
        sep = sep or detect_delimiter(head)
    if names is None:
        for first, row in enumerate(csv.reader(io.StringIO(head, newline=""), delimiter=sep), 1):  # noqa: B007
            if any(x.strip() for x in row):
                break
        else:
            raise FileError("csv_empty")
        names = normalize_headers(row)
    require(len(names) <= COLUMNS, "too_many_columns", FileError)
    rows = records(spark, path).where(F.col("ordinal") >= first)
    return rows.select((F.col("ordinal") - first).alias(ORDINAL), cells(F.col("record"), names, sep).alias("c")).select(ORDINAL, "c.*")


def csv_record(texts: list[Column], sep: str = ",") -> Column:
    """A record of texts, quoted where it must be; null is empty."""
    special = f'[{sep}"\\r\\n]'
    quoted = [F.when(t.rlike(special), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in (F.coalesce(x, F.lit("")) for x in texts)]
    line = F.concat_ws(sep, *quoted)
    # A record of one empty cell would be an empty line.
    return F.when(line == "", '""').otherwise(line) if len(texts) == 1 else line


def write_canonical(df: DataFrame, path: str, order: str = ORDINAL, end: str = "\n", safe: bool = False) -> None:
    """A UTF-8 CSV with a header and all rows in their order: the folder's parts one after the other are the file."""
    names = [c for c in df.columns if c != order]
    guard = formula_safe if safe else lambda c: c
    rows = df.select(F.col(order).alias("o"), csv_record([guard(cell(df, c)) for c in names]).alias("value"))
    head = df.sparkSession.range(1).select(F.lit(None).cast(rows.schema["o"].dataType).alias("o"), csv_record([guard(F.lit(c)) for c in names]).alias("value"))
    both = head.unionByName(rows).repartitionByRange("o").sortWithinPartitions("o")
    both.select("value").write.option("lineSep", end).text(path)


def export(original: str, df: DataFrame, path: str, order: str = ORDINAL) -> tuple[str, bool]:
    """(where the file is, whether it differs): the original itself, unless a cell or a name must be made safe for spreadsheets."""
    names = [c for c in df.columns if c != order]
    unsafe = lambda c: ~c.eqNullSafe(formula_safe(c))
    named = df.sparkSession.range(1).where(F.array_contains(F.array(*(unsafe(F.lit(n)) for n in names)), True)).count()
    changes = named or df.where(F.array_contains(F.array(*(unsafe(cell(df, n)) for n in names)), True)).limit(1).count()
    if not changes:
        return original, False
    write_canonical(df, path, order, "\r\n", safe=True)
    return path, True


def fingerprint(df: DataFrame) -> tuple[int, str, str]:
    """(rows, two sums of hashes) of all cells with their order: equal tables have equal ones, however they are parted."""
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    return tuple(df.agg(F.count("*"), *sums).first())


CATALOG = "path string, state string, code string, rows long, columns array<string>, missing array<long>, working string, fingerprint string, at timestamp"


def ingest(spark: SparkSession, path: str, catalog: str, folder: str, parts: list[str] | None = None) -> str:
    """Takes a CSV file in, or the parts of a canonical copy with these names: ``ready`` with its profile and a canonical working copy, or ``failed`` with a code.

    The catalog gets a row before and a row after; what is read of a source is its latest row, so it turns ready at once, and never
    without its copy: that is written aside, read back and compared before.
    """

    def publish(state: str, code: str | None = None, rows: int | None = None, columns: list | None = None, missing: list | None = None, working: str | None = None, mark: str | None = None) -> str:
        row = spark.createDataFrame([(path, state, code, rows, columns, missing, working, mark, None)], CATALOG).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(catalog)
        return state

    publish("processing")
    try:
        if parts:
            # Only the first part has the header; order goes by the parts' names and places.
            read = records(spark, path).select(F.struct("file", "ordinal").alias(ORDINAL), cells(F.col("record"), parts).alias("c"))
            header = F.coalesce(F.concat_ws(",", *(F.col(f"c.`{n}`") for n in parts)), F.lit("")) == ",".join(parts)
            data = read.where(~((F.col(f"{ORDINAL}.ordinal") == 0) & header)).select(ORDINAL, "c.*")
        else:
            data = table(spark, path)
        names = [c for c in data.columns if c != ORDINAL]
        working = f"{folder.rstrip('/')}/{scratch(spark, 'working').rsplit('/', 1)[1]}"
        write_canonical(data, working)
        mark = fingerprint(data)
        copy = records(spark, working)  # its parts' records, whose order the parts' names give
        require(copy.count() == mark[0] + 1, "working_copy_differs", FileError)
        missing = data.agg(*(F.count_if(F.col(f"`{c}`").isNull()) for c in names)).first()
    except FileError as e:
        return publish("failed", e.code)
    return publish("ready", None, mark[0], names, list(missing), working, "-".join(map(str, mark)))


def latest(spark: SparkSession, catalog: str) -> DataFrame:
    """The state that each source is in."""
    turn = F.struct("at", F.col("state") != "processing")
    return spark.read.schema(CATALOG).parquet(catalog).groupBy("path").agg(F.max_by(F.struct("state", "code", "rows", "columns", "missing", "working", "fingerprint"), turn).alias("s")).select("path", "s.*")
