"""Reading delimited text, JSON records, flat Parquet, workbooks and office documents, with their guards.

What is read on the driver is a bounded peek at a file's first bytes, or an archive of
bounded size; rows themselves are read by Spark.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.errors import FileError, require
from lodeframe.operators.profile import normalize_headers

PEEK = 1 << 20
COLUMNS, CELLS, RATIO, ENTRY = 1_000, 1_000_000, 100, 32 << 20


def peek(spark: SparkSession, path: str, n: int = PEEK) -> bytes:
    """The first bytes of a file on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def detect_encoding(head: bytes) -> str:
    """By byte-order mark, else UTF-8 if it decodes, else what the bytes look like."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16")):
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 4:
            return "UTF-8"
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        raise FileError("encoding_unknown") from None
    best = from_bytes(head).best()
    require(best is not None, "encoding_unknown", FileError)
    return best.encoding


def detect_delimiter(text: str) -> str:
    """By the csv module's rules over the first lines, else the most frequent of them, else a comma."""
    require(bool(text.strip()), "csv_empty", FileError)
    try:
        return csv.Sniffer().sniff("\n".join(text.splitlines()[:50]), ",\t;|").delimiter
    except csv.Error:
        n = Counter(c for c in text.splitlines()[0] if c in ",\t;|")
        return n.most_common(1)[0][0] if n else ","


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, headers trimmed and made unlike; a malformed row fails the read."""
    head = peek(spark, path)
    encoding = detect_encoding(head)
    text = head.decode(encoding if encoding != "UTF-8" else "utf-8-sig", "ignore")
    sep = detect_delimiter(text)
    names = normalize_headers(next(csv.reader(io.StringIO(text), delimiter=sep)))
    require(len(names) <= COLUMNS, "too_many_columns", FileError)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"', mode="FAILFAST", nullValue="")


def _pairs(pairs: list) -> dict:
    require(len({k for k, _ in pairs}) == len(pairs), "records_invalid", FileError)
    return dict(pairs)


def parse_records(text: str) -> list[dict]:
    """A non-empty array of flat objects; repeated keys, nesting and non-finite numbers are rejected; numbers stay as written."""
    def bad(_):
        raise FileError("records_invalid")

    try:
        rows = json.loads(text, object_pairs_hook=_pairs, parse_float=str, parse_int=str, parse_constant=bad)
    except json.JSONDecodeError:
        raise FileError("records_invalid") from None
    flat = isinstance(rows, list) and rows and all(isinstance(r, dict) and not any(isinstance(v, (dict, list)) for v in r.values()) for r in rows)
    require(bool(flat), "records_invalid", FileError)
    return rows


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of flat records as text columns, in the order in which keys first come.

    Spark reads the rows; that keys don't repeat can be told from the text alone, so a file
    is also checked as a whole, a file a task.
    """
    df = spark.read.json(path, multiLine=True, primitivesAsString=True, mode="FAILFAST")
    require(not any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) for f in df.schema), "records_invalid", FileError)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: dict[str, None] = {}
            for content in batch.column("content").to_pylist():
                for r in parse_records(content.decode("utf-8-sig")):
                    keys |= dict.fromkeys(r)
            yield pa.RecordBatch.from_arrays([pa.array([list(keys)], pa.list_(pa.string()))], ["keys"])

    keys = list(dict.fromkeys(k for r in spark.read.format("binaryFile").load(path).select("content").mapInArrow(check, "keys array<string>").collect() for k in r["keys"]))
    return df.select(*(f"`{k}`" for k in keys))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Flat columns only."""
    df = spark.read.parquet(path)
    require(len(df.columns) <= COLUMNS, "too_many_columns", FileError)
    require(not any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)) for f in df.schema), "records_invalid", FileError)
    return df


def guard_archive(content: bytes) -> zipfile.ZipFile:
    """Opens an office archive after its checks: no paths out, no repeats, no bombs, macros or document types."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise FileError("xlsx_invalid") from None
    names = [i.filename for i in z.infolist()]
    require(len(set(names)) == len(names) and not any(n.startswith("/") or "\\" in n or ".." in n.split("/") for n in names), "xlsx_unsafe_archive", FileError)
    for i in z.infolist():
        require(i.file_size <= ENTRY, "xlsx_archive_limit", FileError)
        require(i.file_size <= RATIO * max(1, i.compress_size) or i.file_size < 1 << 16, "xlsx_compression_ratio", FileError)
        require(not i.filename.lower().endswith("vbaproject.bin"), "macros_rejected", FileError)
        if i.filename.endswith((".xml", ".rels")):
            require(b"<!DOCTYPE" not in z.read(i)[:4096] and b"<!ENTITY" not in z.read(i)[:4096], "xml_entities_rejected", FileError)
    return z


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_sheets(content: bytes) -> dict[str, list[list[str | None]]]:
    """Rows of text by sheet: the values that formulas had, shared strings, and zero-padded formats kept."""
    z = guard_archive(content)
    read = lambda n: ElementTree.fromstring(z.read(n))
    require("xl/workbook.xml" in z.namelist(), "xlsx_invalid", FileError)
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    pads: list[int] = []
    if "xl/styles.xml" in z.namelist():
        styles = read("xl/styles.xml")
        formats = {e.get("numFmtId"): e.get("formatCode", "") for e in styles.iter() if _local(e.tag) == "numFmt"}
        for group in styles:
            if _local(group.tag) == "cellXfs":
                pads = [len(f) if re.fullmatch("0+", f := formats.get(x.get("numFmtId"), "")) else 0 for x in group]
    targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in read("xl/_rels/workbook.xml.rels")}
    out: dict[str, list[list[str | None]]] = {}
    cells = 0
    for sheet in (e for e in read("xl/workbook.xml").iter() if _local(e.tag) == "sheet"):
        rows = []
        for row in (e for e in read("xl/" + targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]).iter() if _local(e.tag) == "row"):
            values: list[str | None] = []
            for c in row:
                at = _column(c.get("r")) if c.get("r") else len(values)
                values += [None] * (at - len(values))
                texts = {_local(e.tag): e for e in c}
                if c.get("t") == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                else:
                    v = texts["v"].text if "v" in texts else None
                    if v is not None and c.get("t") == "s":
                        v = shared[int(v)]
                    elif v is not None and c.get("t") == "b":
                        v = "true" if v == "1" else "false"
                    elif v is not None and (s := int(c.get("s", 0))) < len(pads) and pads[s] and v.isdigit():
                        v = v.zfill(pads[s])
                values.append(v)
                cells += 1
                require(cells <= CELLS, "xlsx_cell_limit", FileError)
            if any(v not in (None, "") for v in values):
                rows.append(values)
        if rows:
            out[sheet.get("name")] = rows
    require(bool(out), "xlsx_empty", FileError)
    return out


def scan_xlsx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table of text columns a sheet; the first row names them. Workbooks are bounded by the guard."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    out = {}
    for name, rows in xlsx_sheets(bytes(content)).items():
        width = max(map(len, rows))
        names = normalize_headers([*(v or "" for v in rows[0]), *[""] * (width - len(rows[0]))])
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        out[name] = spark.createDataFrame([[*r, *[None] * (width - len(r))] for r in rows[1:]], schema)
    return out


def _text(e, tag: str) -> str:
    return "".join(t.text or "" for t in e.iter() if _local(t.tag) == tag)


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs, headings with their path, and table rows of a word-processing document."""
    z = guard_archive(content)
    require("word/document.xml" in z.namelist(), "invalid_docx", FileError)
    out, path, table = [], [], 0
    body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    for e in body:
        if _local(e.tag) == "p":
            text = _text(e, "t").strip()
            style = next((v for s in e.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
            level = re.match(r"Heading\s*(\d)", style)
            if text and level:
                path = [(n, t) for n, t in path if n < int(level[1])] + [(int(level[1]), text)]
            if text:
                out.append({"kind": "heading" if level else "paragraph", "text": text, "heading": " > ".join(t for _, t in path) or None, "table": None, "row": None, "cells": None})
        elif _local(e.tag) == "tbl":
            table += 1
            for n, row in enumerate(r for r in e if _local(r.tag) == "tr"):
                cells = [_text(c, "t").strip() for c in row if _local(c.tag) == "tc"]
                out.append({"kind": "table_row", "text": " | ".join(cells), "heading": " > ".join(t for _, t in path) or None, "table": table, "row": n, "cells": cells})
    require(bool(out), "empty_document", FileError)
    return out


def pptx_blocks(content: bytes) -> list[dict]:
    """Titles, paragraphs and table rows of slides, in order."""
    z = guard_archive(content)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    require(bool(slides), "invalid_pptx", FileError)
    out = []
    for number, name in enumerate(slides, 1):
        heading, table = None, 0
        for e in ElementTree.fromstring(z.read(name)).iter():
            if _local(e.tag) == "sp":
                title = any(_local(p.tag) == "ph" and p.get("type") in ("title", "ctrTitle") for p in e.iter())
                for p in (x for x in e.iter() if _local(x.tag) == "p"):
                    if text := _text(p, "t").strip():
                        heading = text if title else heading
                        out.append({"kind": "heading" if title else "paragraph", "text": text, "heading": heading, "slide": number, "table": None, "cells": None})
            elif _local(e.tag) == "tbl":
                table += 1
                for row in (x for x in e.iter() if _local(x.tag) == "tr"):
                    cells = [_text(c, "t").strip() for c in row if _local(c.tag) == "tc"]
                    out.append({"kind": "table_row", "text": " | ".join(cells), "heading": heading, "slide": number, "table": table, "cells": cells})
    require(bool(out), "empty_document", FileError)
    return out


_BLOCKS = pa.schema([("path", pa.string()), ("block", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("heading", pa.string()), ("slide", pa.int32()), ("table", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


def scan_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Blocks of the docx or pptx files that path names, a file at a time on the workers.

    A file that its guard rejects, or that has no blocks, is one row with the code as error; an archive's
    entries are bounded by the guard.
    """
    require(kind in ("docx", "pptx"), "file_type_unsupported", FileError)
    read = docx_blocks if kind == "docx" else pptx_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    rows = [{"path": name.as_py(), "block": n} | b for n, b in enumerate(read(content.as_py()))]
                except (FileError, ElementTree.ParseError) as e:
                    rows = [{"path": name.as_py(), "error": e.code if isinstance(e, FileError) else f"invalid_{kind}"}]
                yield pa.RecordBatch.from_pylist(rows, _BLOCKS)

    schema = "path string, block int, kind string, text string, heading string, slide int, table int, row int, cells array<string>, error string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def page(df: DataFrame, order: list[str], offset: int, limit: int, max_bytes: int = 1 << 20) -> tuple[list[dict], bool]:
    """Rows as text from an offset, within a number and bytes; and whether bytes cut them."""
    rows = df.orderBy(*order).offset(offset).limit(min(limit, 500)).select(*(F.col(f"`{c}`").cast("string") for c in df.columns)).collect()
    out, total = [], 0
    for r in rows:
        total += len(json.dumps(r.asDict(), ensure_ascii=False).encode())
        if total > max_bytes:
            return out, True
        out.append(r.asDict())
    return out, False


# What files of an extension start with; text has no mark of its own.
MAGIC = {"pdf": b"%PDF-", "docx": b"PK", "pptx": b"PK", "png": b"\x89PNG", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff", "webp": b"RIFF"}
ARTIFACT_ROWS, ARTIFACT_COLUMNS, ARTIFACT_CHARS = 250_000, 256, 64_000


def validate_upload(name: str, content: bytes, most: int) -> str:
    """The document's kind, if its bytes are what its extension says; else FileError."""
    require(bool(content), "empty_upload", FileError)
    require(len(content) <= most, "upload_too_large", FileError)
    suffix = name.replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix in MAGIC:
        require(content.startswith(MAGIC[suffix]), "file_type_mismatch", FileError)
        if suffix in ("docx", "pptx"):
            guard_archive(content)
        return suffix if suffix in ("pdf", "docx", "pptx") else "image"
    require(suffix in ("txt", "md", "html", "htm"), "file_type_unsupported", FileError)
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise FileError("file_type_mismatch") from None
    page = suffix.startswith("htm")
    marked = not page or re.search(r"(?i)<\s*(?:html|body|p|h[1-6]|div|table)\b", text)
    require("\0" not in text and bool(marked) and (page or not content.startswith(b"PK")), "file_type_mismatch", FileError)
    return "html" if page else suffix


def scan_artifact(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A stored result (csv, json, parquet or xlsx) as text columns, at most ARTIFACT_ROWS rows of it.

    json is {"columns": [...], "rows": [[...], ...]} or an array of flat records. Wider tables and longer cells are rejected.
    """
    require(kind in ("csv", "json", "parquet", "xlsx"), "artifact_format_unsupported", FileError)
    if kind == "json":
        table = spark.read.text(path, wholetext=True).select(F.from_json("value", "columns array<string>, rows array<array<string>>").alias("t"))
        names = table.select("t.columns").first()["columns"]
        if names is None:
            df = scan_json(spark, path)
        else:
            require(len(names) <= ARTIFACT_COLUMNS, "too_many_columns", FileError)
            df = table.select(F.explode("t.rows").alias("r")).select(*(F.get("r", F.lit(i)).alias(n) for i, n in enumerate(normalize_headers(names))))
    elif kind == "xlsx":
        df = next(iter(scan_xlsx(spark, path).values()))
    else:
        df = scan_csv(spark, path) if kind == "csv" else scan_parquet(spark, path)
    require(len(df.columns) <= ARTIFACT_COLUMNS, "too_many_columns", FileError)
    cell = lambda c: F.when(F.length(c) > ARTIFACT_CHARS, F.raise_error(F.lit("artifact_cell_too_large"))).otherwise(c)
    return df.limit(ARTIFACT_ROWS).select(*(cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns))


def inspect_schema(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str, bool]]:
    """(table, position, column, type, nullable) of each table, from their plans alone."""
    return [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema, 1)]
