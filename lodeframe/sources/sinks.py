"""Serialising results: exact cells, spreadsheet-safe text, bounded and labelled outputs."""

from __future__ import annotations

import io
import json
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.errors import AnalysisError, require

_SAFE_INTEGER = 2**53 - 1


def formula_safe(text: Column) -> Column:
    """Text that a spreadsheet would run gets a quotation mark in front; plain numbers stay."""
    starts = text.rlike(r"^[\s\x00-\x20]*[=+\-@]")
    number = F.trim(text).rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    return F.when(starts & ~number, F.concat(F.lit("'"), text)).otherwise(text)


def cell(df: DataFrame, name: str) -> Column:
    """A column as exact text: plain decimals, ISO times, nested values as JSON, bytes in hex; NaN and infinities are null."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def needs_text(value: Column) -> Column:
    """Whether an integer is beyond what JSON readers keep exact."""
    return F.abs(value) > _SAFE_INTEGER


def unique_names(names: list[str]) -> list[str]:
    """Repeated names with __2, __3 and so on."""
    out: list[str] = []
    for name in names:
        new, n = name, 2
        while new in out:
            new, n = f"{name}__{n}", n + 1
        out.append(new)
    return out


@dataclass(frozen=True)
class Written:
    path: str
    rows: int
    truncated: bool


def write_csv(df: DataFrame, path: str, max_rows: int | None = None, safe: bool = True, max_bytes: int | None = None) -> Written:
    """Exact cells with a header; with a bound, so many rows and bytes at the most, and whether there were more."""
    out = df.select(*(cell(df, c).alias(c) for c in df.columns))
    if safe:
        out = out.select(*(formula_safe(F.col(f"`{c}`")).alias(c) for c in out.columns))
    truncated, n = False, None
    if max_rows is not None:
        rows = out.limit(max_rows + 1).collect()
        truncated, rows = len(rows) > max_rows, rows[:max_rows]
        if max_bytes is not None:
            total, kept = 0, []
            for r in rows:
                total += sum(len((v or "").encode()) + 1 for v in r)
                if total > max_bytes:
                    truncated = True
                    break
                kept.append(r)
            rows = kept
        n = len(rows)
        out = df.sparkSession.createDataFrame(rows, out.schema)
    out.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
    return Written(path, out.count() if n is None else n, truncated)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_xlsx(df: DataFrame, path: str, max_rows: int = 100_000) -> Written:
    """A workbook of one sheet, made on the driver for results of bounded size; integers beyond 15 digits become text.

    path is absolute, or a URI that Arrow opens.
    """
    text = df.select(*(formula_safe(cell(df, c)).alias(c) for c in df.columns))
    rows = text.limit(max_rows + 1).collect()
    numeric = [isinstance(f.dataType, (T.NumericType,)) for f in df.schema]

    def written(v: str | None, number: bool) -> str:
        if v is None:
            return "<c/>"
        if number and len(v.lstrip("-").replace(".", "")) <= 15:
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    head = "".join(written(c, False) for c in df.columns)
    body = "".join("<row>" + "".join(written(v, n) for v, n in zip(r, numeric, strict=True)) + "</row>" for r in rows[:max_rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row>{head}</row>{body}</sheetData></worksheet>')
    at, name = fs.FileSystem.from_uri(str(path))
    with at.open_output_stream(name) as out:
        out.write(held.getvalue())
    return Written(path, min(len(rows), max_rows), len(rows) > max_rows)


def chart_spec(df: DataFrame, kind: str, x: str, y: str, units: dict[str, str] | None = None, points: int = 1000) -> dict:
    """A checked bar, scatter or pie chart of at most so many points, as plain data."""
    require(kind in ("bar", "scatter", "pie") and {x, y} <= set(df.columns), "unknown_column")
    rows = df.select(cell(df, x).alias("x"), F.col(f"`{y}`").cast("double").alias("y")).limit(points + 1).collect()
    require(len(rows) <= points, "analysis_expansion_limit")
    require(all(r["y"] is not None and abs(r["y"]) < float("inf") for r in rows), "chart_nonfinite_values", AnalysisError)
    return json.loads(json.dumps({"type": kind, "x": [r["x"] for r in rows], "y": [r["y"] for r in rows], "x_title": x, "y_title": y, "unit": (units or {}).get(y)}))


def preview(df: DataFrame, columns: int = 12, rows: int = 100) -> tuple[DataFrame, str]:
    """The first columns and rows, with how many rows there are: exactly, or at least."""
    shown = df.select(*(f"`{c}`" for c in df.columns[:columns]))
    n = shown.limit(rows + 1).count()
    return shown.limit(rows), str(n) if n <= rows else f"at least {rows}"
