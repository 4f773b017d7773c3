"""Documents as blocks, blocks as groups, groups as chunks with links between them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.errors import FileError, require

BODY_BYTES, OVERLAP_BYTES = 480, 48


def text_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, kind, text, heading, line, char_start, char_end): a block a line that isn't blank.

    Lines that start with one to six # and a space are headings; a block's heading is the
    path of those above it, joined by " > ". An id names one text.
    """
    parts = F.split(F.col(f"`{text_col}`"), "\n")
    above = Window.partitionBy(F.col(f"`{id_col}`")).orderBy("line")
    lines = df.select(F.col(f"`{id_col}`"), F.posexplode(parts).alias("line", "raw"))
    start = F.coalesce(F.sum(F.length("raw") + 1).over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    lines = lines.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("raw")).where(F.trim("raw", F.lit(" \t\r")) != "")
    level = F.length(F.regexp_extract("raw", r"^(#{1,6})\s+\S", 1))
    lines = lines.withColumns({"level": level, "title": F.trim(F.regexp_replace("raw", r"^#{1,6}\s+", ""))})
    # Per level the latest heading, which counts only if no higher one came after it.
    seen = [F.last(F.when(F.col("level") == i, F.struct("line", "title")), ignorenulls=True).over(above) for i in range(1, 7)]
    lines = lines.withColumns({f"h{i}": s for i, s in enumerate(seen, 1)})
    alive = [F.when(F.col(f"h{i}").isNotNull() & (F.col(f"h{i}.line") >= F.greatest(*(F.coalesce(F.col(f"h{j}.line"), F.lit(-1)) for j in range(1, i)), F.lit(-1), F.lit(-1))), F.col(f"h{i}.title")) for i in range(1, 7)]
    return lines.select(F.col(f"`{id_col}`"), (F.row_number().over(above) - 1).alias("ordinal"), F.when(F.col("level") > 0, "heading").otherwise("paragraph").alias("kind"), F.when(F.col("level") > 0, F.col("title")).otherwise(F.col("raw")).alias("text"), F.nullif(F.concat_ws(" > ", *alive), F.lit("")).alias("heading"), "line", "char_start", "char_end")


_SKIPPED = frozenset("script style iframe object embed svg noscript".split())
_BLOCKS = frozenset("p div li blockquote pre article section header footer main aside td th br ul ol table tr body title nav".split())
_HEADS = {f"h{i}": i for i in range(1, 7)}


class HtmlBlocks(HTMLParser):
    """Collects (kind, text, heading, table, row, cells) while it is fed; tolerant of bad markup."""

    def __init__(self, most: int = 200_000):
        super().__init__(convert_charrefs=True)
        self.most, self.found = most, []
        self.held: list[str] = []
        self.skip = self.table = self.depth = 0
        self.level, self.path, self.row, self.cell = 0, [], None, None

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if not text:
            return
        if self.cell is not None:
            self.cell.append(text)
            return
        if self.level:
            self.path = [(lv, t) for lv, t in self.path if lv < self.level] + [(self.level, text)]
        self.put("heading" if self.level else "paragraph", text)

    def put(self, kind: str, text: str, **more) -> None:
        require(len(self.found) < self.most, "html_node_limit", FileError)
        self.found.append({"kind": kind, "text": text, "heading": " > ".join(t for _, t in self.path) or None, "table": None, "row": None, "cells": None} | more)

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif not self.skip:
            if tag in _BLOCKS or tag in _HEADS:
                self.flush()
            if tag in _HEADS:
                self.level = _HEADS[tag]
            elif tag == "table":
                self.table, self.depth = self.table + 1, 0
            elif tag == "tr":
                self.end_row()
                self.row = []
            elif tag in ("td", "th") and self.row is not None:
                self.end_cell()
                self.cell = []

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip:
            if tag in _BLOCKS or tag in _HEADS:
                self.flush()
            if tag in _HEADS:
                self.level = 0
            elif tag in ("td", "th"):
                self.end_cell()
            elif tag in ("tr", "table"):
                self.end_row()

    def end_cell(self) -> None:
        if self.cell is not None:
            self.flush()
            self.row.append(" ".join(self.cell))
            self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row:
            self.put("table_row", " | ".join(self.row), table=self.table, row=self.depth, cells=self.row)
            self.depth += 1
        self.row = None

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)

    def blocks(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self.end_row()
        self.flush()
        return self.found


_HTML = "ordinal int, kind string, text string, heading string, table int, row int, cells array<string>"


def html_blocks(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, ordinal, kind, text, heading, table, row, cells) of each page; a null page has none."""
    kind = df.schema[id_col].dataType.simpleString()
    inner = pa.schema([("ordinal", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("heading", pa.string()), ("table", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = HtmlBlocks().blocks(html or "")
                ids += [i] * len(found)
                rows += [b | {"ordinal": n} for n, b in enumerate(found)]
            made = pa.RecordBatch.from_pylist(rows, inner)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), *made.columns], [id_col, *inner.names])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`").cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {_HTML}")


def group_blocks(blocks: DataFrame, id_col: str) -> DataFrame:
    """Neighbouring paragraphs under one heading, or rows of one table, as one text: (id, grp, kind, heading, text, first, last)."""
    order = Window.partitionBy(F.col(f"`{id_col}`")).orderBy("ordinal")
    table = F.col("table") if "table" in blocks.columns else F.lit(None).cast("int")
    rows = blocks.withColumn("__t", table).where("kind <> 'heading'")
    key = F.struct(F.col("kind"), F.coalesce("__t", F.lit(-1)), F.coalesce("heading", F.lit("")))
    rows = rows.withColumn("__new", (~key.eqNullSafe(F.lag(key).over(order)) | (F.col("kind") == "image")).cast("int"))
    rows = rows.withColumn("grp", F.sum(F.coalesce("__new", F.lit(1))).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    return rows.groupBy(F.col(f"`{id_col}`"), "grp", "kind", "heading").agg(F.array_join(parts, "\n").alias("lines"), F.array_join(parts, "\n\n").alias("paragraphs"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).select(F.col(f"`{id_col}`"), "grp", "kind", "heading", F.when(F.col("kind") == "table_row", F.col("lines")).otherwise(F.col("paragraphs")).alias("text"), "first", "last")


def byte_windows(text: str, body: int = BODY_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple[int, int, int]]:
    """(from, to, bytes) of windows of at most ``body`` bytes, each starting in the last ``overlap`` bytes before; code points stay whole."""
    ends = [0]
    for c in text:
        ends.append(ends[-1] + len(c.encode("utf-8", "surrogatepass")))
    n, start, out = len(text), 0, []
    while start < n:
        end = start
        while end < n and ends[end + 1] - ends[start] <= body:
            end += 1
        end = max(end, start + 1)
        out.append((start, end, ends[end] - ends[start]))
        if end == n:
            break
        start = end
        while start > 0 and ends[end] - ends[start - 1] <= overlap:
            start -= 1
    return out


def chunks(groups: DataFrame, id_col: str, strategy: str = "structure", most: int | None = None) -> DataFrame:
    """Windows over each group's text, numbered and linked: previous, next, and the first chunk of the heading as parent.

    parent_child takes windows of half the size. ``most`` rejects documents of more chunks.
    """
    require(strategy in ("structure", "recursive", "parent_child"), "invalid_chunk_strategy", FileError)
    half = 2 if strategy == "parent_child" else 1
    kind = groups.schema[id_col].dataType.simpleString()
    rows = groups.select(F.col(f"`{id_col}`"), "grp", "heading", "text")
    schema = pa.schema([("grp", pa.int64()), ("heading", pa.string()), ("part", pa.int32()), ("text", pa.string()), ("normal", pa.string()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, grp, heading, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for n, (a, b, size) in enumerate(byte_windows(text or "", BODY_BYTES // half, OVERLAP_BYTES // half)):
                    if text[a:b].strip():
                        ids.append(i)
                        out.append({"grp": grp, "heading": heading, "part": n, "text": text[a:b], "normal": unicodedata.normalize("NFKC", text[a:b]).casefold(), "size": size})
            made = pa.RecordBatch.from_pylist(out, schema)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), *made.columns], [id_col, *schema.names])

    cut = rows.mapInArrow(run, f"`{id_col}` {kind}, grp long, heading string, part int, text string, normal string, size int")
    if most is not None:
        require(cut.groupBy(F.col(f"`{id_col}`")).count().where(F.col("count") > most).isEmpty(), "document_chunk_limit", FileError)
    order = Window.partitionBy(F.col(f"`{id_col}`")).orderBy("grp", "part")
    cut = cut.withColumn("ordinal", F.row_number().over(order) - 1)
    cut = cut.withColumn("chunk_id", F.concat_ws(":", F.col(f"`{id_col}`").cast("string"), "ordinal"))
    head = Window.partitionBy(F.col(f"`{id_col}`"), "heading").orderBy("ordinal")
    return cut.withColumns({"previous_id": F.lag("chunk_id").over(order), "next_id": F.lead("chunk_id").over(order), "parent_id": F.when(F.col("heading").isNotNull(), F.first("chunk_id").over(head))})


def token_windows(df: DataFrame, id_col: str, text_col: str = "text", body: int = 384, overlap: int = 48) -> DataFrame:
    """(id, part, text, tokens): bodies of so many words, each but the first with some before it; a null or blank text has none.

    A word takes the white space after it along, so bodies join to the text but for white space at its start. Words stand in for a model's
    tokens, which are not at hand.
    """
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[^ \t\n\r]+[ \t\n\r]*"), F.lit(0))
    cut = df.select(F.col(f"`{id_col}`"), words.alias("__w")).where(F.size("__w") > 0)
    each = cut.select(F.col(f"`{id_col}`"), "__w", F.explode(F.sequence(F.lit(0), F.floor((F.size("__w") - 1) / body).cast("int"))).alias("part"))
    start = F.greatest(F.lit(0), F.col("part") * body - overlap)
    return each.withColumn("__s", F.slice("__w", start + 1, (F.col("part") + 1) * body - start)).select(F.col(f"`{id_col}`"), "part", F.array_join("__s", "").alias("text"), F.size("__s").alias("tokens"))


def location(blocks: DataFrame, *by: str) -> DataFrame:
    """(by, type, start, end): where grouped blocks are: rows of a table, else pages, slides, paragraphs, else blocks.

    blocks has ordinal and, null where unknown, table, row, page, slide and paragraph.
    """
    kinds = (("table", F.when(F.col("table").isNotNull(), F.col("row"))), ("pages", F.col("page")), ("slides", F.col("slide")), ("paragraphs", F.col("paragraph")), ("blocks", F.col("ordinal")))
    span = F.coalesce(*(F.when(F.min(c).isNotNull(), F.struct(F.lit(k).alias("type"), F.min(c).alias("start"), F.max(c).alias("end"))) for k, c in kinds))
    return blocks.groupBy(*by).agg(span.alias("l")).select(*by, "l.*")


def block_page(blocks: DataFrame, id_col: str, document, offset: int, limit: int) -> tuple[DataFrame, int]:
    """A document's blocks in order from an offset, and how many it has."""
    own = blocks.where(F.col(f"`{id_col}`") == document)
    return own.orderBy("ordinal").offset(offset).limit(limit), own.count()
