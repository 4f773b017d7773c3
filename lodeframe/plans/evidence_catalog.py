"""Registered queries of scope, coverage, multi-query retrieval, evidence, reviews, artifacts and previews, with twins."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.errors import EngineError
from lodeframe.operators import evaluate, lineage, profile, tables
from lodeframe.operators.asof import asof_join
from lodeframe.plans import policy, text_catalog
from lodeframe.plans.run import file_query, run_sql
from lodeframe.scratch import scratch
from lodeframe.sources import database, files, quoted, sinks
from lodeframe.text import blocks, retrieval, summarize
from lodeframe.text import expressions as x

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(run):
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return put


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _said(call) -> str:
    """What a call gives, as text; the code of its rejection."""
    try:
        got = call()
    except EngineError as e:
        return e.code
    return got if isinstance(got, str) else json.dumps(got, ensure_ascii=False)


#: (name, case): what a rule of a few values gives as text, and what it must give. Rules read no table, so they aren't queries.
RULES: dict[tuple[str, str], tuple[Callable, str]] = {}


def cases(name: str, **each: tuple[Callable, str]) -> None:
    RULES.update({(name, case): (lambda call=call: _said(call), want) for case, (call, want) in each.items()})


# --- SQL over files
@query("sql_join_asof", "WITH c AS (SELECT user_id, ts, max(event_id) AS last_click FROM events WHERE event_type = 'click' GROUP BY user_id, ts), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT e.event_id, c.last_click FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts")
def sql_join_asof(spark, d):
    e = _t(spark, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_click"))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["last_click"]).select("event_id", "last_click")


@query("sql_file_query", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment")
def sql_file_query(spark, d):
    result, _ = file_query(spark, {t: f"{d}/{t}.parquet" for t in ("orders", "customer")}, "SELECT c_mktsegment, count(*) AS n FROM orders JOIN dataset_2 ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment", 100)
    rows, _ = result.rows()
    return spark.createDataFrame(rows, result.df.schema)


@query("sql_table_alias", "SELECT 'dataset_1' AS alias, 'orders' AS name, 'table_not_selected' AS other UNION ALL SELECT 'dataset_2', 'customer', 'table_not_selected'")
def sql_table_alias(spark, d):
    paths = {t: f"{d}/{t}.parquet" for t in ("orders", "customer")}
    _, evidence = file_query(spark, paths, "SELECT count(*) AS n FROM dataset_1", 10)
    other = _said(lambda: file_query(spark, paths, "SELECT count(*) AS n FROM dataset_3", 10) and "admitted")
    return spark.createDataFrame([(alias, name, other) for alias, name in evidence["aliases"].items()], "alias string, name string, other string")




_decide = lambda name, **args: "/".join(policy.tool_decision(name, args, ["run_sql", "inspect"], ["s1"], ["d1"], ["hunter2"]))
cases(
    "tool_decision",
    known=(lambda: _decide("run_sql", dataset_id="d1", source_id="s1"), "allow/validated_input"),
    source=(lambda: _decide("run_sql", dataset_ids=["d1", "s1"]), "allow/validated_input"),
    unknown=(lambda: _decide("rm"), "reject/unknown_tool"),
    secret=(lambda: _decide("run_sql", sql=["x hunter2"]), "reject/configured_secret_detected"),
    other=(lambda: _decide("run_sql", input_dataset_ids=["d1", "d2"]), "reject/dataset_not_selected"),
    foreign=(lambda: _decide("inspect", source_id="d1"), "reject/source_not_selected"),
)


# --- files, catalog, artifacts
def _zipped(*names: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "<x/>")
    return out.getvalue()


_DOCX = {
    "heading": '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>',
    "paragraph": "<w:p><w:r><w:t>{}</w:t></w:r></w:p>",
    "rows": "<w:tbl>{}</w:tbl>",
    "row": "<w:tr><w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc></w:tr>",
    "all": '<w:document xmlns:w="w"><w:body>{}</w:body></w:document>',
    "name": "word/document.xml",
}
_PPTX = {
    "heading": '<p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>{}</a:t></a:p></p:sp>',
    "paragraph": "<p:sp><a:p><a:t>{}</a:t></a:p></p:sp>",
    "rows": "<a:tbl>{}</a:tbl>",
    "row": "<a:tr><a:tc><a:t>{}</a:t></a:tc><a:tc><a:t>{}</a:t></a:tc></a:tr>",
    "all": '<p:sld xmlns:p="p" xmlns:a="a">{}</p:sld>',
    "name": "ppt/slides/slide1.xml",
}


def _documents(spark, d, kind: str, parts: dict[str, str]) -> DataFrame:
    """The customers of each nation, written as an office document by the workers and read back."""
    folder = scratch(spark, kind)

    def put(batches):
        for batch in batches:
            at, base = fs.FileSystem.from_uri(folder)
            at.create_dir(base)
            for nation, rows in zip(batch.column("c_nationkey").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                table = "".join(parts["row"].format(r["c_custkey"], escape(r["c_name"])) for r in rows)
                body = parts["heading"].format(f"Nation {nation}") + parts["paragraph"].format("Customers") + parts["rows"].format(table)
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr(parts["name"], parts["all"].format(body))
                with at.open_output_stream(f"{base}/n{nation}.{kind}") as out:
                    out.write(held.getvalue())
            yield batch.select(["c_nationkey"])

    rows = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows")
    _t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(rows).mapInArrow(put, "c_nationkey long").count()
    nation = F.regexp_extract("path", r"n(\d+)\.\w+$", 1).cast("long").alias("nation")
    return files.scan_documents(spark, folder, kind).select(nation, "block", "kind", "text", "heading", "table", "cells", "error")


_OFFICE = """
    WITH c AS (SELECT c_nationkey AS n, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
    SELECT CAST(n AS BIGINT) AS nation, CAST(0 AS INTEGER) AS block, 'heading' AS kind, 'Nation ' || n AS text, 'Nation ' || n AS heading, CAST(NULL AS INTEGER) AS "table", CAST(NULL AS VARCHAR[]) AS cells, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT n FROM c)
    UNION ALL SELECT n, 1, 'paragraph', 'Customers', 'Nation ' || n, NULL, NULL, NULL FROM (SELECT DISTINCT n FROM c)
    UNION ALL SELECT n, CAST(1 + i AS INTEGER), 'table_row', c_custkey || ' | ' || c_name, 'Nation ' || n, 1, [CAST(c_custkey AS VARCHAR), c_name], NULL FROM c"""
query("scan_docx", _OFFICE)(lambda spark, d: _documents(spark, d, "docx", _DOCX))
query("scan_pptx", _OFFICE)(lambda spark, d: _documents(spark, d, "pptx", _PPTX))


cases("detect_encoding", ascii=(lambda: files.detect_encoding(b"a,b"), "UTF-8"), mark=(lambda: files.detect_encoding(b"\xef\xbb\xbfa"), "UTF-8"), wide=(lambda: files.detect_encoding(b"\xff\xfea\0"), "UTF-16"), cut=(lambda: files.detect_encoding("aé".encode()[:-1]), "UTF-8"))
cases("detect_delimiter", comma=(lambda: files.detect_delimiter("a,b\n1,2\n"), ","), semicolon=(lambda: files.detect_delimiter("a;b\n1;2\n"), ";"), tab=(lambda: files.detect_delimiter("a\tb\n1\t2\n"), "\t"), bar=(lambda: files.detect_delimiter("a|b\n1|2\n"), "|"), one=(lambda: files.detect_delimiter("name\nx\n"), ","), empty=(lambda: files.detect_delimiter(" \n"), "csv_empty"))
cases("xlsx_archive_guard", fine=(lambda: len(files.guard_archive(_zipped("xl/workbook.xml")).namelist()), "1"), out=(lambda: str(files.guard_archive(_zipped("../x"))), "xlsx_unsafe_archive"), broken=(lambda: str(files.guard_archive(b"PK")), "xlsx_invalid"))
cases("normalize_header", plain=(lambda: profile.normalize_headers([" a ", "", "A", "a"]), '["a", "column_2", "A_2", "a_3"]'), long=(lambda: len(profile.normalize_headers(["x" * 300])[0]), "128"))
cases(
    "validate_upload",
    pdf=(lambda: files.validate_upload("a/b.PDF", b"%PDF-1.7", 99), "pdf"),
    text=(lambda: files.validate_upload("a.md", b"# x", 99), "md"),
    page=(lambda: files.validate_upload("a.htm", b"<p>x", 99), "html"),
    image=(lambda: files.validate_upload("a.png", b"\x89PNG\r\n", 99), "image"),
    other=(lambda: files.validate_upload("a.pdf", b"PK", 99), "file_type_mismatch"),
    bare=(lambda: files.validate_upload("a.html", b"x", 99), "file_type_mismatch"),
    nul=(lambda: files.validate_upload("a.txt", b"a\0", 99), "file_type_mismatch"),
    unknown=(lambda: files.validate_upload("a.exe", b"MZ", 99), "file_type_unsupported"),
    empty=(lambda: files.validate_upload("a.txt", b"", 99), "empty_upload"),
    large=(lambda: files.validate_upload("a.txt", b"x" * 100, 99), "upload_too_large"),
)


@query("scan_artifact_table", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey > 1 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def scan_artifact_table(spark, d):
    path = scratch(spark, "artifact")
    cells = F.array(F.col("n_nationkey").cast("string"), "n_name", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string")))
    whole = F.struct(F.array(*map(F.lit, ("n_nationkey", "n_name", "region"))).alias("columns"), F.collect_list(cells).alias("rows"))
    _t(spark, d, "nation").agg(F.to_json(whole).alias("value")).coalesce(1).write.text(path)
    return files.scan_artifact(spark, path, "json")


@query("inspect_schema", "SELECT table_name AS \"table\", ordinal_position AS position, column_name AS name FROM information_schema.columns WHERE table_name IN ('orders', 'nation', 'events')")
def inspect_schema(spark, d):
    rows = files.inspect_schema({t: _t(spark, d, t) for t in ("orders", "nation", "events")})
    return spark.createDataFrame([r[:3] for r in rows], "table string, position int, name string")


@query("list_datasets", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def list_datasets(spark, d):
    return lineage.current(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("sink_parquet", "SELECT p_partkey, p_retailprice FROM part")
def sink_parquet(spark, d):
    path = scratch(spark, "parquet")
    sinks.write_parquet(_t(spark, d, "part").select("p_partkey", "p_retailprice"), path)
    return spark.read.parquet(path)


@query("sink_sql_csv", "SELECT 5 AS rows, TRUE AS truncated")
def sink_sql_csv(spark, d):
    result = run_sql(spark, "SELECT o_orderkey, o_totalprice FROM orders", {"orders": _t(spark, d, "orders")})
    written = sinks.write_csv(result.df, scratch(spark, "sql"), max_rows=5)
    return spark.createDataFrame([(int(written.rows), bool(written.truncated))], "rows int, truncated boolean")


@query("sink_table_preview", "SELECT n_nationkey, n_name, 'at least 10' AS of FROM nation ORDER BY n_nationkey LIMIT 10")
def sink_table_preview(spark, d):
    shown, n = sinks.preview(_t(spark, d, "nation").orderBy("n_nationkey"), 2, 10)
    return shown.withColumn("of", F.lit(n))


@query("chart_spec", "SELECT n_name AS x, CAST(n_nationkey AS DOUBLE) AS y, 'USD' AS unit FROM nation")
def chart_spec(spark, d):
    spec = sinks.chart_spec(_t(spark, d, "nation"), "bar", "n_name", "n_nationkey", {"n_nationkey": "USD"})
    return spark.createDataFrame([(a, b, spec["unit"]) for a, b in zip(spec["x"], spec["y"], strict=True)], "x string, y double, unit string")


_LEGACY = "CASE WHEN p_partkey % 3 = 0 THEN '/ABCDEF+KrutiDev010' WHEN p_partkey % 3 = 1 THEN 'Chanakya' ELSE 'Arial' END"


@query("legacy_font_detect", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'KrutiDev010' WHEN p_partkey % 3 = 1 THEN 'Chanakya' END AS font FROM part")
def legacy_font_detect(spark, d):
    return _t(spark, d, "part").select("p_partkey", x.legacy_font(F.expr(_LEGACY)).alias("font"))


# --- profiles
def _typed(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    return profile.judged(profile.column_stats(c.select(F.concat(F.lit("0"), "c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("n"), F.when(F.col("c_custkey") % 2 == 0, "1.5").otherwise("2").alias("price inr"), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("2").alias("total"), F.lit("").alias("none"), F.lit("01/02/2026").alias("day"))))


@query("infer_merge", "SELECT * FROM (VALUES ('id', 'string', TRUE), ('n', 'integer', FALSE), ('price inr', 'decimal', FALSE), ('total', 'string', TRUE), ('none', 'unknown', FALSE), ('day', 'date', FALSE)) t(name, type, uncertain)")
def infer_merge(spark, d):
    return _typed(spark, d).select("name", "type", "uncertain")


@query("infer_hints", "SELECT * FROM (VALUES ('id', 'leading_zero_identifier,type_inference_uncertain'), ('n', ''), ('price inr', 'unit'), ('total', 'currency_unknown,type_inference_uncertain'), ('none', ''), ('day', 'date_format_uncertain')) t(name, hints)")
def infer_hints(spark, d):
    return _typed(spark, d).select("name", F.array_join(F.array_sort(F.map_keys("hints")), ",").alias("hints"))


@query("profile_rows", "SELECT 'c_name' AS name, 'string' AS type, count(*) AS row_count, (SELECT list(c_name) FROM (SELECT c_name FROM customer ORDER BY c_custkey LIMIT 5))[1] AS first FROM customer UNION ALL SELECT 'c_custkey', 'integer', count(*), CAST(min(c_custkey) AS VARCHAR) FROM customer")
def profile_rows(spark, d):
    found = profile.profile(_t(spark, d, "customer").orderBy("c_custkey").select("c_name", "c_custkey"))
    return spark.createDataFrame([(r["name"], r["type"], r["row_count"], r["examples"][0]) for r in found], "name string, type string, row_count long, first string")


# --- tables of documents
def _tables(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    row = o.select("o_custkey", F.lit("table_row").alias("kind"), F.lit(0).alias("table"), F.col("o_orderkey").cast("int").alias("row"), F.array(F.col("o_orderkey").cast("string"), "o_orderstatus").alias("cells"))
    head = o.select("o_custkey").distinct().select("o_custkey", F.lit("table_row").alias("kind"), F.lit(0).alias("table"), F.lit(-1).alias("row"), F.array(F.lit("order id"), F.lit("status")).alias("cells"))
    return tables.cells(tables.candidates(head.unionByName(row), "o_custkey"), "o_custkey")


@query("table_preview", "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row, o_orderstatus AS status, o_orderkey AS raw FROM orders QUALIFY row < 10")
def table_preview(spark, d):
    return tables.preview(_tables(spark, d), "o_custkey").select("o_custkey", "row", F.col("cells")[1]["value"].alias("status"), F.col("cells")[0]["provenance"]["raw_value"].cast("long").alias("raw"))


@query("cell_provenance", "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row, 1 AS \"column\", o_orderstatus AS raw_value FROM orders")
def cell_provenance(spark, d):
    return tables.provenance(_tables(spark, d)).where("col = 1").select("o_custkey", "provenance.*")


cases("table_columns", names=(lambda: tables.column_names(["a ", "", "a", "b  c"]), '["a", "Column 2", "a (2)", "b c"]'))


@query("table_warnings", "SELECT n_regionkey, 'invalid_grouping' AS warnings FROM (SELECT DISTINCT n_regionkey FROM nation)")
def table_warnings(spark, d):
    n = _t(spark, d, "nation")
    row = n.select("n_regionkey", F.lit("table_row").alias("kind"), F.lit(0).alias("table"), (F.col("n_nationkey") + 1).alias("row"), F.array(F.lit("1,2")).alias("cells"))
    head = n.select("n_regionkey").distinct().select("n_regionkey", F.lit("table_row").alias("kind"), F.lit(0).alias("table"), F.lit(0).alias("row"), F.array(F.lit("amount")).alias("cells"))
    found = tables.schema(tables.cells(tables.candidates(head.unionByName(row), "n_regionkey"), "n_regionkey"), "n_regionkey")
    return found.select("n_regionkey", F.array_join("warnings", ",").alias("warnings"))


# --- blocks and chunks
_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\r]+[ \\t\\n\\r]*')"


@query("chunk_token_windows", f"SELECT doc_id, CAST(i AS INTEGER) AS part, CAST(len(s) AS INTEGER) AS tokens, sha256(array_to_string(s, '')) AS text_sha256 FROM (SELECT doc_id, i, list_slice(w, greatest(0, i * 384 - 48) + 1, (i + 1) * 384) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents), unnest(range(CAST(ceil(len(w) / 384.0) AS BIGINT))) AS t(i))")
def chunk_token_windows(spark, d):
    return blocks.token_windows(_t(spark, d, "documents"), "doc_id").select("doc_id", "part", "tokens", F.sha2("text", 256).alias("text_sha256"))


@query("chunk_location", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'pages' WHEN bool_or(l_returnflag = 'R') THEN 'paragraphs' ELSE 'blocks' END AS type, CASE WHEN bool_or(l_returnflag = 'A') THEN min(l_suppkey) FILTER (WHERE l_returnflag = 'A') WHEN bool_or(l_returnflag = 'R') THEN min(l_linenumber) FILTER (WHERE l_returnflag = 'R') ELSE min(l_linenumber) END AS first, CASE WHEN bool_or(l_returnflag = 'A') THEN max(l_suppkey) FILTER (WHERE l_returnflag = 'A') WHEN bool_or(l_returnflag = 'R') THEN max(l_linenumber) FILTER (WHERE l_returnflag = 'R') ELSE max(l_linenumber) END AS last FROM lineitem GROUP BY l_orderkey")
def chunk_location(spark, d):
    none, of = F.lit(None).cast("long"), lambda flag, c: F.when(F.col("l_returnflag") == flag, F.col(c).cast("long"))
    b = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("ordinal"), none.alias("table"), none.alias("row"), of("A", "l_suppkey").alias("page"), none.alias("slide"), of("R", "l_linenumber").alias("paragraph"))
    return blocks.location(b, "l_orderkey").select("l_orderkey", "type", F.col("start").alias("first"), F.col("end").alias("last"))


@query("block_page", "SELECT doc_id, i AS line, (SELECT count(*) FROM documents, unnest(string_split(text, chr(10))) AS t(s) WHERE doc_id = 3 AND trim(s, ' ' || chr(9) || chr(13)) <> '') AS total FROM (SELECT doc_id, i - 1 AS i FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i) WHERE doc_id = 3 AND trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(13)) <> '') ORDER BY i LIMIT 20 OFFSET 1")
def block_page(spark, d):
    found = blocks.text_blocks(_t(spark, d, "documents")).withColumn("ordinal", F.col("line"))
    page, total = blocks.block_page(found, "doc_id", 3, 1, 20)
    return page.select("doc_id", F.col("line").cast("long").alias("line"), F.lit(total).cast("long").alias("total"))


# --- retrieval: scope, coverage, several queries
def _catalog(spark, d):
    o = _t(spark, d, "orders")
    documents = o.select(F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 3).alias("version"), F.when(F.col("o_orderstatus") == "O", "ready").otherwise("failed").alias("state"), F.col("o_orderkey").alias("generation"))
    generations = o.select(F.col("o_orderkey").alias("generation"), F.col("o_orderkey").alias("document"), (F.col("o_orderkey") % 3).alias("version"), F.when(F.col("o_orderkey") % 5 == 0, "building").when(F.col("o_orderkey") % 5 == 1, "degraded").otherwise("ready").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "m").otherwise("n").alias("model"))
    selected = _t(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("version"))
    return documents, generations, selected


@query("retr_eligible", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND o_orderkey % 3 < 2 AND o_orderkey % 5 > 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def retr_eligible(spark, d):
    chunks = _t(spark, d, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("document"), F.col("l_orderkey").alias("generation"))
    return retrieval.eligible(chunks, *_catalog(spark, d)).select(F.col("document").alias("l_orderkey"), "l_linenumber")


@query("retr_dense_coverage", "SELECT count(*) AS selected, count(*) FILTER (WHERE o_orderkey % 5 > 1 AND o_orderkey % 2 = 0) AS matching FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 < 2 AND o_custkey IN (SELECT c_custkey FROM customer)")
def retr_dense_coverage(spark, d):
    return retrieval.dense_coverage(*_catalog(spark, d), {"model": "m"})


_PREVIOUS = "CASE WHEN turn % 2 = 1 THEN 'of 2025' END"


@query("retr_variants", f"""
    WITH q AS (SELECT conv_id, turn, trim(regexp_replace(lower(left(text, 60)), '[^a-z]+', ' ', 'g'), ' ') AS q, {_PREVIOUS} AS p FROM conversations),
    w AS (SELECT *, list_filter(regexp_split_to_array(q, ' +'), lambda x: x NOT IN ('what', 'which', 'are', 'is', 'the', 'a', 'an', 'of', 'for', 'in', 'and', 'to', 'does', 'please', 'explain', 'tell', 'me', 'about')) AS t FROM q),
    m AS (
      SELECT conv_id, turn, list_concat([q], CASE WHEN p IS NOT NULL AND regexp_matches(q, '\\b(it|that|those|same|they|its)\\b') THEN [q || ' ' || p] ELSE [] END, [array_to_string(t, ' ')],
             CASE WHEN len(t) > 4 THEN [array_to_string(list_filter(t, lambda x, i: i % 2 = 1), ' '), array_to_string(list_filter(t, lambda x, i: i % 2 = 0), ' ')] ELSE [] END) AS v FROM w
    ), d AS (SELECT conv_id, turn, v, i FROM m, unnest(range(1, len(v) + 1)) AS u(i) WHERE v[i] <> '' AND list_position(v, v[i]) = i)
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS place, v[i] AS variant FROM d QUALIFY place < 3""")
def retr_variants(spark, d):
    turns = _t(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower(F.substring("text", 1, 60)), "[^a-z]+", " ").alias("query"), F.expr(_PREVIOUS).alias("previous"))
    asked = turns.select(F.struct("conv_id", "turn").alias("query_no"), "query", "previous", F.expr("CAST(NULL AS ARRAY<STRING>)").alias("offered"), F.expr("CAST(NULL AS ARRAY<STRUCT<key: STRING, words: ARRAY<STRING>>>)").alias("aliases"))
    return retrieval.rewritings(asked).select("query_no.conv_id", "query_no.turn", "place", "variant")


cases(
    "retr_hop",
    found=(lambda: retrieval.hop("who owns", ["Acme  Ltd"], ["by Acme  Ltd."]), "who owns Acme Ltd"),
    absent=(lambda: retrieval.hop("who owns", ["Other"], ["by Acme"]), "invalid_hop_terms"),
    bare=(lambda: retrieval.hop("who owns", ["Acme"], []), "invalid_hop"),
    none=(lambda: retrieval.hop("who owns", [], []), "who owns"),
)
cases("retr_clean_query", spaces=(lambda: retrieval.clean_query("  a\n b "), "a b"), wide=(lambda: retrieval.clean_query("Ａ１"), "A1"), empty=(lambda: retrieval.clean_query(" "), "empty_query"), long=(lambda: retrieval.clean_query("x" * 2001), "query_too_long"))
cases("retr_context_budget", characters=(lambda: [p["text"] for p in retrieval.within_budget([{"text": "aaa"}, {"text": "bbb"}, {"text": "c"}], 5, 99)], '["aaa"]'), bytes=(lambda: len(retrieval.within_budget([{"text": "éé"}, {"text": "é"}], 99, 5)), "1"), fits=(lambda: len(retrieval.within_budget([{"text": "a"}], 1, 1)), "1"))
# The first query asks for "de" and "la" together, the second for either; a stop word in the first is a lexeme but in English.
@query("retr_advanced", f"""
    WITH e AS ({text_catalog._MATCHED}), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM e WHERE t IS NOT NULL),
    l AS (
      SELECT *, max(pos) FILTER (t = 0) OVER w AS a, max(pos) FILTER (t = 1) OVER w AS b, max(n) FILTER (t = 0) OVER w AS na, max(n) FILTER (t = 1) OVER w AS nb
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
    ), c AS (
      SELECT doc_id, english, pos, n, least(a, b) AS p, least(na, nb) AS np,
             max(least(a, b)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM l WHERE a IS NOT NULL AND b IS NOT NULL
    ), s AS (
      SELECT 0 AS variant, doc_id, any_value(english) AS english, round(sum(0.1::DOUBLE / (1 + (pos - p) - (n - np))), 9) AS score FROM c WHERE (before IS NULL OR p > before) GROUP BY doc_id
      UNION ALL
      SELECT 1, doc_id, any_value(english), round(count(*) * 0.1::DOUBLE, 9) FROM e WHERE t IS NOT NULL GROUP BY doc_id
    ), o AS (SELECT *, row_number() OVER (PARTITION BY variant, english ORDER BY score DESC, doc_id) AS own FROM s QUALIFY own <= 15),
    v AS (SELECT variant, doc_id, row_number() OVER (PARTITION BY variant ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= 20),
    f AS (SELECT doc_id, sum(1.0 / (60 + rank)) * (1 + 0.1 * (count(*) - 1)) AS score, count(*) AS variants FROM v GROUP BY doc_id),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f),
    t AS (SELECT r.*, source, row_number() OVER (PARTITION BY source ORDER BY rank) AS turn FROM r JOIN documents USING (doc_id))
    SELECT doc_id, source, variants, CAST(row_number() OVER (ORDER BY turn, rank) AS INTEGER) AS place FROM t QUALIFY place <= 20""")
def retr_advanced(spark, d):
    docs = _t(spark, d, "documents")
    found = retrieval.advanced(retrieval.lexeme_index(docs, "doc_id", lang_col="lang"), docs, ["de la", "la de"], 20, "source", "doc_id")
    return found.select("doc_id", "source", "variants", "place")


# --- summaries, language
cases("sum_join", short=(lambda: summarize.joined(["A.", "B."]), "A. B."), cut=(lambda: summarize.joined(["aaa bbb, ccc"], 10), "aaa bbb…"))


@query("sum_cache", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1 OR l_orderkey % 4 = 0")
def sum_cache(spark, d):
    chunks = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("chunk_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("text"))
    cache = summarize.fingerprints(chunks.where("l_orderkey % 2 = 0"), "l_orderkey")
    changed = chunks.withColumn("text", F.when(F.col("l_orderkey") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return summarize.pending(changed, cache, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("lang_protect", "SELECT c_custkey, '⟦kept0000⟧ is ⟦kept0001⟧ old' AS text, 'Customer,' || c_custkey AS originals, 'Customer is ' || c_custkey || ' old' AS restored, TRUE AS missing FROM customer")
def lang_protect(spark, d):
    p = _t(spark, d, "customer").select("c_custkey", x.protect(F.concat(F.lit("Customer is "), "c_custkey", F.lit(" old"))).alias("p"))
    return p.select("c_custkey", "p.text", F.array_join("p.originals", ",").alias("originals"), x.restore(F.col("p.text"), F.col("p.originals")).alias("restored"), x.restore(F.lit("no placeholder"), F.col("p.originals")).isNull().alias("missing"))


# --- metrics
cases("eval_edit_distance", equal=(lambda: evaluate.edit_distance(list("abc"), list("abc")), "0"), mixed=(lambda: evaluate.edit_distance(list("kitten"), list("sitting")), "3"), empty=(lambda: evaluate.edit_distance([], list("ab")), "2"))
cases("eval_schema_match", inner=(lambda: evaluate.schema_matches({"a": [1, {"b": 2, "c": 3}]}, {"a": [1, {"b": 2}]}), "true"), short=(lambda: evaluate.schema_matches({"a": [1]}, {"a": [1, 2]}), "false"))


@query("eval_allowlist", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS unexpected FROM orders")
def eval_allowlist(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(evaluate.unexpected_actions(F.array(F.lit("inspect"), "o_orderstatus"), F.array(F.lit("inspect"), F.lit("O"))), ",").alias("unexpected"))


@query("eval_immutability", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'passed' ELSE 'failed' END AS status FROM orders")
def eval_immutability(spark, d):
    before = F.when(F.col("o_orderkey") % 3 > 0, F.lit("a"))
    return _t(spark, d, "orders").select("o_orderkey", evaluate.unchanged(before, F.when(F.col("o_orderkey") % 3 == 1, F.lit("a"))).alias("status"))


@query("eval_usage", "SELECT o_orderpriority, sum(o_custkey) FILTER (WHERE o_orderkey % 4 > 1) AS total, count(*) FILTER (WHERE o_orderkey % 4 > 1) AS measured_count, count(*) FILTER (WHERE o_orderkey % 4 < 2) AS unavailable_count FROM orders GROUP BY o_orderpriority")
def eval_usage(spark, d):
    used = F.expr("CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE o_custkey END")
    return evaluate.usage(_t(spark, d, "orders").select("o_orderpriority", used.alias("tokens")), "tokens", "o_orderpriority").withColumn("total", F.col("total").cast("decimal(38,0)"))


@query("eval_review", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'stale' END AS verdict FROM customer")
def eval_review(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("answer"))
    given = c.where("c_custkey % 3 < 2").select("c_custkey", F.lit("accepted").alias("label"), F.sha2(F.when(F.col("c_custkey") % 3 == 0, F.col("answer")).otherwise("before"), 256).alias("answer_sha256"), F.lit(2).alias("at"))
    older = given.withColumns({"label": F.lit("rejected"), "at": F.lit(1)})
    return evaluate.reviewed(c, given.unionByName(older), "c_custkey").select("c_custkey", "verdict")


# --- lineage and audit
@query("lineage_references", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) OR (o_orderkey % 10 = 0 AND o_orderkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))")
def lineage_references(spark, d):
    ref = F.concat(F.lit("source:"), "o_custkey", F.lit("@1"))
    value = F.to_json(F.struct(F.array(F.struct(ref.alias("ref"))).alias("inputs"), F.create_map(F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey").cast("string")).otherwise("none"), F.lit(1)).alias("by"), F.col("o_orderkey").alias("n")))
    rows = _t(spark, d, "orders").select("o_orderkey", value.alias("value"))
    return lineage.references(rows, "value", _t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))).select("o_orderkey")


@query("lineage_validate", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def lineage_validate(spark, d):
    ref = F.concat(F.lit("dataset:"), "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "@2#ab").when(F.col("o_orderkey") % 3 == 1, "@1#ab").otherwise("@1"))
    known = _t(spark, d, "customer").select(F.lit("dataset").alias("kind"), F.col("c_custkey").cast("string").alias("id"), F.lit(1).cast("long").alias("version"), F.lit("ab").alias("hash"))
    return lineage.unresolved(_t(spark, d, "orders").select("o_orderkey", ref.alias("ref")), known).select("o_orderkey")


@query("run_export", "SELECT * FROM (SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS id, event_type || ' [redacted]' AS details FROM events ORDER BY event_id LIMIT 50) UNION ALL SELECT * FROM (SELECT 'order', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 50)")
def run_export(spark, d):
    events = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.concat("event_type", F.lit(" hunter2")).alias("details"))
    return lineage.export({"event": events, "order": _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("details"))}, 50, ["hunter2"])


@query("eval_percentile", """
    SELECT o_orderstatus AS status, count(*) AS trials, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS passed, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.95) AS p95
    FROM orders GROUP BY o_orderstatus""")
def eval_percentile(spark, d):
    rows = _t(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderpriority").like("1%"), "passed").otherwise("failed").alias("status"), F.col("o_totalprice").cast("double").alias("latency"), F.lit(1).alias("tokens"))
    return evaluate.summary(rows, "o_orderstatus").select(F.col("o_orderstatus").alias("status"), "trials", "passed", "p50", "p95")


@query("eval_redact", "SELECT c_custkey, 'get https://[redacted]@host/' || c_custkey || ' with Bearer [redacted] as [redacted]' AS text, FALSE AS left_over FROM customer")
def eval_redact(spark, d):
    secret = "hunter2"
    said = F.concat(F.lit("get https://user:"), "c_name", F.lit("@host/"), F.col("c_custkey").cast("string"), F.lit(" with bearer tok."), F.col("c_custkey").cast("string"), F.lit(f" as {secret}"))
    out = _t(spark, d, "customer").select("c_custkey", x.redact(said, [secret]).alias("text"))
    return out.withColumn("left_over", x.contains_secret(F.col("text"), [secret]))


# --- quoted CSV in parallel: texts with line ends and quotes, through files and back
def _as_csv(df: DataFrame, path: str) -> None:
    df.write.option("escape", '"').csv(path, quoteAll=True, nullValue="", emptyValue="")


@query("canonical_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(coalesce(text, '')) AS text_sha256, lang FROM documents")
def canonical_csv(spark, d):
    path, copy, names = scratch(spark, "csv"), scratch(spark, "canonical"), ["doc_id", "text", "lang"]
    _as_csv(_t(spark, d, "documents").select(*names), path)
    quoted.write_canonical(quoted.table(spark, path, names, ","), copy)
    again = quoted.table(spark, copy, names, ",").where("doc_id <> 'doc_id'")
    return again.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang")


@query("sink_csv_export", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN chr(39) || '=' || c_name ELSE c_name END AS c_name, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) AS c_acctbal FROM customer")
def sink_csv_export(spark, d):
    path, out, names = scratch(spark, "csv"), scratch(spark, "export"), ["c_custkey", "c_name", "c_acctbal"]
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name"))
    _as_csv(_t(spark, d, "customer").select("c_custkey", name.alias("c_name"), F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal")), path)
    where, _ = quoted.export(path, quoted.table(spark, path, names, ","), out)
    return quoted.table(spark, where, names, ",").where("c_custkey <> 'c_custkey'").drop(quoted.ORDINAL)


@query("ingest_file", "SELECT 'ready' AS state, CAST(NULL AS VARCHAR) AS code, count(*) AS rows, 'doc_id,lang,text' AS columns, '0,0,' || count(*) FILTER (coalesce(text, '') = '') AS missing FROM documents")
def ingest_file(spark, d):
    path, catalog = scratch(spark, "csv"), scratch(spark, "catalog")
    quoted.write_canonical(_t(spark, d, "documents").select(F.monotonically_increasing_id().alias(quoted.ORDINAL), "doc_id", "lang", "text"), path)
    quoted.ingest(spark, path, catalog, scratch(spark, "copies"), ["doc_id", "lang", "text"])
    return quoted.latest(spark, catalog).select("state", "code", "rows", F.concat_ws(",", "columns").alias("columns"), F.array_join(F.transform("missing", lambda m: m.cast("string")), ",").alias("missing"))


# --- a database that comes with Spark, in this process: so these two are for local sessions
_DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _loaded(spark, d) -> str:
    url = f"jdbc:derby:memory:{scratch(spark, 'db').rsplit('/', 1)[1]};create=true"
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    orders = orders.toDF(*(c.upper() for c in orders.columns))  # names without quotes are in upper case there
    orders.write.option("createTableColumnTypes", "O_ORDERSTATUS VARCHAR(8)").jdbc(url, "orders", "overwrite", _DERBY)
    return url


@query("scan_jdbc", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def scan_jdbc(spark, d):
    return database.scan(spark, _loaded(spark, d), "orders", "o_orderkey", 8, _DERBY).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("sql_db_query", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DECIMAL(28, 2)) AS total, FALSE AS truncated FROM orders GROUP BY o_orderstatus")
def sql_db_query(spark, d):
    rows, cut = database.query(spark, _loaded(spark, d), "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus", ["orders"], 100, 300, _DERBY)
    return spark.createDataFrame([(*r, cut) for r in rows], "o_orderstatus string, n long, total decimal(31,2), truncated boolean").withColumn("total", F.col("total").cast("decimal(28,2)"))
