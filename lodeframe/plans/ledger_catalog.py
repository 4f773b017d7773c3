"""Registered queries of records that are kept: audited entries, inputs of analyses, a library of documents; with twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.sanitize import sanitized
from lodeframe.operators import scoring, snapshots
from lodeframe.scratch import scratch
from lodeframe.sources import portable
from lodeframe.text.library import Library

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


@query("audit_sanitize", """
    SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS items, TRUE AS nested, FALSE AS bytes,
        '{"api_key":"[redacted]","deep":' || repeat('{"d":', 10) || '"[truncated]"' || repeat('}', 10) || ',"list":' || CASE event_id % 50 WHEN 0 THEN to_json(range(500)) ELSE to_json(range(event_id % 50)) END
        || ',"note":"see https://[redacted]@host/' || user_id || ' by Bearer [redacted]","props":' || replace(coalesce(props, 'null'), ' ', '') || ',"tokens":' || event_id || '}' AS json
    FROM events""")  # fmt: skip
def audit_sanitize(spark, d):
    n = F.when(F.col("event_id") % 50 == 0, 501).otherwise(F.col("event_id") % 50)
    entry = F.to_json(F.struct(
        F.concat(F.lit("key-"), "event_id").alias("api_key"), F.col("event_id").alias("tokens"),
        F.concat(F.lit("see https://user:pw@host/"), "user_id", F.lit(" by Bearer abc.def")).alias("note"),
        F.parse_json(F.lit('{"d":' * 11 + "1" + "}" * 11)).alias("deep"), F.parse_json(F.coalesce("props", F.lit("null"))).alias("props"),
        F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: i).alias("list"),
    ))
    entry = F.regexp_replace(entry, r",?\d+\](?=[^\[\]]*$)", "]")  # the list without its last number: an empty sequence can't be asked for
    rows = sanitized(_t(spark, d, "events").select("event_id", F.parse_json(entry).alias("v")), F.col("v"), "r")
    return rows.select("event_id", "r.items", "r.nested", "r.bytes", "r.json")


@query("audit_sanitize_turns", """
    SELECT conv_id, turn, CASE WHEN strlen(coalesce(text, '')) <= 24000 THEN json_object('role', role, 'secret', '[redacted]', 'text', text) END AS json, CAST(strlen(coalesce(text, '')) > 24000 AS BIGINT) AS strings FROM conversations""")
def audit_sanitize_turns(spark, d):
    """Longer texts are cut, which the twin only counts."""
    entry = F.to_json(F.struct("role", F.lit("s3").alias("secret"), "text"), {"ignoreNullFields": "false"})
    rows = sanitized(_t(spark, d, "conversations").withColumn("v", F.parse_json(entry)), F.col("v"), "r")
    return rows.select("conv_id", "turn", F.when(F.col("r.strings") == 0, F.col("r.json")).alias("json"), "r.strings")


@query("op_snapshot_inputs", """
    WITH r AS (
        SELECT o_orderkey, bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS truncated,
            CASE WHEN c_custkey IS NULL OR c_custkey % 7 = 0 THEN 'dataset_not_selected' WHEN c_custkey % 10 = 1 THEN 'snapshot_required' WHEN o_orderkey % 2 = 0 AND c_nationkey % 2 = 1 THEN 'unit_conflict' END AS a,
            CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'artifact_not_accessible' WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'F' THEN 'unit_conflict' END AS b
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, CASE WHEN coalesce(a, b) IS NOT NULL THEN 'rejected' WHEN truncated THEN 'partial' ELSE 'ok' END AS status, coalesce(a, b) AS code, CAST(2 AS BIGINT) AS inputs, truncated FROM r""")
def op_snapshot_inputs(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    unit = lambda name, u: F.create_map(F.lit(name), u)
    only = lambda holds, m: F.when(holds, m)
    none = F.lit(None).cast("long")
    sets = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 1, "postgresql").otherwise("csv").alias("kind"), (F.col("c_custkey") % 7 > 0).alias("selected"), unit("c_acctbal", F.when(F.col("c_nationkey") % 2 == 0, "EUR").otherwise("USD")).alias("units"))
    made = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 > 0, "text/csv").otherwise("image/png").alias("media_type"), (F.col("o_orderkey") % 13 > 0).alias("accessible"))
    told = o.select(F.col("o_orderkey").alias("id"), only(F.col("o_orderstatus") == "F", unit("o_totalprice", F.lit("EUR"))).alias("units"), (F.col("o_orderstatus") == "P").alias("truncated"), F.when(F.col("o_orderstatus") == "P", 1000).alias("row_limit"))
    edges = o.selectExpr("o_orderkey AS child", "lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS parent").where("parent IS NOT NULL")
    asked = o.select(F.col("o_orderkey").alias("request_id"), F.lit("a").alias("input"), F.col("o_custkey").alias("dataset_id"), none.alias("artifact_id"), only(F.col("o_orderkey") % 2 == 0, unit("c_acctbal", F.lit("EUR"))).alias("units")).unionByName(
        o.select(F.col("o_orderkey").alias("request_id"), F.lit("b").alias("input"), none.alias("dataset_id"), F.col("o_orderkey").alias("artifact_id"), only(F.col("o_orderkey") % 5 == 0, unit("o_totalprice", F.lit("USD"))).alias("units"))
    )
    return snapshots.judged(snapshots.resolved(asked, sets, made, told, edges)).withColumnRenamed("request_id", "o_orderkey")


@query("process_document", r"""
    WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || chr(10) || '# End' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 7 <> 3),
        b AS (SELECT *, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS BIGINT) AS blocks FROM t)
    SELECT doc_id, CASE blocks WHEN 0 THEN 'ocr_needed' ELSE 'ready' END AS state, sha256(text) AS fingerprint, blocks, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS number, TRUE AS whole FROM b""")
def process_document(spark, d):
    """All documents, then a third of them changed and a seventh removed, with a job that is lost on the way."""
    docs, library = _t(spark, d, "documents").select("doc_id", "text"), Library(spark, scratch(spark, "library"))
    library.process(docs)
    changed = docs.where("doc_id % 7 <> 3").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n# End"))).otherwise(F.col("text")))
    gone = docs.where("doc_id % 7 = 3").select("doc_id")

    def lost(part: str) -> None:
        if part == "chunks":
            raise InterruptedError(part)

    try:
        library.process(changed, gone, lost)
    except InterruptedError:
        library.process(changed, gone)
    there = library.read("chunks").groupBy("doc_id").agg(F.count("*").alias("n"))
    return library.manifest().join(there, "doc_id", "left").select("doc_id", "state", "fingerprint", "blocks", F.col("number").cast("int").alias("number"), (F.col("chunks") == F.coalesce("n", F.lit(0))).alias("whole"))


@query("eval_score_case", """
    WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c, o_orderpriority AS p FROM orders), live AS (SELECT * FROM o WHERE s <> 'P'),
        l AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS DECIMAL(20, 2))) AS q FROM lineitem GROUP BY 1), n AS (SELECT * FROM live JOIN l USING (k))
    SELECT k AS case_id, 'run_completion' AS name, CASE WHEN s = 'P' THEN 'needs_review' WHEN s = 'O' AND k % 2 = 1 THEN 'needs_review' ELSE 'pass' END AS status FROM o
    UNION ALL SELECT k, 'unsupported_handling', CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'needs_review' END FROM live WHERE s = 'O'
    UNION ALL SELECT k, 'calculation:quantity', CASE WHEN k % 3 = 0 AND q > 0.5 THEN 'fail' ELSE 'pass' END FROM n
    UNION ALL SELECT k, 'calculation_unit:quantity', CASE k % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'fail' ELSE 'pass' END FROM n
    UNION ALL SELECT k, 'answer_unit:quantity', CASE WHEN k % 5 = 0 THEN 'fail' ELSE 'pass' END FROM n
    UNION ALL SELECT k, 'passage:1', CASE WHEN c % 2 = 0 THEN 'pass' WHEN k % 2 = 0 THEN 'needs_review' ELSE 'fail' END FROM live WHERE c IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT k, 'artifact:1', CASE WHEN k % 6 = 0 THEN 'pass' ELSE 'fail' END FROM live
    UNION ALL SELECT k, 'action_allowlist', CASE WHEN p LIKE '1%' THEN 'fail' ELSE 'pass' END FROM live
    UNION ALL SELECT k, 'source_immutable:c', CASE WHEN k % 7 = 0 THEN 'fail' ELSE 'pass' END FROM live
    UNION ALL SELECT k, 'label_provenance', 'needs_review' FROM live WHERE k % 9 = 0""")  # fmt: skip
def eval_score_case(spark, d):
    """Orders as cases: their lines' quantities calculated, their customers cited, with faults by the order's number."""
    o, k = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "case_id"), F.col("case_id")
    total = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sum(F.col("l_quantity").cast("decimal(20,2)")).alias("q"))
    none = F.lit(None).cast("string")
    bench = scoring.Bench(
        cases=o.select("case_id", F.when(F.col("o_orderstatus") == "O", "unsupported").otherwise("answerable").alias("answerability"), F.when(k % 9 > 0, "human_reviewed").alias("provenance"), none.alias("manual"), F.array(F.lit("read")).alias("allowed")),
        outcomes=o.select("case_id", F.when(F.col("o_orderstatus") == "P", "timeout").when(F.col("o_orderstatus") == "O", "awaiting_clarification").otherwise("completed").alias("run_state"), (k % 2 == 0).alias("clarified"), F.when(k % 5 == 0, "some kgs").otherwise("12 KG in all").alias("answer"), F.array(F.when(F.col("o_orderpriority").like("1%"), "write").otherwise("read")).alias("called"), F.lit(None).cast("boolean").alias("refused")),
        calculations=total.select("case_id", F.lit("quantity").alias("key"), F.col("q").alias("value"), F.lit(0.5).cast("decimal(5,2)").alias("tolerance"), F.lit("kg").alias("unit"), F.lit("l_quantity").alias("column")),
        observed=total.select("case_id", F.lit("quantity").alias("key"), F.when(k % 3 == 0, F.lit(0).cast("decimal(20,2)")).otherwise(F.col("q")).alias("value"), F.when(k % 4 == 1, "g").when(k % 4 > 0, " KG").alias("unit"), F.lit("L_Quantity").alias("column")),
        passages=o.join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("case_id", F.lit(1).alias("n"), F.lit("c").alias("alias"), F.array("c_name").alias("phrases"), F.when(k % 2 == 0, "diagnostic").otherwise("strict").alias("policy"), F.lit(2).alias("version")),
        evidence=o.join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("case_id", F.lit("c").alias("alias"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("It is  "), F.upper("c_name"))).otherwise("it is another").alias("text"), F.lit(True).alias("declared"), F.lit(2).alias("version")),
        artifacts=o.select("case_id", F.lit(1).alias("n"), F.lit("text/csv").alias("media_type"), F.lit('{"columns": ["a"]}').alias("schema")),
        made=o.select("case_id", F.when(k % 2 == 0, "text/csv").otherwise("text/html").alias("media_type"), F.when(k % 3 == 0, '{"columns": ["a", "b"]}').otherwise('{"columns": []}').alias("schema"), F.lit(True).alias("available")),
        sources=o.select("case_id", F.lit("c").alias("alias"), F.lit("h").alias("before"), F.when(k % 7 > 0, "h").alias("after")),
    )
    return scoring.score_cases(bench)


def _bundle(spark, d) -> tuple[str, portable.Links]:
    """Customers, their orders and documents as a workspace; orders refer to customers by id, and to the order before by reference."""
    path, o = scratch(spark, "bundle"), _t(spark, d, "orders")
    before = F.expr("lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    docs = _t(spark, d, "documents")
    portable.export_workspace(
        {
            "sources": _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"),
            "runs": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("source"), F.when(before.isNull(), F.array(F.lit("note:1"))).otherwise(F.array(F.concat(F.lit("run:"), before, F.lit("@2")))).alias("lineage")),
            "documents": docs.select(F.col("doc_id").alias("id"), "lang"),
        },
        docs.where("text IS NOT NULL").select(F.lit("documents").alias("part"), F.col("doc_id").alias("id"), F.lit("text").alias("role"), F.encode("text", "UTF-8").alias("content")),
        path,
    )
    return path, portable.Links({("runs", "source"): "sources"}, [("runs", "lineage")], {"run": "runs"})


@query("export_workspace", """
    SELECT 'sources' AS part, count(*) AS rows, '' AS sha256 FROM customer UNION ALL SELECT 'runs', count(*), '' FROM orders UNION ALL SELECT 'documents', count(*), '' FROM documents
    UNION ALL SELECT 'asset', count(*), sha256(text) FROM documents WHERE text IS NOT NULL GROUP BY 3""")
def export_workspace(spark, d):
    path, _ = _bundle(spark, d)
    owned, kept = spark.read.parquet(f"{path}/owned"), spark.read.parquet(f"{path}/assets").select("sha256")
    assets = owned.join(kept, "sha256").groupBy("sha256").agg(F.count("*").alias("rows"))
    return spark.read.parquet(f"{path}/manifest").select("part", "rows", F.lit("").alias("sha256")).unionByName(assets.select(F.lit("asset").alias("part"), "rows", "sha256"))


@query("import_workspace", """
    SELECT o_orderkey, o_custkey, CASE WHEN b IS NULL THEN 'note:1' ELSE 'run:' || b || '@2' END AS lineage, TRUE AS fresh FROM
        (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) JOIN customer ON o_custkey = c_custkey""")
def import_workspace(spark, d):
    """What was taken in under new ids, with its ids led back by the map that the import gives."""
    (path, links), out = _bundle(spark, d), scratch(spark, "workspace")
    ids = portable.import_workspace(spark, path, "copy", ["sources", "runs", "documents"], links, out)
    of = lambda part, a, b: ids.where(F.col("part") == part).select(F.col("old").cast("long").alias(a), F.col("new").alias(b))
    rows = spark.read.parquet(f"{out}/entities/runs").join(of("runs", "o_orderkey", "id"), "id").join(of("sources", "o_custkey", "source"), "source")
    rows = rows.withColumn("ref", F.regexp_extract(F.col("lineage")[0], "^run:(.*)@2$", 1)).join(of("runs", "before", "ref"), "ref", "left")
    return rows.select("o_orderkey", "o_custkey", F.coalesce(F.concat(F.lit("run:"), F.col("before").cast("string"), F.lit("@2")), F.col("lineage")[0]).alias("lineage"), (F.length("id") == 36).alias("fresh"))


@query("storage_get", """
    WITH n AS (SELECT c_nationkey AS n, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY 1)
    SELECT CAST(n AS VARCHAR) AS nation, CASE WHEN n % 5 = 0 THEN 'differs' ELSE 'ready' END AS state, CASE WHEN n % 5 > 0 THEN t END AS content FROM n UNION ALL SELECT 'none', 'missing', NULL""")
def storage_get(spark, d):
    """The customers of each nation as an object."""
    folder, c = scratch(spark, "objects"), _t(spark, d, "customer")
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(folder)
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.concat(x["c_name"], F.lit("\n")))
    held = c.groupBy(F.col("c_nationkey").cast("string").alias("nation")).agg(F.sha2(F.array_join(names, ""), 256).alias("sha256"))
    keys = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"c_nationkey=([^/]*)/", 1).alias("nation"), F.regexp_extract("path", r"(c_nationkey=[^/]*/[^/]*)$", 1).alias("key"))
    wanted = held.join(keys, "nation").select("key", F.when(F.col("nation") % 5 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    got = portable.stored(spark, folder, wanted.unionByName(spark.createDataFrame([("none", "0")], "key string, sha256 string")))
    return got.select(F.coalesce(F.nullif(F.regexp_extract("key", "=([^/]*)/", 1), F.lit("")), "key").alias("nation"), "state", F.decode("content", "UTF-8").alias("content"))
