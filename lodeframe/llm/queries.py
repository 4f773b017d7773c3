"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import audit, binary, bpe, decontam, jaccard, lines, lm, phrases, secrets, topk, toxicity, urls, warc
from lodeframe.llm.shared import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


#: The rules that the query is to judge by.
RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lines.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return binary.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontam": op1_decontam,
    "op2_bpe": op2_bpe,
    "op3_jaccard": op3_jaccard,
    "op4_secrets": op4_secrets,
    "op5_lm": op5_lm,
    "op6_urls": op6_urls,
    "op7_lines": op7_lines,
    "op8_topk": op8_topk,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_audit": op11_audit,
    "op12_binary": op12_binary,
    "op13_phrases": op13_phrases,
}

#: Lower-cases A-Z alone.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_decontam": f"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), b AS (
          SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), bw AS (
          SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
          FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
        ), k AS (SELECT DISTINCT k FROM bw),
        dw AS (
          SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
          FROM d, k, unnest(range(1, len(w) - k + 2)) AS t(i)
        ), m AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
        h AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id
        ), n AS (
          SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    # Without redirects or canonical links in the table, the method's own verdict is allow.
    "op6_urls": f"""
        WITH p AS (
          SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
        ), r(v, h, s) AS (
          VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                 ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
        ), m AS (
          SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict
          FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id
        ) SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op7_lines": r"""
        WITH l AS (
          SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS s
          FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
        ), t AS (
          SELECT doc_id, line, list_filter(regexp_split_to_array(s, '[ \t\r]+'), lambda x: x <> '') AS r,
                 list_filter(regexp_split_to_array(regexp_replace(s, '[^ \t\r]*[0-9][^ \t\r]*', '<*>', 'g'), '[ \t\r]+'), lambda x: x <> '') AS t FROM l
        ), n AS (SELECT *, len(t) AS n, len(list_filter(t, lambda x: x <> '<*>')) AS f FROM t WHERE len(t) > 0),
        k AS (
          SELECT doc_id, line, n, array_to_string(t, ' ') AS k FROM n WHERE n >= 4 AND f >= 3
          UNION ALL
          SELECT doc_id, line, n, chr(9) || array_to_string(r, ' ') AS k FROM n WHERE n < 4 OR f < 3
          UNION ALL
          SELECT doc_id, line, n,
                 array_to_string(t[1 : a], ' ') || ' <+> ' || array_to_string(t[b + 1 : n], ' ') AS k
          FROM (SELECT *, CAST(floor(3 + (n - 3) * p / 3.0) AS BIGINT) AS a, CAST(floor(3 + (n - 3) * (p + 1) / 3.0) AS BIGINT) AS b
                FROM n, (VALUES (0), (1), (2)) AS v(p) WHERE f >= 12)
        ), r AS (SELECT n, k, min(doc_id) AS first FROM k GROUP BY n, k HAVING min(doc_id) <> max(doc_id)),
        g AS (SELECT doc_id, list(DISTINCT line) AS gone FROM k JOIN r USING (n, k) WHERE doc_id <> first GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
               sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: string_split(text, chr(10))[i]), chr(10)), '')) AS kept_sha256
        FROM documents LEFT JOIN g USING (doc_id)""",
    "op8_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100""",
    "op11_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s FROM documents),
        w AS (SELECT *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w FROM t),
        m AS (
          SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                 100 * len(regexp_replace(s, '[^A-Z]', '', 'g')) > 3 * length(s) AS c, regexp_matches(s, '[#$%&*|]') AS d,
                 doc_id > min(doc_id) OVER (PARTITION BY s) AS e FROM w
        ), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        f AS (
          SELECT part, a::INT + b::INT * 2 + c::INT * 4 + d::INT * 8 + e::INT * 16 AS m, count(*) AS n,
                 count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(bad, false)) AS bad
          FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
        ), x(x, v) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (
          SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS v FROM x a, x b, x c, x d, x e
          WHERE a.v | b.v | c.v | d.v | e.v = 31
        ), s AS (
          SELECT filter_order, CAST(i AS INT) AS step, v[i] AS bit, CAST(coalesce(list_sum(v[1 : i - 1]), 0) AS BIGINT) AS prior
          FROM o, unnest(range(1, 6)) AS u(i)
        ), r AS (
          SELECT part, filter_order, step, bit,
                 coalesce(sum(n) FILTER (m & bit = 0 AND m & prior = 0), 0) AS kept, coalesce(sum(n) FILTER (m & bit <> 0 AND m & prior = 0), 0) AS removed,
                 coalesce(sum(n) FILTER (m & bit <> 0 AND m & prior <> 0), 0) AS redundant, coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails,
                 coalesce(sum(good) FILTER (m & bit <> 0 AND m & prior = 0), 0) AS good_lost,
                 coalesce(sum(bad) FILTER (m & bit <> 0 AND m & prior = 0), 0) AS toxic_lost
          FROM f, s GROUP BY ALL
        )
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
    "op13_phrases": rf"""
        WITH p AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (
          SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
          FROM w, (VALUES (1), (2), (3), (4)) AS v(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL
        ), n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
        s AS (
          SELECT c.lang, c.phrase, c.a, j, gl.f AS l, gr.f AS r, (2000000::HUGEINT * c.a) // (gl.f + gr.f) AS score
          FROM c, unnest(range(1, c.k)) AS t(j) JOIN g AS gl ON gl.lang = c.lang AND gl.phrase = array_to_string(c.w[1 : j], ' ')
          JOIN g AS gr ON gr.lang = c.lang AND gr.phrase = array_to_string(c.w[j + 1 : c.k], ' ')
        ), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        i AS (
          SELECT lang, array_to_string(w[j : j + m - 1], ' ') AS phrase, max(a) AS most
          FROM c, unnest(range(2, k)) AS t(m), unnest(range(1, k - m + 2)) AS u(j) GROUP BY ALL
        ), r AS (
          SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
          FROM b LEFT JOIN i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a
        )
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
}
