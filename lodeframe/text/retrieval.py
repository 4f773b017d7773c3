"""Lexical, dense and fused retrieval over chunks, and what is done with the ranks."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.errors import RetrievalError, require
from lodeframe.text.expressions import STOP, ascii_digits
from lodeframe.text.stem import STOP_WORDS, stem

#: Constant of reciprocal-rank fusion, and how many candidates a request may have.
FUSION, CANDIDATES = 60, 80
#: Candidates that all queries of an advanced search share, and how many results each of them gives.
BUDGET, FOUND = 60, 20
_WORD = r"[\p{L}\p{M}\p{N}]+"
# Words that point back at an earlier question, and what each rewriting must keep.
_BACK = r"\b(it|that|those|same|they|its)\b|उस|वही|इसके"
_KEPT = r'\b\w*\d\w*\b|"[^"]+"|\b[A-Z][\w-]*\b'
VARIANTS, QUERY_CHARS = 3, 2000


def clean_query(query: str) -> str:
    text = " ".join(unicodedata.normalize("NFKC", query).split())
    require(bool(text), "empty_query", RetrievalError)
    require(len(text) <= 2000, "query_too_long", RetrievalError)
    return text


def inverted_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, positions): words of letters and digits in lower case. Write it bucketed by term to reuse it."""
    words = F.regexp_extract_all(F.lower(F.col(f"`{text_col}`")), F.lit(_WORD), F.lit(0))
    each = chunks.select(F.col(f"`{id_col}`"), F.posexplode(words).alias("pos", "term"))
    return each.groupBy("term", F.col(f"`{id_col}`")).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def _told(chunks: DataFrame, id_col: str, text_col: str, lang_col: str | None, heading_col: str | None, beside: Sequence[str] = ()) -> DataFrame:
    """(id, beside, config, words): each chunk's words in lower case, a heading before the text; nulls are empty."""
    text = F.concat_ws(" ", *([F.col(f"`{heading_col}`")] if heading_col else []), F.col(f"`{text_col}`"))
    english = F.coalesce(F.lower(F.col(f"`{lang_col}`")).startswith("en"), F.lit(False)) if lang_col else F.lit(False)
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    return chunks.select(*(F.col(f"`{c}`") for c in (id_col, *beside)), F.when(english, "english").otherwise("simple").alias("config"), words.alias("words"))


def lexeme_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", lang_col: str | None = None, heading_col: str | None = None, beside: Sequence[str] = ()) -> DataFrame:
    """(config, lexeme, id, positions, beside) for ranking by cover density; write it bucketed by lexeme to reuse it.

    Chunks of a language that begins with ``en`` are ``english``: their words are stemmed, and stop words left out,
    though they keep their places. All others, those without a language too, are ``simple``: words in lower case. A heading
    comes before the text. Nulls are empty. A lexeme has a row a word that it stands for. Columns ``beside`` an id, of which
    each id has one value, go along.
    """
    own = [F.col(f"`{c}`") for c in (id_col, *beside)]
    each = _told(chunks, id_col, text_col, lang_col, heading_col, beside).select(*own, "config", F.posexplode("words").alias("pos", "term"))
    terms = each.where((F.col("config") == "simple") | ~F.col("term").isin(*STOP_WORDS)).groupBy("config", "term", *own).agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return terms.select("config", F.when(F.col("config") == "english", stem(F.col("term"))).otherwise(F.col("term")).alias("lexeme"), own[0], "positions", *own[1:])


def lexemes_asked(chunks: DataFrame, lexemes: DataFrame, id_col: str = "chunk_id", text_col: str = "text", lang_col: str | None = None, heading_col: str | None = None) -> DataFrame:
    """The rows of ``lexeme_index`` that lexemes (config, lexeme) have, a row for all words of one, without the index.

    Two passes over the texts. The first takes the distinct English words that begin as a lexeme does, and stems each once;
    few words have one stem. The second keeps the places of these words alone, so that nothing else is grouped or shuffled.
    """
    told, lexemes = _told(chunks, id_col, text_col, lang_col, heading_col), lexemes.select("config", "lexeme").distinct()
    # A stem is its word but for the end: no rule changes the first letter, nor more than the stem's last two.
    begins = lexemes.where("config = 'english'").select(F.expr("left(lexeme, greatest(1, length(lexeme) - 2))").alias("begin")).distinct()
    begins = sorted(r["begin"] for r in begins.collect())  # of one query's words
    fits = lambda w: reduce(Column.__or__, (w.startswith(b) for b in begins), F.lit(False))
    words = told.where("config = 'english'").select(F.explode(F.filter("words", fits)).alias("term")).distinct().where(~F.col("term").isin(*STOP_WORDS))
    english = words.select(F.lit("english").alias("config"), "term", stem(F.col("term")).alias("lexeme")).join(F.broadcast(lexemes), ["config", "lexeme"])
    simple = lexemes.where("config = 'simple'").select("config", F.col("lexeme").alias("term"), "lexeme")
    each = told.select(F.col(f"`{id_col}`"), "config", F.posexplode("words").alias("pos", "term"))
    hits = each.join(F.broadcast(english.select("config", "term", "lexeme").unionByName(simple)), ["config", "term"])
    return hits.groupBy("config", "lexeme", F.col(f"`{id_col}`")).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def query_lexemes(queries: DataFrame) -> DataFrame:
    """(query_no, any, config, lexeme, t, n) of rows (query_no, query, any): the n lexemes that a query has under each configuration, numbered from 0."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(_WORD), F.lit(0)))
    told = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    ways = F.array(F.struct(F.lit("english").alias("config"), F.array_distinct(F.transform(told, stem)).alias("lexemes")), F.struct(F.lit("simple").alias("config"), words.alias("lexemes")))
    each = queries.select("query_no", "any", F.explode(ways).alias("way"))
    return each.select("query_no", "any", "way.config", F.size("way.lexemes").alias("n"), F.posexplode("way.lexemes").alias("t", "lexeme"))


def cover_density(entries: Column, n: Column) -> Column:
    """The sum of a tenth over one plus the other words within, over all minimal covers of the n lexemes.

    ``entries`` are (pos, t), the places of lexeme t, in order of place. One sweep: each entry ends the cover
    that begins at the earliest of the lexemes' last places, which is minimal if no cover before began there.
    """
    place = lambda pos, i: F.struct(pos.cast("int").alias("pos"), i.cast("int").alias("i"))
    none = F.lit(-1)

    def step(acc: Column, e: Column) -> Column:
        last = F.transform(acc["last"], lambda x, j: F.when(j == e["t"], place(e["pos"], acc["i"])).otherwise(x))

        def ended(last: Column) -> Column:
            low = F.array_min(last)
            new = low["pos"] > acc["began"]
            others = (e["pos"] - low["pos"]) - (acc["i"] - low["i"])
            return F.struct(last.alias("last"), F.when(new, low["pos"]).otherwise(acc["began"]).alias("began"), (acc["i"] + 1).alias("i"), (acc["score"] + F.when(new, 0.1 / (1 + others)).otherwise(0.0)).alias("score"))

        return F.get(F.transform(F.array(last), ended), F.lit(0))

    start = F.struct(F.array_repeat(place(none, none), n).alias("last"), none.alias("began"), F.lit(0).alias("i"), F.lit(0.0).alias("score"))
    return F.aggregate(entries, start, step, lambda acc: acc["score"])


def lexical_many(index: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", strict: bool = False) -> DataFrame:
    """(query_no, id, score, rank): for each of rows (query_no, query, any) the k best chunks that have all its lexemes, or any.

    Chunks are ranked within their configuration, and both lists merged: k of each, or with ``strict`` half of k each, the
    odd one English. With ``any`` every place of a lexeme is a cover of its own. Scores have nine digits; ties go by id.
    """
    if "config" not in index.columns:
        index = index.select(F.lit("simple").alias("config"), F.col("term").alias("lexeme"), F.col(f"`{id_col}`"), "positions")
    hits = index.join(query_lexemes(queries), ["config", "lexeme"])
    found = hits.groupBy("query_no", "any", "config", "n", F.col(f"`{id_col}`")).agg(F.collect_list(F.struct("positions", "t")).alias("lists"))
    found = found.where(F.col("any") | (F.size(F.array_distinct("lists.t")) == F.col("n")))
    entries = F.array_sort(F.flatten(F.transform("lists", lambda w: F.transform(w["positions"], lambda p: F.struct(p.cast("int").alias("pos"), w["t"].alias("t"))))))
    score = F.when(F.col("any"), F.size(entries) * 0.1).otherwise(cover_density(entries, F.col("n")))
    scored = found.select("query_no", "config", F.col(f"`{id_col}`"), F.round(score, 9).alias("score"))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), id_col))
    most = F.when(F.col("config") == "english", (k + 1) // 2 if strict else k).otherwise(k // 2 if strict else k)
    own = scored.withColumn("rank", best("query_no", "config")).where((F.col("rank") <= k) & (F.col("rank") <= most))
    return own.drop("config").withColumn("rank", best("query_no")).where(F.col("rank") <= k)


def lexical(index: DataFrame, query: str, k: int, any_term: bool = False, id_col: str = "chunk_id") -> DataFrame:
    """(id, score, rank) of one query: see ``lexical_many``."""
    asked = index.sparkSession.createDataFrame([(0, clean_query(query), any_term)], "query_no int, query string, any boolean")
    return lexical_many(index, asked, k, id_col).drop("query_no")


def lexical_scan(chunks: DataFrame, query: str, k: int, any_term: bool = False, id_col: str = "chunk_id", text_col: str = "text", lang_col: str | None = None, heading_col: str | None = None) -> DataFrame:
    """What ``lexical`` finds in the index of these chunks, for a query that is asked once: only its lexemes are looked for."""
    asked = chunks.sparkSession.createDataFrame([(0, clean_query(query), any_term)], "query_no int, query string, any boolean")
    found = lexemes_asked(chunks, query_lexemes(asked), id_col, text_col, lang_col, heading_col)
    return lexical_many(found, asked, k, id_col).drop("query_no")


def dense(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance, rank): exact cosine distance, ties by id."""
    v = F.col(f"`{vector_col}`")
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    distance = 1 - dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))
    best = vectors.where(F.size(v) == len(query)).select(F.col(f"`{id_col}`"), distance.alias("distance")).orderBy("distance", id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


def vector_check(vectors: DataFrame, size: int, vector_col: str = "embedding") -> DataFrame:
    """Adds code: null, or why the vector can't be used."""
    v = F.col(f"`{vector_col}`")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.withColumn("code", F.when(F.size(v) != size, "embedding_dimension_mismatch").when(bad, "embedding_invalid_vector").when(~norm.between(0.98, 1.02), "embedding_invalid_norm"))


def fuse(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """(id, score, rank_a, rank_b, rank) by reciprocal ranks of two lists, ties by id."""
    both = a.select(F.col(f"`{id_col}`"), F.col("rank").alias("rank_a")).join(b.select(F.col(f"`{id_col}`"), F.col("rank").alias("rank_b")), id_col, "full")
    part = lambda c: F.coalesce(1 / (FUSION + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("rank_a") + part("rank_b")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def fuse_variants(lists: DataFrame, id_col: str, consensus: bool = False) -> DataFrame:
    """(id, score, variants, rank) of rows (id, variant, rank); consensus raises what several variants found."""
    n = F.count("*")
    score = F.sum(1 / (FUSION + F.col("rank"))) * ((1 + 0.1 * (n - 1)) if consensus else F.lit(1.0))
    out = lists.groupBy(F.col(f"`{id_col}`")).agg(score.alias("score"), n.alias("variants"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def diversify(ranked: DataFrame, document_col: str, limit: int) -> DataFrame:
    """Round-robin over documents: the next hit of the document with the fewest so far, by rank."""
    turn = F.row_number().over(Window.partitionBy(F.col(f"`{document_col}`")).orderBy("rank"))
    return ranked.withColumn("turn", turn).withColumn("place", F.row_number().over(Window.orderBy("turn", "rank"))).where(F.col("place") <= limit)


def neighbours(chunks: DataFrame, hits: DataFrame, n: int, document_col: str, id_col: str = "chunk_id") -> DataFrame:
    """Chunks at most n places from a hit in its document: (hit, id, ordinal, distance)."""
    require(0 <= n <= 2, "invalid_neighbors", RetrievalError)
    at = hits.join(chunks, id_col).select(F.col(f"`{id_col}`").alias("hit"), F.col(f"`{document_col}`").alias("__d"), F.col("ordinal").alias("__c"), F.explode(F.sequence(F.col("ordinal") - n, F.col("ordinal") + n)).alias("__o"))
    others = chunks.select(F.col(f"`{document_col}`").alias("__d"), F.col("ordinal").alias("__o"), F.col(f"`{id_col}`"))
    return at.join(others, ["__d", "__o"]).select("hit", id_col, F.col("__o").alias("ordinal"), (F.col("__o") - F.col("__c")).alias("distance"))


def expand(chunks: DataFrame, hits: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The previous, next and parent chunks of hits: (id, expanded_from, expansion)."""
    own = hits.join(chunks, id_col)
    ways = F.explode(F.array(*(F.struct(F.lit(w).alias("expansion"), F.col(c).alias("other")) for w, c in (("neighbor", "previous_id"), ("neighbor", "next_id"), ("parent", "parent_id")))))
    return own.select(F.col(f"`{id_col}`").alias("expanded_from"), ways.alias("w")).select("expanded_from", "w.expansion", F.col("w.other").alias(id_col)).where(F.col(f"`{id_col}`").isNotNull()).distinct()


def _overlap(earlier: str, later: str) -> bool:
    a, b = earlier.rstrip().casefold(), later.lstrip().casefold()
    return any(a.endswith(b[:n]) for n in range(min(len(a), len(b), 512), 47, -16))


def dedupe_adjacent(ranked: list[dict]) -> list[dict]:
    """Drops a neighbour, in its document, of a better hit whose text runs on into it; for lists of at most CANDIDATES."""
    kept: list[dict] = []
    for c in ranked:
        near = [o for o in kept if o["document_id"] == c["document_id"] and o["chunk_id"] in (c["previous_id"], c["next_id"])]
        if not any(_overlap(*(x["text"] for x in sorted((o, c), key=lambda x: x["ordinal"]))) for o in near):
            kept.append(c | {"rank": len(kept) + 1})
    return kept


def passages(ranked: DataFrame, budget: int, n: int, text_col: str = "text") -> DataFrame:
    """An equal share of the characters for each of n passages, and whether it was cut."""
    share = max(1, budget // max(1, n))
    return ranked.withColumns({text_col: F.substring(text_col, 1, share), "truncated": F.length(text_col) > share})


def within_budget(passages: list[dict], characters: int, size: int) -> list[dict]:
    """Passages in order for as long as characters and UTF-8 bytes last; the one that doesn't fit ends it."""
    out: list[dict] = []
    for p in passages:
        characters -= len(p["text"])
        size -= len(p["text"].encode())
        if characters < 0 or size < 0:
            break
        out.append(p)
    return out


def chunks_hash(chunks: DataFrame, document_col: str, id_col: str = "chunk_id") -> DataFrame:
    """(document, hash) over ids and texts in order: the fingerprint of what an index was built on."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.col(f"`{id_col}`").cast("string").alias("i"), "text")))
    line = F.transform(parts, lambda p: F.concat_ws("\0", p["i"], p["text"]))
    return chunks.groupBy(F.col(f"`{document_col}`")).agg(F.sha2(F.array_join(line, "\0"), 256).alias("hash"))


def stale(hashes: DataFrame, built: DataFrame, document_col: str) -> DataFrame:
    """Documents whose fingerprint has no finished generation yet."""
    return hashes.join(built, [document_col, "hash"], "left_anti")


def search(chunks: DataFrame, index: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, mode: str = "hybrid", limit: int = 10) -> DataFrame:
    """Text, vector or hybrid search; without vectors a hybrid search is a lexical one. (chunk_id, score, rank)"""
    require(mode in ("text", "vector", "hybrid"), "invalid_mode", RetrievalError)
    require(1 <= limit <= 50, "invalid_limit", RetrievalError)
    k = min(4 * limit, CANDIDATES)
    text = lexical(index, query, k) if mode != "vector" else None
    near = dense(vectors, vector, k, "chunk_id") if mode != "text" and vectors is not None and vector else None
    require(text is not None or near is not None, "embedding_unavailable", RetrievalError)
    if text is not None and near is not None:
        return fuse(text, near, "chunk_id").select("chunk_id", "score", "rank").where(F.col("rank") <= limit)
    one = text if text is not None else near.withColumn("score", 1 - F.col("distance"))
    return one.select("chunk_id", "score", "rank").where(F.col("rank") <= limit)


def in_scope(rows: DataFrame, selected: DataFrame, *keys: str) -> DataFrame:
    """Rows whose (source, version) is selected."""
    return rows.join(selected.select(*keys).distinct(), list(keys), "left_semi")


def relevance(ranked: DataFrame, relevant: DataFrame, k: int, query_col: str, id_col: str) -> DataFrame:
    """(query, precision, recall, reciprocal_rank, hit_rate) at k."""
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(relevant.withColumn("__r", F.lit(1)), [query_col, id_col], "left")
    got = hits.groupBy(query_col).agg(F.count("*").alias("n"), F.count("__r").alias("h"), F.min(F.when(F.col("__r") == 1, F.col("rank"))).alias("first"))
    want = relevant.groupBy(query_col).agg(F.count("*").alias("want"))
    m = want.join(got, query_col, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return m.select(query_col, zero(F.col("h") / F.col("n")).alias("precision"), zero(F.col("h") / F.col("want")).alias("recall"), zero(1 / F.col("first")).alias("reciprocal_rank"), F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"))


def eligible(chunks: DataFrame, documents: DataFrame, generations: DataFrame, selected: DataFrame) -> DataFrame:
    """Chunks of ready documents of selected (source, version), by the generation that the document points at.

    documents: (document, source, version, state, generation); generations: (generation, document, version,
    status). Generations that are neither ready nor degraded, or of another version, serve no one.
    """
    ready = documents.where("state = 'ready'").join(selected.select("source", "version").distinct(), ["source", "version"], "left_semi")
    serving = generations.where("status IN ('ready', 'degraded')").select("generation", "document", "version")
    current = ready.join(serving, ["generation", "document", "version"], "left_semi").select("document", "generation")
    return chunks.join(current, ["document", "generation"], "left_semi")


def dense_coverage(documents: DataFrame, generations: DataFrame, selected: DataFrame, model: dict[str, object]) -> DataFrame:
    """(selected, matching): ready documents in scope, and those whose ready generation is of this model (its columns' values)."""
    ready = documents.where("state = 'ready'").join(selected.select("source", "version").distinct(), ["source", "version"], "left_semi")
    fits = F.col("status") == "ready"
    for name, value in model.items():
        fits &= F.col(name) == value
    own = generations.where(fits).select("generation", "document", "version").distinct().withColumn("__fits", F.lit(1))
    return ready.join(own, ["generation", "document", "version"], "left").agg(F.count_distinct("document").alias("selected"), F.count_distinct(F.when(F.col("__fits") == 1, F.col("document"))).alias("matching"))


def rewritings(queries: DataFrame, most: int = VARIANTS) -> DataFrame:
    """(query_no, place, variant): each query, then its distinct rewritings by the order of the rules below.

    queries: (query_no, query, previous string, offered array<string>, aliases array<struct<key, words array<string>>>); all but the
    number and the query may be null. No rewriting drops a name, a number or a quotation that it isn't free to drop,
    and none is longer than QUERY_CHARS; a query without words has itself alone.
    """
    query = F.trim("query")
    words = F.split(query, r"\s+")
    kept = F.array_distinct(F.regexp_extract_all(query, F.lit("(?U)" + _KEPT), F.lit(0)))
    holds = lambda text: F.forall(kept, lambda k: F.contains(text, k))
    telling = F.filter(words, lambda w: ~F.lower(F.regexp_replace(w, "^[?,।.]+|[?,।.]+$", "")).isin(*STOP))
    some = lambda condition, value: F.when(condition, F.array(value)).otherwise(F.array().cast("array<string>"))
    every = lambda side: F.array_join(F.filter(telling, lambda w, i: (i % 2 == side) | F.exists(kept, lambda k: F.contains(w, k))), " ")
    none = F.array().cast("array<string>")
    rules = {
        "itself": F.array(query),
        "offered": F.coalesce(F.filter(F.reverse("offered"), holds), none),
        "reference": some(F.col("previous").isNotNull() & query.rlike("(?iU)" + _BACK), F.concat_ws(" ", query, F.trim("previous"))),
        "telling": F.array(F.array_join(telling, " ")),
        "aliases": F.coalesce(F.transform(F.filter("aliases", lambda a: F.contains(F.lower(query), F.lower(a["key"]))), lambda a: F.concat_ws(" ", query, F.array_join(a["words"], " "))), none),
        "digits": some(ascii_digits(query) != query, ascii_digits(query)),
        "halves": F.when(F.size(telling) > 4, F.array(every(0), every(1))).otherwise(none),
    }
    made = F.filter(F.transform(F.flatten(F.array(*rules.values())), lambda v: F.trim(v)), lambda v: F.length(v).between(1, QUERY_CHARS))
    return queries.select("query_no", F.posexplode(F.slice(F.array_distinct(made), 1, most)).alias("place", "variant"))


_ASKED = "query_no int, query string, previous string, offered array<string>, aliases array<struct<key: string, words: array<string>>>"


def variants(query: str, previous: str | None = None, aliases: dict[str, list[str]] | None = None, offered: list[str] = (), most: int = VARIANTS) -> list[str]:  # type: ignore[assignment]
    """The rewritings of one query, itself first."""
    spark = SparkSession.active()
    row = (0, query, previous, list(offered), list((aliases or {}).items()))
    return [r["variant"] for r in sorted(rewritings(spark.createDataFrame([row], _ASKED), most).collect(), key=lambda r: r["place"])]


def hop(query: str, terms: list[str], excerpts: list[str]) -> str:
    """A dependent query: with terms that earlier evidence has verbatim."""
    require(bool(terms) == bool(excerpts), "invalid_hop", RetrievalError)
    require(all(t.strip() and len(t) <= 100 and any(t in e for e in excerpts) for t in terms), "invalid_hop_terms", RetrievalError)
    return clean_query(" ".join([query, *terms]))


def advanced(index: DataFrame, chunks: DataFrame, queries: list[str], limit: int, document_col: str, id_col: str = "chunk_id", vectors: DataFrame | None = None, vector: list[float] | None = None) -> DataFrame:
    """(id, document, score, variants, rank, place): what several queries find, fused with consensus and spread over documents.

    The first query asks for all its lexemes, the others for any. All queries together have BUDGET candidates, an equal
    share each, half of it a configuration; each gives its first FOUND. With vectors, a query's words and the
    vector are fused by their ranks before. One scan of the index serves all queries.
    """
    require(1 <= len(queries) <= VARIANTS and 1 <= limit <= 50, "invalid_limit", RetrievalError)
    share = BUDGET // len(queries)
    asked = index.sparkSession.createDataFrame([(i, clean_query(q), i > 0) for i, q in enumerate(queries)], "query_no int, query string, any boolean")
    lists = lexical_many(index, asked, share, id_col, strict=True).select(id_col, F.col("query_no").alias("variant"), "rank")
    if vectors is not None and vector is not None:
        near = dense(vectors, vector, share, id_col).select(id_col, F.explode(F.sequence(F.lit(0), F.lit(len(queries) - 1))).alias("variant"), "rank")
        both = lists.unionByName(near).groupBy("variant", id_col).agg(F.sum(1 / (FUSION + F.col("rank"))).alias("score"))
        lists = both.withColumn("rank", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("score"), id_col))).drop("score")
    # At most BUDGET rows, twice as many with vectors, meet the chunks.
    found = fuse_variants(lists.where(F.col("rank") <= min(FOUND, share)), id_col, consensus=True)
    return diversify(chunks.select(id_col, document_col).join(F.broadcast(found), id_col), document_col, limit).drop("turn")
