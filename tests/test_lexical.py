import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeframe.text import retrieval
from lodeframe.text.stem import _IRREGULAR, STOP_WORDS, stem

# Words and stems of the published sample vocabulary of the rules.
STEMS = dict(
    x.split(":")
    for x in (
        "consign:consign consigned:consign consistency:consist knightly:knight knots:knot caresses:caress ponies:poni ties:tie cries:cri hopping:hop hoping:hope generously:generous "
        "communism:communism happy:happi dying:die relational:relat conditional:condit hopefulness:hope goodness:good formalize:formal electrical:electr adoption:adopt controlling:control rate:rate "
        "probate:probat roll:roll feed:feed agreed:agre plastered:plaster motoring:motor sing:sing sky:sky by:by say:say news:news conflated:conflat troubled:troubl sized:size filing:file "
        "national:nation rationally:ration abilities:abil gas:gas kiwis:kiwi gaps:gap youth:youth apologies:apolog succeeding:succeed formative:format triplicate:triplic decisiveness:decis "
        "adjustable:adjust replacement:replac effective:effect cease:ceas x2s:x2s er:er saying:say enjoyed:enjoy"
    ).split()
)


def test_stems(spark):
    rows = spark.createDataFrame(list(STEMS.items()) + [(None, None)], "w string, want string").withColumn("got", stem(F.col("w")))
    assert [tuple(r) for r in rows.where("NOT got <=> want").collect()] == []


def brute(docs, query, k, any_term, stems):
    """Every window of a document that holds all lexemes and no smaller one, by looking at all of them."""
    scored = defaultdict(list)
    asked = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    for i, text, lang in docs:
        english = (lang or "").lower().startswith("en")
        name = lambda w, english=english: stems[w] if english else w
        wanted = list(dict.fromkeys(name(w) for w in asked if not (english and w in STOP_WORDS)))
        places = [(p, name(w)) for p, w in enumerate(re.findall(r"\w+", (text or "").lower())) if not (english and w in STOP_WORDS) and name(w) in wanted]
        if any_term:
            score = 0.1 * len(places)
        else:
            has = lambda a, b, places=places, wanted=wanted: {t for _, t in places[a : b + 1]} == set(wanted)
            least = [(a, b) for a in range(len(places)) for b in range(a, len(places)) if has(a, b) and not has(a + 1, b) and not has(a, b - 1)] if has(0, len(places)) else []
            score = sum(0.1 / (1 + places[b][0] - places[a][0] - (b - a)) for a, b in least)
        if wanted and score:
            scored[english].append((-round(score, 9), i))
    own = [x for rows in scored.values() for x in sorted(rows)[:k]]
    return [(i, -s, rank) for rank, (s, i) in enumerate(sorted(own)[:k], 1)]


@pytest.mark.parametrize("query", ["the only houses", "an retion oner is", "zzz de"])
@pytest.mark.parametrize("any_term", [False, True])
def test_ranks_over_all_documents(spark, query, any_term):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.regexp_replace("text", "[^A-Za-z ]", " ").alias("text"), "lang")
    docs = docs.unionByName(spark.createDataFrame([(9001, "The house only; houses, housed. Only", "en-GB"), (9002, "the only houses", None), (9003, None, "en"), (9004, "la de la de la", "fr")], docs.schema))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0))).alias("w")).union(spark.createDataFrame([(w,) for w in query.split()], "w string")).distinct()
    stems = {r.w: r.s for r in words.withColumn("s", stem(F.col("w"))).collect()}
    index = retrieval.lexeme_index(docs, "doc_id", lang_col="lang")
    found = retrieval.lexical(index, query, 12, any_term, "doc_id")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.doc_id, r.score, r["rank"]) for r in found.collect()), key=lambda r: r[2])
    assert got == brute([tuple(r) for r in docs.collect()], query, 12, any_term, stems)


def test_a_stem_begins_as_its_word_does(spark):
    """What the search without an index relies on: but for its last two letters a stem is the word's beginning, and so is its first letter."""
    ends = "s es ies ied ed edly ing ingly eed eedly y ly er ion tional enci ization ational ator alism aliti fulness ousli iveness iviti biliti bli ogi fulli lessli alize icate iciti ical ful ness ative ement ible ll e".split()
    beginnings = "b d s y ab ya ey eye sse bill hopp rat troubl controll commun gener happ sens oper ski".split()
    made = [b + x + y for b in beginnings for x in ["", *ends] for y in ["", *ends]]
    words = spark.createDataFrame([(w,) for w in [*STEMS, *_IRREGULAR, *made]], "w string").repartition(4).withColumn("s", stem(F.col("w")))
    assert [tuple(r) for r in words.where("NOT startswith(w, left(s, greatest(1, length(s) - 2)))").collect()] == []


@pytest.mark.parametrize("any_term", [False, True])
def test_a_search_without_an_index_groups_only_what_is_asked(spark, any_term):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(9001, "The house only; houses, housed. Only", "en-GB"), (9002, "the only houses", None), (9003, None, "en")], docs.schema))
    for query in ("the only houses", "de la", "zzz"):
        want = retrieval.lexical(retrieval.lexeme_index(docs, "doc_id", lang_col="lang"), query, 12, any_term, "doc_id").collect()
        assert sorted(retrieval.lexical_scan(docs, query, 12, any_term, "doc_id", lang_col="lang").collect()) == sorted(want)
    assert retrieval.lexical_scan(docs.where("lang LIKE 'en%'"), "the", 12, any_term, "doc_id", lang_col="lang").collect() == []
    kept = retrieval.lexemes_asked(docs, spark.createDataFrame([("english", "hous"), ("simple", "houses")], "config string, lexeme string"), "doc_id", lang_col="lang")
    assert {(r.config, r.lexeme, tuple(r.positions)) for r in kept.where("doc_id > 9000").collect()} == {("english", "hous", (1, 3, 4)), ("simple", "houses", (2,))}


def test_many_queries_and_strict_budgets(spark):
    docs = spark.createDataFrame([(i, "cats here", "en" if i % 2 else "de") for i in range(20)], "chunk_id int, text string, lang string")
    index = retrieval.lexeme_index(docs, lang_col="lang")
    asked = spark.createDataFrame([("a", "cats", True), ("b", "here cats", False), ("c", "the", False), ("d", "?!", True)], "query_no string, query string, any boolean")
    got = retrieval.lexical_many(index, asked, 5, strict=True).collect()
    assert {(r.query_no, r.chunk_id % 2) for r in got} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    assert sorted(r.chunk_id for r in got if r.query_no == "a") == [0, 1, 2, 3, 5]
    assert retrieval.lexical_many(index.limit(0), asked, 5).collect() == []


def test_advanced_fuses_words_and_vectors(spark):
    chunks = spark.createDataFrame([(i, f"d{i % 3}", "red apple" if i < 6 else "blue", [float(i == 9), 1.0]) for i in range(12)], "chunk_id int, document string, text string, embedding array<double>")
    index = retrieval.lexeme_index(chunks)
    words = retrieval.advanced(index, chunks, ["red apple", "apple"], 4, "document").collect()
    assert [r.variants for r in words] == [2] * 4 and {r.document for r in words} == {"d0", "d1", "d2"}
    both = retrieval.advanced(index, chunks, ["red apple"], 12, "document", vectors=chunks.select("chunk_id", "embedding"), vector=[1.0, 1.0]).collect()
    assert 9 in {r.chunk_id for r in both}


def test_rewritings(spark):
    got = retrieval.variants("alpha beta Gamma delta epsilon")
    assert got == ["alpha beta Gamma delta epsilon", "alpha Gamma epsilon", "beta Gamma delta"]
    assert retrieval.variants("does it rise", "income of 2025") == ["does it rise", "does it rise income of 2025", "it rise"]
    assert retrieval.variants("GST rate", aliases={"gst": ["goods", "tax"]}) == ["GST rate", "GST rate goods tax"]
    assert retrieval.variants("rate in 2025", offered=["rate", "tax rate 2025"]) == ["rate in 2025", "tax rate 2025", "rate 2025"]
    assert retrieval.variants("grant income") == ["grant income"] and retrieval.variants("what is the grant") == ["what is the grant", "grant"]
    assert retrieval.variants("दर २०२५") == ["दर २०२५", "दर 2025"]
