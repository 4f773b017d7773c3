import random

import pytest
from pyspark.sql import functions as F

from lodeframe.errors import FileError
from lodeframe.operators import lineage, pipeline, profile
from lodeframe.plans import evidence_catalog as e
from lodeframe.plans import more_catalog
from lodeframe.sources import files, sinks
from lodeframe.text import blocks, retrieval, summarize
from lodeframe.text import expressions as x


def test_profile_types_and_hints(spark):
    df = spark.createDataFrame([("007", "1", "x" * 300, None), ("1", "2.5", "y", None)], "id string, price string, note string, none string")
    got = {r["name"]: r for r in profile.profile(df)}
    assert (got["id"]["type"], got["id"]["hints"]) == ("string", {"leading_zero_identifier": True, "type_inference_uncertain": True})
    assert (got["price"]["type"], got["price"]["hints"]) == ("decimal", {"currency_unknown": True})
    assert got["note"]["hints"] == {"example_values_truncated": True} and len(got["note"]["examples"][0]) == 256
    assert (got["none"]["type"], got["none"]["sql_type"], got["none"]["nullable"]) == ("unknown", "VARCHAR", True)


def test_choice_of_sentences_against_a_plain_loop():
    rng = random.Random(5)
    for _ in range(50):
        scored = [{"chunk_id": rng.randrange(6), "score": rng.choice([1.0, 2.0, 2.5]), "sentence": " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "word"], k=4))} for _ in range(rng.randrange(14))]
        n = len({r["chunk_id"] for r in scored})
        left, want, known, used = list(enumerate(scored)), [], set(), set()
        while left and len(want) < 6:
            i, r = min(left, key=lambda p: (-p[1]["score"] * (1 + 0.15 * len(set(p[1]["sentence"].split()) - known)), p[0]))
            left.remove((i, r))
            if r["chunk_id"] not in used or len(used) >= min(10, n):
                want.append(r)
                used.add(r["chunk_id"])
                known |= set(r["sentence"].split())
        assert summarize.choose(scored, n) == want


def test_windows_join_to_the_text(spark):
    text = "  a b\n" + " ".join(f"w{i}" for i in range(50)) + " \n"
    rows = blocks.token_windows(spark.createDataFrame([(1, text), (2, " "), (3, None)], "id int, text string"), "id", body=10, overlap=0).orderBy("part").collect()
    assert {r.id for r in rows} == {1} and "".join(r.text for r in rows) == text.lstrip()
    both = blocks.token_windows(spark.createDataFrame([(1, text)], "id int, text string"), "id", body=10, overlap=3).orderBy("part").collect()
    assert [r.tokens for r in both] == [10, 13, 13, 13, 13, 5]


def test_protected_spans_come_back(spark):
    texts = ["Visit https://a.b/c and `code` in New Delhi, 12.5 kg for USD [1].", "nothing here", "", None, "ABC" * 2]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", x.protect(F.col("t")).alias("p"))
    rows = df.select("t", "p.text", "p.originals", x.restore(F.col("p.text"), F.col("p.originals")).alias("back"), x.restore(F.concat("p.text", "p.text"), F.col("p.originals")).alias("twice")).collect()
    assert all(r.back == r.t for r in rows)
    assert rows[0].originals[:2] == ["Visit", "https://a.b/c"] and rows[0].twice is None


def test_references_are_whole_names(spark):
    values = ['{"a": "7"}', '{"a": ["run:7@2"]}', '{"7": 1}', '{"a": 7}', '{"a": "77"}', '{"a": "other:7"}', None]
    df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    ids = spark.createDataFrame([("7",)], "id string")
    assert {r.n for r in lineage.references(df, "v", ids).collect()} == {0, 1, 2}


def test_artifacts_are_bounded(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"columns": ["x", "X", ""], "rows": [[1, null, "é"], ["2"]]}')
    got = files.scan_artifact(spark, str(tmp_path / "a.json"), "json")
    assert got.columns == ["x", "X_2", "column_3"] and [tuple(r) for r in got.collect()] == [("1", None, "é"), ("2", None, None)]
    with pytest.raises(FileError, match="artifact_format_unsupported"):
        files.scan_artifact(spark, "x", "exe")


def test_a_rewriting_keeps_names_and_numbers(spark):
    assert retrieval.variants("rate of Acme in 2025", offered=["rate of acme 2025", "Acme 2025 rate"])[1] == "Acme 2025 rate"


@pytest.mark.parametrize("rule", e.RULES, ids="-".join)
def test_rules(spark, rule):
    call, want = e.RULES[rule]
    assert call() == want


@pytest.mark.parametrize("name", more_catalog.RULES)
def test_codes(spark, name):
    got = {case: more_catalog.code_of(lambda call=call: call(spark, "")) for case, (call, _) in more_catalog.RULES[name].items()}
    assert got and got == {case: code for case, (_, code) in more_catalog.RULES[name].items()}


def test_types_of_values(spark):
    want = {"1": "integer", "01": "string", "-2.50": "decimal", "1e5": "decimal", "TRUE": "boolean", "2026-04-01": "date", "2026-04-01T10:00:00": "timestamp", "31/12/2025": "date", "x": "string", "2026-13-01": "string"}
    rows = spark.createDataFrame([(v,) for v in want], "v string").select("v", profile.infer_type(F.col("v")).alias("kind")).collect()
    assert {r.v: r.kind for r in rows} == want


def test_units_and_names():
    assert [pipeline.derived_unit("multiply", "USD", "kg"), pipeline.derived_unit("divide", "USD", "kg"), pipeline.derived_unit("divide", "kg", "kg")] == ["USD*kg", "USD/kg", "1"]
    assert sinks.unique_names(["a", "a", "b", "a"]) == ["a", "a__2", "b", "a__3"]


def test_text_blocks_know_their_places(spark):
    text = "# Top\n\nfirst é line\n## Sub\n  \n\tsecond\n# Next\nlast"
    rows = blocks.text_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")).orderBy("ordinal").collect()
    lines = text.split("\n")
    assert [(r.line, r.heading) for r in rows if r.kind == "paragraph"] == [(2, "Top"), (5, "Top > Sub"), (7, "Next")]
    assert all(text[r.char_start : r.char_end] == lines[r.line] for r in rows) and {r.doc_id for r in rows} == {1}
