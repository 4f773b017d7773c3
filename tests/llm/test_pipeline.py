import hashlib

import pytest

import corpus_pipeline as cp
from lodeframe.llm.words import space_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def sf_dir(spark, tmp_path):
    clean = [f"line {chr(97 + i)} of the first kind stands here\nsecond {chr(97 + i)} goes on with other words {chr(110 - i)} and ends" for i in range(12)]
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(20 + i, f"you are a vile dirty scoundrel number {chr(97 + i)} and more of that vile scoundrel talk {chr(98 + i)}") for i in range(12)]
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs += [(40, f"own words of forty come here\n{passage}\nand its end is this one"), (41, f"forty one begins in its way\n{passage}\nto be over now and then")]
    docs += [(50, clean[0]), (51, None), (52, "")]
    item = "the test item asks for a word that no one here would ever say twice"
    docs += [(60, f"start of it {item} and out")]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(20 <= i < 40)) for i, _ in docs if i < 40], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = cp.written(out, name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert not any(20 <= i < 40 for i in seen["toxicity"]) and set(range(12)) <= set(seen["toxicity"])
    lines = seen["line_dedup"]
    assert set(range(12)) <= set(lines) and {51, 52} <= set(lines)
    assert sum("paa" in r.text for r in lines.values() if r.text) == 1
    assert all(r.n_chars == len(r.text) for r in lines.values() if r.text is not None)
    assert 50 not in seen["near_duplicates"] and set(range(12)) <= set(seen["near_duplicates"])
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {60}


def test_run_gives_a_row_a_kept_document(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert set(range(12)) <= {r.doc_id for r in rows} and len({r.doc_id for r in rows}) == len(rows)
    empty = next(r for r in rows if r.doc_id == 51)
    assert empty.n_tokens == 0 and empty.ids == [] and empty.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(len(r["ids"]) == r.n_tokens for r in rows) and space_words(None) == []


def test_shared_passages_do_not_pass_line_dedup(spark, sf_dir):
    passages = [" ".join(f"{a}{chr(97 + i)}{a}" for i in range(14)) for a in "qrst"]
    rows = [(70 + i, f"opening words of document {chr(97 + i)} here\n{p}") for i, p in enumerate(passages)] + [(80, "\n".join([*passages, "its own line is short"]))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    left = {r.doc_id: r.text for r in cp.drop_lines(spark, frame, sf_dir).collect()}
    assert left[80] == "its own line is short" and all(left[70 + i] == rows[i][1] for i in range(4))


def test_rows_are_dropped_one_by_one(spark, sf_dir):
    texts = [" ".join(f"{a}{chr(97 + i)}{a}" for i in range(20)) for a in "ghjk"]
    item = "the test item asks for a word that no one here would ever say twice"
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (3, texts[3]), (None, texts[1]), (None, item), (3, item), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    near = cp.drop_near_duplicates(spark, frame, sf_dir)
    assert near.columns == frame.columns and seen(near) == sorted([(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (3, item), (None, None)], key=repr)
    assert seen(cp.drop_contaminated(spark, frame, sf_dir)) == sorted([r for r in rows if r[1] != item], key=repr)


def test_clashing_columns_empty_tables_and_repeated_rows(spark, sf_dir, tmp_path):
    extra = "score string, kept long, n_lines string, predicted int, contaminated string, component_id long, class string, id string, fixed int"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *(f"cast(null as {x.split()[1]}) AS `{x.split()[0]}`" for x in extra.split(", ")))
    twice = docs.union(docs.where("doc_id IN (0, 1)"))
    for rows, most in ((docs.limit(0), 0), (twice, 1)):
        for name, stage in cp.STAGES[:-1]:
            rows = cp.written(stage(spark, rows, sf_dir), name)
            assert rows.schema == docs.schema
        got = cp.tokenize(spark, rows, sf_dir).collect()
        assert max((sum(r.doc_id == i for r in got) for i in range(12)), default=0) == most
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert cp.run(spark, empty).collect() == []
