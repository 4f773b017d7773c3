import random

import pytest

from lodeframe.errors import FileError, RetrievalError
from lodeframe.operators import evaluate, lineage, tables
from lodeframe.text import expressions as x
from lodeframe.text import retrieval


def block(row, *cells):
    return (1, "table_row", 0, row, list(cells))


def test_tables(spark):
    rows = [block(0, "Applicant", "Amount", "Amount"), block(1, "A-01", "₹10,000", "1,2"), block(2, "A-02", "12500", "x")]
    t = tables.candidates(spark.createDataFrame(rows, "doc long, kind string, table int, row int, cells array<string>"), "doc")
    values = tables.cells(t, "doc")
    s = {r["col"]: r for r in tables.schema(values, "doc").collect()}
    assert (s[1]["type"], s[1]["unit"], s[0]["type"]) == ("integer", "INR", "text")
    assert s[2]["warnings"] == ["invalid_grouping"]
    out = tables.accept(values, "doc", 1, 0)
    assert out.columns == ["Applicant", "Amount", "Amount (2)"] and tuple(out.first()) == ("A-01", "10000", "1,2")
    with pytest.raises(FileError, match="table_not_found"):
        tables.accept(values, "doc", 1, 9)


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            new = [i]
            for j, q in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in "xy")
        assert evaluate.edit_distance(a, b) == plain(a, b)


def test_fusion_ties_go_by_id(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("x", 2)], "id string, rank int")
    got = [(r.id, r.rank, round(r.score, 9)) for r in retrieval.fuse(a, b, "id").orderBy("rank").collect()]
    assert got == [("x", 1, round(1 / 61 + 1 / 62, 9)), ("y", 2, round(1 / 61 + 1 / 62, 9))]


def test_search(spark):
    chunks = spark.createDataFrame([("1", "the cat sat on a mat"), ("2", "cat and dog"), ("3", "a dog")], "chunk_id string, text string")
    index = retrieval.inverted_index(chunks)
    assert [r.chunk_id for r in retrieval.search(chunks, index, None, "cat dog", None).collect()] == ["2"]
    assert {r.chunk_id for r in retrieval.lexical(index, "cat dog", 9, True).collect()} == {"1", "2", "3"}
    for call, code in ((lambda: retrieval.search(chunks, index, None, "x", None, "other"), "invalid_mode"), (lambda: retrieval.clean_query("  "), "empty_query"), (lambda: retrieval.search(chunks, index, None, "x", None, "vector"), "embedding_unavailable")):
        with pytest.raises(RetrievalError, match=code):
            call()


def test_numbers_and_redaction(spark):
    df = spark.createDataFrame([("It was 1,234.50 and -7, not 2020-01; see [evidence:9].", "Bearer abc https://u:p@h/x my-secret")], "a string, b string")
    row = df.select(x.numeric_claims(x.F.col("a")), x.redact(x.F.col("b"), ["my-secret"])).first()
    assert row[0][:2] == ["1234.50", "-7"]
    assert row[1] == "Bearer [redacted] https://[redacted]@h/x [redacted]"


def test_lineage(spark):
    refs = spark.createDataFrame([("source:a@2",), ("dataset:b#ff",), ("artifact:c",), ("junk",)], "ref string")
    known = spark.createDataFrame([("source", "a", 1, "x"), ("dataset", "b", 1, "ff"), ("artifact", "c", 9, None)], "kind string, id string, version long, hash string")
    assert {r.ref for r in lineage.unresolved(refs, known).collect()} == {"source:a@2", "junk"}


def test_schema_match():
    assert evaluate.schema_matches({"a": [1, {"b": 2, "c": 3}]}, {"a": [1, {"b": 2}]})
    assert not evaluate.schema_matches({"a": [1]}, {"a": [1, 2]})
