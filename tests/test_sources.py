import io
import zipfile

import pytest

from lodeframe.errors import FileError
from lodeframe.operators import profile
from lodeframe.sources import files, sinks
from lodeframe.text import blocks, context, retrieval, summarize
from lodeframe.text import expressions as x


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id;Name;name\n007;"a;b";\n8;"say ""x""";z\n'.encode())
    df = files.scan_csv(spark, str(p))
    assert df.columns == ["id", "Name", "name_2"]
    assert [tuple(r) for r in df.collect()] == [("007", "a;b", None), ("8", 'say "x"', "z")]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "a", "n": 12345678901234567890.10}, {"id": "b", "m": true}]')
    df = files.scan_json(spark, str(tmp_path / "a.json"))
    assert df.columns == ["id", "n", "m"] and df.first()["n"] == "12345678901234567890.10"
    for bad in ('[{"a": 1, "a": 2}]', '[{"a": [1]}]', '[{"a": NaN}]', "[]", '{"a": 1}'):
        with pytest.raises(FileError, match="records_invalid"):
            files.parse_records(bad)


def test_parquet_is_flat(spark, tmp_path):
    spark.range(3).selectExpr("array(id) AS a").write.parquet(str(tmp_path / "n"))
    with pytest.raises(FileError, match="records_invalid"):
        files.scan_parquet(spark, str(tmp_path / "n"))


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 5, "x & y"), ("007", 12345678901234567, None)], "a string, n long, t string")
    sinks.write_xlsx(df, str(tmp_path / "a.xlsx"))
    back = files.scan_xlsx(spark, str(tmp_path / "a.xlsx"))["data"]
    assert [tuple(r) for r in back.collect()] == [("'=1+1", "5", "x & y"), ("007", "12345678901234567", None)]
    with pytest.raises(FileError, match="xlsx_invalid"):
        files.guard_archive(b"no archive")


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, "-5"), (3, "ok")], "id long, t string").coalesce(1)
    w = sinks.write_csv(df, str(tmp_path / "o"), max_rows=2)
    assert (w.rows, w.truncated) == (2, True)
    assert "1,'=x" in "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))


def test_profile(spark):
    df = spark.createDataFrame([("01", "1", "2026-01-02", "5"), ("02", "2.5", "03/04/2026", ""), ("03", "", "x", None)], "code string, amount string, day string, n string").coalesce(1)
    p = {c["name"]: c for c in profile.profile(df)}
    assert p["code"]["type"] == "string" and p["code"]["hints"]["leading_zero_identifier"]
    assert p["amount"]["type"] == "decimal" and p["amount"]["missing_count"] == 1 and p["amount"]["hints"] == {"currency_unknown": True}
    assert p["day"]["hints"] == {"date_format_uncertain": True, "type_inference_uncertain": True}
    assert p["n"]["missing_count"] == 2 and p["code"]["examples"] == ["01", "02", "03"]
    assert profile.normalize_headers(["a", " A ", "", "a_2"]) == ["a", "A_2", "column_3", "a_2_2"]


def test_html_blocks(spark):
    html = "<h1>Top</h1><p>one <b>two</b></p><script>x<y</script><h2>Sub</h2><table><tr><th>A<th>B</tr><tr><td>1<td>2</tr></table>tail"
    rows = blocks.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("ordinal").collect()
    assert [(r.kind, r.text, r.heading) for r in rows] == [("heading", "Top", "Top"), ("paragraph", "one two", "Top"), ("heading", "Sub", "Top > Sub"), ("table_row", "A | B", "Top > Sub"), ("table_row", "1 | 2", "Top > Sub"), ("paragraph", "tail", "Top > Sub")]


def test_text_blocks(spark):
    rows = blocks.text_blocks(spark.createDataFrame([(1, "# A\nx\n\n## B\ny\n# C\nz")], "doc_id long, text string")).orderBy("ordinal").collect()
    assert [(r.text, r.heading) for r in rows] == [("A", "A"), ("x", "A"), ("B", "A > B"), ("y", "A > B"), ("C", "C"), ("z", "C")]
    assert (rows[1].char_start, rows[1].char_end, rows[3].line) == (4, 5, 4)


def test_byte_windows():
    for text in ("", "a" * 1000, "é" * 700, "x" * 10 + "👍" * 200):
        w = blocks.byte_windows(text)
        assert all(len(text[a:b].encode()) == n <= 480 for a, b, n in w)
        assert all(n0 < e0 and len(text[n0:e0].encode()) <= 48 for (_, e0, _), (n0, _, _) in zip(w, w[1:], strict=False))
        assert not text or (w[0][0] == 0 and w[-1][1] == len(text))


def test_dedupe_adjacent_and_budget():
    base = "word " * 60
    c = lambda i, t, p=None, n=None: {"chunk_id": i, "document_id": "d", "ordinal": i, "text": t, "previous_id": p, "next_id": n}
    kept = retrieval.dedupe_adjacent([c(1, "start " + base, None, 2), c(2, base.rstrip()[-80:], 1, 3), c(3, "other", 2)])
    assert [k["chunk_id"] for k in kept] == [1, 3]
    assert len(retrieval.within_budget([{"text": "abc"}, {"text": "é"}, {"text": "x"}], 4, 4)) == 1


def test_context():
    turns = [(1, "user", "hi"), (2, "assistant", "Some prose here. A km is a unit. More."), (3, "user", "ok"), (4, "assistant", "New words.")]
    assert context.select_turns(turns, 1000)[1][2] == "Some prose here. A km is a unit. More."
    kept = context.select_turns(turns, 32)
    assert kept[1][2] == "A km is a unit." and kept[3][2] == "New words."
    assert context.select_turns(turns, 10) is None


def test_summary(spark):
    rows = [("1:0", "d", 0, None, "Alpha beta gamma. Short."), ("1:1", "d", 1, "H", "Delta epsilon zeta eta theta. Alpha beta.")]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc string, ordinal int, heading string, text string")
    text = summarize.summarize(chunks, "doc")
    assert "Delta epsilon zeta eta theta." in text and "Alpha beta gamma." in text
    assert summarize.sample(spark.range(10).selectExpr("1 AS d", "id AS ordinal"), "d", 3).count() == 3


def test_every_page_has_its_summary(spark):
    import __spark_entry__
    from lodeframe.plans import more_catalog

    sf_dir = __spark_entry__.SMOKE
    chunks = more_catalog._page_chunks(spark, sf_dir)
    got = {r.page_id: r.summary for r in __spark_entry__.queries()["sum_select"](spark, sf_dir).collect()}
    ids = {r.page_id for r in chunks.select("page_id").distinct().collect()}
    assert set(got) == ids and max(ids) >= 20
    for i in sorted(ids)[::20][:2]:
        assert got[i] == summarize.summarize(chunks.where(f"page_id = {i}"), "page_id")


def test_language(spark):
    df = spark.createDataFrame([("the cat is here",), ("नमस्ते दुनिया",), ("bonjour monde",), ("the и is",), ("",)], "t string")
    assert [r[0] for r in df.select(x.script_language(x.F.col("t"))).collect()] == ["en-IN", "hi-IN", "und", "und", "und"]
    assert [r[0] for r in df.select(x.dominant_script(x.F.col("t"))).collect()] == ["Latin", "Devanagari", "Latin", "Latin", None]


def test_documents_that_are_rejected_are_rows(spark, tmp_path):
    def docx(body: str) -> bytes:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
        return held.getvalue()

    for name, content in {"a": docx("<w:p><w:t>some text</w:t></w:p>"), "b": b"PK", "c": docx(""), "d": docx("<w:p>")}.items():
        (tmp_path / f"{name}.docx").write_bytes(content)
    rows = files.scan_documents(spark, str(tmp_path), "docx").collect()
    found = {r.path[-6]: (r.block, r.kind, r.text, r.error) for r in rows}
    assert len(rows) == 4 and found["a"] == (0, "paragraph", "some text", None)
    assert {k: found[k][3] for k in "bcd"} == {"b": "xlsx_invalid", "c": "empty_document", "d": "invalid_docx"}
    with pytest.raises(FileError):
        files.scan_documents(spark, str(tmp_path), "pdf")
