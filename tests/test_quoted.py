import csv
import io
import random

import pytest

from lodeframe.errors import FileError
from lodeframe.sources import quoted


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64b")
    yield
    spark.conf.set(key, before)


def content(rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def rows_of(n=120):
    rng = random.Random(3)
    parts = ["x", "é", '"', '""', "\n", "\r\n", ",", "word ", "\n\n", " ", ";", "=1+1", "\\"]
    cell = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(7)))
    return [["id", "a name", "b"], *[[str(i), cell(), cell()] for i in range(n)], ["last", "y" * 500 + "\n" * 300 + "z", "q"]]


@pytest.mark.parametrize(("end", "most"), [("\n", 10**6), ("\r\n", 10**6), ("\n", 0)])
def test_records_across_blocks(spark, tmp_path, monkeypatch, small_blocks, end, most):
    monkeypatch.setattr(quoted, "BROADCAST_BLOCKS", most)
    rows = rows_of()
    text = content(rows, end)
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    got = sorted((r.ordinal, r.record) for r in quoted.records(spark, str(tmp_path / "a.csv")).collect())
    assert [o for o, _ in got] == list(range(len(rows)))
    assert [next(csv.reader(io.StringIO(r, newline=""))) for _, r in got] == rows
    assert quoted.physical_lines(spark, str(tmp_path / "a.csv")).select("block").distinct().count() > 20


def joined(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


def test_canonical_copy_is_the_file_again(spark, tmp_path, small_blocks):
    rows = rows_of()
    (tmp_path / "a.csv").write_bytes(content(rows).encode())
    table = quoted.table(spark, str(tmp_path / "a.csv"))
    assert table.columns == [quoted.ORDINAL, "id", "a name", "b"]
    got = [tuple(r)[1:] for r in sorted(table.collect())]
    assert got == [tuple(x or None for x in r) for r in rows[1:]]
    quoted.write_canonical(table, str(tmp_path / "out"))
    assert joined(tmp_path / "out") == content(rows).encode()
    where, changed = quoted.export(str(tmp_path / "a.csv"), table.drop("a name", "b"), str(tmp_path / "same"))
    assert (where, changed) == (str(tmp_path / "a.csv"), False)
    where, changed = quoted.export(str(tmp_path / "a.csv"), table, str(tmp_path / "safe"))
    assert changed and b"\r\n" in joined(tmp_path / "safe")
    safe = list(csv.reader(io.StringIO(joined(tmp_path / "safe").decode(), newline="")))
    assert len(safe) == len(rows) and all(not c.lstrip().startswith("=") for r in safe for c in r)


def test_blank_lines_short_and_long_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("\nx;y\n1\n\n1;2;3\n")
    assert sorted(map(tuple, quoted.table(spark, str(tmp_path / "b.csv"), sep=";").collect())) == [(0, "1", None), (1, None, None), (2, "1", "2")]
    (tmp_path / "c.csv").write_text('x\n"open\n')
    with pytest.raises(FileError, match="csv_quote_open"):
        quoted.table(spark, str(tmp_path / "c.csv"))


def test_ingest_publishes_once_it_is_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(content(rows_of()).encode())
    (tmp_path / "b.csv").write_text('x\n"open\n')
    catalog, folder = str(tmp_path / "catalog"), str(tmp_path / "copies")
    assert quoted.ingest(spark, str(tmp_path / "a.csv"), catalog, folder) == "ready"
    assert quoted.ingest(spark, str(tmp_path / "b.csv"), catalog, folder) == "failed"
    states = {r.path.rsplit("/", 1)[1]: r for r in quoted.latest(spark, catalog).collect()}
    assert states["a.csv"].state == "ready" and states["a.csv"].rows == 121 and states["a.csv"].columns == ["id", "a name", "b"]
    assert (states["b.csv"].state, states["b.csv"].code) == ("failed", "csv_quote_open")
