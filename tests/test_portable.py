import pytest
from pyspark.sql import functions as F

from lodeframe.errors import FileError
from lodeframe.sources.portable import Links, export_workspace, import_workspace, stored

LINKS = Links({("runs", "source"): "sources"}, [("runs", "lineage")], {"run": "runs"})


def bundle(spark, path, runs=((1, "7", ["run:2@1#ab", "other:9"]), (2, None, None)), assets=((7, b"one"), (8, b"one"), (8, b""))):
    sources = spark.createDataFrame([(7, "a"), (8, "b")], "id long, name string")
    made = spark.createDataFrame(list(runs), "id long, source string, lineage array<string>")
    own = spark.createDataFrame([("sources", i, "original", c) for i, c in assets], "part string, id long, role string, content binary")
    export_workspace({"sources": sources, "runs": made}, own, path)
    return path


def take(spark, path, out):
    return import_workspace(spark, path, "w2", ["sources", "runs"], LINKS, out)


def test_a_bundle_is_taken_in_under_new_ids(spark, tmp_path):
    path, out = bundle(spark, str(tmp_path / "b")), str(tmp_path / "o")
    assert spark.read.parquet(f"{path}/assets").count() == 2
    ids = {(r.part, r.old): r.new for r in take(spark, path, out).collect()}
    runs = {r.id: r for r in spark.read.parquet(f"{out}/entities/runs").collect()}
    one = runs[ids["runs", "1"]]
    assert one.source == ids["sources", "7"] and one.lineage == [f"run:{ids['runs', '2']}@1#ab", "other:9"]
    assert runs[ids["runs", "2"]].source is None and len(set(ids.values())) == 4
    assert {r.id for r in spark.read.parquet(f"{out}/owned").collect()} == {ids["sources", "7"], ids["sources", "8"]}
    assert {(r.part, r.old): r.new for r in take(spark, path, out).collect()} == ids  # run again, as after a loss


@pytest.mark.parametrize(("change", "code"), [
    ({"runs": [(1, "9", [])]}, "reference_missing"), ({"runs": [(1, "7", ["run:5"])]}, "reference_missing"), ({"runs": [(1, None, None), (1, None, None)]}, "duplicate_id"), ({"assets": [(9, b"x")]}, "asset_owner_missing"),
])
def test_a_bundle_with_faults_is_not(spark, tmp_path, change, code):
    with pytest.raises(FileError, match=code):
        take(spark, bundle(spark, str(tmp_path / "b"), **change), str(tmp_path / "o"))
    assert not (tmp_path / "o").exists()


def test_what_was_changed_since_the_export_is_not_taken(spark, tmp_path):
    path = bundle(spark, str(tmp_path / "b"))
    spark.createDataFrame([("3", None, None)], "id string, source string, lineage array<string>").write.mode("append").parquet(f"{path}/entities/runs")
    with pytest.raises(FileError, match="entity_differs"):
        take(spark, path, str(tmp_path / "o"))
    path = bundle(spark, str(tmp_path / "c"))
    spark.createDataFrame([("0" * 64, 1, b"z")], "sha256 string, size long, content binary").write.mode("append").parquet(f"{path}/assets")
    with pytest.raises(FileError, match="asset_differs"):
        take(spark, path, str(tmp_path / "o"))
    with pytest.raises(FileError, match="unsupported_schema"):
        import_workspace(spark, path, "w2", ["sources"], LINKS, str(tmp_path / "o"))


def test_objects_are_read_with_a_check(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, data in (("a b/x", b"x" * 10), ("a b/w", b"w"), ("y", b"yy"), ("z", b"")):  # the last one is passed over
        (tmp_path / name).write_bytes(data)
    sha = lambda b: spark.range(1).select(F.sha2(F.lit(b), 256)).first()[0]
    wanted = spark.createDataFrame([("a b/x", sha(b"x" * 10)), ("y", "00"), ("z", sha(b"")), ("a b/w", sha(b"w")), ("no", "1")], "key string, sha256 string")
    got = {r.key: (r.state, r.content) for r in stored(spark, str(tmp_path), wanted, 5).collect()}
    assert got == {"a b/x": ("too_large", None), "y": ("differs", None), "z": ("missing", None), "no": ("missing", None), "a b/w": ("ready", b"w")}
