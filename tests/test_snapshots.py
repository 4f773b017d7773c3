import pytest

from lodeframe.errors import AnalysisError
from lodeframe.operators import snapshots as s

REQUEST = "request_id long, input string, dataset_id string, artifact_id string, units map<string,string>"


def tables(spark):
    sets = spark.createDataFrame([("d", "csv", True, {"x": "EUR", "y": ""}), ("pg", "postgresql", True, None), ("off", "csv", False, None)], "id string, kind string, selected boolean, units map<string,string>")
    made = spark.createDataFrame([("a", "text/csv", True), ("b", "text/csv", True), ("c", "text/csv", True), ("png", "image/png", True), ("shut", "text/csv", False)], "id string, media_type string, accessible boolean")
    told = spark.createDataFrame([("a", {"v": "kg"}, True, 10), ("c", None, None, None), ("old", None, True, 5)], "id string, units map<string,string>, truncated boolean, row_limit int")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", None), (None, "a")], "child string, parent string")
    return sets, made, told, edges


def test_inputs_are_judged_with_what_lineage_carries(spark):
    asked = [
        (1, "i", "d", None, {"x": "EUR", "y": "m", "z": "s"}), (2, "i", "d", None, {"x": "USD"}), (3, "i", "pg", None, None), (4, "i", "off", None, None), (5, "i", "nope", None, None),
        (6, "i", None, "a", None), (7, "i", None, "b", None), (8, "i", None, "c", {"v": "g"}), (9, "i", None, "png", None), (10, "i", None, "shut", None), (11, "i", None, None, None), (12, "i", "d", "a", None), (13, "i", None, "a", {"v": "g"}),
    ]
    got = {r.request_id: r for r in s.resolved(spark.createDataFrame(asked, REQUEST), *tables(spark)).collect()}
    assert {i: r.code for i, r in got.items() if r.code} == {2: "unit_conflict", 3: "snapshot_required", 4: "dataset_not_selected", 5: "dataset_not_selected", 9: "artifact_not_accessible", 10: "artifact_not_accessible", 11: "input_ambiguous", 12: "input_ambiguous", 13: "unit_conflict"}
    assert got[1].units == {"x": "EUR", "y": "m", "z": "s"} and got[6].units == {"v": "kg"} and got[8].units == {"v": "g"}
    assert {i: (r.truncated, r.inherited) for i, r in got.items() if r.truncated or r.inherited} == {6: (True, False), 7: (False, True), 8: (False, True), 13: (True, False)}
    states = {r.request_id: r.status for r in s.judged(spark.createDataFrame(list(got.values()), s.resolved(spark.createDataFrame(asked, REQUEST), *tables(spark)).schema)).collect()}
    assert states[1] == "ok" and states[6] == states[8] == "partial" and states[2] == "rejected"


def test_no_marks_reach_nothing_and_cycles_end(spark):
    edges = tables(spark)[3]
    assert s.carried(spark.createDataFrame([], "id string"), edges).count() == 0
    assert sorted((r.id, r.rounds) for r in s.carried(spark.createDataFrame([("a",), (None,)], "id string"), edges).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_an_analysis_says_what_it_read(spark, tmp_path):
    rows = spark.createDataFrame([("p", "1.5"), ("q", "2"), ("q", "2")], "k string, v string").repartition(3)
    asked = spark.createDataFrame([(1, "left", None, "b", {"v": "kg"}), (1, "right", "d", None, None)], REQUEST)
    request = s.resolved(asked, *tables(spark))
    right = spark.createDataFrame([("p", "P"), ("q", "Q")], "k string, name string")
    work = [{"kind": "join", "frame": "left", "columns": ["k"], "right_frame": "right", "right_on": ["k"], "relationship": "many_to_one"}, {"kind": "aggregate", "frame": "left", "columns": ["name"], "metrics": [{"function": "sum", "column": "v", "output": "total"}]}]
    run, told = s.snapshot_analysis(request, {"left": rows, "right": right}, work, "left", str(tmp_path / "out"))
    assert told["inputs"]["left"]["rows"] == 3 and told["inputs"]["right"]["rows"] == 2 and told["output_rows"] == 2
    assert told["status"] == "partial" and told["limitations"] == [s.LIMITATION] and told["inputs"]["left"]["truncated"]
    assert run.frames["left"].units == {"total": "kg"}
    assert sorted((r.name, float(r.total)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("P", 1.5), ("Q", 4.0)]
    seen, said = s.watched(rows.coalesce(1), ["k", "v"])
    seen.write.format("noop").mode("overwrite").save()
    assert said()["fingerprint"] == told["inputs"]["left"]["fingerprint"]
    bad = s.resolved(spark.createDataFrame([(1, "left", "off", None, None)], REQUEST), *tables(spark))
    with pytest.raises(AnalysisError, match="dataset_not_selected"):
        s.snapshot_analysis(bad, {"left": rows}, [], "left", str(tmp_path / "none"))
