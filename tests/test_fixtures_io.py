"""Fixture tests for sources, sinks, validation and case pairing (FIXTURES.md)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scorecraft.functions import keys as K
from scorecraft.operators import accuracy as A
from scorecraft.operators import cases as CS
from scorecraft.operators import compare as C
from scorecraft.operators import source_scores as SS
from scorecraft.operators import validate as V
from scorecraft.operators.layout import written
from scorecraft.sources import datasets as DS
from scorecraft.sources import reports as RP
from scorecraft.sources import sinks as SK


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)


def _report_csv(rows):
    import csv
    import io

    buf = io.StringIO()
    w = csv.writer(buf)
    w.writerow(["row_index", "status", "score", "llm_output", "error_message"])
    for r in rows:
        w.writerow(r)
    return buf.getvalue()


def test_read_run_reports_and_f1(spark, tmp_path):
    d = str(tmp_path / "reports")
    _write(f"{d}/model-a__synthetic_examples.csv", _report_csv([
        (1, "failed", 0.0, "", "boom"),
        (2, "completed", 0.5, "  ", ""),
        (3, "completed", 1.0, json.dumps({"a": "x,\"y\"\nz"}), ""),
    ]))
    _write(f"{d}/overall_benchmark_report.csv", _report_csv([(1, "completed", 1.0, "{}", "")]))
    _write(f"{d}/noseparator.csv", _report_csv([(1, "completed", 1.0, "{}", "")]))
    _write(f"{d}/model-b__other.csv", _report_csv([("", "completed", 0.0, "{}", "")]))
    rep = RP.read_run_reports(spark, d)
    rows = rep.collect()
    assert {r.model for r in rows} == {"model-a", "model-b"}
    b = [r for r in rows if r.model == "model-b"][0]
    assert b.row_index == 0 and b.score == 0.0
    kept = SS.completed_with_output(SS.sources_in(rep, None)).collect()
    assert [r.row_index for r in kept] == [3]
    assert json.loads(kept[0].llm_output) == {"a": "x,\"y\"\nz"}
    scores = {r.model: r.source_score for r in SS.source_scores(rep, "synthetic_examples").collect()}
    assert scores == {"model-a": 1.0}


def test_source_column_blank_when_no_data(spark):
    summary = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "model string, average_score double")
    reports = spark.createDataFrame([("a", "src", "completed", 0.9, "{}")],
                                    "model string, source string, status string, score double, llm_output string")
    out = {r.model: r.src for r in SS.add_source_score(summary, reports, "src").collect()}
    assert out == {"a": 0.9, "b": None}
    winners = spark.createDataFrame([("overall_best_average", "a"), ("overall_fastest", "a")], "section string, model string")
    w = {r.section: r.src for r in SS.add_source_score_to_winners(winners, reports, "src").collect()}
    assert w == {"overall_best_average": 0.9, "overall_fastest": None}


def test_category_report_from_artifacts(spark, tmp_path):
    rdir, tdir = str(tmp_path / "r"), str(tmp_path / "t")
    truth = {"document_info": {"source_type": "Excel", "filename": "book.xlsx"}, "a": 1}
    _write(f"{rdir}/model-a__source-x.csv", _report_csv([(1, "completed", 1.0, json.dumps(truth), "")]))
    _write(f"{rdir}/model-b__source-x.csv", _report_csv([(1, "completed", 1.0, "{}", "")]))
    _write(f"{rdir}/model-a__source-y.csv", _report_csv([(1, "completed", 1.0, "{}", "")]))
    _write(f"{rdir}/model-a__missing.csv", _report_csv([(1, "completed", 1.0, "{}", "")]))
    _write(f"{tdir}/model-a__source-x.json", json.dumps({"rows": [{"prompt": "p", "expected_output": truth}]}))
    _write(f"{tdir}/model-b__source-x.json", json.dumps({"rows": [{"prompt": "p", "expected_output": truth}]}))
    _write(f"{tdir}/model-a__source-y.json", json.dumps({"rows": "bad"}))
    reports = A.source_model_filter(A.completed_only(RP.read_run_reports(spark, rdir)), " source-x ", " model-a ")
    truths = RP.read_ground_truths(spark, tdir)
    joined = A.reports_with_truth(reports, truths, keys=("case_key",))
    rows = joined.collect()
    assert len(rows) == 1 and rows[0].category == "xlsx"
    scored = A.score_rows(joined.withColumnRenamed("category", "category"), truth_map="_truth_map")
    out = {(r.scope, r.name): r for r in A.accuracy_scopes(None, scored=scored).collect()}
    assert out[("overall", "overall")].exact_accuracy_percent == 100.0
    all_truths = {r.case_key: r.ground_truth for r in truths.collect()}
    assert all_truths["model-a__source-y"] == "{}"


@pytest.mark.parametrize(
    "info,expected",
    [
        ({"filename": "a.csv"}, "csv"), ({"filename": "scan.PNG"}, "png"), ({"filename": "x.txt"}, "txt"),
        (None, "unknown"), ({"filename": "sample.bad!ext"}, "badext"),
        ({"filename": "report.!!!", "source_type": "PDF"}, "PDF"), ({"filename": "a.", "source_type": " Excel "}, "Excel"),
        ({"filename": ".bashrc"}, "unknown"), ({"filename": "a.b.C"}, "c"), ({"source_type": None}, "None"),
    ],
)
def test_category_from_truth(spark, info, expected):
    truth = {} if info is None else {"document_info": info}
    df = spark.createDataFrame([(json.dumps(truth),)], "t string")
    assert df.select(K.category_from_truth("t").alias("c")).first().c == expected


def test_dataset_csv_header_and_blank_columns(spark, tmp_path):
    p = str(tmp_path / "ds.csv")
    _write(p, "\n\nid,prompt,expected,\n1,Prompt,Expected,ignored\n,,,\n")
    df = DS.read_dataset_csv(spark, p)
    assert df.columns == ["dataset", "row_index", "id", "prompt", "expected"]
    rows = df.collect()
    assert len(rows) == 1 and rows[0].row_index == 1 and rows[0].prompt == "Prompt"


def test_dataset_csv_validation_errors(spark, tmp_path):
    schema = {"id": int, "prompt": str, "expected": str}
    p1 = str(tmp_path / "a.csv")
    _write(p1, "id,prompt\n1,x\n")
    _, viol = V.validate(DS.read_dataset_csv(spark, p1), schema, ["row_index"])
    assert [(r.column, r.rule) for r in viol.collect()] == [("expected", "missing_column")]
    p2 = str(tmp_path / "b.csv")
    _write(p2, "id,prompt,expected\nnot-an-integer,x,y\n2, ,y\n3,ok,y\n")
    valid, viol = V.validate(DS.read_dataset_csv(spark, p2), schema, ["row_index"])
    got = sorted((r.row_index, r.column, r.rule) for r in viol.collect())
    assert got == [(1, "id", "type"), (2, "prompt", "required")]
    assert [(r.id, r.prompt) for r in valid.collect()] == [(3, "ok")]
    with pytest.raises(V.ValidationError):
        V.validate_strict(DS.read_dataset_csv(spark, p2), schema, ["row_index"])


def test_schema_checks():
    with pytest.raises(V.SchemaError):
        V.check_schema({})
    with pytest.raises(V.SchemaError):
        V.check_schema({"a": "not a type"})
    assert V.check_schema({" a ": int, "b": dict}) == {"a": "bigint", "b": "object"}


def test_dataset_json_shapes(spark, tmp_path):
    cols = ["id", "prompt"]
    cases = {
        "list.json": ([{}, {"id": 1, " prompt ": "p"}, {}], [(1, "1", "p")]),
        "rows.json": ({"rows": []}, []),
        "data.json": ({"data": [{"id": "2", "prompt": 5}]}, [(1, "2", "5")]),
        "single.json": ({"id": 3, "prompt": "q"}, [(1, "3", "q")]),
    }
    for name, (payload, expected) in cases.items():
        p = str(tmp_path / name)
        _write(p, json.dumps(payload))
        got = [(r.row_index, r.id, r.prompt) for r in DS.read_dataset_json(spark, p, cols).collect()]
        assert got == expected, name
    for name, payload in {"bad_rows.json": {"rows": {"a": 1}}, "mixed.json": [{"id": 1}, "x"]}.items():
        p = str(tmp_path / name)
        _write(p, json.dumps(payload))
        errs = [r.error for r in DS.read_dataset_json(spark, p, cols).collect()]
        assert len(errs) == 1 and errs[0] is not None, name


def test_pairing_holds_no_listing_in_a_task(spark, tmp_path):
    paths = [f"d/ex{i}_{x}" for i in range(40) for x in ("input.txt", "output.csv")] + ["d/ex1_output.csv", "d/new_input.csv"]
    listing = written(spark.createDataFrame([(p,) for p in paths], "path string"), "listing", str(tmp_path / "listing"))
    cases, skipped = CS.pair_cases(listing)
    for found in (cases, skipped):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.input_path for r in cases.collect()) == sorted(f"d/ex{i}_input.txt" for i in range(40))
    assert [r.input_path for r in skipped.collect()] == ["d/new_input.csv"]


def test_pair_cases(spark):
    listing = spark.createDataFrame(
        [("data/examples/ex01_input.csv",), ("data/examples/ex01_output.csv",),
         ("data/examples/ex02_input.gif",), ("data/examples/ex03_input.txt",),
         ("data/examples/ex04_input.PNG",), ("data/examples/ex04_png_output.csv",), ("data/examples/ex04_output.csv",)],
        "path string",
    )
    cases, skipped = CS.pair_cases(listing)
    got = {r.case_id: r.output_path for r in cases.collect()}
    assert got == {"examples__ex01": "data/examples/ex01_output.csv", "examples__ex04": "data/examples/ex04_png_output.csv"}
    reasons = {r.input_path: r.reason for r in skipped.collect()}
    assert reasons == {
        "data/examples/ex02_input.gif": "unsupported input format .gif",
        "data/examples/ex03_input.txt": "matching *_output.csv file was not found",
    }


def test_safe_names(spark):
    df = spark.createDataFrame([("deepseek/v3:2", "  ", "a b!"), ("..__", "x", "__")], "s string, f string, l string")
    rows = df.select(K.safe_segment("s").alias("seg"), K.safe_label("l").alias("lab"),
                     K.filter_suffix("f", "l").alias("suf")).collect()
    assert rows[0].seg == "deepseek_v3_2" and rows[0].lab == "a_b" and rows[0].suf == "_a_b"
    assert rows[1].seg == "unnamed" and rows[1].lab == "all" and rows[1].suf == "_x_all"


def test_run_matrix_and_expected_output(spark):
    cases = spark.createDataFrame([("c2", "b/x_input.pdf"), ("c1", "a/y_input.xlsx")], "case_id string, input_path string")
    m = {(r.model, r.case_id): r.run_index for r in CS.run_matrix(["m1", "m2"], cases).collect()}
    assert m == {("m1", "c1"): 1, ("m1", "c2"): 2, ("m2", "c1"): 3, ("m2", "c2"): 4}
    truth = spark.createDataFrame([("c1", 2, "kg", "rice", "n", "ok", 5), ("c1", 1, "kg", "corn", "n", "ok", 3)],
                                  "case_id string, row_pos int, unit string, item string, num_type string, "
                                  "status_type string, value long")
    out = {r.case_id: json.loads(r.expected_output) for r in CS.expected_output(truth, cases).collect()}
    assert out["c1"]["document_info"] == {"source_type": "Excel", "filename": "y_input.xlsx"}
    assert [r["item"] for r in out["c1"]["content_data"][0]["rows"]] == ["corn", "rice"]
    assert out["c2"]["summary"]["total_rows"] == 0 and out["c2"]["document_info"]["source_type"] == "PDF"


def test_sinks_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("a", "f1", "completed", 0.9, 5.0, 1), ("b", "f1", "completed", 1.0, 8.0, 2)],
                                 "model string, case_id string, status string, average_score double, "
                                 "elapsed_seconds double, run_index long")
    report = C.overall_report(runs)
    out = str(tmp_path / "overall")
    first = SK.write_overall_report(report, out, preserve=True)
    second = SK.write_overall_report(report, out, preserve=True)
    assert first.endswith("version=1") and second.endswith("version=2")
    back = RP.read_overall_report(spark, first)
    assert back.count() == report.count()
    merged = C.merge_overall(back, runs)
    models = {r.model: r.total_runs for r in merged.filter(F.col("section") == "model_summary").collect()}
    assert models == {"a": 2, "b": 2}
    reports = spark.createDataFrame([("a", "s", "f1", 1, "completed", 1.0, "{}", "")],
                                    "model string, source string, case_id string, row_index int, status string, "
                                    "score double, llm_output string, error_message string")
    store = str(tmp_path / "store")
    SK.write_run_reports(reports, store)
    SK.write_run_reports(reports, store)
    assert spark.read.parquet(store).filter(F.col("source") == "s").count() == 2


def test_blank_scores_raise_and_overall_models_are_read(spark, tmp_path):
    d = str(tmp_path / "runs")
    _write(f"{d}/overall_gpt__src.csv", _report_csv([(1, "completed", 0.5, "{}", "")]))
    rep = RP.read_run_reports(spark, d)
    assert [r.model for r in rep.collect()] == ["overall_gpt"]
    assert A.source_model_filter(rep).collect() == []
    _write(f"{d}/model-c__src.csv", _report_csv([(1, "completed", "", "{}", "")]))
    with pytest.raises(Exception, match="blank score"):
        RP.read_run_reports(spark, d).collect()


def test_only_blank_headers_are_dropped(spark, tmp_path):
    path = str(tmp_path / "d" / "data.csv")
    _write(path, "id,_cost,,prompt\n1,2,x,p\n")
    rows = DS.read_dataset_csv(spark, path).collect()
    assert [(r.id, r["_cost"], r.prompt, r.row_index) for r in rows] == [("1", "2", "p", 1)]
    assert "_c2" not in rows[0].asDict()


def test_json_dataset_takes_one_value_and_skips_blank_records(spark, tmp_path):
    d = str(tmp_path / "j")
    _write(f"{d}/junk.json", '{"rows":[{"id":1}]} junk')
    _write(f"{d}/blank.json", '[{"id":"","prompt":" "},{"id":"7","prompt":"p"},{"id":null}]')
    rows = DS.read_dataset_json(spark, d, ["id", "prompt"]).collect()
    junk = [r for r in rows if r.dataset.endswith("junk.json")]
    assert [r.error for r in junk] == [DS.ERR_INVALID]
    good = [r for r in rows if r.dataset.endswith("blank.json")]
    assert [(r.row_index, r.id, r.prompt) for r in good] == [(1, "7", "p")]
