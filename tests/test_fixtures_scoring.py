"""Fixture tests restated from the reference's tests (FIXTURES.md): scoring,
category accuracy, runs, comparison, merge and recommendations."""

import json

import pytest
from pyspark.sql import functions as F

from scorecraft.operators import accuracy as A
from scorecraft.operators import compare as C
from scorecraft.operators import recommend as R
from scorecraft.operators import scoring as S

TRUTH = {"invoice_id": "INV-001", "vendor": "Acme Corp", "total": 125000, "currency": "IDR"}


def _evals(spark, rows):
    data = [(c, json.dumps(t) if not isinstance(t, str) else t, o, m, s) for c, t, o, m, s in rows]
    return spark.createDataFrame(data, "category string, ground_truth string, llm_output string, model string, source string")


def _summary(df):
    return {(r.scope, r.name): r for r in df.collect()}


def test_category_accuracy_counts(spark):
    rows = [("invoice", TRUTH, json.dumps(TRUTH), "m", "s")] * 4
    rows += [("invoice", TRUTH, json.dumps({**TRUTH, "vendor": "X"}), "m", "s")]
    rows += [("payroll", {"a": 1}, '{"a":1}', "m", "s")]
    out = _summary(A.category_accuracy(_evals(spark, rows)))
    inv = out[("category", "invoice")]
    assert inv.ground_truth_count == 5 and inv.exact_match_count == 4 and inv.error_count == 0
    assert inv.exact_accuracy_percent == pytest.approx(80.0)
    assert inv.partial_accuracy_percent == pytest.approx((4 + 0.75) / 5 * 100)
    assert out[("overall", "overall")].ground_truth_count == 6


def test_malformed_and_empty_truth(spark):
    rows = [("c", {"a": 1}, "not json", "m", "s"), ("e", {}, '{"a":1}', "m", "s")]
    out = _summary(A.category_accuracy(_evals(spark, rows)))
    c = out[("category", "c")]
    assert (c.ground_truth_count, c.exact_match_count, c.error_count) == (1, 0, 1)
    assert c.partial_accuracy_percent == 0.0
    e = out[("category", "e")]
    assert (e.ground_truth_count, e.error_count, e.exact_accuracy_percent) == (0, 0, 0.0)


def test_extra_keys_exact_zero_partial_full(spark):
    rows = [("c", {"a": 1, "b": 2}, '{"a":1,"b":2,"x":3,"y":4}', "m", "s")]
    c = _summary(A.category_accuracy(_evals(spark, rows)))[("category", "c")]
    assert c.exact_accuracy_percent == 0.0 and c.partial_accuracy_percent == 100.0


def test_null_and_blank_category_are_uncategorized(spark):
    rows = [(None, {"a": 1}, '{"a":1}', "m", "s"), ("", {"a": 1}, '{"a":1}', "m", "s")]
    out = _summary(A.category_accuracy(_evals(spark, rows)))
    u = out[("category", "uncategorized")]
    assert u.ground_truth_count == 2 and u.exact_match_count == 2


def test_list_truth_and_list_output(spark):
    rows = [("c", "[1,2]", '{"a":1}', "m", "s"), ("c", {"a": 1}, "[1]", "m", "s")]
    c = _summary(A.category_accuracy(_evals(spark, rows)))[("category", "c")]
    assert c.ground_truth_count == 1 and c.error_count == 1 and c.partial_accuracy_percent == 0.0


def test_scopes_by_model_and_source(spark):
    rows = [("c", {"a": 1}, '{"a":1}', "m1", "s1"), ("c", {"a": 1}, '{"a":2}', "m2", "s1")]
    out = _summary(A.accuracy_scopes(_evals(spark, rows)))
    assert out[("model", "m1")].exact_accuracy_percent == 100.0
    assert out[("model", "m2")].exact_accuracy_percent == 0.0
    assert out[("source", "s1")].exact_match_count == 1
    assert out[("overall", "overall")].total_evaluations == 2


def test_finalize_percentages(spark):
    df = spark.createDataFrame([(4, 1, 2.5)], "ground_truth_count long, exact_match_count long, partial_score_sum double")
    r = A.finalize_percentages(df).first()
    assert r.exact_accuracy_percent == 25.0 and r.partial_accuracy_percent == 62.5


def _outputs(spark, rows):
    return spark.createDataFrame(
        rows, "model string, case_id string, row_index long, output string, error_kind string, error_message string"
    )


def _dataset(spark, truths):
    return spark.createDataFrame(
        [("c", i + 1, json.dumps(t)) for i, t in enumerate(truths)], "case_id string, row_index long, ground_truth string"
    )


def test_run_summary_with_failures(spark):
    ds = _dataset(spark, [{"a": 1}, {"a": 1, "b": 2}, {"a": 1}])
    outs = _outputs(spark, [("m", "c", 1, '{"a":1}', None, None), ("m", "c", 2, '{"a":1,"b":3}', None, None),
                            ("m", "c", 3, None, "error", "boom")])
    r = S.run_summary_with_abort(outs, ds).first()
    assert (r.status, r.total_rows, r.successful_evaluations) == ("completed", 3, 2)
    assert r.average_score == pytest.approx(0.5)
    rep = {x.row_index: x for x in S.evaluate(ds, outs).collect()}
    assert rep[3].status == "failed" and rep[3].error_message == "boom" and rep[3].score == 0.0


def test_run_abort_on_auth(spark):
    ds = _dataset(spark, [{"a": 1}, {"a": 1}, {"a": 1}])
    outs = _outputs(spark, [("m", "c", 1, '{"a":1}', None, None), ("m", "c", 2, None, "auth", "denied"),
                            ("m", "c", 3, '{"a":1}', None, None)])
    r = S.run_summary_with_abort(outs, ds).first()
    assert (r.status, r.total_rows, r.successful_evaluations, r.average_score) == ("aborted_due_to_auth", 2, 1, 1.0)
    assert S.evaluate(ds, outs).count() == 1


def test_run_abort_first_row(spark):
    ds = _dataset(spark, [{"a": 1}])
    outs = _outputs(spark, [("m", "c", 1, None, "auth", "denied")])
    r = S.run_summary_with_abort(outs, ds).first()
    assert (r.status, r.total_rows, r.successful_evaluations, r.average_score) == ("aborted_due_to_auth", 1, 0, 0.0)


def test_empty_runs(spark):
    matrix = spark.createDataFrame([("m", "c")], "model string, case_id string")
    summaries = spark.createDataFrame([], "model string, case_id string, status string, total_rows long, "
                                          "successful_evaluations long, average_score double")
    r = S.with_empty_runs(summaries, matrix).first()
    assert (r.status, r.total_rows, r.average_score) == ("empty", 0, 0.0)


def _runs(spark, rows):
    return spark.createDataFrame(
        rows, "model string, case_id string, status string, average_score double, elapsed_seconds double, run_index long"
    )


def test_case_comparison_and_winners(spark):
    runs = _runs(spark, [("a", "f1", "completed", 0.9, 5.0, 1), ("b", "f1", "completed", 1.0, 8.0, 2),
                         ("a", "f2", "completed", 0.4, 3.0, 3), ("b", "f2", "completed", 0.2, 2.0, 4)])
    cases = {r.case_id: r for r in C.case_comparison(runs).collect()}
    assert (cases["f1"].best_model, cases["f1"].fastest_model) == ("b", "a")
    assert (cases["f2"].best_model, cases["f2"].fastest_model) == ("a", "b")
    models = {r.model: r for r in C.model_summary(runs).collect()}
    assert models["a"].average_score == pytest.approx(0.65) and models["a"].average_seconds == pytest.approx(4.0)
    assert models["b"].average_score == pytest.approx(0.6) and models["b"].average_seconds == pytest.approx(5.0)
    winners = {r.section: r.model for r in C.overall_winners(C.model_summary(runs)).collect()}
    assert winners == {"overall_best_average": "a", "overall_fastest": "a"}


def test_full_tie_takes_first_in_input_order(spark):
    runs = _runs(spark, [("z", "f", "completed", 0.5, 1.0, 1), ("a", "f", "completed", 0.5, 1.0, 2)])
    r = C.case_comparison(runs).first()
    assert r.best_model == "z" and r.fastest_model == "z"


def test_best_and_fastest_split(spark):
    runs = _runs(spark, [("a", "f", "completed", 0.5, 5.0, 1), ("b", "f", "completed", 0.7, 7.0, 2)])
    winners = {r.section: r.model for r in C.overall_winners(C.model_summary(runs)).collect()}
    assert winners == {"overall_best_average": "b", "overall_fastest": "a"}


def test_merge_overall_weighted(spark):
    base = C.to_report_layout(
        spark.createDataFrame([("a", 0.7, 3.0, 4, 4)], "model string, average_score double, average_seconds double, "
                                                       "total_runs long, completed_runs long"),
        C.MODEL_SECTION,
    ).unionByName(C.to_report_layout(
        spark.createDataFrame([("legacy_case", "a", 0.7, "a", 3.0, 1, 1)],
                              "case_id string, best_model string, best_score double, fastest_model string, "
                              "fastest_seconds double, total_runs long, completed_runs long"),
        C.CASE_SECTION))
    new = _runs(spark, [("a", "new_case", "completed", 1.0, 2.0, 1), ("b", "new_case", "completed", 0.5, 1.0, 2)])
    merged = C.merge_overall(base, new).collect()
    models = {r.model: r for r in merged if r.section == "model_summary"}
    assert models["a"].average_score == pytest.approx(0.76) and models["a"].average_seconds == pytest.approx(2.8)
    assert models["a"].total_runs == 5
    cases = sorted(r.case_id for r in merged if r.section == "case_comparison")
    assert cases == ["legacy_case", "new_case"]


def test_merge_zero_totals(spark):
    cols = "model string, average_score double, average_seconds double, total_runs long, completed_runs long"
    base = spark.createDataFrame([("a", 0.5, 1.0, 0, 0)], cols)
    new = spark.createDataFrame([("a", 0.9, 2.0, 0, 0)], cols)
    r = C.merge_model_summaries(base, new).first()
    assert r.average_score == 0.0 and r.average_seconds == 0.0


def _scores(spark, pairs):
    return spark.createDataFrame(pairs, "category string, score double")


def test_recommendations_threshold_and_order(spark):
    ranked = R.rank_low_categories(_scores(spark, [("invoice", 0.95), ("payroll", 0.62), ("tax", 0.68)]))
    assert [r.category for r in ranked.orderBy("position").collect()] == ["payroll", "tax"]
    ranked = R.rank_low_categories(_scores(spark, [("alpha", 0.40), ("beta", 0.40), ("zeta", 0.45), ("invoice", 0.85)]))
    assert [r.category for r in ranked.orderBy("position").collect()] == ["alpha", "beta", "zeta"]
    r = R.rank_low_categories(_scores(spark, [("x", 0.60), ("y", 0.80)]), threshold=0.80).collect()
    assert [x.category for x in r] == ["x"] and r[0].gap == pytest.approx(0.20)


def test_recommendation_states(spark):
    assert R.recommendation_state(_scores(spark, [])).first().state == R.STATE_NO_DATA
    assert R.recommendation_state(_scores(spark, [("a", 1.0)])).first().state == R.STATE_MAX
    assert R.recommendation_state(_scores(spark, [("a", 0.9)])).first().state == R.STATE_NONE_LOW
    assert R.recommendation_state(_scores(spark, [("a", 0.1)])).first().state == R.STATE_RANKED


def test_analyzer_failure_replaces_all_lines(spark):
    ranked = R.rank_low_categories(_scores(spark, [("a", 0.1), ("b", 0.2), ("c", 0.3)]))

    def analyzer(cat, score):
        if cat == "c":
            raise RuntimeError("timeout")
        return "ok"

    lines = [r.line for r in R.analyzed_recommendations(ranked, analyzer).collect()]
    assert lines == [R.ANALYSIS_UNAVAILABLE_MESSAGE]
    ok = [r.line for r in R.analyzed_recommendations(ranked, lambda c, s: "fine").orderBy("position").collect()]
    assert ok == ["- a: fine", "- b: fine", "- c: fine"]


def test_default_recommendation_text(spark):
    ranked = R.rank_low_categories(_scores(spark, [("x", 0.60)]), threshold=0.80)
    line = R.default_recommendation(ranked).first().line
    assert line.startswith("- x: ") and "0.60" in line and "0.20" in line


def test_runs_go_through_the_dataset(spark):
    ds = _dataset(spark, [{"a": 1}, {"a": 1}])
    outs = _outputs(spark, [("m", "c", 1, '{"a":1}', None, None), ("m", "c", 9, '{"a":1}', None, None)])
    rep = {x.row_index: x for x in S.evaluate(ds, outs).collect()}
    assert sorted(rep) == [1, 2] and rep[2].status == "failed" and rep[2].error_message == "no recorded output"
    r = S.run_summary(S.evaluate(ds, outs)).first()
    assert (r.total_rows, r.successful_evaluations, r.average_score) == (2, 1, 0.5)
    assert [x.row_index for x in S.stray_outputs(ds, outs).collect()] == [9]
