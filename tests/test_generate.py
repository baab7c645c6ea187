"""The generator hook (U1): per-row errors, bounded retries, the end of a run,
and the table it leaves for the evaluation."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle

from scorecraft.operators import generate as G
from scorecraft.operators import scoring as S
from scorecraft.session import settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not find test modules

DATASET = "case_id string, row_index int, prompt string, ground_truth string"
RUNS = "model string, case_id string"


def dataset(spark, n=6, cases=("c",)):
    rows = [(c, i, f"{c}{i}", json.dumps({"a": i})) for c in cases for i in range(1, n + 1)]
    return spark.createDataFrame(rows, DATASET).repartition(3)


def calls(folder):
    """Prompts called for, from the files that the generators below leave."""
    return sorted(name.split("~")[0] for name in os.listdir(folder))


def noted(folder, name):
    """One new file a call; its number counts the calls of that name."""
    k = 0
    while True:
        try:
            os.close(os.open(f"{folder}/{name}~{k}", os.O_CREAT | os.O_EXCL))
            return k
        except FileExistsError:
            k += 1


def rows(df):
    return {(r.model, r.case_id, r.row_index): (r.output, r.error_kind, r.error_message, r.attempts) for r in df.collect()}


def test_answers_errors_and_retries(spark, tmp_path):
    folder = str(tmp_path)

    def generator(model, prompt):
        k = noted(folder, f"{model}-{prompt}")
        if prompt == "c2":
            raise ValueError("bad prompt")
        if prompt == "c3" or (prompt == "c4" and k < 2):
            raise G.RateLimited("slow down")
        if prompt == "c5":
            raise KeyError
        return {"a": 1} if prompt == "c6" else prompt.upper()

    runs = spark.createDataFrame([("m", "c"), ("n", "c"), ("m", "c"), ("m", "no such case")], RUNS)
    out = G.generate(dataset(spark), runs, generator, max_retries=2, retry_delay_seconds=0.0)
    for model in "mn":
        assert {k[2]: v for k, v in rows(out).items() if k[0] == model} == {
            1: ("C1", None, None, 1),
            2: (None, "error", "bad prompt", 1),
            3: (None, "rate_limit", "slow down", 3),
            4: ("C4", None, None, 3),
            5: (None, "error", "KeyError", 1),
            6: ("{'a': 1}", None, None, 1),
        }
    before = calls(folder)
    assert before.count("m-c3") == 3 and before.count("m-c1") == 1
    out.collect(), out.count()
    assert calls(folder) == before  # the table is read, nobody is called again
    with pytest.raises(ValueError):
        G.generate(dataset(spark), runs, generator, max_retries=-1)


def test_no_retry(spark):
    def generator(model, prompt):
        raise G.RateLimited("slow down")

    runs = spark.createDataFrame([("m", "c")], RUNS)
    out = G.generate(dataset(spark, 1), runs, generator, max_retries=0, retry_delay_seconds=60.0)
    assert rows(out) == {("m", "c", 1): (None, "rate_limit", "slow down", 1)}


@pytest.mark.parametrize("concurrency", [1, 4])
@pytest.mark.parametrize("refused", [1, 4])
def test_refused_credentials_end_the_run(spark, tmp_path, concurrency, refused):
    folder = str(tmp_path)

    def generator(model, prompt):
        noted(folder, f"{model}-{prompt}")
        if model == "m" and int(prompt[1:]) >= refused:
            raise G.AuthFailure("refused")
        return json.dumps({"a": int(prompt[1:])})

    data = dataset(spark, 20)
    runs = spark.createDataFrame([("m", "c"), ("n", "c")], RUNS)
    out = G.generate(data, runs, generator, concurrency=concurrency)
    if concurrency == 1:  # none is called after the refused row
        assert sum(c.startswith("m-") for c in calls(folder)) == refused
    assert sum(c.startswith("m-") for c in calls(folder)) < 20
    assert {r.row_index for r in S.evaluate(data, out).collect() if r.model == "m"} == set(range(1, refused))
    summary = {r.model: r for r in S.run_summary_with_abort(out, data).collect()}
    m, n = summary["m"], summary["n"]
    assert (m.status, m.total_rows, m.successful_evaluations) == (S.ABORTED, refused, refused - 1)
    assert m.average_score == (1.0 if refused > 1 else 0.0)
    assert (n.status, n.total_rows, n.average_score) == (S.COMPLETED, 20, 1.0)


def test_batches_after_the_end_of_their_run(spark):
    def generator(model, prompt):
        if prompt == "c2":
            raise G.AuthFailure("refused")
        return "one"

    runs = spark.createDataFrame([("m", "c"), ("m", "d")], RUNS)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2"}):
        out = G.generate(dataset(spark, 7, ("c", "d")), runs, generator, concurrency=1)
    assert sorted(k[1:] for k in rows(out)) == [("c", 1), ("c", 2), *(("d", i) for i in range(1, 8))]


def test_callers_own_errors(spark):
    class Denied(PermissionError):
        pass

    def generator(model, prompt):
        raise Denied("no") if prompt == "c2" else TimeoutError("late")

    runs = spark.createDataFrame([("m", "c")], RUNS)
    out = G.generate(
        dataset(spark, 3), runs, generator, concurrency=1, retry_delay_seconds=0.0,
        auth_errors=(PermissionError,), rate_limit_errors=(TimeoutError,),
    )
    assert {k[2]: (v[1], v[3]) for k, v in rows(out).items()} == {1: ("rate_limit", 2), 2: ("auth", 1)}


def test_recorded_rows_are_not_called_for_again(spark, tmp_path):
    folder, runs = str(tmp_path), spark.createDataFrame([("m", "c")], RUNS)

    def first(model, prompt):
        if prompt == "c3":
            raise G.AuthFailure("expired")
        return "one"

    def second(model, prompt):
        noted(folder, prompt)
        return "two"

    old = G.generate(dataset(spark), runs, first, concurrency=1)
    assert len(rows(old)) == 3
    new = G.generate(dataset(spark), runs, second, recorded=old, path=str(tmp_path / "table"))
    assert {k[2]: v[0] for k, v in rows(new).items()} == {1: "one", 2: "one", 3: "two", 4: "two", 5: "two", 6: "two"}
    assert calls(folder) == ["c3", "c4", "c5", "c6", "table"]


def test_a_lost_attempt_is_made_again_and_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path)

    def generator(model, prompt):
        if prompt == "c4" and noted(folder, "died") == 0:
            os._exit(1)  # the worker dies within the batch
        noted(folder, prompt)
        return prompt

    # local mode gives a task one attempt; a second call of the job stands for it
    runs = spark.createDataFrame([("m", "c")], RUNS)
    with pytest.raises(Exception):
        G.generate(dataset(spark), runs, generator, path=f"{folder}/out", concurrency=1)
    out = G.generate(dataset(spark), runs, generator, path=f"{folder}/out2", concurrency=1)
    assert {k[2]: v[0] for k, v in rows(out).items()} == {i: f"c{i}" for i in range(1, 7)}


def test_equal_to_a_recorded_table_and_nulls(spark):
    data = spark.createDataFrame([("c", 1, None, '{"a": 1}'), ("c", 2, "p", None)], DATASET)
    runs = spark.createDataFrame([("m", "c")], RUNS)
    out = G.generate(data, runs, lambda model, prompt: f'{{"a": {1 if prompt == "" else 2}}}')
    schema = "model string, case_id string, row_index int, output string, error_kind string, error_message string"
    recorded = spark.createDataFrame([("m", "c", 1, '{"a": 1}', None, None), ("m", "c", 2, '{"a": 2}', None, None)], schema)
    assert out.drop("attempts").schema.simpleString() == recorded.schema.simpleString()
    key = lambda r: r.row_index
    assert sorted(S.evaluate(data, out).collect(), key=key) == sorted(S.evaluate(data, recorded).collect(), key=key)
    assert G.generate(data.limit(0), runs, lambda m, p: p).collect() == []


def test_few_runs_do_not_deal_the_dataset_by_case(spark):
    data = dataset(spark, 5, ("c", "d"))
    runs = spark.createDataFrame([("m", "c"), ("n", "d")], RUNS)
    plan = S.runs_of_cases(data, runs)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
