"""Streaming forms (T-1, T-2) over several micro-batches."""

import json
import random

import pandas as pd
import pytest

from scorecraft.operators import compare as C
from scorecraft.operators import scoring as S
from scorecraft.streaming import evaluation_log as T

OUT_SCHEMA = "model string, case_id string, row_index long, ground_truth string, output string, error_kind string, error_message string"
RUN_SCHEMA = "model string, case_id string, status string, average_score double, elapsed_seconds double, run_index long"


def test_running_counters_over_batches(spark, tmp_path):
    src = str(tmp_path / "outputs")
    truth = json.dumps({"a": 1, "b": 2})
    batches = [
        [("m", "c", 1, truth, '{"a":1,"b":2}', None, None), ("m", "c", 2, truth, '{"a":1}', None, None)],
        [("m", "c", 3, truth, None, "error", "boom"), ("n", "c", 1, truth, "bad", None, None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, OUT_SCHEMA).coalesce(1).write.parquet(f"{src}/batch={i}")
    stream = spark.readStream.schema(OUT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    report_path, counters_path = T.run_evaluation_log(stream, report_path=str(tmp_path / "rep"), counters_path=str(tmp_path / "cnt"))
    got = {r.model: r for r in T.run_summaries(spark, counters_path).collect()}
    assert (got["m"].total_rows, got["m"].successful_evaluations) == (3, 2)
    assert got["m"].average_score == pytest.approx((1.0 + 0.5 + 0.0) / 3)
    assert (got["n"].total_rows, got["n"].average_score) == (1, 0.0)
    assert spark.read.parquet(report_path).count() == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_abort_whatever_the_order_of_rows_and_batches(spark, tmp_path, seed):
    """Runs with none, one and several failures of authentication, rows dealt at
    random over batches with a restart after each: always A2's answer so far."""
    rng = random.Random(seed)
    refused = {"none": [], "one": [37], "first": [1], "several": [55, 20, 58], "edge": [16], "last": [60]}
    rows = []
    for model, at in refused.items():
        for i in range(1, 61):
            kind = "auth" if i in at else "error" if i % 9 == 4 else None
            output = None if kind else json.dumps({"a": 1, "b": i % 3})
            rows.append((model, "c", i, json.dumps({"a": 1, "b": 0}), output, kind, kind and f"{kind} {i}"))
    rng.shuffle(rows)
    src, rep, cnt = (str(tmp_path / n) for n in ("out", "rep", "cnt"))
    cuts = [0, 100, 101, 250, len(rows)]
    for start, end in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[start:end], OUT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(OUT_SCHEMA).parquet(src)
        T.run_evaluation_log(stream, report_path=rep, counters_path=cnt, rows_per_block=16)
        seen = spark.createDataFrame(rows[:end], OUT_SCHEMA)
        key = lambda r: (r.model, r.case_id)
        got = sorted(T.run_summaries(spark, cnt, rows_per_block=16).collect(), key=key)
        expected = sorted(S.run_summary_with_abort(seen, None).collect(), key=key)
        assert [r[:-1] for r in got] == [r[:-1] for r in expected]
        assert [r.average_score for r in got] == pytest.approx([r.average_score for r in expected])
    kept = T.written_reports(spark, rep, cnt).select("model", "row_index", "status").collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, S.evaluate(None, seen).select("model", "row_index", "status").collect()))
    # a batch writes the keys it touched alone: the second one had one row
    assert spark.read.parquet(f"{cnt}/batch=1").count() == 1


def blocks_of(processor, batches):
    """The processor's last counters, with a state held in Python."""

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    processor.state = Value()
    for rows in batches:
        frame = pd.DataFrame(rows, columns=["row_index", "status", "score", "auth"])
        out = next(processor.handleInputRows(("m", 0), iter([frame]), None))
    return out.iloc[0], processor.state.value


def test_a_block_holds_sums_alone_once_it_is_closed():
    full = [(i, "completed", 0.5, False) for i in range(1, 8)]
    out, state = blocks_of(T.BlockOfRows(1, 8, ["model", "block"]), [full[4:], full[:4]])
    assert (out.n, out.score, state[0], state[-1]) == (7, 3.5, b"", True)
    out, state = blocks_of(T.BlockOfRows(1, 8, ["model", "block"]), [full[4:], [(4, "failed", 0.0, True)], full[:2], full[2:3]])
    assert (out.n, out.ok, out.score, out.abort_at) == (3, 3, 1.5, 4) and state[0] == b"" and state[-1]
    out, state = blocks_of(T.BlockOfRows(1, 8, ["model", "block"]), [full[:2], full[:2], [(2, "completed", 1.0, False)] * 2])
    assert (out.n, out.score) == (2, 1.0) and not state[-1]
    out, state = blocks_of(T.BlockOfRows(1, 8, ["model", "block"]), [[(1, "failed", 0.0, True)], full])
    assert (out.n, out.score, out.abort_at) == (0, 0.0, 1) and state[-1]


def compared(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("with_base", [True, False])
def test_report_stream_equals_one_merge_after_each_batch(spark, tmp_path, with_base):
    rng = random.Random(3)
    status = ["completed", "failed_preprocess", "empty"]
    runs = [(f"m{rng.randrange(4)}", f"c{rng.randrange(6)}", rng.choice(status), rng.randrange(5) / 4, float(rng.randrange(4)), i) for i in range(200)]
    old = [("m1", "c0", "completed", 0.5, 2.0, 1), ("idle", "old case", "completed", 1.0, 1.0, 2)]
    base = C.overall_report(spark.createDataFrame(old, RUN_SCHEMA)) if with_base else None
    src, state = str(tmp_path / "runs"), str(tmp_path / "state")
    for start, end in ((0, 1), (1, 90), (90, 200)):
        spark.createDataFrame(runs[start:end], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # the second drain finds no new file and counts nothing twice
            T.merge_stream_into_report(spark.readStream.schema(RUN_SCHEMA).parquet(src), base, state_path=state)
        expected = C.merge_overall(base, spark.createDataFrame(runs[:end], RUN_SCHEMA))
        assert compared(T.latest_report(spark, state)) == compared(expected)


def test_report_without_streamed_runs(spark, tmp_path):
    base = C.overall_report(spark.createDataFrame([("a", "x", "completed", 0.5, 2.0, 1)], RUN_SCHEMA))
    src = str(tmp_path / "none")
    spark.createDataFrame([], RUN_SCHEMA).write.parquet(src)
    state = T.merge_stream_into_report(spark.readStream.schema(RUN_SCHEMA).parquet(src), base, state_path=str(tmp_path / "s"))
    assert compared(T.latest_report(spark, state)) == compared(base)
    with pytest.raises(FileNotFoundError):
        T.latest_report(spark, str(tmp_path / "nowhere"))


def test_merge_stream_goes_on_from_its_state(spark, tmp_path):
    src, state = str(tmp_path / "runs"), str(tmp_path / "state")
    rows = [[("a", "x", "completed", 1.0, 2.0, 1)], [("b", "x", "completed", 0.5, 1.0, 2), ("a", "y", "failed_preprocess", 0.0, 0.0, 3)]]
    base = spark.createDataFrame([("a", 0.7, 3.0, 4, 4), ("idle", 0.9, 2.0, 0, 0)], T.base_schema())
    for i, r in enumerate(rows):
        spark.createDataFrame(r, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # the second drain finds no new file and counts nothing twice
            T.merge_stream_into_summary(spark.readStream.schema(RUN_SCHEMA).parquet(src), base, state_path=state)
        assert {x.model: x.total_runs for x in T.latest_state(spark, state).collect()}["a"] == 5 + i
    got = {r.model: r for r in T.latest_state(spark, state).collect()}
    merged = {r.model: r for r in C.merge_model_summaries(base, C.model_summary(spark.read.parquet(src)).drop("first_run")).collect()}
    assert set(got) == set(merged) == {"a", "b", "idle"}
    for model, row in merged.items():
        assert got[model].average_score == pytest.approx(row.average_score)
        assert got[model].average_seconds == pytest.approx(row.average_seconds)
        assert (got[model].total_runs, got[model].completed_runs) == (row.total_runs, row.completed_runs)
    assert got["idle"].average_score == 0.9


def test_base_without_streamed_runs(spark, tmp_path):
    base = spark.createDataFrame([("a", 0.7, 3.0, 4, 4)], T.base_schema())
    src = str(tmp_path / "none")
    spark.createDataFrame([], RUN_SCHEMA).write.parquet(src)
    state = T.merge_stream_into_summary(spark.readStream.schema(RUN_SCHEMA).parquet(src), base, state_path=str(tmp_path / "s"))
    assert [tuple(r) for r in T.latest_state(spark, state).collect()] == [("a", 0.7, 3.0, 4, 4)]
    with pytest.raises(FileNotFoundError):
        T.latest_state(spark, str(tmp_path / "nowhere"))
