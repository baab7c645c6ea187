"""Evaluate recorded outputs against a dataset and summarise runs.

A *run* is one (model, case) pair. Outputs are a table ``(model, case_id,
row_index, output, error_kind, error_message)``, recorded elsewhere or by
:mod:`scorecraft.operators.generate`; ``error_kind`` is NULL for a normal answer,
``'auth'`` for an authentication failure (aborts the run) and anything else
for a per-row failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions import jsonops as J
from scorecraft.operators.layout import written

COMPLETED = "completed"
FAILED = "failed"
EMPTY = "empty"
ABORTED = "aborted_due_to_auth"
FAILED_PREPROCESS = "failed_preprocess"
AUTH = "auth"
MISSING_ROW = "row_index not found in the dataset"
NO_OUTPUT = "no recorded output"

RUN_KEYS = ("model", "case_id")
REPORT_COLUMNS = ["row_index", "status", "score", "llm_output", "error_message"]


def first_auth_failure(outputs: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Per run, the row index of the first authentication failure (or none).

    One partial aggregate: one row per run leaves each task.
    """
    return outputs.groupBy(*run_keys).agg(
        F.min(F.when(F.col("error_kind") == AUTH, F.col("row_index"))).alias("abort_at")
    )


def runs_of_cases(dataset: DataFrame, runs: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Each dataset row with each run of its case (``runs``: one row per run).

    The runs are written first, so that the planner knows their size: few runs
    are broadcast and the dataset, which has few distinct cases, is not dealt by
    case; many are joined by a sort-merge join whose skewed cases are split."""
    case_keys = [k for k in run_keys if k in dataset.columns]
    return dataset.join(written(runs, "runs"), case_keys)


def evaluate(
    dataset: DataFrame | None,
    outputs: DataFrame,
    run_keys: Sequence[str] = RUN_KEYS,
    truth: str = "ground_truth",
    aborts: DataFrame | None = None,
) -> DataFrame:
    """U1 + M1 + M2: one report row per (run, dataset row) up to the run's
    first authentication failure (that row and later ones are not written).
    ``aborts`` (from :func:`first_auth_failure`) may be passed when the
    caller needs it too, so both uses share one plan.

    ``dataset``: ``(case_id, row_index, <truth>)`` (+ any columns);
    ``outputs``: recorded outputs keyed by ``run_keys + row_index``. Each run
    (a distinct value of ``run_keys``) goes through all dataset rows of its
    case: a row without a recorded output is a failed one, and outputs of rows
    that the dataset does not have are no part of the run (see
    :func:`stray_outputs`). When ``outputs`` already carries the ``truth``
    column, ``dataset`` may be None and no join is made.
    Report rows: ``run_keys, row_index, status, score, llm_output,
    error_message`` (D6). Failed rows score 0.0 with an empty output.
    """
    if aborts is None:
        aborts = first_auth_failure(outputs, run_keys)
    if truth in outputs.columns:
        rows = _before_abort(outputs.join(aborts, list(run_keys), "left"))
    else:
        # the abort table has one row per run: it is the list of runs too
        case_keys = [k for k in run_keys if k in dataset.columns]
        expected = _before_abort(runs_of_cases(dataset.select(*case_keys, "row_index", truth), aborts, run_keys))
        recorded = outputs.withColumn("_recorded", F.lit(True))
        rows = expected.join(recorded, [*run_keys, "row_index"], "left").withColumn(
            "error_kind", F.when(F.col("_recorded").isNull(), F.lit(NO_OUTPUT)).otherwise(F.col("error_kind"))
        )
    rows = J.with_canonical_object(rows, truth, "_truth_raw")
    rows = J.with_canonical_object(rows, "output", "_pred")
    rows = rows.withColumn("_truth", J.empty_if_null(F.col("_truth_raw")))
    rows = J.with_match_counts(rows, "_pred", "_truth")
    failed = F.col("error_kind").isNotNull() | F.col(truth).isNull()
    message = F.coalesce(
        F.col("error_message"),
        F.when(F.col(truth).isNull(), F.lit(MISSING_ROW)),
        F.col("error_kind"),
    )
    return rows.select(
        *run_keys,
        "row_index",
        F.when(failed, F.lit(FAILED)).otherwise(F.lit(COMPLETED)).alias("status"),
        F.when(failed, F.lit(0.0))
        .otherwise(J.strict_from_counts(F.col("_n_pred"), F.col("_n_truth"), F.col("_matches")))
        .alias("score"),
        F.when(failed, F.lit("")).otherwise(F.coalesce(F.col("output"), F.lit(""))).alias("llm_output"),
        F.when(failed, message).otherwise(F.lit("")).alias("error_message"),
    )


def _before_abort(rows: DataFrame) -> DataFrame:
    """Rows before their run's first authentication failure."""
    return rows.filter(F.col("abort_at").isNull() | (F.col("row_index") < F.col("abort_at")))


def stray_outputs(dataset: DataFrame, outputs: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Recorded outputs whose row the dataset does not have: the error table
    beside :func:`evaluate`."""
    case_keys = [k for k in run_keys if k in dataset.columns]
    return outputs.join(dataset.select(*case_keys, "row_index"), [*case_keys, "row_index"], "left_anti")


def run_summary(reports: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """A1: per run ``total_rows, successful_evaluations, average_score``;
    failed rows count in the total and score 0; status ``completed``."""
    agg = reports.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("status") == COMPLETED).alias("successful_evaluations"),
        F.sum(F.coalesce(F.col("score"), F.lit(0.0))).alias("_score_sum"),
    )
    return agg.select(
        *run_keys,
        F.lit(COMPLETED).alias("status"),
        "total_rows",
        "successful_evaluations",
        (F.col("_score_sum") / F.col("total_rows")).alias("average_score"),
    )


def run_summary_with_abort(
    outputs: DataFrame,
    dataset: DataFrame | None,
    run_keys: Sequence[str] = RUN_KEYS,
    truth: str = "ground_truth",
) -> DataFrame:
    """A1 + A2 from recorded outputs.

    Without an auth failure: A1 over the run's report rows. With one at row
    ``i``: status ``aborted_due_to_auth``, ``total_rows = i``, successful =
    completed rows before it, average over those successful rows only
    (0.0 when none) - even when the very first row failed.
    """
    aborts = first_auth_failure(outputs, run_keys)
    reports = evaluate(dataset, outputs, run_keys, truth, aborts=aborts)
    return summary_from_totals(aborts, run_totals(reports, run_keys), run_keys)


def run_totals(reports: DataFrame, run_keys: Sequence[str] = RUN_KEYS, extra_aggs: Sequence = ()) -> DataFrame:
    """Per run partial sums of the report rows (``_n, _ok, _sum, _ok_sum``)
    plus any ``extra_aggs``, in one partial aggregate."""
    return reports.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("status") == COMPLETED).alias("_ok"),
        F.sum("score").alias("_sum"),
        F.sum(F.when(F.col("status") == COMPLETED, F.col("score"))).alias("_ok_sum"),
        *extra_aggs,
    )


def summary_from_totals(
    aborts: DataFrame,
    totals: DataFrame,
    run_keys: Sequence[str] = RUN_KEYS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """A1 + A2 from :func:`run_totals` and the per-run abort table; ``keep``
    carries extra total columns through (NULL for runs without rows)."""
    # Runs whose first row aborted have no report rows: keep them via the
    # per-run abort table (one row per run).
    full = aborts.join(totals, list(run_keys), "left")
    aborted = F.col("abort_at").isNotNull()
    ok = F.coalesce(F.col("_ok"), F.lit(0))
    return full.select(
        *run_keys,
        F.when(aborted, F.lit(ABORTED)).otherwise(F.lit(COMPLETED)).alias("status"),
        F.when(aborted, F.col("abort_at")).otherwise(F.col("_n")).cast("bigint").alias("total_rows"),
        ok.cast("bigint").alias("successful_evaluations"),
        F.when(aborted, F.when(ok > 0, F.col("_ok_sum") / ok).otherwise(F.lit(0.0)))
        .otherwise(F.col("_sum") / F.col("_n"))
        .alias("average_score"),
        *keep,
    )


def with_empty_runs(summaries: DataFrame, matrix: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """A1 for datasets without rows: runs of the matrix with no summary get
    status ``empty`` and zeros (left join from the run matrix)."""
    joined = matrix.join(summaries, list(run_keys), "left")
    missing = F.col("status").isNull()
    return joined.select(
        *matrix.columns,
        F.when(missing, F.lit(EMPTY)).otherwise(F.col("status")).alias("status"),
        F.coalesce(F.col("total_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.col("successful_evaluations"), F.lit(0)).cast("bigint").alias("successful_evaluations"),
        F.coalesce(F.col("average_score"), F.lit(0.0)).alias("average_score"),
    )


def with_failed_runs(
    summaries: DataFrame,
    failures: DataFrame,
    run_keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """A3: runs whose preparation failed (``failures``: run keys or case_id +
    ``error_message``) become ``failed_preprocess`` rows with zero score,
    seconds and rows; the batch goes on. A failure replaces the summary."""
    fail_keys = [k for k in run_keys if k in failures.columns]
    tagged = summaries.join(
        failures.select(*fail_keys, F.col("error_message").alias("_fail_message")), fail_keys, "left"
    )
    failed = F.col("_fail_message").isNotNull()
    cols = []
    for c in summaries.columns:
        if c == "status":
            cols.append(F.when(failed, F.lit(FAILED_PREPROCESS)).otherwise(F.col(c)).alias(c))
        elif c in ("average_score", "elapsed_seconds"):
            cols.append(F.when(failed, F.lit(0.0)).otherwise(F.col(c)).alias(c))
        elif c in ("total_rows", "successful_evaluations"):
            cols.append(F.when(failed, F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c))
        elif c != "error_message":
            cols.append(F.col(c))
    base_msg = F.col("error_message") if "error_message" in summaries.columns else F.lit(None).cast("string")
    cols.append(F.when(failed, F.col("_fail_message")).otherwise(base_msg).alias("error_message"))
    return tagged.select(*cols)
