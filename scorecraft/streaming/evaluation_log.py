"""Structured Streaming forms of the evaluation log and the aggregate merge
(T-1, T-2).

T-1: recorded outputs arrive as a stream, in any order. Each row is scored on
arrival (stateless, M1 + M2) and appended to the report store. A second stream
over that store keeps the runs' counters, with the rule that a run ends at its
first authentication failure (A2), which may arrive after later rows. Its state
is arbitrary: for each block of ROWS_PER_BLOCK rows of a run, the rows' scores
until all rows before the block's first failure have come, and only their sums
from then on. A large run is so many keys, not one. Only the keys that a batch
touched are written, to that batch's folder; a replayed batch rewrites its own.

T-2: batch results arrive as a stream. One streaming aggregation keeps, in the
state store, the sums of each model and the best and fastest run of each case;
a base summary or report is stored beside the checkpoint and merged in when the
state is read (T7: a model on one side only keeps its means). A restart goes on
from the checkpoint. Merging the same *data* twice still doubles the run counts.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scorecraft.functions import jsonops as J
from scorecraft.operators import compare as C
from scorecraft.operators import scoring as S
from scorecraft.session import ANY_AGE, checkpoint_dir, settings

COMPLETED = "completed"
FAILED = "failed"
AUTH = "auth"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
ROWS_PER_BLOCK = 4096
BLOCK_STATE = "rows binary, n bigint, ok bigint, score double, ok_score double, abort_at bigint, closed boolean"
BLOCK_TOTALS = "n bigint, ok bigint, score double, ok_score double, abort_at bigint"
_ROW = np.dtype([("at", "<u2"), ("ok", "u1"), ("score", "<f8")])


def score_rows_stateless(outputs: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Report rows (D6) from outputs that carry their truth, without the
    auth-abort rule (which needs the whole run), and ``auth``, whether the row
    is such a failure: usable on streams."""
    rows = J.with_canonical_object(outputs, truth, "_truth_raw")
    rows = J.with_canonical_object(rows, "output", "_pred")
    rows = rows.withColumn("_truth", J.empty_if_null(F.col("_truth_raw")))
    rows = J.with_match_counts(rows, "_pred", "_truth")
    failed = F.col("error_kind").isNotNull()
    keep = [c for c in outputs.columns if c not in (truth, "output", "error_kind", "error_message")]
    return rows.select(
        *keep,
        F.when(failed, F.lit(FAILED)).otherwise(F.lit(COMPLETED)).alias("status"),
        F.when(failed, F.lit(0.0))
        .otherwise(J.strict_from_counts(F.col("_n_pred"), F.col("_n_truth"), F.col("_matches")))
        .alias("score"),
        F.when(failed, F.lit("")).otherwise(F.coalesce(F.col("output"), F.lit(""))).alias("llm_output"),
        F.when(failed, F.coalesce(F.col("error_message"), F.col("error_kind"))).otherwise(F.lit("")).alias("error_message"),
        F.coalesce(F.col("error_kind") == AUTH, F.lit(False)).alias("auth"),
    )


class BlockOfRows(StatefulProcessor):
    """The counters of a block of a run's rows up to its first authentication
    failure. A row counts once: later records of its ``row_index`` are ignored
    (of one batch's records a failure of authentication is taken first)."""

    def __init__(self, first_row: int, rows_per_block: int, key_names: Sequence[str]) -> None:
        self.first_row, self.rows_per_block, self.key_names = first_row, rows_per_block, list(key_names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("block", BLOCK_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = int(key[-1]) * self.rows_per_block
        held = self.state.get() if self.state.exists() else (b"", 0, 0, 0.0, 0.0, None, False)
        packed, n, ok, score, ok_score, abort_at, closed = held
        batch = pd.concat(rows)
        if abort_at is not None:
            batch = batch[batch["row_index"] < abort_at]
        if not closed and len(batch):
            batch = batch.sort_values(["row_index", "auth", "status", "score"], ascending=[True, False, True, False])
            known = np.frombuffer(bytes(packed), dtype=_ROW)
            batch = batch.drop_duplicates("row_index")
            batch = batch[~np.isin(batch["row_index"].to_numpy(np.int64) - start, known["at"])]
            refused = batch.loc[batch["auth"].astype(bool), "row_index"]
            if len(refused):
                abort_at = int(refused.min())
            fresh = batch[batch["row_index"] < abort_at] if abort_at is not None else batch
            new = np.empty(len(fresh), dtype=_ROW)
            new["at"] = fresh["row_index"].to_numpy(np.int64) - start
            new["ok"] = (fresh["status"] == COMPLETED).to_numpy()
            new["score"] = fresh["score"].to_numpy(np.float64)
            known = known[known["at"] < abort_at - start] if abort_at is not None else known
            known = np.concatenate([known, new])
            done = known["ok"] == 1
            n, ok = len(known), int(done.sum())
            score, ok_score = float(known["score"].sum()), float(known["score"][done].sum())
            end = self.rows_per_block if abort_at is None else abort_at - start
            closed = n == end - max(0, self.first_row - start)
            packed = b"" if closed else known.tobytes()
            self.state.update((packed, n, ok, score, ok_score, abort_at, bool(closed)))
        out = {name: [k] for name, k in zip(self.key_names, key)}
        out |= {"n": [n], "ok": [ok], "score": [score], "ok_score": [ok_score]}
        yield pd.DataFrame(out).assign(abort_at=pd.array([abort_at], dtype="Int64"))

    def close(self) -> None:
        pass


def block_counters(
    reports: DataFrame, run_keys: Sequence[str] = S.RUN_KEYS, first_row: int = 1, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """T-1 state: ``run_keys, block, n, ok, score, ok_score, abort_at`` of every
    block that a batch of the stream of report rows touched."""
    if not 0 < rows_per_block <= 1 << 16:
        raise ValueError(f"rows_per_block must be within 1 to 65536: {rows_per_block}")
    keys = list(run_keys)
    rows = reports.filter(F.col("row_index").isNotNull()).select(
        *keys, F.floor(F.col("row_index") / rows_per_block).cast("bigint").alias("block"),
        F.col("row_index").cast("bigint").alias("row_index"), "status", "score", "auth",
    )
    types = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*keys, "block"]]
    return rows.groupBy(*keys, "block").transformWithStateInPandas(
        BlockOfRows(first_row, rows_per_block, [*keys, "block"]), f"{', '.join(types)}, {BLOCK_TOTALS}", "Update", "None"
    )


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def run_evaluation_log(
    outputs_stream: DataFrame,
    report_path: str | None = None,
    counters_path: str | None = None,
    run_keys: Sequence[str] = S.RUN_KEYS,
    available_now: bool = True,
    spread_to: int | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> tuple[str, str]:
    """T-1: start (and, with ``available_now``, drain) the two streaming
    queries: append report rows to Parquet, keep the runs' counters by block.
    Returns ``(report_path, counters_path)``; see :func:`run_summaries`. A call
    with the paths of an earlier one goes on from its checkpoints.

    ``spread_to`` round-robins every micro-batch over that many tasks before
    scoring; use it when a trigger brings few, unsplittable files (a stream
    of many files per trigger is already spread by its splits)."""
    spark = outputs_stream.sparkSession
    report_path = report_path or _scratch(spark, "reports")
    counters_path = counters_path or _scratch(spark, "counters")
    if spread_to:
        outputs_stream = outputs_stream.repartition(spread_to)
    reports = score_rows_stateless(outputs_stream)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    q1 = (
        reports.writeStream.format("parquet")
        .option("path", report_path)
        .option("checkpointLocation", report_path + "._checkpoint")
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
    if available_now:
        q1.awaitTermination()
    # The counters read the scored report store as a second stream, so each
    # output text is parsed once (in q1). The folder must exist before a file
    # stream can start on it (q1 may not have committed a batch yet).
    _mkdirs(spark, report_path)
    scored = spark.readStream.options(**ANY_AGE).schema(reports.schema).parquet(report_path)

    def write_touched(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(counters_path, f"batch={batch_id}"))

    with settings(spark, ROCKSDB):
        q2 = (
            block_counters(scored, run_keys, rows_per_block=rows_per_block)
            .writeStream.outputMode("update")
            .option("checkpointLocation", counters_path + "._checkpoint")
            .foreachBatch(write_touched)
            .trigger(**trigger)
            .start()
        )
        if available_now:
            q2.awaitTermination()
    return report_path, counters_path


def run_summaries(
    spark: SparkSession, counters_path: str, run_keys: Sequence[str] = S.RUN_KEYS, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """A1 + A2 of every run as the stream has it now: the newest counters of each
    block, blocks after the run's first authentication failure left out."""
    keys = list(run_keys)
    touched = spark.read.parquet(counters_path)
    fields = [f.split()[0] for f in BLOCK_TOTALS.split(", ")]
    blocks = touched.groupBy(*keys, "block").agg(F.max_by(F.struct(*fields), "batch").alias("c")).select(*keys, "block", "c.*")
    aborts = blocks.groupBy(*keys).agg(F.min("abort_at").alias("abort_at"))
    counted = blocks.drop("abort_at").join(aborts, keys).filter(
        F.col("abort_at").isNull() | (F.col("block") * rows_per_block <= F.col("abort_at"))
    )
    totals = counted.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.sum("ok").alias("_ok"), F.sum("score").alias("_sum"), F.sum("ok_score").alias("_ok_sum")
    )
    return S.summary_from_totals(aborts, totals, keys)


def written_reports(
    spark: SparkSession, report_path: str, counters_path: str, run_keys: Sequence[str] = S.RUN_KEYS
) -> DataFrame:
    """The log's report rows up to each run's first authentication failure."""
    keys = list(run_keys)
    aborts = spark.read.parquet(counters_path).groupBy(*keys).agg(F.min("abort_at").alias("abort_at"))
    rows = spark.read.parquet(report_path).join(aborts, keys, "left")
    return rows.filter(F.col("abort_at").isNull() | (F.col("row_index") < F.col("abort_at"))).drop("abort_at", "auth")


SUM_COLUMNS = ["score_sum", "seconds_sum", "total_runs", "completed_runs"]
SUMMARY_COLUMNS = ["average_score", "average_seconds", "total_runs", "completed_runs"]
# The state's value holds the aggregates of runs_to_sums in this order.
STATE_FIELDS = "score_sum: double, seconds_sum: double, total_runs: bigint, completed_runs: bigint"


def runs_to_sums(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(
        F.sum("average_score").alias("score_sum"),
        F.sum("elapsed_seconds").alias("seconds_sum"),
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == COMPLETED).alias("completed_runs"),
    )


def merge_stream_into_summary(
    runs_stream: DataFrame,
    base_models: DataFrame | None,
    state_path: str | None = None,
    available_now: bool = True,
) -> str | tuple[str, StreamingQuery]:
    """T-2: per-model sums of a stream of batch results, kept by the streaming
    aggregation in its state store; the base summary is stored beside it and
    the two are merged when they are read (:func:`latest_state`).

    A run with the ``state_path`` of an earlier one goes on from its
    checkpoint: files that were read are not read again, and the base stays
    the one stored first. Returns the state path; a query that is not drained
    (``available_now=False``) is returned with it.
    """
    spark = runs_stream.sparkSession
    state_path = state_path or _scratch(spark, "model-state")
    if base_models is not None:
        base_models.select("model", *SUMMARY_COLUMNS).write.mode("ignore").parquet(os.path.join(state_path, "base"))
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    query = (
        runs_to_sums(runs_stream)
        .writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", os.path.join(state_path, "_checkpoint"))
        .trigger(**trigger)
        .start()
    )
    if not available_now:
        return state_path, query
    query.awaitTermination()
    return state_path


RUN_KEY_STATE = "score: double, seconds: double, place: bigint, model: string"
# The state's value holds the aggregates of report_entries in this order.
ENTRY_STATE = f"{STATE_FIELDS}, first_run: bigint, best: struct<{RUN_KEY_STATE}>, fastest: struct<{RUN_KEY_STATE}>"
MODEL_ENTRY, CASE_ENTRY = "model", "case"


def report_entries(runs: DataFrame) -> DataFrame:
    """Sums, and the best and fastest run (R1), of every model and every case,
    as one aggregation with one state: both are always of the same batch."""
    score, seconds, place = F.col("average_score"), F.col("elapsed_seconds"), F.col("run_index").cast("bigint")
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    named = runs.select("*", F.inline(F.array(entry(MODEL_ENTRY, "model"), entry(CASE_ENTRY, "case_id"))))
    return named.groupBy("kind", "name").agg(
        F.sum(score).alias("score_sum"),
        F.sum(seconds).alias("seconds_sum"),
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == COMPLETED).alias("completed_runs"),
        F.min(place).alias("first_run"),
        F.min(F.struct((-score).alias("score"), seconds.alias("seconds"), place.alias("place"), F.col("model"))).alias("best"),
        F.min(F.struct(seconds.alias("score"), (-score).alias("seconds"), place.alias("place"), F.col("model"))).alias("fastest"),
    )


def merge_stream_into_report(
    runs_stream: DataFrame,
    base_report: DataFrame | None,
    state_path: str | None = None,
    available_now: bool = True,
) -> str | tuple[str, StreamingQuery]:
    """T-2 with case rows and winners: a stream of batch results merged into an
    overall report (D9), as :func:`scorecraft.operators.compare.merge_overall`
    merges all of them at once. Returns the state path (see
    :func:`latest_report`), and the query if it is not drained."""
    spark = runs_stream.sparkSession
    state_path = state_path or _scratch(spark, "report-state")
    if base_report is not None:
        C.to_report_layout(base_report).write.mode("ignore").parquet(os.path.join(state_path, "base"))
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    query = (
        report_entries(runs_stream)
        .writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", os.path.join(state_path, "_checkpoint"))
        .trigger(**trigger)
        .start()
    )
    if not available_now:
        return state_path, query
    query.awaitTermination()
    return state_path


def latest_report(spark: SparkSession, state_path: str) -> DataFrame:
    """The overall report (D9) now: streamed cases replace those of the base
    (J6), streamed sums are merged with its models (J5), and the winners are
    picked from the merged models."""
    checkpoint, base_path = os.path.join(state_path, "_checkpoint"), os.path.join(state_path, "base")
    base = spark.read.parquet(base_path) if _exists(spark, base_path) else None
    if not _exists(spark, os.path.join(checkpoint, "state", "0")):  # no file has come yet
        if base is None:
            raise FileNotFoundError(f"neither a base nor a state in {state_path}")
        return base
    held = spark.read.format("statestore").load(checkpoint).select(
        "key.kind", "key.name", F.col("value").cast(f"struct<{ENTRY_STATE}>").alias("s")
    )
    cases = held.filter(F.col("kind") == CASE_ENTRY).select(
        F.col("name").alias("case_id"),
        F.col("s.best.model").alias("best_model"), (-F.col("s.best.score")).alias("best_score"),
        F.col("s.fastest.model").alias("fastest_model"), F.col("s.fastest.score").alias("fastest_seconds"),
        "s.total_runs", "s.completed_runs",
    )
    streamed = held.filter(F.col("kind") == MODEL_ENTRY).select(F.col("name").alias("model"), "s.*")
    new = streamed.select(
        "model", (F.coalesce("score_sum", F.lit(0.0)) / F.col("total_runs")).alias("average_score"),
        (F.coalesce("seconds_sum", F.lit(0.0)) / F.col("total_runs")).alias("average_seconds"), "total_runs", "completed_runs", "first_run",
    )
    if base is None:
        models, order = new, "first_run"
    else:
        cases = C.merge_case_rows(C.report_cases(base), cases)
        models, order = C.merge_model_summaries(C.report_models(base), new.drop("first_run")), "model"
    return C.union_sections(C.to_report_layout(cases, C.CASE_SECTION), C.model_and_winner_rows(models, order=order))


def _mkdirs(spark: SparkSession, path: str) -> None:
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hp)


def _exists(spark: SparkSession, path: str) -> bool:
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp)


def latest_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The model summary now: base and streamed sums merged by T7. A model on
    one side only keeps that side's means, whatever its number of runs."""
    checkpoint, base_path = os.path.join(state_path, "_checkpoint"), os.path.join(state_path, "base")
    base = spark.read.parquet(base_path) if _exists(spark, base_path) else None
    if not _exists(spark, os.path.join(checkpoint, "state", "0")):  # no file has come yet
        if base is None:
            raise FileNotFoundError(f"neither a base nor a state in {state_path}")
        return base
    held = spark.read.format("statestore").load(checkpoint).select(
        "key.model", F.col("value").cast(f"struct<{STATE_FIELDS}>").alias("s")
    )
    added = held.select("model", *[F.coalesce(f"s.{c}", F.lit(0)).alias(c) for c in SUM_COLUMNS])
    if base is None:
        base = spark.createDataFrame([], base_schema())
    both = base.join(added, "model", "full")
    runs = F.coalesce(base["total_runs"], F.lit(0)) + F.coalesce(added["total_runs"], F.lit(0))

    def mean(old: str, new: str):
        sums = F.coalesce(base[old] * base["total_runs"], F.lit(0.0)) + added[new]
        return F.when(added["total_runs"].isNull(), base[old]).when(runs == 0, F.lit(0.0)).otherwise(sums / runs).alias(old)

    done = F.coalesce(base["completed_runs"], F.lit(0)) + F.coalesce(added["completed_runs"], F.lit(0))
    return both.select(
        "model", mean("average_score", "score_sum"), mean("average_seconds", "seconds_sum"),
        runs.alias("total_runs"), done.alias("completed_runs"),
    )


def base_schema() -> str:
    return "model string, average_score double, average_seconds double, total_runs bigint, completed_runs bigint"
