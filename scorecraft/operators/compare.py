"""Compare runs across models and cases; merge with an earlier report
(R1, R5, R6, A4-A8, J5, J6).

Input ``runs`` (D8): ``model, case_id, status, average_score,
elapsed_seconds, run_index``. ``run_index`` is the input order used for
full ties (T4): Python's ``max``/``min`` return the first of equal items.

Arg-max / arg-min are ``min_by`` over a struct key, which Spark computes
with partial aggregation (one small buffer per group and task), so a hot
case or model never gathers its rows in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMPLETED = "completed"

# Section names and column order of the overall report.
CASE_SECTION = "case_comparison"
MODEL_SECTION = "model_summary"
BEST_SECTION = "overall_best_average"
FASTEST_SECTION = "overall_fastest"
SECTION_ORDER = [CASE_SECTION, MODEL_SECTION, BEST_SECTION, FASTEST_SECTION]
REPORT_COLUMNS = [
    "section",
    "case_id",
    "model",
    "best_model",
    "best_score",
    "fastest_model",
    "fastest_seconds",
    "average_score",
    "average_seconds",
    "total_runs",
    "completed_runs",
]
_TYPES = {
    "section": "string",
    "case_id": "string",
    "model": "string",
    "best_model": "string",
    "best_score": "double",
    "fastest_model": "string",
    "fastest_seconds": "double",
    "average_score": "double",
    "average_seconds": "double",
    "total_runs": "bigint",
    "completed_runs": "bigint",
}


def best_key(score: Column, seconds: Column, order: Column) -> Column:
    """R1 best: highest score, then lowest seconds, then first in input order
    (as a key for ``min_by``)."""
    return F.struct(-score, seconds, order)


def fastest_key(score: Column, seconds: Column, order: Column) -> Column:
    """R1 fastest: lowest seconds, then highest score, then input order."""
    return F.struct(seconds, -score, order)


def _completed(status: str = "status") -> Column:
    return F.count_if(F.col(status) == COMPLETED)


def case_comparison(runs: DataFrame) -> DataFrame:
    """A4: per case the best and fastest run, total and completed runs."""
    score, seconds, order = F.col("average_score"), F.col("elapsed_seconds"), F.col("run_index")
    agg = runs.groupBy("case_id").agg(
        F.min_by(F.struct(F.col("model"), score), best_key(score, seconds, order)).alias("_best"),
        F.min_by(F.struct(F.col("model"), seconds), fastest_key(score, seconds, order)).alias("_fast"),
        F.count(F.lit(1)).alias("total_runs"),
        _completed().alias("completed_runs"),
    )
    return agg.select(
        "case_id",
        F.col("_best.model").alias("best_model"),
        F.col("_best.average_score").alias("best_score"),
        F.col("_fast.model").alias("fastest_model"),
        F.col("_fast.elapsed_seconds").alias("fastest_seconds"),
        "total_runs",
        "completed_runs",
    )


def model_summary_aggs() -> list[Column]:
    """The A5 aggregates, for a ``groupBy("model")`` of runs."""
    return [
        F.avg("average_score").alias("average_score"),
        F.avg("elapsed_seconds").alias("average_seconds"),
        F.count(F.lit(1)).alias("total_runs"),
        _completed().alias("completed_runs"),
        F.min("run_index").alias("first_run"),
    ]


def model_summary(runs: DataFrame) -> DataFrame:
    """A5: per model mean score and seconds, total and completed runs, and
    ``first_run`` (first appearance, the tie order for A6)."""
    return runs.groupBy("model").agg(*model_summary_aggs())


def overall_winners(models: DataFrame, order: str = "first_run") -> DataFrame:
    """Best average (score desc, seconds asc) and fastest average
    (seconds asc, score desc) over the model summary; ``order`` breaks full
    ties. Two rows, or none when there are no models.

    ``models`` is the A5 output: one row per model, so this global
    aggregate is small by construction.
    """
    score, seconds, tie = F.col("average_score"), F.col("average_seconds"), F.col(order)
    row = F.struct("model", "average_score", "average_seconds", "total_runs", "completed_runs")
    picked = models.agg(
        F.min_by(row, best_key(score, seconds, tie)).alias("best"),
        F.min_by(row, fastest_key(score, seconds, tie)).alias("fast"),
    )
    both = picked.select(
        F.inline(
            F.array(
                F.struct(F.lit(BEST_SECTION).alias("section"), F.col("best").alias("w")),
                F.struct(F.lit(FASTEST_SECTION).alias("section"), F.col("fast").alias("w")),
            )
        )
    )
    return both.filter(F.col("w").isNotNull()).select(
        "section",
        F.col("w.model").alias("model"),
        F.col("w.average_score").alias("average_score"),
        F.col("w.average_seconds").alias("average_seconds"),
        F.col("w.total_runs").alias("total_runs"),
        F.col("w.completed_runs").alias("completed_runs"),
    )


def model_and_winner_rows(models: DataFrame, order: str = "first_run") -> DataFrame:
    """A5 + A6 in the D9 layout from one pass over the model summary: every
    model row, plus the best-average and fastest rows (the same values under
    their winner section), so the summary is not computed twice.

    The winners are picked with ``min_by`` over a window holding all model
    rows: one row per model, bounded by the model list (never by runs).
    """
    return to_report_layout(_with_sections(models, order, with_model_row=True))


def winner_rows(models: DataFrame, order: str = "first_run") -> DataFrame:
    """A6 as whole rows: the best-average and fastest model rows with every
    column of ``models`` (extra columns such as source scores kept) and a
    ``section`` column; picked over a window of the model rows (bounded)."""
    return _with_sections(models, order, with_model_row=False)


def _with_sections(models: DataFrame, order: str, with_model_row: bool) -> DataFrame:
    score, seconds, tie = F.col("average_score"), F.col("average_seconds"), F.col(order)
    everyone = Window.partitionBy()
    tagged = models.select(
        "*",
        F.min_by(F.col("model"), best_key(score, seconds, tie)).over(everyone).alias("_best"),
        F.min_by(F.col("model"), fastest_key(score, seconds, tie)).over(everyone).alias("_fast"),
    )
    sections = F.array_compact(
        F.array(
            *([F.lit(MODEL_SECTION)] if with_model_row else []),
            F.when(F.col("model").eqNullSafe(F.col("_best")), F.lit(BEST_SECTION)),
            F.when(F.col("model").eqNullSafe(F.col("_fast")), F.lit(FASTEST_SECTION)),
        )
    )
    return tagged.select("*", F.explode(sections).alias("section")).drop("_best", "_fast")


def to_report_layout(df: DataFrame, section: str | None = None) -> DataFrame:
    """Project a section onto the D9 columns; unused cells are NULL."""
    cols = []
    for name in REPORT_COLUMNS:
        if name == "section" and section is not None:
            cols.append(F.lit(section).alias(name))
        elif name in df.columns:
            cols.append(F.col(name).cast(_TYPES[name]).alias(name))
        else:
            cols.append(F.lit(None).cast(_TYPES[name]).alias(name))
    return df.select(*cols)


def union_sections(*sections: DataFrame) -> DataFrame:
    """Concatenate D9-shaped sections."""
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def overall_report(runs: DataFrame) -> DataFrame:
    """Case comparison + model summary + winners in the D9 layout."""
    return union_sections(
        to_report_layout(case_comparison(runs), CASE_SECTION),
        model_and_winner_rows(model_summary(runs)),
    )


def section(report: DataFrame, name: str) -> DataFrame:
    """The rows of one section."""
    return report.filter(F.col("section") == name)


def winners_if_complete(report: DataFrame) -> DataFrame:
    """Winner rows only when both winner rows are present."""
    # At most two rows reach the window, so its single partition is bounded.
    winners = report.filter(F.col("section").isin(BEST_SECTION, FASTEST_SECTION))
    counted = winners.withColumn("_n", F.size(F.collect_set("section").over(Window.partitionBy())))
    return counted.filter(F.col("_n") == 2).drop("_n")


def merge_case_rows(base_cases: DataFrame, new_cases: DataFrame) -> DataFrame:
    """A new row replaces the base row of the same case_id."""
    kept = base_cases.join(new_cases.select("case_id"), "case_id", "left_anti")
    return new_cases.unionByName(kept.select(*new_cases.columns))


def merge_model_summaries(base_models: DataFrame, new_models: DataFrame) -> DataFrame:
    """Full outer join on model. Two-sided rows: run-weighted means,
    runs and completed summed, both totals 0 -> means 0.0. One-sided rows
    are kept as they are (T7: not idempotent - merging twice doubles runs).
    """
    b = base_models.select(
        "model",
        F.col("average_score").alias("b_score"),
        F.col("average_seconds").alias("b_seconds"),
        F.col("total_runs").alias("b_runs"),
        F.col("completed_runs").alias("b_done"),
    )
    n = new_models.select(
        "model",
        F.col("average_score").alias("n_score"),
        F.col("average_seconds").alias("n_seconds"),
        F.col("total_runs").alias("n_runs"),
        F.col("completed_runs").alias("n_done"),
    )
    j = b.join(n, "model", "full_outer")
    both = F.col("b_runs").isNotNull() & F.col("n_runs").isNotNull()
    total = F.col("b_runs") + F.col("n_runs")

    def weighted(bc: str, nc: str) -> Column:
        mean = (F.col(bc) * F.col("b_runs") + F.col(nc) * F.col("n_runs")) / total
        return F.when(both, F.when(total == 0, F.lit(0.0)).otherwise(mean)).otherwise(F.coalesce(F.col(nc), F.col(bc)))

    return j.select(
        "model",
        weighted("b_score", "n_score").alias("average_score"),
        weighted("b_seconds", "n_seconds").alias("average_seconds"),
        F.when(both, total).otherwise(F.coalesce(F.col("n_runs"), F.col("b_runs"))).cast("bigint").alias("total_runs"),
        F.when(both, F.col("b_done") + F.col("n_done"))
        .otherwise(F.coalesce(F.col("n_done"), F.col("b_done")))
        .cast("bigint")
        .alias("completed_runs"),
    )


def report_cases(report: DataFrame) -> DataFrame:
    """The case rows of a report (D9), without those that name no case."""
    named = section(report, CASE_SECTION).filter(F.col("case_id").isNotNull() & (F.col("case_id") != ""))
    return named.select(
        "case_id", "best_model", "best_score", "fastest_model", "fastest_seconds", "total_runs", "completed_runs"
    )


def report_models(report: DataFrame) -> DataFrame:
    """The model rows of a report (D9), without those that name no model."""
    named = section(report, MODEL_SECTION).filter(F.col("model").isNotNull() & (F.col("model") != ""))
    return named.select("model", "average_score", "average_seconds", "total_runs", "completed_runs")


def merge_overall(base_report: DataFrame | None, runs: DataFrame) -> DataFrame:
    """Merge fresh runs into an earlier overall report.

    Case rows: J6. Model rows: J5. Winners are recomputed from the merged
    model rows; full ties go to the first model in name order (the merged
    report lists models sorted by name). No base -> plain A7.
    """
    if base_report is None:
        return overall_report(runs)
    cases = merge_case_rows(report_cases(base_report), case_comparison(runs))
    models = merge_model_summaries(report_models(base_report), model_summary(runs).drop("first_run"))
    return union_sections(to_report_layout(cases, CASE_SECTION), model_and_winner_rows(models, order="model"))


def report_order(report: DataFrame) -> DataFrame:
    """Sections in report order, cases and models by name (sink only)."""
    pos = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("section"))
    return report.orderBy(pos, F.col("case_id").asc_nulls_first(), F.col("model").asc_nulls_first())
