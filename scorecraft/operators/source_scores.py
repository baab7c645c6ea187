"""Per-source score columns next to the model summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions import keys as K
from scorecraft.operators.compare import FASTEST_SECTION

COMPLETED = "completed"
# Fixed value: the default source filter.
DEFAULT_SOURCES = ("synthetic_examples",)


def completed_with_output(reports: DataFrame) -> DataFrame:
    """status completed and a non-blank output (unlike F2)."""
    return reports.filter((F.col("status") == COMPLETED) & ~K.is_blank("llm_output"))


def sources_in(reports: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """keep the given sources (empty/None -> the default set). On a
    store partitioned by ``source`` the filter prunes whole folders."""
    chosen = tuple(sources) if sources else DEFAULT_SOURCES
    return reports.filter(F.col("source").isin(*chosen))


def has_model(reports: DataFrame) -> DataFrame:
    """rows with a blank model are ignored."""
    return reports.filter(~K.is_blank("model"))


def source_scores(reports: DataFrame, source: str, column: str = "source_score") -> DataFrame:
    """Mean score per model over the F1 rows of one source.

    ``score`` is cast strictly (ANSI): a non-numeric score fails the job,
    as the reference raises (T15).
    """
    rows = has_model(completed_with_output(sources_in(reports, [source])))
    return rows.groupBy("model").agg(F.avg(F.col("score").cast("double")).alias(column))


def add_source_score(model_summary: DataFrame, reports: DataFrame, source: str) -> DataFrame:
    """Add a column named after ``source`` with the model's mean score
    there (NULL = no data); an existing column of that name is replaced.

    The right side has one row per model; the left join keeps every model.
    """
    scores = source_scores(reports, source, column="_src_score")
    base = model_summary.drop(source) if source in model_summary.columns else model_summary
    return base.join(scores, "model", "left").withColumnRenamed("_src_score", source)


def add_source_scores(model_summary: DataFrame, reports: DataFrame, sources: Sequence[str]) -> DataFrame:
    """J7 for several sources at once: one pivot with the source list given
    up front (no extra job to discover the values)."""
    sources = list(dict.fromkeys(sources))
    rows = has_model(completed_with_output(sources_in(reports, sources)))
    pivoted = rows.groupBy("model").pivot("source", sources).agg(F.avg(F.col("score").cast("double")))
    return join_source_columns(model_summary, pivoted)


def join_source_columns(base: DataFrame, scores: DataFrame) -> DataFrame:
    """J7 join: ``scores`` (``model`` + one column per source, one row per
    model) added to ``base``; same-named columns of ``base`` are replaced."""
    cols = [c for c in scores.columns if c != "model"]
    return base.drop(*[c for c in cols if c in base.columns]).join(scores, "model", "left")


def blank_fastest_row(winners: DataFrame, source: str) -> DataFrame:
    """The fastest-runtime winner row keeps no source score."""
    return winners.withColumn(
        source, F.when(F.col("section") == FASTEST_SECTION, F.lit(None).cast("double")).otherwise(F.col(source))
    )


def add_source_score_to_winners(winners: DataFrame, reports: DataFrame, source: str) -> DataFrame:
    """Like J7 for the winner rows, but the fastest-runtime row stays
    NULL."""
    return blank_fastest_row(add_source_score(winners, reports, source), source)


# --- the same columns from per-run sums (score each report row once) ---------


def f1_run_aggs(score: str = "score") -> list:
    """Aggregates to add to a per-run ``groupBy`` of report rows: the sum
    and count of the F1 rows (completed, non-blank output) of the run."""
    keep = (F.col("status") == COMPLETED) & ~K.is_blank("llm_output")
    return [
        F.sum(F.when(keep, F.col(score).cast("double"))).alias("_f1_sum"),
        F.count_if(keep).alias("_f1_n"),
    ]


def source_mean_aggs(sources: Sequence[str]) -> list:
    """A9 for several sources as aggregates over per-run F1 sums (runs keyed
    by model and source), for a ``groupBy("model")`` of the runs: one column
    per source, the mean over all F1 rows of that model and source (NULL =
    no such row; F6: none for a blank model). Sums of sums, so this equals
    the row-level mean, and it shares the aggregate of the model summary."""

    def mean(s: str):
        here = (F.col("source") == s) & ~K.is_blank("model")
        return F.try_divide(F.sum(F.when(here, F.col("_f1_sum"))), F.sum(F.when(here, F.col("_f1_n"))))

    return [mean(s).alias(s) for s in dict.fromkeys(sources)]
