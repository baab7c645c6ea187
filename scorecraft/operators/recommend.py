"""Recommendations for low-accuracy categories.

Inputs are category-level aggregates (one row per category), so every
table here is small; the operators still stay DataFrame-in/DataFrame-out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from scorecraft.functions import keys as K

# Threshold, states and message texts.
DEFAULT_THRESHOLD = 0.70
STATE_NO_DATA = "no_data"
STATE_MAX = "max_performance"
STATE_NONE_LOW = "none_low"
STATE_RANKED = "ranked"
ANALYSIS_UNAVAILABLE_MESSAGE = (
    "Default recommendation digunakan karena analisis tidak tersedia (gagal/timeout)."
)
DEFAULT_TEMPLATE = (
    "Fokus validasi field inti pada kategori ini dan tambah sampel latihan; "
    "skor saat ini %.2f (gap %.2f dari target)."
)


def category_scores(summary: DataFrame) -> DataFrame:
    """``(category, score)`` in 0..1 from the by-category rows of the
    accuracy summary (exact percent / 100, clamped; non-numeric skipped)."""
    rows = summary.filter(F.col("scope") == "category")
    scored = rows.select(
        F.col("name").cast("string").alias("category"),
        K.percent_to_unit(F.col("exact_accuracy_percent")).alias("score"),
    )
    return scored.filter(F.col("score").isNotNull())


def recommendation_state(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row with the first matching state: no scores -> no data;
    all >= 1.0 -> max performance; none below threshold -> none low; else
    ranked. Also returns the counts behind it."""
    agg = scores.agg(
        F.count(F.lit(1)).alias("categories"),
        F.count_if(F.col("score") < F.lit(1.0)).alias("below_max"),
        F.count_if(F.col("score") < F.lit(float(threshold))).alias("below_threshold"),
    )
    state = (
        F.when(F.col("categories") == 0, F.lit(STATE_NO_DATA))
        .when(F.col("below_max") == 0, F.lit(STATE_MAX))
        .when(F.col("below_threshold") == 0, F.lit(STATE_NONE_LOW))
        .otherwise(F.lit(STATE_RANKED))
    )
    return agg.select(state.alias("state"), "categories", "below_threshold")


def rank_low_categories(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """R2 + X2: categories strictly below the threshold with ``gap =
    max(0, threshold - score)`` and ``position`` (score asc, name asc).

    Only rows already below the threshold reach the ranking window; the
    input is one row per category.
    """
    t = F.lit(float(threshold))
    low = scores.filter(F.col("score") < t).select(
        "category", "score", F.greatest(F.lit(0.0), t - F.col("score")).alias("gap")
    )
    order = Window.orderBy(F.col("score").asc(), F.col("category").asc())
    return low.withColumn("position", F.row_number().over(order))


def default_recommendation(ranked: DataFrame) -> DataFrame:
    """X2 text: ``- <category>: <advice with score and gap, 2 decimals>``.

    Formatting is presentation only (T5: Spark rounds half-up, Python
    half-even on the binary value); keep ``score``/``gap`` for comparisons.
    """
    text = F.format_string(DEFAULT_TEMPLATE, F.col("score"), F.col("gap"))
    return ranked.withColumn("line", F.concat(F.lit("- "), F.col("category"), F.lit(": "), text))


def analyzed_recommendations(
    ranked: DataFrame, analyzer: Callable[[str, float], str]
) -> DataFrame:
    """A user analyzer per category (pandas UDF over Arrow batches).

    Any failure replaces *all* lines by one fallback message: the per-row
    error flags are OR-ed with one aggregate, then the fallback row or the
    analyzed lines are kept.
    """

    def run(pdf_iter):
        for pdf in pdf_iter:
            texts, errors = [], []
            for cat, score in zip(pdf["category"], pdf["score"]):
                try:
                    texts.append(f"- {cat}: {analyzer(cat, float(score))}")
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - any analyzer failure
                    texts.append(None)
                    errors.append(type(exc).__name__)
            yield pdf.assign(line=texts, error=errors)

    schema = StructType(
        list(ranked.schema.fields) + [StructField("line", StringType()), StructField("error", StringType())]
    )
    analyzed = ranked.mapInPandas(run, schema)
    # One row per low category reaches this window (a small, bounded set).
    flagged = analyzed.withColumn(
        "_failed", F.max(F.col("error").isNotNull().cast("int")).over(Window.partitionBy()) == 1
    )
    # both outcomes come from one branch, so the analyzer runs once per category
    unless = lambda c: F.when(~F.col("_failed"), F.col(c)).alias(c)
    line = F.when(F.col("_failed"), F.lit(ANALYSIS_UNAVAILABLE_MESSAGE)).otherwise(F.col("line")).alias("line")
    return flagged.filter(~F.col("_failed") | (F.col("position") == 1)).select(
        unless("category"), unless("score"), unless("gap"), "position", line
    )
