"""Category accuracy over evaluation rows.

Each evaluation row is parsed and scored exactly once (the reference
re-parses per grouping). The per-row flags are pre-aggregated by
``(category, model, source)`` - a map-side partial aggregation whose
shuffle carries one small row per key and task - and the report scopes
(overall / category / model / source) are grouping sets over that small
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.functions import jsonops as J
from scorecraft.functions import keys as K

COMPLETED = "completed"
OVERALL_PREFIX = "overall_"
SUMMARY_COLUMNS = [
    "total_evaluations",
    "ground_truth_count",
    "exact_match_count",
    "partial_score_sum",
    "error_count",
    "exact_accuracy_percent",
    "partial_accuracy_percent",
]


def completed_only(reports: DataFrame, status: str = "status") -> DataFrame:
    """status = completed; blank outputs stay (they count as parse errors)."""
    return reports.filter(F.col(status) == COMPLETED)


def source_model_filter(reports: DataFrame, source: str = "", model: str = "") -> DataFrame:
    """exact match on the stripped filters; blank filter = no filter.
    Rows of ``overall_*`` files (by their ``case_key``) are no run reports.

    On a store partitioned by ``model``/``source`` this prunes partitions.
    """
    out = reports
    if "case_key" in out.columns:
        out = out.filter(~F.col("case_key").startswith(OVERALL_PREFIX))
    if source.strip():
        out = out.filter(F.col("source") == source.strip())
    if model.strip():
        out = out.filter(F.col("model") == model.strip())
    return out


def reports_with_truth(reports: DataFrame, truths: DataFrame, keys: tuple[str, ...] = ("model", "source", "case_id")) -> DataFrame:
    """Attach the per-report ground truth and its category.

    ``truths`` holds one row per report key with the ``ground_truth`` text
    (T14: row 0 of the runtime dataset). Reports without a truth are dropped
    (inner join). The truth side is canonicalised and categorised before the
    join, so each distinct truth is parsed once, not once per report row.
    The join is a plain equi-join: AQE broadcasts the truth side when it is
    small and keeps a sort-merge join (with skew splitting) when it is not.
    """
    prepared = truths.select(
        *keys,
        J.empty_if_null(J.canonical_object("ground_truth")).alias("_truth_map"),
        K.category_from_truth(F.col("ground_truth")).alias("category"),
    )
    return reports.join(prepared, list(keys), "inner")


def score_rows(
    evaluations: DataFrame,
    category: Column | str | None = None,
    truth_map: str | None = None,
) -> DataFrame:
    """Per-row flags: ``has_truth, exact, partial, strict_score, parse_error``
    (M2-M5, M7, M8).

    ``category``: a Column, ``"from_truth"`` for M9 on the parsed truth, or
    None for M8 on the ``category`` column. ``truth_map`` names a column
    that already holds the canonical truth map (J4 prepares it once per
    truth); otherwise the ``ground_truth`` text is parsed here (non-objects
    -> ``{}``). Each text is parsed once.
    """
    df = evaluations
    if truth_map is None:
        df = J.with_canonical_object(df, "ground_truth", "_truth_raw", keep_object="_truth_obj")
        df = df.withColumn("_truth", J.empty_if_null(F.col("_truth_raw"))).drop("_truth_raw")
    else:
        df = df.withColumn("_truth", J.empty_if_null(F.col(truth_map)))
    if isinstance(category, str) and category == "from_truth":
        if truth_map is not None:
            raise ValueError("category='from_truth' needs the ground_truth text")
        df = K.with_category(df, "_truth_obj", "_category")
    else:
        df = df.withColumn("_category", K.normalize_category("category") if category is None else category)
    df = J.with_canonical_object(df, "llm_output", "_pred")
    df = J.with_match_counts(df, "_pred", "_truth")
    n_pred, n_truth, matches = F.col("_n_pred"), F.col("_n_truth"), F.col("_matches")
    has_truth = n_truth > 0
    keep = [c for c in evaluations.columns if c not in ("category", truth_map)]
    return df.select(
        *keep,
        F.col("_category").alias("category"),
        has_truth.alias("has_truth"),
        (has_truth & J.exact_from_counts(n_pred, n_truth, matches)).alias("exact"),
        J.partial_from_counts(n_truth, matches).alias("partial"),
        J.strict_from_counts(n_pred, n_truth, matches).alias("strict_score"),
        F.col("_pred").isNull().alias("parse_error"),
    )


def _partial_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_evaluations"),
        F.count_if(F.col("has_truth")).alias("ground_truth_count"),
        F.count_if(F.col("exact")).alias("exact_match_count"),
        F.sum("partial").alias("partial_score_sum"),
        F.count_if(F.col("parse_error")).alias("error_count"),
    ]


def _merge_aggs() -> list[Column]:
    return [
        F.sum("total_evaluations").alias("total_evaluations"),
        F.sum("ground_truth_count").alias("ground_truth_count"),
        F.sum("exact_match_count").alias("exact_match_count"),
        F.sum("partial_score_sum").alias("partial_score_sum"),
        F.sum("error_count").alias("error_count"),
    ]


def finalize_percentages(df: DataFrame) -> DataFrame:
    """Count / n * 100 and partial_sum / n * 100; n = 0 -> 0.0."""
    n = F.col("ground_truth_count")
    return df.withColumns(
        {
            "exact_accuracy_percent": F.when(n > 0, F.col("exact_match_count") / n * 100.0).otherwise(F.lit(0.0)),
            "partial_accuracy_percent": F.when(n > 0, F.col("partial_score_sum") / n * 100.0).otherwise(F.lit(0.0)),
        }
    )


def accuracy_by(scored: DataFrame, field: str) -> DataFrame:
    """The summary for one grouping field (``name`` = the field value)."""
    agg = scored.groupBy(F.col(field).cast("string").alias("name")).agg(*_partial_aggs())
    return finalize_percentages(agg).select(F.lit(field).alias("scope"), "name", *SUMMARY_COLUMNS)


def category_accuracy(evaluations: DataFrame, **score_kwargs) -> DataFrame:
    """A10 + A12 + A13: rows ``scope in (overall, category)``.

    ``overall`` has ``name = 'overall'``; error_count counts every row,
    the other counters only rows with a non-empty truth.
    """
    return accuracy_scopes(evaluations, scopes=("category",), **score_kwargs)


_SCOPE_FIELDS = ("category", "model", "source")


def accuracy_scopes(
    evaluations: DataFrame,
    scopes: tuple[str, ...] = _SCOPE_FIELDS,
    scored: DataFrame | None = None,
    **score_kwargs,
) -> DataFrame:
    """Overall plus one block per field in ``scopes``.

    Two-level aggregation: rows -> (category, model, source) partials ->
    ``GROUPING SETS ((), (category), (model), (source))``. The scope comes
    from ``grouping_id()`` (T6), never from NULL keys.
    """
    if scored is None:
        scored = score_rows(evaluations, **score_kwargs)
    present = [f for f in _SCOPE_FIELDS if f in scored.columns]
    keys = [F.col(f).cast("string").alias(f) for f in present]
    partial = scored.groupBy(*keys).agg(*_partial_aggs())
    sets = [[]] + [[f] for f in scopes]
    grouped = partial.groupingSets(sets, *present).agg(
        *_merge_aggs(), F.grouping_id(*present).alias("_gid")
    )
    n = len(present)
    scope_expr = F.when(F.col("_gid") == (1 << n) - 1, F.lit("overall"))
    name_expr = F.when(F.col("_gid") == (1 << n) - 1, F.lit("overall"))
    for i, f in enumerate(present):
        gid = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        scope_expr = scope_expr.when(F.col("_gid") == gid, F.lit(f))
        name_expr = name_expr.when(F.col("_gid") == gid, F.col(f))
    out = grouped.select(scope_expr.alias("scope"), name_expr.alias("name"), *_merge_aggs_names())
    return finalize_percentages(out).select("scope", "name", *SUMMARY_COLUMNS)


def _merge_aggs_names() -> list[str]:
    return ["total_evaluations", "ground_truth_count", "exact_match_count", "partial_score_sum", "error_count"]


def stored_evaluations(
    spark: SparkSession, store: str, truths: DataFrame, source: str = "", model: str = ""
) -> DataFrame:
    """F4 + F2 + J4 over the report store (K1): completed rows of one source and
    model (blank: all) with the truth of their run's runtime dataset (T14).

    ``store`` is partitioned by model and source: a filter reads those folders
    only, and where the truths name few sources the join prunes by them too.
    ``truths``: ``case_key`` (``<model>__<source>__<case>``), ``ground_truth``."""
    reports = completed_only(source_model_filter(spark.read.parquet(store), source, model))
    keyed = reports.withColumn("case_key", F.concat_ws("__", *[K.safe_segment(c) for c in ("model", "source", "case_id")]))
    of_model = F.col("case_key").startswith(F.concat(K.safe_segment(F.lit(model.strip())), F.lit("__")))
    return reports_with_truth(keyed, truths.filter(of_model) if model.strip() else truths, keys=("case_key",))


def stored_accuracy(spark: SparkSession, store: str, truths: DataFrame, source: str = "", model: str = "") -> DataFrame:
    """A10-A13 over :func:`stored_evaluations`."""
    rows = stored_evaluations(spark, store, truths, source, model)
    return accuracy_scopes(None, scored=score_rows(rows, truth_map="_truth_map"))


def category_report_json(summary: DataFrame) -> DataFrame:
    """K3 payload: one row with the nested ``{overall, by_category, by_model,
    by_source}`` JSON text. ``summary`` is the small output of
    :func:`accuracy_scopes` (one row per scope value)."""
    value = F.struct(*[F.col(c) for c in SUMMARY_COLUMNS if c != "total_evaluations"])
    entries = summary.select("scope", F.struct(F.col("name"), value).alias("entry"))
    per_scope = entries.groupBy("scope").agg(F.map_from_entries(F.collect_list("entry")).alias("m"))
    keyed = per_scope.select(
        F.when(F.col("scope") == "overall", F.lit("overall"))
        .otherwise(F.concat(F.lit("by_"), F.col("scope")))
        .alias("k"),
        F.when(F.col("scope") == "overall", F.to_json(F.col("m")["overall"])).otherwise(F.to_json("m")).alias("v"),
    )
    return keyed.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("k", F.parse_json("v"))))).alias("report_json")
    )
