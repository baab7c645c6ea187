"""Case discovery, pairing, the run matrix and expected outputs
(S7, F5, J1-J3, A14, M11, M14-M16).

A *file listing* is a DataFrame with a ``path`` column (from
``scorecraft.sources.files.list_files`` or any table of paths). Pairing is
two left equi-joins on the candidate output paths, so it scales with the
listing instead of probing the file system once per input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.functions import keys as K
from scorecraft.operators.layout import dense_index, written

# Reasons for skipped inputs and the ground-truth table layout.
UNSUPPORTED_REASON = "unsupported input format "
NO_OUTPUT_REASON = "matching *_output.csv file was not found"
GROUND_TRUTH_HEADERS = ["unit", "item", "num_type", "status_type", "value"]
SHEET_NAME = "Sheet1"
# Rows of the two sides that meet in one group of the run matrix.
MODELS_PER_BLOCK = 1_000
CASES_PER_BLOCK = 100_000


def input_files(listing: DataFrame) -> DataFrame:
    """Entries whose name matches ``*_input.*``, with the parts the
    pairing needs: ``dir, name, stem, suffix, ext`` (lower-cased suffix)."""
    name = K.path_name("path")
    files = listing.select("path", name.alias("name"))
    files = files.filter(F.col("name").rlike(r"^.*_input\..*$"))
    return files.select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        "name",
        K.path_stem("path").alias("stem"),
        K.path_suffix("path").alias("suffix"),
        F.lower(K.path_suffix("path")).alias("ext"),
    )


def pair_cases(
    listing: DataFrame, extensions: Sequence[str] = K.SUPPORTED_EXTENSIONS
) -> tuple[DataFrame, DataFrame]:
    """J2 + J3 + F5: ``(cases, skipped)``.

    cases: ``case_id, input_path, output_path``. The output is
    ``<prefix>_<ext>_output.csv`` when it exists, else ``<prefix>_output.csv``
    in the same folder (``prefix`` = stem without one trailing ``_input``).
    skipped: ``input_path, reason``; an unsupported format is reported
    before a missing output.
    """
    exts = [e.lower() for e in K.normalize_extensions(extensions)]
    inputs = input_files(listing)
    prefix = F.regexp_replace(F.col("stem"), r"_input$", "")
    ext_name = F.regexp_replace(F.col("ext"), r"^\.", "")
    # a path without a folder pairs with files that have none either
    base = F.when(F.col("path").contains("/"), F.concat(F.col("dir"), F.lit("/"), prefix)).otherwise(prefix)
    candidates = inputs.select(
        "path",
        "ext",
        "suffix",
        F.concat(base, F.lit("_"), ext_name, F.lit("_output.csv")).alias("_first"),
        F.concat(base, F.lit("_output.csv")).alias("_second"),
    )
    supported = F.col("ext").isin(*exts)
    # Paths pack so well that the planner takes a long listing for a small table and
    # would hold it whole in every task. So both joins sort (and spill), and paths
    # are dealt out before the tasks look for repeated ones.
    outputs = listing.select(F.col("path").alias("_out")).filter(F.col("_out").endswith("_output.csv")).repartition("_out").distinct()
    first = outputs.select(F.col("_out").alias("_first"), F.col("_out").alias("_hit1")).hint("merge")
    second = outputs.select(F.col("_out").alias("_second"), F.col("_out").alias("_hit2")).hint("merge")
    paired = (
        candidates.filter(supported)
        .join(first, "_first", "left")
        .join(second, "_second", "left")
        .select("path", F.coalesce("_hit1", "_hit2").alias("output_path"))
    )
    cases = paired.filter(F.col("output_path").isNotNull()).select(
        K.case_id("path").alias("case_id"), F.col("path").alias("input_path"), "output_path"
    )
    unsupported = candidates.filter(~supported).select(
        F.col("path").alias("input_path"),
        F.concat(F.lit(UNSUPPORTED_REASON), F.col("suffix")).alias("reason"),
    )
    unmatched = paired.filter(F.col("output_path").isNull()).select(
        F.col("path").alias("input_path"), F.lit(NO_OUTPUT_REASON).alias("reason")
    )
    return cases, unsupported.unionByName(unmatched)


def with_case_positions(cases: DataFrame, order_col: str = "input_path") -> DataFrame:
    """0-based dense position of each case in ``order_col`` order (see
    :func:`scorecraft.operators.layout.dense_index`)."""
    return dense_index(cases, order_col, "case_pos")


def run_matrix(
    models: DataFrame | Sequence[str],
    cases: DataFrame,
    order_col: str = "input_path",
    model_order: str = "model",
    models_per_block: int = MODELS_PER_BLOCK,
    cases_per_block: int = CASES_PER_BLOCK,
) -> DataFrame:
    """Every model x every case, model-major, 1-based ``run_index``
    ``= model_pos * n_cases + case_pos + 1``.

    ``models``: a DataFrame with ``model``, in the order of ``model_order``, or a
    list in its own order; repeated models count once. Both sides get dense
    positions. The models of a block are gathered in one row by a partial
    aggregate, and each pair of blocks is one key of an equi-join: no side is
    collected, no group grows with the data, and what is sent is cases x model
    blocks + models x case blocks (few models make one block, which Spark
    broadcasts by its size).
    """
    spark = cases.sparkSession
    if not isinstance(models, DataFrame):
        names = list(dict.fromkeys(models))
        models = spark.createDataFrame(list(enumerate(names)), "_nth long, model string")
        model_order = "_nth"
    first = models.groupBy("model").agg(F.min(model_order).alias("_order"))
    positioned = dense_index(first, "_order", "model_pos")
    blocks = written(
        positioned.groupBy(F.floor(F.col("model_pos") / models_per_block).cast("long").alias("_mb")).agg(
            F.collect_list(F.struct("model_pos", "model")).alias("_models")
        ),
        "model-blocks",
    )
    cased = with_case_positions(cases, order_col)
    n_cases, model_blocks = cased.count(), blocks.count()
    case_blocks = -(-n_cases // cases_per_block)
    if not model_blocks or not case_blocks:
        return cased.select("*", F.lit(0).cast("bigint").alias("model_pos"), F.lit("").alias("model"), F.lit(0).cast("bigint").alias("run_index")).limit(0)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = cased.withColumn("_cb", F.floor(F.col("case_pos") / cases_per_block).cast("long")).withColumn("_mb", each(model_blocks))
    right = blocks.withColumn("_cb", each(case_blocks))
    pairs = left.join(right, ["_mb", "_cb"]).select(*cased.columns, F.inline("_models"))
    return pairs.withColumn("run_index", F.col("model_pos") * F.lit(n_cases) + F.col("case_pos") + F.lit(1))


def expected_output(truth_rows: DataFrame, cases: DataFrame) -> DataFrame:
    """One expected-output object per case (D5) as JSON text.

    ``truth_rows``: ``case_id, row_pos`` + the five ground-truth columns;
    ``cases``: ``case_id, input_path``. The rows of one case form one
    document: they are gathered with ``collect_list`` (the size of one
    ground-truth table) and put in ``row_pos`` order (ties by the row's
    values) with ``sort_array``.
    """
    row = F.struct(*[F.col(c) for c in GROUND_TRUTH_HEADERS])
    grouped = truth_rows.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("row_pos"), row.alias("r")))).alias("_rows")
    )
    joined = cases.join(grouped, "case_id", "left")
    row_type = grouped.schema["_rows"].dataType.elementType["r"].dataType
    no_rows = F.array_compact(F.array(F.lit(None).cast(row_type)))
    rows = F.coalesce(F.transform(F.col("_rows"), lambda x: x["r"]), no_rows)
    doc = F.struct(
        F.struct(
            K.source_type(K.path_suffix("input_path")).alias("source_type"),
            K.path_name("input_path").alias("filename"),
        ).alias("document_info"),
        F.struct(
            F.lit(1).alias("total_sheets"),
            F.size(rows).alias("total_rows"),
            F.lit(len(GROUND_TRUTH_HEADERS)).alias("total_columns"),
        ).alias("summary"),
        F.array(
            F.struct(
                F.lit(SHEET_NAME).alias("table_name"),
                F.array(*[F.lit(h) for h in GROUND_TRUTH_HEADERS]).alias("headers"),
                rows.alias("rows"),
            )
        ).alias("content_data"),
    )
    return joined.select("case_id", F.size(rows).alias("total_rows"), F.to_json(doc).alias("expected_output"))
