"""Reshape and document-contract checks stated in the extraction instruction
(N1, N2). These are table work the reference asks the model to do; here they
are plain DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions import jsonops as J

# Long-format columns and the allowed source types.
LONG_COLUMNS = ["unit", "item", "num_type", "status_type", "value"]
SOURCE_TYPES = ("Excel", "PDF")
RULES = (
    "top_keys",
    "source_type",
    "filename",
    "summary_scalars",
    "content_empty",
    "table_names_unique",
    "headers_unique",
    "row_keys",
)


def to_long(
    df: DataFrame,
    unit_cols: Sequence[str],
    item: Column | str,
    num_type: Column | str,
    status_type: Column | str,
) -> DataFrame:
    """Unpivot the category columns to ``unit``/``value`` rows and drop
    zero or NULL values. Output ``unit, item, num_type, status_type, value``."""

    def c(x):
        return F.col(x) if isinstance(x, str) else x

    base = df.select(
        c(item).alias("item"),
        c(num_type).alias("num_type"),
        c(status_type).alias("status_type"),
        *[F.col(u).cast("bigint").alias(u) for u in unit_cols],
    )
    long = base.unpivot(["item", "num_type", "status_type"], list(unit_cols), "unit", "value")
    return long.filter(F.col("value").isNotNull() & (F.col("value") != 0)).select(*LONG_COLUMNS)


def document_violations(docs: DataFrame, doc_col: str = "doc", id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row ``(id..., rule)`` per broken rule of an expected-output
    document (D5): exactly 3 top keys; source_type Excel/PDF; non-empty
    filename; scalar summary values; non-empty content_data with unique table
    names; at least one header, all unique and non-empty; every row's keys
    equal the headers and its values are scalars. A text that is not exactly
    one JSON object (trailing text included) breaks ``top_keys``.
    """
    staged = docs.select(*id_cols, J.parsed_object(doc_col).alias("_top"))
    info = F.try_variant_get(F.try_element_at(F.col("_top"), F.lit("document_info")), "$", "map<string,variant>")
    summary = F.try_variant_get(F.try_element_at(F.col("_top"), F.lit("summary")), "$", "map<string,variant>")
    tables = F.try_variant_get(F.try_element_at(F.col("_top"), F.lit("content_data")), "$", "array<variant>")
    staged = staged.select(*id_cols, "_top", info.alias("_info"), summary.alias("_summary"), tables.alias("_tables"))

    def text_of(m: Column, key: str) -> Column:
        return F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", "string")

    names = F.transform("_tables", lambda t: F.try_variant_get(t, "$.table_name", "string"))
    headers = F.transform("_tables", lambda t: F.try_variant_get(t, "$.headers", "array<string>"))
    rows = F.transform("_tables", lambda t: F.try_variant_get(t, "$.rows", "array<map<string,variant>>"))
    staged = staged.select("*", names.alias("_names"), headers.alias("_headers"), rows.alias("_rows"))

    def nested(v: Column) -> Column:
        return F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY")

    def bad_headers(h: Column) -> Column:
        return (
            h.isNull()
            | (F.size(h) == 0)
            | (F.size(F.array_distinct(h)) != F.size(h))
            | F.exists(h, lambda x: x.isNull() | (F.trim(x) == ""))
        )

    row_keys_bad = F.exists(
        F.arrays_zip(F.transform("_headers", lambda h: F.array_sort(F.array_distinct(h))).alias("h"), F.col("_rows").alias("r")),
        lambda z: z["r"].isNull()
        | F.exists(
            z["r"],
            lambda row: (F.array_sort(F.map_keys(row)) != z["h"]) | F.exists(F.map_values(row), nested),
        ),
    )
    checks = [
        ("top_keys", F.col("_top").isNull() | (F.size("_top") != 3)),
        ("source_type", ~F.coalesce(text_of(F.col("_info"), "source_type").isin(*SOURCE_TYPES), F.lit(False))),
        ("filename", F.coalesce(F.trim(text_of(F.col("_info"), "filename")), F.lit("")) == ""),
        (
            "summary_scalars",
            F.col("_summary").isNull()
            | F.exists(F.map_values("_summary"), nested),
        ),
        ("content_empty", F.coalesce(F.size("_tables"), F.lit(0)) <= 0),
        (
            "table_names_unique",
            F.coalesce(F.size(F.array_distinct("_names")) != F.size("_names"), F.lit(False))
            | F.coalesce(F.exists("_names", lambda n: n.isNull() | (F.trim(n) == "")), F.lit(False)),
        ),
        ("headers_unique", F.coalesce(F.exists("_headers", bad_headers), F.lit(False))),
        ("row_keys", F.coalesce(row_keys_bad, F.lit(False))),
    ]
    flagged = staged.select(
        *id_cols,
        F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in checks])).alias("_bad"),
    )
    return flagged.select(*id_cols, F.explode("_bad").alias("rule"))
