"""File sources for evaluation artifacts.

All readers are lazy DataFrame scans. Text formats keep ``multiLine`` CSV
(JSON cells hold quotes and newlines, T11), which makes one file one task;
the native store for large volumes is Parquet (see ``sinks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scorecraft.functions import jsonops as J
from scorecraft.functions import keys as K
from scorecraft.sources.named_files import read_whole_files

# Column layouts of the text artifacts.
REPORT_FIELDS = ["row_index", "status", "score", "llm_output", "error_message"]
OVERALL_FIELDS = [
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
BOM = "﻿"


def _text_schema(fields: Sequence[str]) -> StructType:
    return StructType([StructField(f, StringType(), True) for f in fields])


def _csv(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.schema(_text_schema(fields))
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("pathGlobFilter", "*.csv")
        .csv(paths)
    )


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """S7 listing: one row per file (``path``); file contents are never read
    (the ``content`` column is pruned from the ``binaryFile`` scan)."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = reader.load(paths).select("path")
    return df.select(F.regexp_replace("path", "^file:", "").alias("path"))


def read_run_reports(
    spark: SparkSession,
    path: str | Sequence[str],
    sources: Sequence[str] | None = None,
    model: str = "",
) -> DataFrame:
    """S1 + M10 + F3/F4: every ``<model>__<source>[__...].csv`` run report.

    Adds ``model``, ``source``, ``case_key`` (file stem) from the file name;
    names with fewer than two ``__`` parts are skipped (``overall_*`` files by
    the category report's own filter, F4). ``row_index`` blank/missing -> 0,
    otherwise a strict integer; ``score`` is strictly numeric (a bad or blank
    value fails the job, T15).
    ``sources`` / ``model`` filter on file-name columns, which Spark uses to
    skip whole files.
    """
    raw = _csv(spark, path, REPORT_FIELDS).select("*", F.col("_metadata.file_name").alias("_file"))
    stem = F.regexp_replace(F.col("_file"), r"\.csv$", "")
    m, s = K.report_key_parts(stem)
    df = raw.select(
        "*", stem.alias("case_key"), m.alias("model"), s.alias("source")
    ).filter(F.col("model").isNotNull())
    if sources:
        df = df.filter(F.col("source").isin(*sources))
    if model.strip():
        df = df.filter(F.col("model") == model.strip())
    row_index = F.when(K.is_blank("row_index"), F.lit(0)).otherwise(K.py_strip("row_index").cast("int"))
    blank = F.raise_error(F.concat(F.lit("blank score in "), F.col("_file"))).cast("double")
    score = F.when(K.is_blank("score"), blank).otherwise(K.py_strip("score").cast("double"))
    return df.select(
        "model",
        "source",
        "case_key",
        row_index.alias("row_index"),
        "status",
        score.alias("score"),
        F.coalesce(F.col("llm_output"), F.lit("")).alias("llm_output"),
        F.coalesce(F.col("error_message"), F.lit("")).alias("error_message"),
    )


def read_ground_truths(spark: SparkSession, path: str | Sequence[str], source: str = "", model: str = "") -> DataFrame:
    """Per runtime dataset file, ``rows[0].expected_output`` when every
    level has the right type, else ``{}``; an unreadable file gives ``{}``.
    Columns: ``case_key`` (file stem), ``ground_truth`` (JSON text).

    ``model`` / ``source``: only files of this name, ``<model>__<source>__<case>``,
    are listed and read (F4); blank: any."""
    paths = [path] if isinstance(path, str) else list(path)
    parts = [K.safe_name(part) if part.strip() else "*" for part in (model.strip(), source.strip())]
    glob = "__".join([*parts, "*.json"]) if parts != ["*", "*"] else "*.json"
    raw = read_whole_files(spark, paths, glob)
    stem = F.regexp_replace(F.col("file"), r"\.json$", "")
    text = F.regexp_replace(F.col("value"), "^" + BOM, "")
    staged = raw.select(stem.alias("case_key"), text.alias("_text"))
    parsed = J.parsed_object(F.col("_text"))
    rows = F.try_variant_get(F.try_element_at(parsed, F.lit("rows")), "$", "array<variant>")
    first = F.try_variant_get(F.try_element_at(rows, F.lit(1)), "$", "map<string,variant>")
    expected = F.try_element_at(first, F.lit("expected_output"))
    is_obj = F.try_variant_get(expected, "$", "map<string,variant>").isNotNull()
    return staged.select(
        "case_key", F.when(is_obj, F.to_json(expected)).otherwise(F.lit("{}")).alias("ground_truth")
    )


def read_ground_truth_rows(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Ground-truth CSV rows, keys and values stripped, ``value`` a
    strict integer (ANSI cast raises on bad text). Adds ``case_key`` (file
    stem) and ``row_pos`` (1-based line order within the file)."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("pathGlobFilter", "*.csv").csv(paths)
    )
    cols = {c.strip(): K.py_strip(F.col(f"`{c}`")) for c in raw.columns}
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    staged = raw.select(
        stem.alias("case_key"),
        F.monotonically_increasing_id().alias("_mid"),
        *[v.alias(k) for k, v in cols.items()],
    )
    from pyspark.sql.window import Window

    # One multiLine CSV file is read by one task, so this window's
    # partitions are single files.
    pos = F.row_number().over(Window.partitionBy("case_key").orderBy("_mid"))
    return staged.select("case_key", pos.alias("row_pos"), *[F.col(k) for k in cols]).withColumn(
        "value", F.col("value").cast("bigint")
    )


def read_overall_report(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A previous overall report (D9); blank cells -> NULL, numbers typed."""
    raw = _csv(spark, path, OVERALL_FIELDS)
    typed = {
        "best_score": "double",
        "fastest_seconds": "double",
        "average_score": "double",
        "average_seconds": "double",
        "total_runs": "bigint",
        "completed_runs": "bigint",
    }
    cols = []
    for f in OVERALL_FIELDS:
        c = F.when(K.is_blank(f), F.lit(None)).otherwise(F.col(f))
        cols.append((c.cast(typed[f]) if f in typed else c).alias(f))
    return raw.select(*cols)


def read_text_documents(
    spark: SparkSession, path: str | Sequence[str], glob: str = "{*.[cC][sS][vV],*.[tT][xX][tT]}"
) -> DataFrame:
    """Every ``.csv``/``.txt`` file (of names that match ``glob``) as one
    UTF-8 text (BOM stripped)."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace("value", "^" + BOM, "").alias("text"),
    )
