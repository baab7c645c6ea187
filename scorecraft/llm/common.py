"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.session import checkpoint_dir

#: Word separators of the corpus contracts: space and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, the
    rows are computed once, and any executor may be lost afterwards."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(value: Column) -> Column:
    """60 bits of an MD5 as a long: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python workers in batches of at most ``rows``: with
    the default of 10,000 a worker and its executor would hold some of long
    texts at once. Stays set, as plans read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:  # 0 and below mean no limit
        spark.conf.set(key, str(rows))


def file_backed(df: DataFrame) -> DataFrame:
    """``df`` itself if its rows have locators (a plain read of files), else a
    written copy of it that has."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return df
    except AnalysisException:
        return stage(df, "rows")


def row_hash() -> Column:
    """A hash of a file-backed row's locator, whatever the row holds."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def located(df: DataFrame) -> DataFrame:
    """A file-backed ``df`` with ``__file`` and ``__row``, which name a row."""
    return df.select(
        *df.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )


def write_shared(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file where all executors can read it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads neighbouring values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
