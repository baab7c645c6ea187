"""Partition layout helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.session import checkpoint_dir


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, its lineage cut
    and its size known to the planner, which broadcasts it only if small. The
    folder is ``path`` or a new one below ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    path = path or os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, keep: Sequence[str], /, **columns: Column) -> DataFrame:
    """``keep`` and new ``columns``, which are worked out once for each row: Spark
    merges projections and moves filters into them, and would repeat them; it
    leaves what a generator gives as it is."""
    made = df.select(*keep, *[c.alias(name) for name, c in columns.items()])
    return made.select(*keep, F.inline(F.array(F.struct(*columns))))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that arrives in fewer partitions than the cluster
    has cores, before CPU-heavy per-row work (JSON parsing, scoring).

    A scan of many files already has enough splits and is left untouched, so
    at scale this adds no shuffle; a single unsplittable file (one row group)
    would otherwise run on one core.

    Call it on a scan (plus projections/filters) only: asking a plan that
    contains a shuffle for its partition count would run that shuffle.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def dense_index(df: DataFrame, order_col: str, out: str = "pos") -> DataFrame:
    """0-based dense position of every row in ``order_col`` order, computed
    without a single-partition window.

    Rows are range-partitioned and sorted, tagged with their partition and
    in-partition id, and checkpointed (to the shared ``spark.checkpoint.dir``)
    so the ids are fixed; per-partition row counts (one row per partition)
    give the offsets, which are joined back by partition id.
    """
    from pyspark.sql.window import Window

    checkpoint_dir(df.sparkSession)
    n = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    tagged = (
        df.repartitionByRange(n, order_col)
        .sortWithinPartitions(order_col)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    # monotonically_increasing_id = (partition << 33) + row number in partition
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset")
    )
    joined = tagged.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (F.col("_offset") + local).alias(out))
