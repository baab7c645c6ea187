"""Sharding by sampled splitters.

Every record has a place on a line: the 60-bit key is made of 30 bits of the
text's hash and 30 bits of the id's, so equal texts lie side by side and a
text with very many copies is still cut between them. A size-weighted sample
of keys gives quantile boundaries, records are range-partitioned by them, and
the exact byte totals of the ranges place every record on the line of
cumulated bytes. Shard borders fall at equal distances on that line; a range
that lies across one is divided record by record with its running sum. A range of
more than twice ``range_bytes`` is overfull and is subdivided first, by splitters
sampled from it over (key, id, place of the record), which part even records of
equal key and id.

Law: ``bytes``. A record of bytes [start, start + size) belongs to shard
floor((start + size / 2) * shards / total), so each border is at most half a
record away from its place.

Scale: the number of ranges follows the data (``range_bytes`` each) up to
``max_ranges``, which bounds the sampled keys that the driver sees
(``samples_per_range`` a range) and the splitters that are broadcast. Beyond it,
and where a key repeats, ranges are overfull and subdivided by Spark's own sampled
range partitioning, so that the running sums of one task stay bounded. The join
with the ranges' offsets is left to the optimizer; the shards' first positions (a
row for each of ``shards``) are broadcast.

Defined cases: null text has 0 bytes (size is the overhead alone) and CRC 0;
null ids are ordered first; records with equal key are ordered by id; repeated
rows are interchangeable and each has a slot of its own; texts of any length
count with all their bytes (in Spark, one text in memory at a time); an empty
table gives no rows; columns of the input are carried only when asked for, under their own
names, and internal names start with ``__``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecraft.llm.common import hash60, stage

SHARDS = 40
OVERHEAD = 16
RANGE_BYTES, MAX_RANGES = 64 << 20, 1 << 16


def placed(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    """The input with ``__size``, ``__crc`` and ``__key``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    high, low = F.shiftright(hash60(text), 30), F.shiftright(hash60(ident), 30)
    return docs.withColumns({
        "__size": (F.octet_length(text) + F.lit(overhead)).cast("long"),
        "__crc": F.crc32(text.cast("binary")),
        "__key": F.shiftleft(high, 30).bitwiseOR(low),
    })


def splitters(keyed: DataFrame, total: int, ranges: int, samples_per_range: int) -> np.ndarray:
    """Quantiles of a key sample in which a record counts by its size.

    A record enters when a hash of its key falls below its share of the
    sample; records above a whole share weigh more instead.
    """
    if ranges < 2:
        return np.empty(0, np.int64)
    step = max(total / (ranges * samples_per_range), 1.0)
    chance = F.pmod(F.xxhash64("__key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = keyed.filter(chance < F.col("__size") / F.lit(step)).select(
        "__key", F.greatest(F.col("__size") / F.lit(step), F.lit(1.0)).alias("w")
    ).toPandas()
    if sample.empty:
        return np.empty(0, np.int64)
    sample = sample.sort_values("__key", kind="stable")
    cum = sample["w"].to_numpy().cumsum()
    at = np.searchsorted(cum, cum[-1] * np.arange(1, ranges) / ranges)
    return np.unique(sample["__key"].to_numpy(np.int64)[np.minimum(at, len(cum) - 1)])


def subdivided(ranged: DataFrame, most: int) -> DataFrame:
    """``ranged`` with ``__sub``: 0, or in ranges of more than ``most`` bytes the
    number of the record's part, in the order of (key, id, place)."""
    sums = ranged.groupBy("__range").agg(F.sum("__size").alias("b"))
    over = stage(sums.filter(F.col("b") > most), "shard-overfull")
    size = over.agg(F.sum("b")).first()[0]
    if not size:
        return ranged.withColumn("__sub", F.lit(0))
    parts = min(math.ceil(2 * size / most), MAX_RANGES)
    dealt = ranged.join(over, "__range", "left_semi").repartitionByRange(parts, "__range", "__key", "__id", "__at")
    split = stage(dealt.withColumn("__sub", F.spark_partition_id()), "shard-parts")
    even = ranged.join(over, "__range", "left_anti").withColumn("__sub", F.lit(0))
    return even.unionByName(split)


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    overhead: int = OVERHEAD,
    range_bytes: int = RANGE_BYTES,
    ranges_per_shard: int = 8,
    samples_per_range: int = 16,
    max_ranges: int = MAX_RANGES,
) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` and the carried columns."""
    keep = [c for c in carry if c not in (id_col, "size", "text_crc32", "shard", "slot")]
    keyed = stage(
        placed(docs, id_col, text_col, overhead).select(
            F.col(id_col).alias("__id"), "__size", "__crc", "__key", F.monotonically_increasing_id().alias("__at"),
            *[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)],
        ),
        "shard-keys",
    )
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    ranges = min(max(shards * ranges_per_shard, math.ceil(total / range_bytes)), max_ranges)
    cuts = keyed.sparkSession.sparkContext.broadcast(splitters(keyed, total, ranges, samples_per_range))

    @F.pandas_udf("int")
    def range_of(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(np.searchsorted(cuts.value, k.to_numpy(np.int64), side="right").astype(np.int32))

    ranged = stage(keyed.withColumn("__range", range_of("__key")), "shard-ranges")
    pieces = subdivided(ranged, 2 * range_bytes)
    part = ["__range", "__sub"]
    sums = pieces.groupBy(*part).agg(F.sum("__size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *part,
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__b0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"),
    )
    inside = Window.partitionBy(*part).orderBy("__key", F.col("__id").asc_nulls_first(), "__at")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    # twice the middle of the record
    middle = 2 * (F.col("__b0") + F.col("__run")) - F.col("__size")
    shard = F.expr(f"(cast(__middle as decimal(20, 0)) * {shards}) div {max(2 * total, 1)}")
    lined = stage(
        pieces.withColumn("__run", F.sum("__size").over(running))
        .withColumn("__row", F.row_number().over(inside).cast("long"))
        .join(offsets, part)
        .withColumn("__middle", middle)
        .withColumn("__shard", F.least(shard, F.lit(shards - 1)).cast("int"))
        .withColumn("__pos", F.col("__n0") + F.col("__row"))
        .drop(*part, "__at", "__run", "__row", "__b0", "__n0", "__middle"),
        "shard-line",
    )
    first = lined.groupBy("__shard").agg(F.min("__pos").alias("__first"))
    return lined.join(F.broadcast(first), "__shard").select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        (F.col("__pos") - F.col("__first")).alias("slot"),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write all columns of ``docs`` as Parquet, one folder per shard, each
    file sorted by slot; large shards are split by the rebalancing."""
    placed_docs = assign_shards(docs, shards, carry=docs.columns, **options)
    placed_docs.hint("rebalance", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
