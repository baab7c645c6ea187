"""Mixing sources to target weights by hash-threshold histograms.

Each source's token target follows its weight, up to ``max_repeat`` times what
the source holds; what is cut off is shared out again among the others. A
document is repeated floor(target / source size) times, and once more when its
hash lies below the source's threshold. The threshold is found without a sort:
tokens are summed by source and hash bucket, the running sum over the buckets
names the one that the budget falls into, and only that bucket is split
further, ``levels`` times. Thresholds are nested: a larger budget takes every
document that a smaller one takes, and reruns agree, as the hash is of the id
and text alone.

Scale: every step is a partial aggregate; a hot source is one group of at most
2**bits rows after it. The first level sums all cells of all sources without a
join, the next ones join by (source, bucket prefix), and the thresholds (a row per
source) join back by (source, salt), so that a hot source is dealt over SALTS
keys even where there are too many sources to broadcast. The targets are found
in one task over a row per source.

Defined cases: a null text has no words, one of any length is counted whole (in
Spark, one text in memory at a time); a null source is a source of its own,
sorted last; a null id is hashed as empty; rows with equal id and text share
their fate (repeated rows are taken together); documents without words are
repeated like others and take nothing; an empty table gives no rows. Extra
columns stay, whatever their names (see ``mix``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecraft.llm.common import hash60, stage, word_count

HASH_BITS = 60
#: Keys that a source's rows are dealt over in the join with the thresholds.
SALTS = 64


def source_targets(sized: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """One row per source key: ``__skey, __ssize, __target``.

    The common level L with sum(min(weight * L, max_repeat * size)) = total is
    found over the sources in the order in which they reach their limit.
    """
    sums = sized.groupBy("__skey", "__source").agg(F.sum("__size").alias("__ssize"))
    turn = (F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1) % len(weights)
    weighed = sums.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long"))
    limit = F.col("__ssize") * F.lit(max_repeat)
    order = Window.orderBy((limit / F.col("w")).asc(), F.col("__skey"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    on = order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = (
        weighed.withColumn("limit", limit)
        .withColumn("total", F.sum("__ssize").over(whole))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("wrest", F.sum("w").over(on))
        # the first source that stays below its limit fixes the level for all after it
        .withColumn("open", F.col("rest") * F.col("w") <= F.col("limit") * F.col("wrest"))
    )
    level = F.first(F.when(F.col("open"), F.struct("rest", "wrest")), ignorenulls=True).over(whole)
    return steps.withColumn("level", level).select(
        "__skey",
        "__ssize",
        F.when(
            F.col("level").isNotNull() & (F.col("limit") * F.col("level.wrest") >= F.col("w") * F.col("level.rest")),
            (F.col("w") * F.col("level.rest")).cast("double") / F.col("level.wrest").cast("double"),
        ).otherwise(F.col("limit").cast("double")).alias("__target"),
    )


def thresholds(sized: DataFrame, targets: DataFrame, bits: int, levels: int) -> DataFrame:
    """``__skey, __ssize, __target, __whole, __cut``: whole repeats, and the
    hash prefix below which a document is taken once more."""
    whole = F.when(F.col("__ssize") > 0, F.floor(F.col("__target") / F.col("__ssize"))).otherwise(F.lit(0)).cast("long")
    plans = targets.withColumn("__whole", whole).withColumn(
        "__extra", F.col("__target") - F.col("__whole") * F.col("__ssize")
    )
    bounds = plans.select("__skey", "__extra", F.lit(0).cast("long").alias("__prefix"), F.lit(0).cast("long").alias("__base"))
    for level in range(levels):
        above, here = HASH_BITS - bits * level, HASH_BITS - bits * (level + 1)
        rows = sized.select("__skey", "__size", F.shiftright("__h", above).alias("__prefix"), F.shiftright("__h", here).alias("cell"))
        if level:  # in the first level every row is within its source's bounds
            rows = rows.join(bounds.select("__skey", "__prefix"), ["__skey", "__prefix"])
        # written: a source's few cells are joined with its bounds, not its rows
        summed = stage(rows.groupBy("__skey", "cell").agg(F.sum("__size").alias("tokens")), "mix-cells")
        cells = summed.join(bounds.select("__skey", "__extra", "__base"), "__skey")
        run = Window.partitionBy("__skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        past = cells.withColumn("upto", F.col("__base") + F.sum("tokens").over(run)).filter(F.col("upto") > F.col("__extra"))
        edge = F.min(F.struct("cell", "upto", "tokens"))
        bounds = stage(
            past.groupBy("__skey", "__extra").agg(edge.alias("e")).select(
                "__skey", "__extra",
                F.col("e.cell").alias("__prefix"),
                (F.col("e.upto") - F.col("e.tokens")).alias("__base"),
                F.col("e.tokens").alias("__tokens"),
            ),
            "mix-bounds",
        )
    # the last cell goes in when that brings the source nearer to its budget
    cut = F.col("__prefix") + F.when(2 * (F.col("__extra") - F.col("__base")) >= F.col("__tokens"), F.lit(1)).otherwise(F.lit(0))
    found = bounds.select("__skey", cut.alias("__found"))
    none = F.when(F.col("__extra") > 0, F.lit(1 << (bits * levels))).otherwise(F.lit(0))
    cut = F.when(F.col("__extra") > 0, F.coalesce("__found", none)).otherwise(F.lit(0))
    return plans.join(found, "__skey", "left").withColumn("__cut", cut).drop("__found", "__extra")


def planned(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: Sequence[str],
    weights: Sequence[int], max_repeat: int, bits: int, levels: int,
) -> DataFrame:
    """``__id, __size, __ssize, __target, __times`` of every row, and the carried
    columns as ``__c0``, ``__c1``, ... in their order."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    sized = stage(
        docs.select(
            F.col(id_col).alias("__id"),
            F.col(source_col).alias("__source"),
            key.alias("__skey"),
            word_count(F.col(text_col)).alias("__size"),
            hash60(F.concat(ident, F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))).alias("__h"),
            *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)],
        ),
        "mix-sizes",
    )
    targets = stage(source_targets(sized, weights, max_repeat), "mix-targets")
    cuts = stage(thresholds(sized, targets, bits, levels), "mix-thresholds")
    salted = cuts.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    once_more = (F.shiftright("__h", HASH_BITS - bits * levels) < F.col("__cut")).cast("long")
    return sized.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(salted, ["__skey", "__salt"]).select(
        "__id", "__size", "__ssize", "__target", (F.col("__whole") + once_more).alias("__times"),
        *[f"__c{i}" for i in range(len(carry))],
    )


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
    weights: Sequence[int] = (5, 2, 1),
    max_repeat: int = 3,
    bits: int = 10,
    levels: int = 3,
) -> DataFrame:
    """Every row with ``__id, __size, __ssize, __target, __times`` and the carried
    columns (which must not have those names)."""
    rows = planned(docs, id_col, text_col, source_col, carry, weights, max_repeat, bits, levels)
    return rows.withColumnsRenamed({f"__c{i}": c for i, c in enumerate(carry)})


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    max_repeat: int = 3,
    bits: int = 10,
    levels: int = 3,
) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its source needs,
    with the columns of ``docs``."""
    rows = planned(docs, id_col, text_col, source_col, docs.columns, weights, max_repeat, bits, levels)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))).alias("__copy")
    taken = rows.filter(F.col("__times") > 0).select(*[f"__c{i}" for i in range(len(docs.columns))], copies)
    return taken.drop("__copy").toDF(*docs.columns)
