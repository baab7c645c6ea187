"""Exact deduplication as a stateful stream.

The documents' table is read as a stream. Each row's mark (digest of the
normalised text, code points, id and locator: file and row number) lands in a
table of marks, and a keyed aggregation over them, without a watermark, keeps
in a disk-backed state store that never expires one entry per digest: how many
rows have come, and of the row that stays its id and its locator. A later run
over a table with more files and the same ``state`` folder reads only the new
files, whatever their modification times.

The digest only proposes. On every hit (a digest that has more than one row)
the full normalised bytes are compared with those of the row that the locator
names; rows that differ in spite of an equal digest are grouped anew by their
bytes.

Of equal texts, the row with the most code points in the original text stays,
then the one with the smallest id, then the last by locator.

Scale: one entry per distinct text, spread over the state partitions by
digest; the aggregation combines before the shuffle, so a text with very many
copies sends one row per task. Texts are read twice, once for their marks and
once for the comparison, which only hits reach: a runtime Bloom filter over
their locators stands before the shuffle. Its join and that with the keepers
are plain joins that AQE can split, as nothing above them needs a group's rows
together.

Defined cases: null text counts as empty, and all empty and all-blank texts
are equal; null ids lose against others and ``keep_id`` is null where a group
has no other; repeated rows are copies of which one stays; an empty table
gives no rows; texts of any length are hashed and compared whole (in Spark, a
few texts in memory at a time); ids are whole numbers (a column of another type
must cast to a long); other columns are not read, and ``dedup`` keeps them
whatever their names.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm.common import SEPARATORS, scratch_path, stage
from scorecraft.session import ANY_AGE

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # an executor holds many partitions: small buffers each, and one limit for all
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # executors let go of a finished stream's stores soon, not a minute into the next work
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
#: Lets the optimizer put a Bloom filter of the hits' locators before the shuffle of the texts.
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100g",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for a while, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SEPARATORS, "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def fingerprints(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__digest, __rank`` of rows read from files; the rank orders equal
    texts and carries id (inverted: the smallest is the greatest) and locator."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(
        digest(F.col(text_col)).alias("__digest"),
        F.struct(
            F.char_length(text).cast("long").alias("points"),
            F.bitwise_not(F.col(id_col).cast("long")).alias("inverted_id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("__rank"),
    )


def run_stream(spark: SparkSession, path: str, id_col: str, text_col: str, state: str) -> tuple[DataFrame, DataFrame]:
    """Feed what is new in ``path`` to the state and return the marks,
    ``__digest, __rank``, and the state, ``__digest, __n, __keep``."""
    # a pattern that matches this path alone: the stream source takes a plain path for a folder only
    path = path.rstrip("/")
    rows = spark.readStream.options(**ANY_AGE).schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    marks, landing = fingerprints(rows, id_col, text_col), f"{state}/marks"
    marks.writeStream.format("parquet").option("path", landing).trigger(availableNow=True) \
        .option("checkpointLocation", f"{state}/landing").start().awaitTermination()
    landed = spark.readStream.options(**ANY_AGE).schema(marks.schema).parquet(landing)
    entries = landed.groupBy("__digest").agg(F.max("__rank").alias("keep"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, _STORE):
        entries.writeStream.outputMode("update").format("noop").trigger(availableNow=True) \
            .option("checkpointLocation", f"{state}/entries").start().awaitTermination()
        held = spark.read.format("statestore").load(f"{state}/entries")
        keep, n = held.schema["value"].dataType.names
        entries = stage(
            held.select(
                F.col("key.__digest").alias("__digest"), F.col("value").getField(n).alias("__n"),
                F.col("value").getField(keep).alias("__keep"),
            ),
            "dedup-state",
        )
    return spark.read.schema(marks.schema).parquet(landing), entries


def strangers(table: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """``__digest, __file, __row, __text`` of the hits whose bytes are not those
    of the row that stays."""
    hits = groups.filter(F.col("__n") > 1).select(
        "__digest", "__file", "__row", "kept", F.xxhash64("__file", "__row").alias("__at")
    )
    texts = table.select(
        normalised(F.col(text_col)).alias("__text"),
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"),
        F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__at"),
    )
    with _settings(table.sparkSession, _BLOOM):
        read = stage(texts.join(hits, ["__at", "__file", "__row"]).drop("__at"), "dedup-texts")
    keepers = read.filter("kept").select("__digest", F.col("__text").alias("__kept_text"))
    return stage(
        read.filter("NOT kept").join(keepers, "__digest").filter(F.col("__text") != F.col("__kept_text"))
        .select("__digest", "__file", "__row", "__text"),
        "dedup-strangers",
    )


def dedup_table(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", state: str | None = None
) -> DataFrame:
    """One row for each row of the Parquet table at ``path``:
    ``id, keep_id, group_size, kept, text_sha256`` and its locator
    ``file, row``."""
    marks, entries = run_stream(spark, path, id_col, text_col, state or scratch_path(spark, "dedup-stream"))
    stays = (F.col("__keep.file") == F.col("__file")) & (F.col("__keep.row") == F.col("__row"))
    groups = stage(
        marks.withColumns({"__file": F.col("__rank.file"), "__row": F.col("__rank.row")})
        .join(entries, "__digest").withColumn("kept", stays),
        "dedup-groups",
    )
    odd = strangers(spark.read.parquet(path), groups, text_col)
    if not odd.isEmpty():
        moved = groups.drop("__n", "__keep", "kept").join(odd, ["__digest", "__file", "__row"])
        anew = moved.groupBy("__digest", "__text").agg(F.max("__rank").alias("__keep"), F.count(F.lit(1)).alias("__n"))
        moved = moved.join(anew, ["__digest", "__text"]).withColumn("kept", stays)
        fewer = odd.groupBy("__digest").agg(F.count(F.lit(1)).alias("__gone"))
        stay = groups.join(odd.select("__digest", "__file", "__row"), ["__digest", "__file", "__row"], "left_anti") \
            .join(fewer, "__digest", "left").withColumn("__n", F.col("__n") - F.coalesce(F.col("__gone"), F.lit(0)))
        groups = stay.select(*groups.columns).unionByName(moved.select(*groups.columns))
    return groups.select(
        F.bitwise_not("__rank.inverted_id").alias(id_col),
        F.bitwise_not("__keep.inverted_id").alias("keep_id"),
        F.col("__n").alias("group_size"),
        "kept",
        F.lower(F.hex("__digest")).alias("text_sha256"),
        F.col("__file").alias("file"),
        F.col("__row").alias("row"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. ``docs`` is first
    written to the shared folder, which gives its rows locators."""
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup-input")
    docs.write.option("compression", "zstd").parquet(path)
    kept = dedup_table(spark, path, id_col, text_col).filter("kept").select(
        F.col("file").alias("__file"), F.col("row").alias("__row")
    )
    rows = spark.read.schema(docs.schema).parquet(path)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    located = rows.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)],
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"),
    )
    return located.join(kept, ["__file", "__row"], "left_semi").select(*names).toDF(*docs.columns)
