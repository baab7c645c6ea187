"""Dataset readers (S2, S3): rows keyed by ``(dataset, row_index)``.

CSV: every file has a header of its own, its first record that is not blank;
names are stripped, unnamed columns dropped, of equal names the last counts.
Cells are put under their names by the file's own header, so files of other
column orders read together; short rows give blank cells, cells beyond the
header are ignored, blank rows are skipped before numbering (V5).

JSON: ``{"rows": [...]}``, else ``{"data": [...]}``, else a single object,
else a list. Elements must be objects; empty objects are skipped; keys are
stripped; the header is the key set of the first non-empty record. A file
that breaks these rules yields one ``error`` row instead of failing the job.
Cells are text, or with ``typed`` the JSON values themselves (VARIANT), which
``validate`` casts by their JSON type.

The ``*_files`` forms also return each file's header ``(dataset, header)``, for
files without rows too; ``validate.validate_files`` checks them (V2).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecraft.functions import jsonops as J
from scorecraft.functions import keys as K
from scorecraft.operators.layout import once, written

BOM = "\ufeff"
ERR_NOT_LIST = "JSON dataset must contain an object or list of objects."
ERR_NOT_OBJECT = "JSON dataset rows must be objects."
ERR_INVALID = "JSON dataset is not valid JSON."
ROW_KEYS = ("dataset", "row_index")


def _csv_records(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Records of CSV files without a header; ``dataset`` and ``_mid``, which
    grows with the place in the file (multiLine: one file is read by one task)."""
    raw = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("columnNameOfCorruptRecord", "_record")
        .csv(list(paths))
    )
    names = [field.split()[0] for field in schema.split(", ")]  # folders named key=value add columns
    return raw.select(F.col("_metadata.file_path").alias("dataset"), F.monotonically_increasing_id().alias("_mid"), *names)


def blank_record(raw: Column) -> Column:
    """Whether all cells of a CSV record are blank."""
    bare = F.regexp_replace(raw, r'(?U)(?<![^,])"\s*"(?![^,])', "")
    return F.regexp_replace(bare, r"(?U)[\s,\x1c-\x1f]", "") == ""


def _header_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parsed = [
            [cell] if record is None else next(csv.reader(io.StringIO(record, newline="")), [])
            for cell, record in zip(batch["_cell"], batch["_record"])
        ]
        yield pd.DataFrame({"dataset": batch["dataset"], "header": [[name.strip() for name in names] for names in parsed]})


def csv_headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``dataset, header`` of CSV files: the stripped names of the first record
    that is not blank, unnamed columns as empty names; files of blank records
    only have none. One partial aggregate; a small helper reads the record."""
    paths = [path] if isinstance(path, str) else list(path)
    # A record that has not exactly one cell is kept whole as a corrupt one.
    records = _csv_records(spark, paths, "_cell string, _record string")
    blank = F.when(F.col("_record").isNull(), K.is_blank("_cell")).otherwise(blank_record(F.col("_record")))
    first = records.groupBy("dataset").agg(
        F.min_by(F.struct("_cell", "_record"), F.when(~blank, F.col("_mid"))).alias("first")
    )
    named = first.filter(F.col("first").isNotNull()).select("dataset", "first.*").mapInPandas(
        _header_names, "dataset string, header array<string>"
    )
    return named.unionByName(
        first.filter(F.col("first").isNull()).select("dataset", F.array().cast("array<string>").alias("header"))
    )


def _last_positions(header: Column) -> Column:
    """Map of the names to their last positions (0-based)."""
    named = F.filter(F.transform(header, lambda h, i: F.struct(h.alias("k"), i.alias("v"))), lambda p: p["k"] != "")
    last = F.filter(named, lambda p: p["v"] == F.array_max(F.transform(F.filter(named, lambda q: q["k"] == p["k"]), lambda q: q["v"])))
    return F.map_from_entries(last)


def read_dataset_csv_files(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(rows, headers)``. Rows: ``dataset`` (file path), 1-based
    ``row_index`` after blank rows are skipped (R3), and the cells of
    ``columns`` as text; None: of all names in the files' headers, by position.
    A file that has no column of a name gives NULL there.

    Files may differ in width and order: headers are found first, then the
    records are read at the width of the widest header and written once."""
    paths = [path] if isinstance(path, str) else list(path)
    headers = written(csv_headers(spark, paths), "csv-headers")
    width = headers.agg(F.max(F.size("header"))).first()[0] or 0
    if columns is None:
        places = headers.select(F.posexplode("header").alias("pos", "name")).filter(F.col("name") != "")
        found = places.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name").collect()  # names, not rows
        columns = [r["name"] for r in found]
    columns = [c.strip() for c in columns]
    if set(columns) & set(ROW_KEYS):
        raise ValueError(f"a column has the name of a row key: {sorted(set(columns) & set(ROW_KEYS))}")
    names = [f"_c{i}" for i in range(max(width, 1))]
    raw = _csv_records(spark, paths, ", ".join(f"{n} string" for n in names))
    filled = raw.select("dataset", "_mid", F.array(*[F.coalesce(n, F.lit("")) for n in names]).alias("_cells"))
    filled = filled.filter(F.exists("_cells", lambda c: ~K.is_blank(c)))
    records = written(filled, "csv-records")
    # The header is the file's first record that is not blank, so the first left.
    first = records.groupBy("dataset").agg(F.min("_mid").alias("_first"))
    plan = headers.join(first, "dataset").select("dataset", "_first", _last_positions(F.col("header")).alias("_at"))
    rows = records.join(plan, "dataset").filter(F.col("_mid") > F.col("_first"))
    rows = rows.filter(F.exists(F.map_values("_at"), lambda i: ~K.is_blank(F.get("_cells", i))))
    pos = F.row_number().over(Window.partitionBy("dataset").orderBy("_mid"))
    cells = [F.get("_cells", F.try_element_at("_at", F.lit(c))).alias(c) for c in columns]
    return rows.select("dataset", pos.alias("row_index"), *cells), headers


def read_dataset_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of :func:`read_dataset_csv_files`."""
    return read_dataset_csv_files(spark, path, columns)[0]


def read_dataset_json_files(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], typed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """S3: ``(rows, headers)``. One row per non-empty record: ``dataset,
    row_index, error, header`` plus the requested ``columns`` as text (JSON
    strings as their value, other JSON values as JSON text; missing -> NULL), or
    with ``typed`` as VARIANT. ``header`` lists the keys of the first non-empty
    record; a file of records that are all empty has an empty one, a file
    without records none. A record whose values are all null or blank is no
    record and has no number (V5)."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("wholetext", True).text(paths)
    doc = raw.select(
        F.col("_metadata.file_path").alias("dataset"),
        F.regexp_replace("value", "^" + BOM, "").alias("_text"),
    )
    doc = once(doc, ["dataset"], _v=J.parsed_value("_text"))
    doc = once(doc, ["dataset", "_v"], _obj=F.try_variant_get("_v", "$", "map<string,variant>"))
    list_of = lambda v: F.try_variant_get(v, "$", "array<variant>")
    records = (
        F.when(F.map_contains_key("_obj", F.lit("rows")), list_of(F.try_element_at("_obj", F.lit("rows"))))
        .when(F.map_contains_key("_obj", F.lit("data")), list_of(F.try_element_at("_obj", F.lit("data"))))
        .when(F.col("_obj").isNotNull(), F.array("_v"))
        .otherwise(list_of("_v"))
    )
    maps = F.transform(records, lambda r: F.try_variant_get(r, "$", "map<string,variant>"))
    staged = once(doc, ["dataset"], _maps=maps, _invalid=F.col("_v").isNull())
    err = (
        F.when(F.col("_invalid"), F.lit(ERR_INVALID))
        .when(F.col("_maps").isNull(), F.lit(ERR_NOT_LIST))
        .when(F.exists("_maps", lambda m: m.isNull()), F.lit(ERR_NOT_OBJECT))
    )
    blank = lambda v: F.is_variant_null(v) | K.is_blank(F.try_variant_get(v, "$", "string"))
    non_empty = F.filter("_maps", lambda m: F.exists(F.map_values(m), lambda v: ~F.coalesce(blank(v), F.lit(False))))
    stripped = F.transform(non_empty, lambda m: F.transform_keys(m, lambda k, _v: K.py_strip(k)))
    staged = once(staged, [], dataset=F.col("dataset"), error=err, _n=F.size("_maps"), _rows=F.when(err.isNull(), stripped))
    staged = staged.withColumn("header", F.map_keys(F.try_element_at("_rows", F.lit(1))))
    headers = staged.filter(F.col("error").isNull() & (F.col("_n") > 0)).select(
        "dataset", F.coalesce("header", F.array().cast("array<string>")).alias("header")
    )
    cell_type = "variant" if typed else "string"
    errors = staged.filter(F.col("error").isNotNull()).select(
        "dataset", F.lit(None).cast("int").alias("row_index"), "error", F.lit(None).cast("array<string>").alias("header"),
        *[F.lit(None).cast(cell_type).alias(c) for c in columns],
    )
    exploded = staged.filter(F.col("error").isNull()).select(
        "dataset", "header", F.posexplode("_rows").alias("_pos", "_row")
    )

    def cell(name: str):
        v = F.try_element_at(F.col("_row"), F.lit(name))
        if typed:
            return v
        return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(
            F.when(~F.is_variant_null(v), F.to_json(v))
        )

    rows = exploded.select(
        "dataset",
        (F.col("_pos") + 1).cast("int").alias("row_index"),
        F.lit(None).cast("string").alias("error"),
        "header",
        *[cell(c).alias(c) for c in columns],
    )
    return rows.unionByName(errors), headers


def read_dataset_json(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], typed: bool = False
) -> DataFrame:
    """The rows of :func:`read_dataset_json_files`."""
    return read_dataset_json_files(spark, path, columns, typed)[0]
