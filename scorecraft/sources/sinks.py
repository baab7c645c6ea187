"""Sinks (K1-K5).

The native store is Parquet partitioned by ``model``/``source`` (later
reads prune partitions, F3/F4). CSV/JSON exports keep the reference's text
layouts and file names, ``<model>__<case>.csv`` and ``.json``, so that the
readers (S1, S4) find model and case again. ``preserve=True`` never overwrites:
the output goes to a new ``version=<n>`` folder (K5), which a writer claims by
creating its marker; of two writers at once one gets the next number.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecraft.functions import keys as K
from scorecraft.operators import compare as C
from scorecraft.operators.accuracy import category_report_json
from scorecraft.sources import reports as RP
from scorecraft.sources.named_files import write_named_files


def _exclusive(df: DataFrame, marker: str) -> bool:
    """Create an empty file unless it is there; whether this call created it."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(marker)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
        fs.mkdirs(path.getParent())
        return jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        fs.create(path, False).close()
        return True
    except Py4JJavaError as error:
        if fs.exists(path):
            return False
        raise error


def _next_version(df: DataFrame, path: str) -> str:
    """K5: claim ``<path>/version=<max+1>`` of the folders and claims there."""
    jvm = df.sparkSession._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    versions = [0]
    if fs.exists(hadoop_path):
        for st in fs.listStatus(hadoop_path):
            number = re.fullmatch(r"(?:version=|_claim-)(\d+)", st.getPath().getName())
            if number:
                versions.append(int(number[1]))
    version = max(versions) + 1
    while not _exclusive(df, os.path.join(path, f"_claim-{version}")):
        version += 1
    return os.path.join(path, f"version={version}")


def _target(df: DataFrame, path: str, preserve: bool) -> tuple[str, str]:
    return (_next_version(df, path), "errorifexists") if preserve else (path, "overwrite")


def write_run_reports(
    reports: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("model", "source"),
    mode: str = "append",
) -> None:
    """K1: report rows appended to the Parquet store, one folder per
    (model, source); rows are gathered by the partition columns first so
    each task writes few files, and AQE splits the pairs that are large."""
    cols = list(partition_by)
    reports.hint("rebalance", *cols).write.partitionBy(*cols).mode(mode).parquet(path)


def file_key(keys: Sequence[str] = ("model", "case_id")) -> Column:
    """``<model>__<case>`` with each part safe in a file name."""
    return F.concat_ws("__", *[K.safe_segment(k) for k in keys])


# A CSV record as Python's csv module reads it; texts keep their outer blanks.
_CSV_TEXT = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def export_run_reports_csv(
    reports: DataFrame, path: str, keys: Sequence[str] = ("model", "case_id"), overwrite: bool = True
) -> None:
    """K1 text export: ``<model>__<case>.csv`` with a header and the run's rows by
    ``row_index``, JSON cells quoted with doubled quotes. Runs whose names are
    the same once safe would share a file: an error."""
    clash = reports.select(*keys).distinct().groupBy(file_key(keys).alias("file")).count().filter("count > 1").first()
    if clash:
        raise ValueError(f"several runs would be written to {clash['file']}.csv")
    row = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RP.REPORT_FIELDS])
    rows = reports.select(file_key(keys).alias("file"), "row_index", F.to_csv(row, _CSV_TEXT).alias("line"))
    heads = reports.select(file_key(keys).alias("file")).distinct().select(
        "file", F.lit(None).cast(reports.schema["row_index"].dataType).alias("row_index"), F.lit(",".join(RP.REPORT_FIELDS)).alias("line")
    )
    lines = heads.unionByName(rows).select(
        F.concat("file", F.lit(".csv")).alias("file"), F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias("content"),
        F.col("row_index").isNotNull().alias("_body"), "row_index",
    )
    write_named_files(lines, path, ["_body", "row_index", "content"], overwrite)


def write_overall_report(report: DataFrame, path: str, preserve: bool = False) -> str:
    """K2: sections in order (case comparison, model summary, winners), cases
    and models sorted by name, as CSV part files whose names follow the order."""
    target, mode = _target(report, path, preserve)
    C.report_order(report).write.mode(mode).option("header", True).option("emptyValue", "").csv(target)
    return target


def write_category_report(summary: DataFrame, path: str, preserve: bool = False) -> str:
    """K3: the long summary as Parquet plus the nested JSON document."""
    target, mode = _target(summary, path, preserve)
    summary.write.mode(mode).parquet(os.path.join(target, "summary"))
    category_report_json(summary).coalesce(1).write.mode(mode).text(os.path.join(target, "report_json"))
    return target


def write_eval_dataset(runs: DataFrame, path: str, keys: Sequence[str] = ("model", "case_id"), overwrite: bool = True) -> None:
    """K4: ``<model>__<case>.json`` with ``{"rows": [{"prompt",
    "expected_output"}]}``, from rows ``(model, case_id, prompt,
    expected_output)``, by ``row_index`` if there is one. A file is written row
    by row: no document is held whole."""
    place = F.col("row_index") if "row_index" in runs.columns else F.lit(0)
    item = F.to_json(F.struct(F.col("prompt"), F.parse_json("expected_output").alias("expected_output")))
    rows = runs.select(F.concat(file_key(keys), F.lit(".json")).alias("file"), place.alias("_place"), item.alias("text"))
    in_file = Window.partitionBy("file").orderBy("_place", "text")
    rows = rows.withColumns({"_n": F.row_number().over(in_file), "_last": F.lead(F.lit(True)).over(in_file).isNull()})
    before = F.when(F.col("_n") == 1, F.lit('{"rows":[')).otherwise(F.lit(","))
    after = F.when(F.col("_last"), F.lit("]}")).otherwise(F.lit(""))
    write_named_files(rows.select("file", F.encode(F.concat(before, "text", after), "UTF-8").alias("content"), "_n"), path, ["_n"], overwrite)
