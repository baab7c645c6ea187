"""Evaluation-shaped inputs derived from the driver's tables.

The driver tables hold no evaluation data, so the registered queries derive
it with expressions both Spark and the DuckDB oracle evaluate identically
(integers and strings only inside JSON text):

* ``evaluations`` from ``orders`` - one scored extraction per order. The
  ground truth is an object of the order's fields plus a ``document_info``
  object; the recorded output is that object altered by ``o_orderkey % 8``
  (same / extra key / missing key / number as string / wrong value /
  truncated / trailing text / array). Model = ``o_orderstatus``, case (and
  source) = ``o_orderpriority``, row_index = ``o_orderkey + 1``.
* ``runs`` from ``events`` - one batch result per event: model =
  ``event_type``, case = ``user_id``, bucketed score and seconds so that
  full ties between models occur and the input-order rule is exercised.

The same derivations are written in SQL in ``scorecraft.plans.oracle``.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecraft.operators.generate import AuthFailure, RateLimited
from scorecraft.operators.layout import spread
from scorecraft.session import ANY_AGE, checkpoint_dir, prepare_session
from scorecraft.sources.named_files import FILE_ROWS, write_named_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# document_info variants chosen by o_custkey % 5.
_DOC_INFO_SQL = """CASE o_custkey % 5
  WHEN 0 THEN '{"source_type":"Excel","filename":"doc.csv"}'
  WHEN 1 THEN '{"source_type":"PDF","filename":"scan.PNG"}'
  WHEN 2 THEN '{"source_type":"PDF","filename":"notes"}'
  WHEN 3 THEN '{"source_type":"Excel","filename":"data.bad!ext"}'
  ELSE '{"source_type":" "}' END"""


def _fields_sql(custkey_sql: str, with_priority: bool = True) -> str:
    parts = [
        "'\"o_orderkey\":', CAST(o_orderkey AS STRING)",
        f"',\"o_custkey\":', {custkey_sql}",
        "',\"o_orderstatus\":\"', o_orderstatus, '\"'",
    ]
    if with_priority:
        parts.append("',\"o_orderpriority\":\"', o_orderpriority, '\"'")
    parts.append("',\"document_info\":', doc_info")
    return ", ".join(parts)


_FULL = _fields_sql("CAST(o_custkey AS STRING)")
_AS_FLOAT = _fields_sql("CAST(o_custkey AS STRING), '.0'")
_NO_PRIORITY = _fields_sql("CAST(o_custkey AS STRING)", with_priority=False)
_AS_STRING = _fields_sql("'\"', CAST(o_custkey AS STRING), '\"'")
_WRONG = _fields_sql("CAST(o_custkey + 1 AS STRING)")

_TRUTH_SQL = f"CASE WHEN o_orderkey % 97 = 0 THEN '{{}}' ELSE concat('{{', {_FULL}, '}}') END"
_OUTPUT_SQL = f"""CASE
  WHEN o_orderkey % 89 = 0 THEN ''
  WHEN o_orderkey % 16 = 8 THEN concat('{{', {_AS_FLOAT}, '}}')
  WHEN o_orderkey % 8 = 0 THEN concat('{{', {_FULL}, '}}')
  WHEN o_orderkey % 8 = 1 THEN concat('{{"note":"extra",', {_FULL}, '}}')
  WHEN o_orderkey % 8 = 2 THEN concat('{{', {_NO_PRIORITY}, '}}')
  WHEN o_orderkey % 8 = 3 THEN concat('{{', {_AS_STRING}, '}}')
  WHEN o_orderkey % 8 = 4 THEN concat('{{', {_WRONG}, '}}')
  WHEN o_orderkey % 8 = 5 THEN concat('{{', {_FULL})
  WHEN o_orderkey % 8 = 6 THEN concat('{{', {_FULL}, '}} trailing')
  ELSE concat('[{{', {_FULL}, '}}]') END"""
_ERROR_KIND_SQL = """CASE WHEN o_orderkey % 211 = 7 THEN 'auth'
  WHEN o_orderkey % 113 = 5 THEN 'error' END"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(eval_id, model, source, case_id, row_index, ground_truth, llm_output,
    error_kind, error_message)`` - one row per order, whole table."""
    prepare_session(spark)
    orders = spread(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    )
    return evaluations_of(orders)


def evaluations_of(orders: DataFrame) -> DataFrame:
    """The evaluation derivation on any orders DataFrame (batch or stream)."""
    with_info = orders.withColumn("doc_info", F.expr(_DOC_INFO_SQL))
    return with_info.select(
        F.col("o_orderkey").alias("eval_id"),
        F.col("o_orderstatus").alias("model"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderpriority").alias("case_id"),
        (F.col("o_orderkey") + 1).alias("row_index"),
        F.expr(_TRUTH_SQL).alias("ground_truth"),
        F.expr(_OUTPUT_SQL).alias("llm_output"),
        F.expr(_ERROR_KIND_SQL).alias("error_kind"),
        F.expr("CASE WHEN o_orderkey % 113 = 5 THEN concat('generation failed for row ', "
               "CAST(o_orderkey + 1 AS STRING)) END").alias("error_message"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint dir."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


#: The case of a stored run: orders of 400 keys.
STORED_CASE_SQL = "concat('block_', CAST(CAST(floor((row_index - 1) / 400) AS BIGINT) AS STRING))"


def stored_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded outputs of small runs: a model, a source and a block of orders."""
    ev = evaluations(spark, sf_dir)
    return ev.select(
        "model", "source", F.expr(STORED_CASE_SQL).alias("case_id"), "row_index", "ground_truth",
        F.col("llm_output").alias("output"),
        F.when(F.col("error_kind").isNotNull(), F.lit("error")).alias("error_kind"), "error_message",
    )


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream: one file or a folder of part files.

    The pattern matches the table's path alone; as a plain path the stream
    source would take a folder only. The source sizes its own batches."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.options(**ANY_AGE).schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


# Run status by event_id % 10.
_STATUS_SQL = """CASE event_id % 10
  WHEN 7 THEN 'aborted_due_to_auth'
  WHEN 8 THEN 'empty'
  WHEN 9 THEN 'failed_preprocess'
  ELSE 'completed' END"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch results (D8): ``model, case_id, status, average_score,
    elapsed_seconds, run_index`` - one per event, whole table."""
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(events: DataFrame) -> DataFrame:
    """The run derivation on any events DataFrame (batch or stream)."""
    events = events.select("event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.expr(_STATUS_SQL)
    score = F.least(F.floor(k / 10), F.lit(8)) / F.lit(8.0)
    seconds = F.floor(F.col("value") / 10).cast("double")
    return events.select(
        F.col("event_type").alias("model"),
        F.concat(F.lit("case_"), F.col("user_id").cast("string")).alias("case_id"),
        status.alias("status"),
        F.when(status.isin("empty", "failed_preprocess"), F.lit(0.0)).otherwise(score).alias("average_score"),
        F.when(status == "failed_preprocess", F.lit(0.0)).otherwise(seconds).alias("elapsed_seconds"),
        F.col("event_id").alias("run_index"),
    )


def split_point(spark: SparkSession, sf_dir: str) -> float:
    """The middle event id: one scalar aggregate brought to the driver."""
    top = table(spark, sf_dir, "events").agg(F.max("event_id").alias("m")).first()["m"]
    return ((top if top is not None else -1) + 1) / 2


def split_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(base, new): runs before / from the middle event id on."""
    mid = split_point(spark, sf_dir)
    all_runs = runs(spark, sf_dir)
    return (
        all_runs.filter(F.col("run_index") < F.lit(mid)),
        all_runs.filter(F.col("run_index") >= F.lit(mid)),
    )


# A file listing derived from ``part`` - one input per part,
# extension by p_partkey % 8, outputs present by p_size % 4
# (0: <prefix>_<ext>_output.csv, 1: <prefix>_output.csv, 2: both, 3: none).
_PART_DIR_SQL = "concat('data/examples.', lower(replace(p_brand, '#', '_')))"
_PART_PREFIX_SQL = "concat('ex', CAST(p_partkey AS STRING))"
_PART_EXT_SQL = """CASE p_partkey % 8 WHEN 0 THEN 'csv' WHEN 1 THEN 'PDF' WHEN 2 THEN 'png' WHEN 3 THEN 'txt'
  WHEN 4 THEN 'xlsx' WHEN 5 THEN 'gif' WHEN 6 THEN 'docx' ELSE 'Csv' END"""
PART_LISTING_SQL = {
    "input": f"concat({_PART_DIR_SQL}, '/', {_PART_PREFIX_SQL}, '_input.', {_PART_EXT_SQL})",
    "out_ext": f"""CASE WHEN p_size % 4 IN (0, 2) THEN concat({_PART_DIR_SQL}, '/', {_PART_PREFIX_SQL}, '_',
  lower({_PART_EXT_SQL}), '_output.csv') END""",
    "out_plain": f"""CASE WHEN p_size % 4 IN (1, 2) THEN concat({_PART_DIR_SQL}, '/', {_PART_PREFIX_SQL},
  '_output.csv') END""",
}


def part_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing (``path``) built from ``part``: inputs and outputs."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    paths = F.array(*[F.expr(PART_LISTING_SQL[k]) for k in ("input", "out_ext", "out_plain")])
    return part.select(F.explode(paths).alias("path")).filter(F.col("path").isNotNull())


# Ground-truth rows derived from ``lineitem`` (one case per order).
TRUTH_ROW_SQL = {
    "case_id": "concat('order_', CAST(l_orderkey AS STRING))",
    "row_pos": "l_linenumber",
    "unit": "l_returnflag",
    "item": "concat('part_', CAST(l_partkey AS STRING))",
    "num_type": "l_linestatus",
    "status_type": "'qty'",
    "value": "CAST(l_quantity AS BIGINT)",
}
ORDER_CASE_SQL = {
    "case_id": "concat('order_', CAST(o_orderkey AS STRING))",
    "input_path": """concat('orders/order_', CAST(o_orderkey AS STRING), '_input.',
  CASE o_orderkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' ELSE 'PNG' END)""",
}


def truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*[F.expr(v).alias(k) for k, v in TRUTH_ROW_SQL.items()])


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(*[F.expr(v).alias(k) for k, v in ORDER_CASE_SQL.items()])


# A text dataset derived from ``conversations`` (as a CSV
# loader would give it) with type, required and blank-row cases.
DATASET_SQL = {
    "key_conv": "conv_id",
    "key_turn": "turn",
    "id": """CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN ''
  ELSE concat(CAST(conv_id AS STRING), CASE WHEN turn % 5 = 4 THEN '.5' ELSE '' END) END""",
    "turn": "CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN ' ' ELSE CAST(turn AS STRING) END",
    "prompt": "CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN NULL WHEN role = 'system' THEN '  ' ELSE text END",
    "expected": "CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN '' WHEN conv_id % 7 = 3 THEN NULL ELSE role END",
}
DATASET_SCHEMA = {"id": int, "turn": int, "prompt": str, "expected": str}


def text_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.select(*[F.expr(v).alias(k) for k, v in DATASET_SQL.items()])


# The prompts of ``conversations`` and the rules of the models that
# answer them, all by the number of characters n.
GENERATOR_MODELS = ["model-b", "model-a"]
PROMPT_SQL = {
    "case_id": "role",
    "row_index": "conv_id * 1000 + turn + 1",
    "prompt": "text",
    "ground_truth": """concat('{"chars":', CAST(length(coalesce(text, '')) AS STRING), ',"turn":', CAST(turn AS STRING), '}')""",
}


def prompt_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, row_index, prompt, ground_truth``: a row per conversation turn."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(*[F.expr(v).alias(k) for k, v in PROMPT_SQL.items()])


class RuleGenerator:
    """Answers by rule; limited once for some prompts, always for others."""

    def __init__(self) -> None:
        self.limited: set[tuple[str, str]] = set()

    def __call__(self, model: str, prompt: str) -> str:
        n = len(prompt)
        if model == "model-b" and n % 101 == 7:
            raise AuthFailure("credentials refused")
        if n % 17 == 3:
            raise RateLimited("too many requests")
        if n % 23 == 1 and (model, prompt) not in self.limited:
            self.limited.add((model, prompt))
            raise RateLimited("too many requests")
        self.limited.discard((model, prompt))
        if n % 19 == 5:
            raise ValueError(f"no answer of {n} characters")
        if n % 5 == 2:
            return "no object"
        turn = ',"turn":0' if model == "model-b" else ""
        return f'{{"chars":{n}{turn}}}'


# CSV files of ``conversations``, 500 conversations each, in one of
# three column orders by file; a first line of separators, blank rows (conv_id %
# 13 = 5, turn 1), rows without their last cell (conv_id % 7 = 3) or with one more
# (conv_id % 7 = 4), and a column without a name.
CSV_FILE_SQL = "CAST(floor(conv_id / 500) AS BIGINT)"
CSV_HEADERS = ["conv_id, turn ,role,text", "text,role,turn,conv_id", "role,,conv_id,turn,text"]
_CSV_CELLS = [["conv_id", "turn", "role", "text"], ["text", "role", "turn", "conv_id"], ["role", "_junk", "conv_id", "turn", "text"]]


def conversation_csv_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of CSV files (``g=<n>/part-*``) written from ``conversations``."""
    conv = table(spark, sf_dir, "conversations").select(
        F.expr(CSV_FILE_SQL).alias("g"), F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"),
        *[F.col(c).cast("string").alias(c) for c in ("conv_id", "turn", "role", "text")], F.lit("x").alias("_junk"),
    )
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rest = F.col("_conv") % 7
    lines = F.lit(None).cast("string")
    for order, cells in enumerate(_CSV_CELLS):
        record = (
            F.when(rest == 3, F.to_csv(F.struct(*cells[:-1]), options))
            .when(rest == 4, F.to_csv(F.struct(*cells, F.lit("more").alias("_more")), options))
            .otherwise(F.to_csv(F.struct(*cells), options))
        )
        lines = F.when(F.col("g") % 3 == order, record).otherwise(lines)
    blank = (F.col("_conv") % 13 == 5) & (F.col("_turn") == 1)
    rows = conv.select("g", "_conv", "_turn", F.when(blank, F.lit(', ,"",')).otherwise(lines).alias("value"))
    titles = F.array(F.lit(",,,"), F.element_at(F.array(*[F.lit(h) for h in CSV_HEADERS]), (F.col("g") % 3 + 1).cast("int")))
    heads = conv.select("g").distinct().select("g", F.posexplode(titles).alias("n", "value")).select(
        "g", F.lit(None).cast("bigint").alias("_conv"), F.col("n").cast("bigint").alias("_turn"), "value"
    )
    path = scratch(spark, "conversation-csv")
    ordered = heads.unionByName(rows).repartition("g").sortWithinPartitions("g", "_conv", "_turn")
    ordered.select("g", "value").write.partitionBy("g").text(path)
    return path


# JSON datasets of ``orders``, 500 keys a file, records of mixed types
# by o_orderkey % 8; {} for o_orderkey % 97 = 0; in files with g % 11 = 7 the last
# record is no object, in files with g % 13 = 4 no record has a flag.
JSON_FILE_SQL = "CAST(floor(o_orderkey / 500) AS BIGINT)"
JSON_FIELDS_SQL = {
    "id": """CASE o_orderkey % 8 WHEN 1 THEN concat('" ', CAST(o_orderkey AS STRING), '"')
  WHEN 2 THEN concat(CAST(o_orderkey AS STRING), '.7') WHEN 3 THEN '"12.7"' WHEN 4 THEN 'true' WHEN 6 THEN '[1]'
  ELSE CAST(o_orderkey AS STRING) END""",
    "price": """CASE o_orderkey % 8 WHEN 5 THEN '"1.5"' WHEN 6 THEN CAST(o_custkey AS STRING) WHEN 7 THEN '"abc"' WHEN 4 THEN 'true'
  ELSE concat(CAST(o_custkey AS STRING), '.25') END""",
    "flag": """CASE o_orderkey % 8 WHEN 0 THEN '"false"' WHEN 1 THEN '0' WHEN 2 THEN '[]' WHEN 3 THEN '0.0' WHEN 4 THEN '{"a":1}'
  WHEN 5 THEN 'false' ELSE 'true' END""",
    "note": """CASE o_orderkey % 8 WHEN 0 THEN '12.50' WHEN 1 THEN 'true' WHEN 2 THEN 'null' WHEN 3 THEN '" "' WHEN 4 THEN '10000000.5'
  WHEN 5 THEN CAST(o_custkey AS STRING) ELSE concat('"', o_orderstatus, '"') END""",
}
JSON_SCHEMA = {"id": int, "price": float, "flag": bool, "note": str}


def order_json_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON datasets (``g=<n>.json``) written from ``orders``."""
    fields = {k: F.expr(v) for k, v in JSON_FIELDS_SQL.items()}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(JSON_FILE_SQL).alias("g"), *[v.alias(k) for k, v in fields.items()])
    no_flag = F.col("g") % 13 == 4
    parts = [F.concat(F.lit(f'" {k}":'), F.col(k)) for k in ("id", "price", "note")]
    record = F.concat(F.lit("{"), F.concat_ws(",", *parts, F.when(~no_flag, F.concat(F.lit('"flag":'), F.col("flag")))), F.lit("}"))
    records = orders.select("g", "o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, F.lit("{}")).otherwise(record).alias("r"))
    listed = records.groupBy("g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "r"))), lambda x: x["r"]), ",").alias("r")
    )
    array = F.concat(F.lit("["), F.col("r"), F.when(F.col("g") % 11 == 7, F.lit(',"x"]')).otherwise(F.lit("]")))
    value = (
        F.when(F.col("g") % 3 == 0, F.concat(F.lit('{"rows":'), array, F.lit("}")))
        .when(F.col("g") % 3 == 1, F.concat(F.lit('{"data":'), array, F.lit("}")))
        .otherwise(array)
    )
    path = scratch(spark, "order-json")
    name = F.concat(F.lit("g="), F.coalesce(F.col("g").cast("string"), F.lit("none")), F.lit(".json"))
    write_named_files(listed.select(name.alias("file"), F.encode(value, "UTF-8").alias("content")), path, [])
    return path


def file_number(dataset: str = "dataset") -> Column:
    """The ``g`` of a file of the two folders above."""
    return F.regexp_extract(dataset, r"/g=(\d+)[/.]", 1).cast("bigint")


# An expected-output document per row of ``documents`` with
# one broken rule chosen by doc_id (7: blank filename, 5: unknown source
# type, 11: object in summary, 13: fourth top key, 17: no tables,
# 19: duplicate table, 23: duplicate header, 29: extra row key, 31: not JSON).
_DOC_TABLE_SQL = """concat('{"table_name":"T_', lang, '","headers":["source","lang"',
  CASE WHEN doc_id % 23 = 0 THEN ',"lang"' ELSE '' END,
  '],"rows":[{"source":"', source, '","lang":"', lang, '"',
  CASE WHEN doc_id % 29 = 0 THEN ',"x":"1"' ELSE '' END, '}]}')"""
DOC_SQL = f"""concat('{{"document_info":{{"source_type":"',
  CASE doc_id % 5 WHEN 0 THEN 'Word' WHEN 1 THEN 'PDF' ELSE 'Excel' END,
  '","filename":"', CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE concat('doc', CAST(doc_id AS STRING), '.txt') END,
  '"}},"summary":{{"total_sheets":1,"total_rows":', CAST(n_chars AS STRING),
  CASE WHEN doc_id % 11 = 0 THEN ',"extra":{{"x":1}}' ELSE '' END,
  '}},"content_data":[',
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN concat({_DOC_TABLE_SQL}, ',', {_DOC_TABLE_SQL})
       ELSE {_DOC_TABLE_SQL} END,
  ']', CASE WHEN doc_id % 13 = 0 THEN ',"extra":1' ELSE '' END,
  CASE WHEN doc_id % 31 = 0 THEN '' ELSE '}}' END)"""


def document_jsons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))
    return docs.select("doc_id", F.expr(DOC_SQL).alias("doc"))


# Archives written from the tables. Suppliers, 40 a Word file: a title,
# a blank paragraph, and a table whose header spans two columns and whose nation is
# merged with the row above where it is the same. Parts, 100 a workbook: a sheet with
# a gap and shared strings, a sheet of inline ones. Customers, 300 a ".rec" file, a
# format of the caller's own; and a file that no extractor reads.
ARCHIVE_SQL = {
    "supplier": "CAST(floor(s_suppkey / 40) AS BIGINT)",
    "part": "CAST(floor(p_partkey / 100) AS BIGINT)",
    "customer": "CAST(floor(c_custkey / 300) AS BIGINT)",
}
_ROOT_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_WORD_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SHEET_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_BOOK = (
    f'{_ROOT_XML}<workbook {_SHEET_NS} xmlns:r="{_REL_NS}"><sheets><sheet name="Parts" sheetId="1" r:id="a"/>'
    '<sheet name="Sizes" sheetId="2" r:id="b"/></sheets></workbook>'
)
_BOOK_RELS = (
    f'{_ROOT_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    f'<Relationship Id="a" Type="{_REL_NS}/worksheet" Target="worksheets/one.xml"/>'
    f'<Relationship Id="b" Type="{_REL_NS}/worksheet" Target="/xl/worksheets/two.xml"/></Relationships>'
)


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``file, content``: the parts (name and text) of each archive, zipped."""
    for batch in batches:
        contents = []
        for parts in batch["parts"]:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for part in parts:
                    archive.writestr(zipfile.ZipInfo(part["name"]), part["text"])
            contents.append(out.getvalue())
        yield pd.DataFrame({"file": batch["file"], "content": contents})


def upper_record(content: bytes) -> str:
    """The extractor of ``.rec`` files: fields between bars, in upper case."""
    if content.startswith(b"broken"):
        raise ValueError("no record")
    return "/".join(content.decode().upper().split("|"))


def archive_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of Word files, workbooks and others written from the tables."""
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("x")))), lambda r: r["x"]), "")
    part = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("text"))
    cell = lambda text, props="": F.concat(F.lit("<w:tc>"), F.lit(props) if isinstance(props, str) else props, F.lit("<w:p><w:r><w:t>"), text, F.lit("</w:t></w:r></w:p></w:tc>"))

    suppliers = table(spark, sf_dir, "supplier").select(F.expr(ARCHIVE_SQL["supplier"]).alias("g"), "s_suppkey", "s_name", "s_nationkey")
    same = F.lag("s_nationkey").over(Window.partitionBy("g").orderBy("s_suppkey")) == F.col("s_nationkey")
    merge = F.when(same, F.lit("<w:tcPr><w:vMerge/></w:tcPr>")).otherwise(F.lit('<w:tcPr><w:vMerge w:val="restart"/></w:tcPr>'))
    nation = cell(F.when(same, F.lit("")).otherwise(F.col("s_nationkey").cast("string")), merge)
    line = F.concat(F.lit("<w:tr>"), cell(F.col("s_suppkey").cast("string")), cell(F.col("s_name")), nation, F.lit("</w:tr>"))
    head = F.concat(F.lit("<w:tr>"), cell(F.lit("supplier"), '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'), cell(F.lit("nation")), F.lit("</w:tr>"))
    body = suppliers.select("g", "s_suppkey", line.alias("line")).groupBy("g").agg(ordered("s_suppkey", F.col("line")).alias("rows"))
    word = F.concat(
        F.lit(f"{_ROOT_XML}<w:document {_WORD_NS}><w:body><w:p><w:r><w:t>Suppliers "), F.col("g").cast("string"),
        F.lit("</w:t></w:r></w:p><w:p/><w:tbl>"), head, F.col("rows"), F.lit("</w:tbl></w:body></w:document>"),
    )
    words = body.select(F.concat(F.lit("suppliers_"), "g", F.lit(".docx")).alias("file"), F.array(part("word/document.xml", word)).alias("parts"))

    parts = table(spark, sf_dir, "part").select(F.expr(ARCHIVE_SQL["part"]).alias("g"), "p_partkey", "p_brand", "p_size")
    brands = parts.groupBy("g").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    row = F.concat(
        F.lit("<row><c r=\"A1\"><v>"), F.col("p_partkey").cast("string"), F.lit('</v></c><c r="C1" t="s"><v>'),
        (F.array_position("brands", F.col("p_brand")) - 1).cast("string"), F.lit("</v></c></row>"),
    )
    size = F.concat(F.lit('<row><c r="B1" t="inlineStr"><is><t>size '), F.col("p_size").cast("string"), F.lit("</t></is></c></row>"))
    sheets = parts.join(brands, "g").groupBy("g").agg(
        F.first("brands").alias("brands"), ordered("p_partkey", row).alias("one"), ordered("p_partkey", size).alias("two")
    )
    sheet = lambda rows: F.concat(F.lit(f"{_ROOT_XML}<worksheet {_SHEET_NS}><sheetData>"), rows, F.lit("</sheetData></worksheet>"))
    shared = F.array_join(F.transform("brands", lambda b: F.concat(F.lit("<si><t>"), b, F.lit("</t></si>"))), "")
    books = sheets.select(
        F.concat(F.lit("parts_"), "g", F.lit(".XLSX")).alias("file"),
        F.array(
            part("xl/workbook.xml", F.lit(_BOOK)), part("xl/_rels/workbook.xml.rels", F.lit(_BOOK_RELS)),
            part("xl/sharedStrings.xml", F.concat(F.lit(f"{_ROOT_XML}<sst {_SHEET_NS}>"), shared, F.lit("</sst>"))),
            part("xl/worksheets/one.xml", sheet(F.col("one"))), part("xl/worksheets/two.xml", sheet(F.col("two"))),
        ).alias("parts"),
    )
    archives = words.unionByName(books).mapInPandas(_zipped, FILE_ROWS)

    customers = table(spark, sf_dir, "customer").select(F.expr(ARCHIVE_SQL["customer"]).alias("g"), "c_custkey", "c_name")
    records = customers.groupBy("g").agg(ordered("c_custkey", F.concat(F.col("c_name"), F.lit("|"))).alias("names"))
    broken = F.when(F.col("g") % 3 == 1, F.lit("broken")).otherwise(F.lit(""))
    plain = records.select(
        F.concat(F.lit("customers_"), "g", F.lit(".rec")).alias("file"), F.encode(F.concat(broken, "names"), "UTF-8").alias("content")
    ).unionByName(records.select(F.concat(F.lit("notes_"), "g", F.lit(".gif")).alias("file"), F.encode("names", "UTF-8").alias("content")))
    path = scratch(spark, "archives")
    write_named_files(archives.unionByName(plain), path, [])
    return path


def supplier_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide counts: suppliers per nation by balance band (a pivot)."""
    sup = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    band = (
        F.when(F.col("s_acctbal") < 0, F.lit("negative"))
        .when(F.col("s_acctbal") < 5000, F.lit("low"))
        .otherwise(F.lit("high"))
    )
    joined = (
        sup.join(nation, sup.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("n_name", "r_name", band.alias("band"))
    )
    return joined.groupBy("n_name", "r_name").pivot("band", ["negative", "low", "high", "unused"]).count()
