"""Dataset contract checks (V1-V7) as a quarantine split.

At scale the reference's fail-fast loader becomes two DataFrames: the valid,
typed rows and one violation row per failing cell ``(row_id, column, rule,
value)``. Strict mode is a thin wrapper that raises on the first violation
found (``limit(1)``), so it never scans more than it needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions import keys as K
from scorecraft.operators.layout import once

# Schema type names accepted (Python types or their names).
TYPE_NAMES = {
    str: "string",
    int: "bigint",
    float: "double",
    bool: "boolean",
    dict: "object",
    list: "array",
}
RULE_MISSING = "missing_column"
RULE_REQUIRED = "required"
RULE_TYPE = "type"
RULE_UNREADABLE = "unreadable"

_INT_RE = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT_RE = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf(inity)?|nan)\s*$"


class SchemaError(ValueError):
    """The declared schema itself is unusable (V1)."""


class ValidationError(ValueError):
    """A dataset violates its declared schema (strict mode)."""


def check_schema(schema: Mapping[str, object]) -> dict[str, str]:
    """V1: non-empty mapping of column name -> type; returns name -> kind."""
    if not schema:
        raise SchemaError("dataset schema must not be empty")
    out: dict[str, str] = {}
    for name, typ in schema.items():
        kind = TYPE_NAMES.get(typ) if isinstance(typ, type) else None
        if kind is None and isinstance(typ, str) and typ in TYPE_NAMES.values():
            kind = typ
        if kind is None:
            raise SchemaError(f"schema entry {name!r} is not a supported type: {typ!r}")
        out[str(name).strip()] = kind
    return out


def normalize_headers(df: DataFrame) -> DataFrame:
    """V6: strip header names; drop columns whose header is blank (the CSV
    reader names a blank cell at position n ``_c<n>``)."""
    keep = [c for i, c in enumerate(df.columns) if c.strip() and c != f"_c{i}"]
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in keep])


def missing_columns(df: DataFrame, schema: Mapping[str, object]) -> list[str]:
    """V2: schema columns absent from the (stripped) header, schema order.

    Uses only the DataFrame's schema (no job)."""
    present = {c.strip() for c in df.columns}
    return [c for c in check_schema(schema) if c not in present]


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as text; of a VARIANT the string itself, else its JSON text."""
    cell = F.col(f"`{name}`")
    if df.schema[name].dataType.simpleString() != "variant":
        return cell.cast("string")
    text = F.when(F.schema_of_variant(cell) == "STRING", F.try_variant_get(cell, "$", "string"))
    return F.when(F.is_variant_null(cell), F.lit(None)).otherwise(F.coalesce(text, F.to_json(cell)))


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """V5: rows whose values are all NULL or blank are skipped."""
    cols = list(columns or df.columns)
    if not cols:
        return df
    any_value = F.lit(False)
    for c in cols:
        any_value = any_value | ~K.is_blank(cell_text(df, c))
    return df.filter(any_value)


def cast_value(value: Column, kind: str, source_type: str = "string") -> tuple[Column, Column]:
    """V4 for one cell: (typed value, ok flag), Python rules.

    From text: ``int`` needs an optionally signed integer (``"12.7"``
    fails); ``float`` accepts the float literals Python takes; ``bool`` is
    True for any non-empty text; ``str`` keeps the text.
    From numbers: ``int`` truncates, ``str`` gives the number's text.
    A VARIANT is cast by its JSON type (:func:`cast_variant`).
    """
    if source_type == "variant":
        return cast_variant(value, kind)
    if kind == "string":
        return value.cast("string"), F.lit(True)
    if kind == "bigint":
        if source_type == "string":
            parsed = K.py_strip(value).try_cast("bigint")
            ok = value.rlike(_INT_RE) & parsed.isNotNull()
            return F.when(ok, parsed), ok
        typed = value.cast("double").cast("bigint") if source_type in ("double", "float") else value.cast("bigint")
        return typed, F.lit(True)
    if kind == "double":
        if source_type == "string":
            ok = F.lower(value).rlike(_FLOAT_RE)
            return F.when(ok, F.lower(K.py_strip(value)).try_cast("double")), ok
        return value.cast("double"), F.lit(True)
    if kind == "boolean":
        if source_type == "string":
            return F.length(value) > 0, F.lit(True)
        return value.cast("boolean"), F.lit(True)
    if kind in ("object", "array"):
        from scorecraft.functions.jsonops import is_object_text

        if kind == "object":
            ok = is_object_text(value.cast("string"))
        else:
            ok = F.try_variant_get(F.try_parse_json(value.cast("string")), "$", "array<variant>").isNotNull()
        return F.when(ok, value.cast("string")), ok
    raise SchemaError(f"unsupported kind {kind!r}")


def python_float_text(value: Column) -> Column:
    """A double as Python writes it: plain from 1e-4 to below 1e16."""
    text = value.cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_extract(text, r"^-?(\d+)\.(\d+)E(-?\d+)$", 1)
    part = F.regexp_replace(F.regexp_extract(text, r"^-?(\d+)\.(\d+)E(-?\d+)$", 2), "0+$", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.concat(whole, part)
    padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), "0")
    fraction = F.substring(padded, power + 2, F.length(padded))
    large = F.concat(F.substring(padded, F.lit(1), power + 1), F.lit("."), F.when(fraction == "", F.lit("0")).otherwise(fraction))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    spelled = (
        F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(F.concat(mantissa, exponent))
    )
    named = F.when(F.isnan(value), F.lit("nan")).when(value == float("inf"), F.lit("inf")).when(value == float("-inf"), F.lit("-inf"))
    return F.coalesce(named, F.when(power.isNull(), text).otherwise(F.concat(sign, spelled)))


def cast_variant(value: Column, kind: str) -> tuple[Column, Column]:
    """V4 for a JSON value (T10): a value of the type stays, others go through
    the Python type's own conversion. ``int`` truncates 12.7 but refuses "12.7";
    a bool is an int; ``bool`` of a container or number says whether it is empty
    or 0; ``list`` of a text gives its characters, of an object its keys.

    Numbers written with a fraction are floats, also if it is zero. Differences:
    whole numbers beyond a long are no ``bigint``; ``str`` of an object or array
    is its JSON text, keys sorted; ``dict`` of an array of pairs is refused."""
    shape = F.schema_of_variant(value)
    text, flag = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "boolean")
    whole, real = F.try_variant_get(value, "$", "bigint"), F.try_variant_get(value, "$", "double")
    is_text, is_flag = shape == "STRING", shape == "BOOLEAN"
    is_object, is_array = shape.startswith("OBJECT"), shape.startswith("ARRAY")
    # the parser keeps 12.0 as a decimal without places; integers are longs while they fit
    is_int = (shape == "BIGINT") | (shape.rlike(r"^DECIMAL\(\d+,0\)$") & whole.isNull())
    empty = F.to_json(value).isin("{}", "[]")
    yes, no = F.lit(True), F.lit(False)
    if kind == "string":
        return (
            F.when(is_text, text).when(is_flag, F.when(flag, F.lit("True")).otherwise(F.lit("False")))
            .when(is_int | is_object | is_array, F.to_json(value)).otherwise(python_float_text(real))
        ), yes
    if kind in ("bigint", "double"):
        parsed, fits = cast_value(text, kind)
        number = whole if kind == "bigint" else real
        ok = F.when(is_text, fits).when(is_flag, yes).when(is_object | is_array, no).otherwise(number.isNotNull())
        return F.when(ok, F.when(is_text, parsed).when(is_flag, flag.cast(kind)).otherwise(number)), ok
    if kind == "boolean":
        return (
            F.when(is_flag, flag).when(is_text, F.length(text) > 0).when(is_object | is_array, ~empty).otherwise(real != 0)
        ), yes
    if kind == "object":
        ok = is_object | (is_array & empty)
        return F.when(is_object, F.to_json(value)).when(ok, F.lit("{}")), ok
    if kind == "array":
        letters = F.to_json(F.filter(F.split(text, ""), lambda c: c != ""))
        names = F.to_json(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
        return F.when(is_array, F.to_json(value)).when(is_text, letters).when(is_object, names), is_array | is_text | is_object
    raise SchemaError(f"unsupported kind {kind!r}")


def validate(
    df: DataFrame,
    schema: Mapping[str, object],
    row_id: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """V2-V7: ``(valid_rows, violations)``.

    ``valid_rows``: rows without any violation, schema columns only, in
    schema order, typed (V7). ``violations``: ``row_id..., column, rule,
    value``; a missing schema column gives one dataset-level violation with
    NULL row id and no valid rows. Blank rows are skipped first (V5).
    """
    kinds = check_schema(schema)
    df = normalize_headers(df)
    missing = missing_columns(df, kinds)
    id_cols = list(row_id)
    spark = df.sparkSession
    if missing:
        rows = [(c, RULE_MISSING) for c in missing]
        violations = spark.createDataFrame(rows, "column string, rule string").select(
            *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in id_cols if c in df.columns],
            "column",
            "rule",
            F.lit(None).cast("string").alias("value"),
        )
        return df.limit(0).select(*id_cols), violations
    data_cols = list(kinds)
    df = drop_blank_rows(df, data_cols)
    cells = {}
    for c in data_cols:
        src_type = df.schema[c].dataType.simpleString()
        value, ok = cast_value(F.col(c), kinds[c], src_type)
        text = cell_text(df, c)
        rule = F.when(K.is_blank(text), F.lit(RULE_REQUIRED)).when(~ok, F.lit(RULE_TYPE))
        cells |= {c: value, f"_rule_{c}": rule, f"_text_{c}": text}
    checked = once(df, id_cols, **cells)
    rules = F.coalesce(*[F.col(f"`_rule_{c}`") for c in data_cols])
    valid = checked.filter(rules.isNull()).select(*[c for c in id_cols if c not in data_cols], *data_cols)
    bad = [
        F.struct(F.lit(c).alias("column"), F.col(f"`_rule_{c}`").alias("rule"), F.col(f"`_text_{c}`").alias("value")) for c in data_cols
    ]
    violations = checked.filter(rules.isNotNull()).select(
        *id_cols, F.inline(F.filter(F.array(*bad), lambda x: x["rule"].isNotNull()))
    )
    return valid, violations


def validate_files(
    rows: DataFrame, headers: DataFrame, schema: Mapping[str, object], row_id: Sequence[str] = ("dataset", "row_index")
) -> tuple[DataFrame, DataFrame]:
    """V2-V7 over many dataset files at once: ``(valid, violations)``.

    ``headers`` has a row per file, so a file is checked against its own header
    even if no row of it is left: a missing column is one violation of the file
    with a NULL row, and none of its rows is valid. A file that could not be
    read (``error``) is one violation of rule ``unreadable``."""
    kinds = check_schema(schema)
    dataset, row = row_id
    row_type = rows.schema[row].dataType
    needed = F.array(*[F.lit(c) for c in kinds])
    lacks = headers.select(dataset, F.explode(F.filter(needed, lambda c: ~F.array_contains("header", c))).alias("column"))
    of_file = lacks.select(
        dataset, F.lit(None).cast(row_type).alias(row), "column", F.lit(RULE_MISSING).alias("rule"), F.lit(None).cast("string").alias("value")
    )
    if "error" in rows.columns:
        of_file = of_file.unionByName(rows.filter(F.col("error").isNotNull()).select(
            dataset, F.lit(None).cast(row_type).alias(row), F.lit(None).cast("string").alias("column"),
            F.lit(RULE_UNREADABLE).alias("rule"), F.col("error").alias("value"),
        ))
        rows = rows.filter(F.col("error").isNull())
    if "header" in rows.columns and rows.schema["header"].dataType.typeName() == "array":
        # each row has its file's header: no join is needed
        sound = rows.filter(F.coalesce(F.forall(needed, lambda c: F.array_contains("header", c)), F.lit(True)))
    else:
        sound = rows.join(lacks.select(dataset).distinct(), dataset, "left_anti")
    valid, violations = validate(sound.select(*row_id, *kinds), schema, row_id)
    return valid, violations.unionByName(of_file)


def validate_strict(df: DataFrame, schema: Mapping[str, object], row_id: Sequence[str]) -> DataFrame:
    """The reference's fail-fast mode: raise on the first violation."""
    valid, violations = validate(df, schema, row_id)
    first = violations.limit(1).collect()
    if first:
        r = first[0].asDict()
        raise ValidationError(
            f"dataset violates its schema: column {r['column']!r}, rule {r['rule']}, "
            f"row {[r.get(c) for c in row_id]}"
        )
    return valid
