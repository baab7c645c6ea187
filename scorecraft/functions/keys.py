"""Names, labels and small scalar rules as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
UNCATEGORIZED = "uncategorized"
UNKNOWN = "unknown"
UNNAMED = "unnamed"
ALL_LABEL = "all"
PDF_LIKE_EXTENSIONS = ("pdf", "png")
SUPPORTED_EXTENSIONS = (".csv", ".docx", ".pdf", ".png", ".txt", ".xlsx")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace, not only spaces."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    """NULL or whitespace-only (Unicode whitespace, as ``str.strip``)."""
    c = _col(c)
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def normalize_category(c: Column | str) -> Column:
    """M8: NULL / "" -> ``uncategorized``; otherwise the text as it is."""
    c = _col(c).cast("string")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNCATEGORIZED))


def path_name(path: Column | str) -> Column:
    """Last path component (``PurePosixPath.name``)."""
    p = _col(path)
    trimmed = F.when(p.endswith("/"), F.regexp_replace(p, "/+$", "")).otherwise(p)
    return F.substring_index(trimmed, "/", -1)


def _suffix_of_name(name: Column) -> Column:
    after = F.substring_index(name, ".", -1)
    dot = F.length(name) - F.length(after)  # 1-based position of the last dot, 0 if none
    return F.when((dot > 1) & (F.length(after) > 0), F.concat(F.lit("."), after)).otherwise(F.lit(""))


def path_suffix(path: Column | str) -> Column:
    """``PurePath.suffix`` of the last component: '.ext' or '' (T8).

    A name ending in a dot or starting with its only dot has no suffix.
    Plain string functions (no regex), so it stays in generated code.
    """
    return _suffix_of_name(path_name(path))


def path_stem(path: Column | str) -> Column:
    name = path_name(path)
    suffix = path_suffix(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix))


def path_parent_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)/[^/]*$", 1)


def category_from_object(obj: Column | str) -> Column:
    """M9 on a parsed truth (``map<string, variant>``, NULL = not an object).

    ``document_info.filename`` extension (lower-cased, only letters, digits,
    ``-`` and ``_`` kept); when that is empty the stripped
    ``document_info.source_type`` (JSON null reads ``None``); ``unknown``
    when ``document_info`` is not an object or nothing is left.
    """
    info = F.try_variant_get(F.try_element_at(_col(obj), F.lit("document_info")), "$", "map<string,variant>")
    return _category_from_info(info)


def _category_from_info(info: Column) -> Column:
    """Single-expression M9 (for one-off use; :func:`with_category` stages
    the same rules so each piece is computed once per row)."""
    filename_v = F.try_element_at(info, F.lit("filename"))
    filename = F.when(F.schema_of_variant(filename_v) == "STRING", F.variant_get(filename_v, "$", "string"))
    source_v = F.try_element_at(info, F.lit("source_type"))
    return _category_rule(info, path_name(filename), filename, source_v, F.schema_of_variant(source_v))


def _category_rule(info: Column, name: Column, filename: Column, source_v: Column, kind: Column) -> Column:
    after = F.substring_index(name, ".", -1)
    dot = F.length(name) - F.length(after)
    suffix = F.when((dot > 1) & (F.length(after) > 0), after).otherwise(F.lit(""))
    ext = F.regexp_replace(F.lower(suffix), r"[^\p{L}\p{N}_-]", "")
    ext = F.when(~is_blank(filename), ext)
    source_text = (
        F.when(source_v.isNull(), F.lit(UNKNOWN))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "STRING", F.variant_get(source_v, "$", "string"))
        .when(kind == "BOOLEAN", F.when(F.variant_get(source_v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
        .otherwise(F.to_json(source_v))
    )
    fallback = F.coalesce(F.nullif(py_strip(source_text), F.lit("")), F.lit(UNKNOWN))
    return F.when(info.isNull(), F.lit(UNKNOWN)).otherwise(F.coalesce(F.nullif(ext, F.lit("")), fallback))


def with_category(df: DataFrame, obj: str, out: str = "category") -> DataFrame:
    """Add M9 ``out`` from the parsed truth column ``obj``.

    Staged projections: ``document_info``, the raw ``filename`` /
    ``source_type`` values and the file name text each get their own column
    (referenced more than once, so they stay materialised); one nested
    expression would re-derive them in every branch.
    """
    info, fn_v, src_v, fn, kind, name = (f"_{out}_{x}" for x in ("info", "fnv", "srcv", "fn", "kind", "name"))
    staged = df.withColumn(
        info, F.try_variant_get(F.try_element_at(F.col(obj), F.lit("document_info")), "$", "map<string,variant>")
    )
    staged = staged.withColumns(
        {fn_v: F.try_element_at(F.col(info), F.lit("filename")), src_v: F.try_element_at(F.col(info), F.lit("source_type"))}
    )
    staged = staged.withColumns(
        {
            fn: F.when(F.schema_of_variant(F.col(fn_v)) == "STRING", F.variant_get(F.col(fn_v), "$", "string")),
            kind: F.schema_of_variant(F.col(src_v)),
        }
    )
    staged = staged.withColumn(name, path_name(F.col(fn)))
    result = _category_rule(F.col(info), F.col(name), F.col(fn), F.col(src_v), F.col(kind))
    return staged.withColumn(out, result).drop(info, fn_v, src_v, fn, kind, name)


def category_from_truth(truth_text: Column | str) -> Column:
    """M9 on a truth text (parses it; see :func:`with_category` for reuse)."""
    from scorecraft.functions.jsonops import parsed_object

    return category_from_object(parsed_object(truth_text))


def report_key_parts(stem: Column | str) -> tuple[Column, Column]:
    """(model, source) = parts 0 and 1 of ``stem.split('__')``; NULL when
    fewer than two parts (the report is skipped)."""
    parts = F.split(_col(stem), "__")
    ok = F.size(parts) >= 2
    return F.when(ok, F.get(parts, 0)), F.when(ok, F.get(parts, 1))


def case_id(path: Column | str) -> Column:
    """``<parent with . -> _>__<stem minus one trailing _input>``."""
    parent = F.regexp_replace(path_parent_name(path), r"\.", "_")
    stem = F.regexp_replace(path_stem(path), r"_input$", "")
    return F.concat_ws("__", parent, stem)


def safe_segment(c: Column | str) -> Column:
    """Runs of characters outside ``[A-Za-z0-9_.-]`` -> ``_``; dots and
    underscores stripped at both ends; empty -> ``unnamed``."""
    cleaned = F.regexp_replace(_col(c).cast("string"), r"[^A-Za-z0-9_.\-]+", "_")
    stripped = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(stripped, F.lit("")), F.lit(UNNAMED))


def safe_name(text: str) -> str:
    """:func:`safe_segment` of a parameter."""
    return re.sub(r"^[._]+|[._]+$", "", re.sub(r"[^A-Za-z0-9_.\-]+", "_", text)) or UNNAMED


def safe_label(c: Column | str) -> Column:
    """Each character that is not alphanumeric, ``-`` or ``_`` -> ``_``
    (one for one), ``_`` stripped at both ends, empty -> ``all``."""
    replaced = F.regexp_replace(_col(c).cast("string"), r"[^\p{L}\p{N}_\-]", "_")
    stripped = F.regexp_replace(replaced, r"^_+|_+$", "")
    return F.coalesce(F.nullif(stripped, F.lit("")), F.lit(ALL_LABEL))


def filter_suffix(*filters: Column | str) -> Column:
    """M13 suffix: ``_<a>_<b>`` from the non-blank (stripped) filters, else ''."""
    parts = [F.when(~is_blank(f), safe_label(py_strip(f))) for f in filters]
    joined = F.concat_ws("_", *parts)
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("_"), joined))


def source_type(ext: Column | str) -> Column:
    """``pdf``/``png`` (any case, with or without dot) -> ``PDF``, else ``Excel``."""
    e = F.regexp_replace(F.lower(_col(ext)), r"^\.", "")
    return F.when(e.isin(*PDF_LIKE_EXTENSIONS), F.lit("PDF")).otherwise(F.lit("Excel"))


def normalize_extensions(values: Iterable[str], supported: Iterable[str] = SUPPORTED_EXTENSIONS) -> tuple[str, ...]:
    """M15 on the parameter list (driver side, a handful of strings)."""
    allowed = {s.lower() for s in supported}
    out: list[str] = []
    for raw in values:
        e = str(raw).lower()
        if not e.startswith("."):
            e = "." + e
        if e == ".":
            raise ValueError(f"invalid extension: {raw!r}")
        if e not in allowed:
            raise ValueError(f"unsupported extension: {raw!r}")
        if e not in out:
            out.append(e)
    return tuple(out)


def build_prompt(instruction: str, file_name: Column | str, source_text: Column | str) -> Column:
    """Instruction, file name and source text in one stripped prompt."""
    body = F.concat(
        F.lit("\n" + instruction + "\n\nSOURCE FILENAME:\n"),
        _col(file_name),
        F.lit("\n\nSOURCE:\n"),
        _col(source_text),
        F.lit("\n"),
    )
    return py_strip(body)


def percent_to_unit(pct: Column | str) -> Column:
    """Percent -> 0..1 clamped; missing -> 0; non-numeric -> NULL (skipped)."""
    c = _col(pct)
    v = c.cast("string").try_cast("double") / F.lit(100.0)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(c.isNull(), F.lit(0.0)).otherwise(clamped)


def success_fraction(ok: Column | str, total: Column | str) -> Column:
    """``"<ok>/<total>"``."""
    return F.concat_ws("/", _col(ok).cast("string"), _col(total).cast("string"))
