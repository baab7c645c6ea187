"""JSON parsing and key-by-key scoring as native Column expressions (M1-M7).

Everything here stays inside the JVM: VARIANT parsing, casts to
``map<string, variant>`` and higher-order functions over the keys.

Semantics follow Python's ``json`` module and ``==``:

* validity (T1): ``try_parse_json`` ignores trailing text, so the text is
  parsed inside a wrapper object ``{"_v_": <text>, "_z9_": 0}`` that must come
  back with exactly two keys. Texts that could spell the wrapper keys (or use
  ``\\u`` escapes) are also parsed inside ``[<text>]``, which must give a
  one-element array; both wrappers together leave no trailing-text hole.
* equality (T2): values are compared through canonical text: ``to_json`` of
  the variant (object keys sorted, strings re-escaped), with every number
  token rewritten so that ``1``, ``1.0``, ``1e0`` and ``true`` are one text,
  as Python's ``1 == 1.0 == True``. ``null`` only equals ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wrapper keys used for the validity check.
_WRAP_OPEN = '{"_v_":'
_WRAP_CLOSE = ',"_z9_":0}'
# Tokens of a to_json text: quoted strings, bare scalars, punctuation.
_TOKEN_RE = r'"(?:[^"\\]|\\.)*"|[^"\s\[\]{},:]+|[\[\]{},:]'
_RESPELLED = "true|false|[0-9][.eE]"
_PUNCT = ["null", "{", "}", "[", "]", ",", ":"]

MAP_OF_VARIANT = "map<string,variant>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _wrapped_outer(text: Column) -> Column:
    wrapped = F.try_parse_json(F.concat(F.lit(_WRAP_OPEN), text, F.lit(_WRAP_CLOSE)))
    return F.try_variant_get(wrapped, "$", MAP_OF_VARIANT)


def _outer_ok(text: Column, outer: Column) -> Column:
    suspicious = text.contains("_v_") | text.contains("_z9_") | text.contains("\\u")
    as_array = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    array_ok = F.coalesce(F.size(as_array) == 1, F.lit(False))
    return (F.size(outer) == 2) & F.when(suspicious, array_ok).otherwise(F.lit(True))


def _inner(outer: Column) -> Column:
    return F.try_variant_get(F.try_element_at(outer, F.lit("_v_")), "$", MAP_OF_VARIANT)


def parsed_object(text: Column | str) -> Column:
    """``map<string, variant>`` of a text that is exactly one JSON object.

    NULL when the text is not valid JSON (trailing text included), is not an
    object, or is NULL. Keys keep their exact spelling (no trim). For heavy
    use prefer :func:`with_canonical_object`, which parses once per row.
    """
    text = _col(text)
    outer = _wrapped_outer(text)
    return F.when(_outer_ok(text, outer), _inner(outer))


def parsed_value(text: Column | str) -> Column:
    """Variant of a text that is exactly one JSON value, else NULL."""
    text = _col(text)
    outer = _wrapped_outer(text)
    return F.when(_outer_ok(text, outer), F.try_element_at(outer, F.lit("_v_")))


def is_object_text(text: Column | str) -> Column:
    """True when the text is exactly one JSON object (never NULL)."""
    return parsed_object(text).isNotNull()


def _whole_digits(x: Column) -> Column:
    """All digits of a whole double below 1e38: exact, as 2**62 divides without
    a rounding and both parts fit a bigint."""
    high = F.rint(F.floor(F.abs(x) / F.lit(2.0**62)).cast("double"))
    low = F.abs(x) - high * F.lit(2.0**62)
    part = lambda c: c.cast("bigint").cast("decimal(20, 0)")
    size = (part(high) * F.lit(1 << 62).cast("decimal(20, 0)")).cast("decimal(38, 0)") + part(low)
    digits = size.cast("decimal(38, 0)").cast("string")
    return F.when(x < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def _canon_token(t: Column) -> Column:
    as_double = t.try_cast("double")
    return (
        F.when(t.startswith('"') | t.isin(*_PUNCT), t)
        .when(t == "true", F.lit("1"))
        .when(t == "false", F.lit("0"))
        .when(t.rlike("^-?[0-9]+$"), t)
        .when((F.abs(as_double) < F.lit(1e38)) & (as_double == F.rint(as_double)), _whole_digits(as_double))
        .otherwise(as_double.cast("string"))
    )


def canonical_text(json_text: Column) -> Column:
    """Canonical text of a ``to_json`` rendering (numbers unified)."""
    tokens = F.regexp_extract_all(json_text, F.lit(_TOKEN_RE), 0)
    return F.array_join(F.transform(tokens, _canon_token), "")


def canonical_map(obj: Column) -> Column:
    """``map<string, variant>`` -> ``map<string, string>`` of canonical values."""
    return F.transform_values(obj, lambda _k, v: canonical_text(F.to_json(v)))


def _canonical_of(text: Column, obj: Column) -> Column:
    """Canonical values of the object parsed from ``text``. Only booleans and
    numbers with a fraction or exponent can be spelled in more than one way
    once rendered; texts without anything like them need no token pass."""
    plain = F.transform_values(obj, lambda _k, v: F.to_json(v))
    return F.when(text.rlike(_RESPELLED), canonical_map(obj)).otherwise(plain)


def canonical_object(text: Column | str) -> Column:
    """Text -> canonical value map, NULL when not a JSON object (M1 + T2)."""
    return _canonical_of(_col(text), parsed_object(text))


def with_canonical_object(df: DataFrame, text: str, out: str, keep_object: str | None = None) -> DataFrame:
    """Add ``out`` = canonical value map of column ``text`` (NULL when the text
    is not one JSON object); with ``keep_object`` also the parsed
    ``map<string, variant>`` under that name.

    Staged projections: the wrapper map is referenced twice in the second
    one, so the optimizer keeps it materialised and each row is parsed once.
    """
    tmp = f"_{out}_outer"
    obj = keep_object or f"_{out}_obj"
    staged = df.withColumn(tmp, _wrapped_outer(F.col(text)))
    staged = staged.withColumn(obj, F.when(_outer_ok(F.col(text), F.col(tmp)), _inner(F.col(tmp)))).drop(tmp)
    done = staged.withColumn(out, _canonical_of(F.col(text), F.col(obj)))
    return done if keep_object else done.drop(obj)


def empty_if_null(m: Column) -> Column:
    """Turn a NULL map (non-object) into the empty object (M1 / M7)."""
    return F.coalesce(m, F.create_map().cast("map<string,string>"))


def key_matches(pred: Column, truth: Column) -> Column:
    """Number of truth keys present in ``pred`` with an equal value.

    Keys are unique in each map, so this is the size of the intersection of
    the two entry sets - no per-key lambda, each map is read once.
    """
    return F.size(F.array_intersect(F.map_entries(pred), F.map_entries(truth)))


def strict_accuracy(pred: Column, truth: Column) -> Column:
    """M2 on canonical maps (NULL pred = ``{}``; truth assumed non-NULL).

    matches / max(len(truth), len(pred)); empty truth gives 1.0 when the
    prediction is empty too, else 0.0.
    """
    pred = empty_if_null(pred)
    n_truth = F.size(truth)
    n_pred = F.size(pred)
    return (
        F.when(n_truth == 0, F.when(n_pred == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(key_matches(pred, truth) / F.greatest(n_truth, n_pred))
        .cast("double")
    )


def partial_score(pred: Column, truth: Column) -> Column:
    """M5: matches / len(truth); extra keys cost nothing; empty truth -> 0."""
    pred = empty_if_null(pred)
    n_truth = F.size(truth)
    return (
        F.when(n_truth == 0, F.lit(0.0))
        .otherwise(key_matches(pred, truth) / n_truth)
        .cast("double")
    )


def exact_match(pred: Column, truth: Column) -> Column:
    """M4: deep equality of the whole objects (same keys, equal values)."""
    pred = empty_if_null(pred)
    return (F.size(pred) == F.size(truth)) & (key_matches(pred, truth) == F.size(truth))


def ground_truth_object(expected_output: Column, other_columns: dict[str, Column]) -> Column:
    """M6: the ``expected_output`` object when it is one, else the row's other
    fields as an object (NULL values kept as JSON null). Returns JSON text.

    ``other_columns`` is fixed at plan time (the dataset schema minus
    ``prompt``/``expected_output``).
    """
    if other_columns:
        fallback = F.to_json(
            F.struct(*[c.alias(name) for name, c in other_columns.items()]),
            {"ignoreNullFields": "false"},
        )
    else:
        fallback = F.lit("{}")
    return F.when(is_object_text(expected_output), expected_output).otherwise(fallback)


def with_match_counts(df: DataFrame, pred: str, truth: str, prefix: str = "_") -> DataFrame:
    """Add ``<prefix>n_pred``, ``<prefix>n_truth`` and ``<prefix>matches``
    (NULL pred counts as ``{}``), each computed once per row."""
    p = empty_if_null(F.col(pred))
    t = F.col(truth)
    return df.withColumns(
        {
            f"{prefix}n_pred": F.size(p),
            f"{prefix}n_truth": F.size(t),
            f"{prefix}matches": key_matches(p, t),
        }
    )


def strict_from_counts(n_pred: Column, n_truth: Column, matches: Column) -> Column:
    """M2 from the three counts."""
    return (
        F.when(n_truth == 0, F.when(n_pred == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(matches / F.greatest(n_truth, n_pred))
        .cast("double")
    )


def partial_from_counts(n_truth: Column, matches: Column) -> Column:
    """M5 from the counts."""
    return F.when(n_truth == 0, F.lit(0.0)).otherwise(matches / n_truth).cast("double")


def exact_from_counts(n_pred: Column, n_truth: Column, matches: Column) -> Column:
    """M4 from the counts (equal key sets and all values equal)."""
    return (n_pred == n_truth) & (matches == n_truth)
