"""Dataset files with headers of their own (S2) and typed JSON cells (S3, V2, V4)."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from scorecraft.operators import validate as V
from scorecraft.sources import datasets as DS


def put(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "w", encoding=encoding, newline="") as f:
        f.write(text)


def blank(values):
    return all(v is None or not v.strip() for v in values)


def by_hand(text):
    """Header and rows as Python's csv module gives them."""
    reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))
    header = next(([v.strip() for v in r] for r in reader if not blank(r)), [])
    rows = []
    for values in reader:
        row = {h: (values[i] if i < len(values) else "") for i, h in enumerate(header) if h}
        if not blank(values) and not blank(row.values()):
            rows.append(row)
    return header, rows


FILES = {
    "plain.csv": "id,prompt,expected\n1,a,b\n2,c,d\n",
    "other_order.csv": "expected,id,prompt\nb,1,a\n",
    "separators_first.csv": ',,,\n" ",,\n\n id ,prompt,,expected\n1,a,junk,b\n,,junk,\n2,c,junk,d\n',
    "short_and_long.csv": "id,prompt,expected\n1\n2,c,d,e,f\n,,,beyond\n3,,z\n",
    "quoted.csv": 'id,"pro\nmpt",expected,prompt\n1,"x ""q"", {1,2}\ny",z,"a,b"\n',
    "one_column.csv": '"id, or not"\n"1,2"\n3\n',
    "marked.csv": "﻿id,prompt\n1,a\n",
    "repeated.csv": "id,prompt,id\n1,a,2\n",
    "only_blank.csv": ",,\n \n",
    "header_only.csv": "prompt,id\n\n,\n",
    "windows.csv": "id,prompt\r\n1,a\r\n\r\n2,b\r\n",
    "wide.csv": ",".join(f"c{i}" for i in range(600)) + "\n" + ",".join(str(i) for i in range(600)) + "\n",
}


def test_files_of_other_headers_read_together(spark, tmp_path):
    for name, text in FILES.items():
        put(tmp_path / "d", name, text)
    rows, headers = DS.read_dataset_csv_files(spark, str(tmp_path / "d"))
    found = {r.dataset.rsplit("/", 1)[1]: r.header for r in headers.collect()}
    assert found == {name: by_hand(text)[0] for name, text in FILES.items()}
    got = {}
    for r in rows.collect():
        cells = {k: v for k, v in r.asDict().items() if v is not None and k not in DS.ROW_KEYS}
        got.setdefault(r.dataset.rsplit("/", 1)[1], {})[r.row_index] = cells
    expected = {name: dict(enumerate(by_hand(text)[1], 1)) for name, text in FILES.items() if by_hand(text)[1]}
    assert got == expected
    assert rows.columns[:2] == ["dataset", "row_index"] and len(rows.columns) == len(set(rows.columns))


def test_each_file_against_its_own_header(spark, tmp_path):
    for name, text in FILES.items():
        put(tmp_path / "d", name, text)
    schema = {"id": int, "prompt": str}
    rows, headers = DS.read_dataset_csv_files(spark, str(tmp_path / "d"), list(schema))
    valid, bad = V.validate_files(rows, headers, schema)
    by_file = {}
    for r in bad.collect():
        by_file.setdefault(r.dataset.rsplit("/", 1)[1], []).append((r.row_index, r.column, r.rule))
    assert {k: sorted(v, key=str) for k, v in by_file.items()} == {
        "one_column.csv": [(None, "id", "missing_column"), (None, "prompt", "missing_column")],
        "only_blank.csv": [(None, "id", "missing_column"), (None, "prompt", "missing_column")],
        "wide.csv": [(None, "id", "missing_column"), (None, "prompt", "missing_column")],
        "short_and_long.csv": [(1, "prompt", "required"), (3, "prompt", "required")],
    }
    kept = sorted((r.dataset.rsplit("/", 1)[1], r.row_index, r.id) for r in valid.collect())
    assert ("repeated.csv", 1, 2) in kept and ("separators_first.csv", 2, 2) in kept and len(kept) == 11


def test_a_thousand_files(spark, tmp_path):
    orders = [["a", "b", "c"], ["c", "a", "b"], ["b", "x", "c", "a"]]
    for i in range(1000):
        cells = {"a": f"a{i}", "b": f"b{i}", "c": f"c{i}", "x": "x"}
        order = orders[i % 3]
        put(tmp_path / "d", f"f{i:04d}.csv", ",".join(order) + "\n" + (",".join(cells[n] for n in order) + "\n") * 2)
    rows = DS.read_dataset_csv(spark, str(tmp_path / "d"), ["a", "b", "c"])
    wrong = rows.filter(
        (F.concat(F.lit("b"), F.substring("a", 2, 9)) != F.col("b")) | (F.concat(F.lit("c"), F.substring("a", 2, 9)) != F.col("c"))
    )
    assert rows.count() == 2000 and wrong.count() == 0
    assert rows.agg(F.countDistinct("a"), F.max("row_index")).first() == (1000, 2)


def test_names_of_row_keys_are_refused(spark, tmp_path):
    put(tmp_path / "d", "a.csv", "row_index,x\n1,2\n")
    with pytest.raises(ValueError):
        DS.read_dataset_csv(spark, str(tmp_path / "d"))
    assert [r.x for r in DS.read_dataset_csv(spark, str(tmp_path / "d"), ["x"]).collect()] == ["2"]


REFUSED = object()


def python_cast(value, kind):
    """What Python makes of a JSON value."""
    if isinstance(value, kind):
        return value
    if kind is str:
        return str(value)
    try:
        return kind(value)
    except (TypeError, ValueError):
        return REFUSED


VALUES = [
    1, -7, 0, 12.7, -12.7, 12.0, 0.0, 0.1, 1e3, 1.5e-7, 0.00015, 1e15, 1e16, 123456789.125, 1.2345678901234567e22, 9007199254740993,
    True, False, "a", "12", " 12 ", "12.7", "1e3", "inf", "-5", "false", [], [1], [1, 2], {}, {"b": 1, "a": [2]},
]


@pytest.mark.parametrize("kind", [str, int, float, bool, dict, list])
def test_casts_follow_the_json_type(spark, tmp_path, kind):
    put(tmp_path / "d", "v.json", json.dumps([{"n": i, "v": v} for i, v in enumerate(VALUES)]))
    rows, headers = DS.read_dataset_json_files(spark, str(tmp_path / "d"), ["n", "v"], typed=True)
    valid, bad = V.validate_files(rows, headers, {"n": int, "v": kind})
    got = {r.n: r.v for r in valid.collect()}
    refused = {r.row_index - 1: r.rule for r in bad.collect()}
    for i, value in enumerate(VALUES):
        expected = python_cast(value, kind)
        if expected is REFUSED or (kind is int and abs(expected) >= 1 << 63):
            assert refused.pop(i) == "type", value
        elif kind in (dict, list) or (kind is str and isinstance(value, (dict, list))):
            assert json.loads(got.pop(i)) == (value if kind is str else sorted(expected) if isinstance(value, dict) and kind is list else expected)
        else:
            found = got.pop(i)
            assert type(found) is type(expected) or isinstance(value, bool), value
            assert found == expected, value
    assert got == {} and refused == {}


def test_number_texts(spark):
    values = [1.0, 100000.0, 1e7, 12345678.9, 1e15, 1.5e15, 9999999999999998.0, 1e16, 1.25e17, 1e100, 1e-3, 1e-4, 1.25e-4, 9.99e-5, 1e-5,
              -1e7, -2.5e-7, 2.5e-300, 1.7976931348623157e308, 0.0, -0.0, float("inf"), float("-inf"), float("nan"), 1 / 3, 2e-4 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(V.python_float_text(F.col("v")).alias("t")).collect()] == [str(v) for v in values]


def test_json_headers_by_file(spark, tmp_path):
    d = tmp_path / "d"
    put(d, "first.json", json.dumps([{}, {"id": " "}, {" id ": 1, "x": None}, {"prompt": "later"}]))
    put(d, "all_empty.json", json.dumps({"rows": [{}, {"id": ""}]}))
    put(d, "no_rows.json", json.dumps({"data": []}))
    put(d, "broken.json", "[1, 2]")
    put(d, "good.json", json.dumps({"id": "7", "prompt": "p"}))
    schema = {"id": int, "prompt": str}
    rows, headers = DS.read_dataset_json_files(spark, str(d), list(schema), typed=True)
    assert {r.dataset.rsplit("/", 1)[1]: sorted(r.header) for r in headers.collect()} == {
        "first.json": ["id", "x"], "all_empty.json": [], "good.json": ["id", "prompt"],
    }
    valid, bad = V.validate_files(rows, headers, schema)
    assert [(r.id, r.prompt) for r in valid.collect()] == [(7, "p")]
    assert sorted((r.dataset.rsplit("/", 1)[1], r.column or "", r.rule) for r in bad.collect()) == [
        ("all_empty.json", "id", "missing_column"), ("all_empty.json", "prompt", "missing_column"),
        ("broken.json", "", "unreadable"), ("first.json", "prompt", "missing_column"),
    ]


def test_valid_json_rows_read_each_file_once(spark, tmp_path):
    for n, text in enumerate(['{"rows":[{"a":1,"b":"x"},{"a":"y","b":"z"}]}', '[{"a":1}]', '[{"a":1,"b":"w"},3]', '{"a":4,"b":"v"}', "nothing"]):
        (tmp_path / f"{n}.json").write_text(text)
    rows, headers = DS.read_dataset_json_files(spark, str(tmp_path), ["a", "b"], typed=True)
    valid, violations = V.validate_files(rows, headers, {"a": int, "b": str})
    plan = valid._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan text") == 1 and "Join" not in plan
    assert sorted((r.dataset[-6], r.row_index, r.a, r.b) for r in valid.collect()) == [("0", 1, 1, "x"), ("3", 1, 4, "v")]
    assert sorted((r.dataset[-6], r.row_index or 0, r.column or "", r.rule, r.value or "") for r in violations.collect()) == [
        ("0", 2, "a", "type", "y"), ("1", 0, "b", "missing_column", ""),
        ("2", 0, "", "unreadable", DS.ERR_NOT_OBJECT), ("4", 0, "", "unreadable", DS.ERR_INVALID),
    ]
