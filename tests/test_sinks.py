"""Exports by name (K1, K4), claimed versions (K5) and the report over stored
artifacts (E3)."""

import csv
import json
import os
import pickle
import threading
import tracemalloc

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scorecraft.operators import accuracy as A
from scorecraft.operators import compare as C
from scorecraft.operators import source_scores as SS
from scorecraft.plans import catalog
from scorecraft.plans import derived as D
from scorecraft.sources import named_files as NF
from scorecraft.sources import reports as RP
from scorecraft.sources import sinks as SK

REPORTS = "model string, case_id string, row_index int, status string, score double, llm_output string, error_message string"
ROWS = [
    ("org/model:1", "set__one", 2, "completed", 0.5, '{"a": "x,\\"y\\"\nz"}', ""),
    ("org/model:1", "set__one", 10, "failed", 0.0, "", "boom, \"bad\""),
    ("org/model:1", "set__one", 1, "completed", 1.0, "  {}  ", None),
    ("b", "two", 1, "completed", 1.0, "{}", ""),
]


def names(folder):
    return sorted(n for n in os.listdir(folder) if not n.endswith(".crc"))


def test_reports_are_read_back_by_name(spark, tmp_path):
    out = str(tmp_path / "export")
    SK.export_run_reports_csv(spark.createDataFrame(ROWS, REPORTS).repartition(4), out)
    assert names(out) == ["b__two.csv", "org_model_1__set__one.csv"]
    with open(f"{out}/org_model_1__set__one.csv", newline="", encoding="utf-8") as f:
        table = list(csv.reader(f))
    assert table[0] == RP.REPORT_FIELDS
    assert [r[0] for r in table[1:]] == ["1", "2", "10"] and table[1][3] == "  {}  " and table[2][3] == ROWS[0][5]
    back = {(r.model, r.source, r.row_index): (r.status, r.score, r.llm_output, r.error_message) for r in RP.read_run_reports(spark, out).collect()}
    assert back == {
        ("org_model_1", "set", 1): ("completed", 1.0, "  {}  ", ""),
        ("org_model_1", "set", 2): ("completed", 0.5, ROWS[0][5], ""),
        ("org_model_1", "set", 10): ("failed", 0.0, "", 'boom, "bad"'),
        ("b", "two", 1): ("completed", 1.0, "{}", ""),
    }


def test_files_of_other_names_stay_and_equal_names_are_refused(spark, tmp_path):
    out = str(tmp_path / "export")
    one, other = spark.createDataFrame(ROWS[3:], REPORTS), spark.createDataFrame(ROWS[:3], REPORTS)
    SK.export_run_reports_csv(one, out)
    SK.export_run_reports_csv(other, out)
    assert len(names(out)) == 2
    with pytest.raises(Exception, match="there already"):
        SK.export_run_reports_csv(one, out, overwrite=False)
    SK.export_run_reports_csv(one.withColumn("score", F.lit(0.25)), out)
    assert {r.score for r in RP.read_run_reports(spark, out, model="b").collect()} == {0.25}
    assert len(names(out)) == 2  # nothing is left of the attempts
    clash = one.unionByName(one.withColumn("model", F.lit("b.")))
    with pytest.raises(ValueError, match="several runs"):
        SK.export_run_reports_csv(clash, out)


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "export")
    rows = spark.createDataFrame([("a.txt", b"1"), ("b.txt", b"2")], NF.FILE_ROWS)
    bad = rows.withColumn("content", F.when(F.col("file") == "b.txt", F.raise_error(F.lit("late")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception):
        NF.write_named_files(bad, out, [])
    assert not os.path.isdir(out) or names(out) == []
    with pytest.raises(Exception, match="not a file name"):
        NF.write_named_files(rows.withColumn("file", F.lit("../x")), out, [])


def test_rows_of_a_file_in_two_tasks_are_an_error(spark, tmp_path):
    spark.dataSource.register(NF.NamedFiles)
    rows = spark.createDataFrame([("a.txt", b"1"), ("a.txt", b"2")], NF.FILE_ROWS).repartition(2)
    with pytest.raises(Exception, match="not together"):
        rows.write.format(NF.FORMAT).mode("append").save(str(tmp_path / "x"))


def test_runtime_datasets_by_name(spark, tmp_path):
    out = str(tmp_path / "runtime")
    rows = [("m", "c", i, f"p{i}", json.dumps({"n": i})) for i in (3, 1, 2)] + [("m", "d", 1, "only", "{}")]
    SK.write_eval_dataset(spark.createDataFrame(rows, "model string, case_id string, row_index int, prompt string, expected_output string"), out)
    assert names(out) == ["m__c.json", "m__d.json"]
    with open(f"{out}/m__c.json") as f:
        assert json.load(f) == {"rows": [{"prompt": f"p{i}", "expected_output": {"n": i}} for i in (1, 2, 3)]}
    truths = {r.case_key: json.loads(r.ground_truth) for r in RP.read_ground_truths(spark, out).collect()}
    assert truths == {"m__c": {"n": 1}, "m__d": {}}


def test_two_writers_at_once_get_two_versions(spark, tmp_path):
    runs = spark.createDataFrame(
        [("a", "x", "completed", 1.0, 2.0, 1)], "model string, case_id string, status string, average_score double, elapsed_seconds double, run_index long"
    )
    report, path, got = C.overall_report(runs), str(tmp_path / "versions"), []
    start = threading.Barrier(4)

    def write():
        start.wait()
        got.append(SK.write_overall_report(report, path, preserve=True))

    threads = [threading.Thread(target=write) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(p.rsplit("=", 1)[1] for p in got) == ["1", "2", "3", "4"]
    assert all(RP.read_overall_report(spark, p).count() == 4 for p in got)
    assert SK.write_overall_report(report, path, preserve=True).endswith("version=5")


def test_store_is_pruned_to_source_and_model(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(m, s, "c", i, "completed" if i else "failed", 0.5, '{"a": 1}', "") for m in "ab" for s in ("x", "y") for i in range(3)]
    reports = spark.createDataFrame(rows, "model string, source string, case_id string, row_index int, status string, score double, llm_output string, error_message string")
    SK.write_run_reports(reports, store)
    truths = spark.createDataFrame([("a__x__c", '{"a": 1}'), ("b__x__c", "{}")], "case_key string, ground_truth string")
    found = A.stored_evaluations(spark, store, truths, " x ", "a")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters:"):].split("PushedFilters", 1)[0]
    assert "model" in pruned and "source" in pruned and "= x" in pruned and "= a" in pruned
    assert found.count() == 2
    files = spark.read.parquet(store).filter("model = 'a' AND source = 'x'").select(F.input_file_name()).distinct().count()
    assert files < spark.read.parquet(store).select(F.input_file_name()).distinct().count()
    scopes = {(r.scope, r.name): r for r in A.stored_accuracy(spark, store, truths, "x").collect()}
    assert scopes["overall", "overall"].total_evaluations == 4 and scopes["model", "a"].exact_accuracy_percent == 100.0


def test_source_columns_from_rows_equal_those_from_run_sums(spark):
    """J7/J8 on report rows (as published) and from per-run sums (one pass)."""
    small = "/root/testdata/sf0.001"
    reports = catalog._eval_reports(spark, small)
    sums = catalog._models_with_sources(spark, small, catalog.PRIORITIES)
    models = sums.drop(*catalog.PRIORITIES)
    rows = SS.add_source_scores(models, reports, catalog.PRIORITIES)
    one = SS.add_source_score(models, reports, catalog.FOCUS_SOURCE)
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(sums.columns)).collect())
    assert key(rows) == key(sums)
    pick = lambda df: {r.model: r[catalog.FOCUS_SOURCE] for r in df.collect()}
    assert pick(one) == pytest.approx(pick(sums))


def test_winners_only_if_both_are_there(spark):
    runs = D.runs(spark, "/root/testdata/sf0.001")
    report = C.overall_report(runs)
    assert sorted(r.section for r in C.winners_if_complete(report).collect()) == [C.BEST_SECTION, C.FASTEST_SECTION]
    for lost in (C.BEST_SECTION, C.FASTEST_SECTION):
        assert C.winners_if_complete(report.filter(F.col("section") != lost)).collect() == []


def test_truths_of_one_source_and_model_are_read_alone(spark, tmp_path):
    rows = [(m, s, c, n, "p", json.dumps({"n": n})) for m in ("m", "m/2") for s in ("s", "s_t", "t__s") for c in ("c", "d") for n in (2, 1)]
    runs = spark.createDataFrame(rows, "model string, source string, case_id string, row_index int, prompt string, expected_output string")
    SK.write_eval_dataset(runs, str(tmp_path), keys=("model", "source", "case_id"))
    read = lambda **which: RP.read_ground_truths(spark, str(tmp_path), **which)
    assert sorted(r.case_key for r in read(source=" s ", model="m/2").collect()) == ["m_2__s__c", "m_2__s__d"]
    assert len(read(source=" s ", model="m/2").inputFiles()) == 2
    assert read(model="m").count() == 6 and read().count() == 12
    assert {r.ground_truth for r in read().collect()} == {'{"n":1}'}
    with open(tmp_path / "m__s__c.json") as f:
        assert [r["expected_output"] for r in json.load(f)["rows"]] == [{"n": 1}, {"n": 2}]


def _write_by_tasks(path, tasks, overwrite=True):
    """The steps of a job: each task writes, then the commit gets their messages."""
    writer = NF.NamedFilesWriter(path, overwrite)
    return writer, [writer.write(iter(Row(file=n, content=c) for n, c in task)) for task in tasks]


def test_the_driver_holds_no_list_of_files(tmp_path):
    """Neither the messages nor the commit grow with the files (memory of the driver)."""
    writer, messages = _write_by_tasks(str(tmp_path), [[(f"m{t}__s__block_{i:05}.json", b"{}") for i in range(5000)] for t in range(4)])
    assert max(len(pickle.dumps(m)) for m in messages) < 1000
    tracemalloc.start()
    writer.commit(messages)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 2_000_000
    assert len(names(tmp_path)) == 20_000


def test_rows_that_come_unsorted(tmp_path):
    def write(tasks, overwrite=True):
        writer, messages = _write_by_tasks(str(tmp_path), tasks, overwrite)
        writer.commit(messages)

    write([[("ü\n", b"1"), ("a", b"2"), ("a", b"3"), ("z", b"")], [("\U0001f600", b"5"), ("＀", b"6")], []])
    assert {n: (tmp_path / n).read_bytes() for n in names(tmp_path)} == {"ü\n": b"1", "a": b"23", "z": b"", "\U0001f600": b"5", "＀": b"6"}
    for tasks in ([[("c", b"1"), ("b", b"2"), ("c", b"3")]], [[("d", b"1"), ("c", b"1")], [("c", b"2")]]):
        with pytest.raises(ValueError, match="not together: \\['c'\\]"):
            write(tasks)
    with pytest.raises(FileExistsError, match="2 files are there already"):
        write([[("z", b"0"), ("y", b"0")], [("a", b"0")]], overwrite=False)
    assert (tmp_path / "a").read_bytes() == b"23" and len(names(tmp_path)) == 5


def test_large_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    for name in ("m__s__c", "m__s__d", "m__t__c", "n__s__c", "n__s__\xe4 %41[^\\`{|}]\"#<>?,;$&+=@~'()*!\xa0"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"rows": [{"expected_output": {"n": name}}]}))
    for name in ("_m__s__x.json", ".m__s__x.json", "m__s__x.txt", "m__s__empty.json"):
        (tmp_path / name).write_text("" if "empty" in name else '{"rows":[{"expected_output":{"n":0}}]}')
    (tmp_path / "m__s__bad.json").write_bytes(b'\xef\xbb\xbf{"rows": [\xff')
    (tmp_path / "m__s__folder.json").mkdir()
    (tmp_path / "m__s__folder.json" / "m__s__in.json").write_text("{}")
    read = lambda **which: RP.read_ground_truths(spark, str(tmp_path), **which)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    asked = ({}, {"model": "m"}, {"source": " s "}, {"source": "s", "model": "m"}, {"model": "none"})
    by_driver = [rows(read(**which)) for which in asked]
    assert [len(r) for r in by_driver] == [6, 4, 5, 3, 0] and len(read().inputFiles()) > 0
    monkeypatch.setattr(NF, "LARGE_FOLDER", 1)
    assert [rows(read(**which)) for which in asked] == by_driver
    assert len(read().inputFiles()) == 0  # the driver holds no list
    truths = read()
    join = A.reports_with_truth(truths.select("case_key"), truths, keys=("case_key",))
    assert "BroadcastHashJoin" not in join._jdf.queryExecution().sparkPlan().toString()
    assert rows(RP.read_ground_truths(spark, [str(tmp_path), f"file:{tmp_path}/m__t*"])) == sorted([*by_driver[0], ("m__t__c", '{"n":"m__t__c"}')])
    (tmp_path / "k" / "version=1").mkdir(parents=True)  # Spark's reader looks into folders that name partitions
    (tmp_path / "k" / "version=1" / "o__s__c.json").write_text("{}")
    assert rows(RP.read_ground_truths(spark, str(tmp_path / "k"))) == [("o__s__c", "{}")]
