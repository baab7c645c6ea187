import hashlib
import os
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scorecraft.llm import exact_dedup

from edge_cases import edge_rows

DROP = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").translate(DROP)].append((-len(text or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("collide", [False, True])
def test_groups_against_brute_force(spark, edge, monkeypatch, collide):
    if collide:  # equal digests of different texts must be told apart by their bytes
        length = lambda text: F.length(exact_dedup.normalised(text))
        monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.when(length(text) % 2 == 0, "00").otherwise("01")))
    path = edge.inputFiles()[0].rsplit("/", 1)[0]
    rows = exact_dedup.dedup_table(spark, path).collect()
    want = brute(edge_rows())
    assert sum(r["kept"] for r in rows) == len(want) and len(rows) == len(edge_rows())
    expected = Counter((i, *want[(t or "").translate(DROP)]) for i, t, *_ in edge_rows())
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == expected
    if not collide:
        sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
        assert all((r["keep_id"], r["group_size"]) == sha[r["text_sha256"]] for r in rows)


def test_rows_that_stay(spark, edge, empty):
    kept = exact_dedup.dedup(edge.filter("doc_id is not null").select("doc_id", "text", "lang", "label"))
    assert kept.columns == ["doc_id", "text", "lang", "label"]
    assert len({(r["text"] or "").translate(DROP) for r in kept.collect()}) == kept.count()
    assert exact_dedup.dedup(empty).collect() == []


def test_state_takes_new_files_and_never_counts_twice(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "state")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    make([(1, "a b"), (2, "c")]).write.parquet(path)
    first = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_table(spark, path, state=state).collect()}
    assert first == {1: (1, 1), 2: (2, 1)}
    make([(3, "a  b"), (4, "c")]).write.mode("append").parquet(path)
    for _ in range(2):  # the second run reads no file
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_table(spark, path, state=state).collect()}
        assert got == {1: (3, 2), 3: (3, 2), 2: (2, 2), 4: (2, 2)}


def test_state_takes_added_files_of_older_modification_time(spark, tmp_path):
    path, state = tmp_path / "t", str(tmp_path / "state")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    make([(1, "a b"), (2, "c")]).write.parquet(str(path))
    exact_dedup.dedup_table(spark, str(path), state=state).collect()
    before = set(path.glob("*.parquet"))
    make([(3, "a  b"), (4, "d")]).write.mode("append").parquet(str(path))
    for added in set(path.glob("*.parquet")) - before:
        os.utime(added, (time.time() - 400 * 86400,) * 2)
    rows = exact_dedup.dedup_table(spark, str(path), state=state).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}
