import zlib
from collections import Counter
from fractions import Fraction

from scorecraft.llm import mixing, sharding
from scorecraft.session import settings

from edge_cases import edge_rows


def size_of(text):
    return len((text or "").encode()) + 16


def test_shards_hold_every_row_once_in_equal_bytes(spark, edge):
    rows = sharding.assign_shards(edge, shards=5).collect()
    want = Counter((i, size_of(t), zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in range(5):
        assert abs(sum(r["size"] for r in rows if r["shard"] == shard) - total / 5) <= largest


def test_equal_texts_are_neighbours(spark, edge):
    rows = sorted(sharding.assign_shards(edge, shards=4).collect(), key=lambda r: (r["shard"], r["slot"]))
    crcs = [r["text_crc32"] for r in rows]
    runs = [c for i, c in enumerate(crcs) if i == 0 or crcs[i - 1] != c]
    assert len(runs) == len(set(crcs))


def test_a_text_with_very_many_copies_is_cut(spark):
    rows = [(i, "copy of one text") for i in range(900)] + [(1000 + i, f"text {i}") for i in range(100)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 2 * 40


def test_overfull_ranges_are_subdivided_and_place_rows_alike(spark, scratch):
    """A third of the rows equal in id and text; few and small ranges allowed."""
    rows = [(7, "the very same record")] * 300 + [(100 + i, f"text {i} " * (1 + i % 9)) for i in range(600)]
    docs = spark.read.parquet(scratch(spark.createDataFrame(rows, "doc_id long, text string"), 3))
    seen = []
    pieces = sharding.subdivided

    def spy(ranged, most):
        out = pieces(ranged, most)
        seen.append({(r[0], r[1]): r[2] for r in out.groupBy("__range", "__sub").sum("__size").collect()})
        return out

    sharding.subdivided = spy
    try:
        one = sharding.assign_shards(docs, shards=6).collect()
        other = sharding.assign_shards(docs, shards=6, range_bytes=1500, max_ranges=4).collect()
    finally:
        sharding.subdivided = pieces
    assert Counter(map(tuple, one)) == Counter(map(tuple, other))
    assert {sub for _, sub in seen[0]} == {0} and len({r for r, _ in seen[1]}) <= 4
    total = sum(seen[1].values())
    assert len(seen[1]) > 4 and max(seen[1].values()) < 0.5 * total


def test_carried_columns_and_empty_table(spark, edge, empty, tmp_path):
    got = sharding.assign_shards(edge, shards=2, carry=["lang", "label"])
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "lang", "label"]
    assert sharding.assign_shards(empty).collect() == []
    sharding.write_shards(edge.select("doc_id", "text", "lang"), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(edge_rows()) and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def word_total(text):
    return len((text or "").encode().split())


def test_targets_against_exact_arithmetic(spark, edge):
    sizes = Counter()
    for _, text, _, source, _ in edge_rows():
        sizes[source] += word_total(text)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        level = Fraction(rest, sum(weight[s] for s in order if s not in capped) or 1)
        over = {s for s in order if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}
    rows = mixing.repeats(edge, carry=["source"]).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r["__ssize"] == sizes[r["source"]] and abs(r["__target"] - float(target[r["source"]])) < 1e-6
        assert 0 <= r["__times"] <= 3
    for s in order:  # the nearest sum of whole documents along the hashes
        taken = sum(r["__size"] * r["__times"] for r in rows if r["source"] == s)
        assert abs(taken - float(target[s])) <= max([r["__size"] for r in rows if r["source"] == s]) * 3
    again = mixing.repeats(edge.repartition(7), carry=["source"]).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))


def test_mix_repeats_rows_and_keeps_columns(spark, edge, empty):
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    times = Counter((r["__id"], r["__size"]) for r in mixing.repeats(edge).collect() for _ in range(r["__times"]))
    assert Counter((r["doc_id"], word_total(r["text"])) for r in mixed.collect()) == times
    assert mixing.mix(empty).collect() == []


def test_a_hot_source_is_dealt_over_many_keys(spark):
    """No exchange deals rows by source alone, broadcast or not."""
    rows = [(i, f"w{i}", "hot" if i % 3 else f"s{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan = mixing.repeats(docs)._jdf.queryExecution().executedPlan().toString()
        got = mixing.repeats(docs).collect()
    assert "hashpartitioning(__skey" in plan and "__salt" in plan.split("hashpartitioning(__skey", 1)[1][:60]
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.repeats(docs).collect()))


def test_nested_budgets(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    less = {r["__id"]: r["__times"] for r in mixing.repeats(docs, weights=(3, 2)).collect()}
    more = {r["__id"]: r["__times"] for r in mixing.repeats(docs, weights=(4, 2)).collect()}
    assert all(more[i] >= less[i] for i in less if i % 2 == 0) and more != less
