from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd

from scorecraft.llm import components, near_dedup

from edge_cases import edge_rows, words


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    group = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for g, (i, s) in zip(group, sets):
        ids[g].append(i)
    low = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    return Counter((i, len(s), low[g] if s else i) for g, (i, s) in zip(group, sets))


def result(docs, **options):
    rows = near_dedup.near_duplicates(docs, **options).collect()
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def test_edge_cases_against_brute_force(spark, edge, empty):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    assert result(edge, width=4) == brute(rows, 4)
    assert result(edge, width=5) == brute(rows, 5)
    assert near_dedup.near_duplicates(empty).collect() == []


def variants(seed, n, length, edits):
    """Near copies of one text: words replaced, here and there the same ones."""
    rng, base = np.random.default_rng(seed), words(seed, length).split()
    for i in range(n):
        text = base.copy()
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            text[at] = f"edit{rng.integers(0, 3)}"
        yield " ".join(text)


def test_large_groups_of_near_copies_against_brute_force(spark):
    texts = [*variants(7, 150, 90, 8), *variants(8, 40, 300, 25), *variants(9, 60, 12, 2)]
    passage = words(99, 60)  # in many texts that are not similar
    texts += [f"{words(200 + i, 45)} {passage} {words(400 + i, 30)}" for i in range(60)]
    texts += [words(600 + i, 40) for i in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs, width=4) == brute(rows, 4)


def test_one_row_of_each_group_stays(spark, edge, empty):
    kept = near_dedup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    groups = brute([(i, t) for i, t, *_ in edge_rows()], 5)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert {i for i in ids if i is not None} >= {c for i, n, c in groups if n and c is not None}
    blank = sum(not (t or "").split() for _, t, *_ in edge_rows())
    assert sum(not (r["text"] or "").split() for r in kept.collect()) == blank
    assert ids[20] == 1  # repeated rows
    assert near_dedup.drop_near_duplicates(empty).collect() == []


def test_bounds():
    assert near_dedup.floor_of(64, 80) > 64 * 0.4 and near_dedup.floor_of(10, 0) == 0
    for n in range(1, 200):
        assert 1 <= near_dedup.prefix_length(n, 64) <= min(n, 64)


def test_near_members_are_linked_once_per_group():
    base = np.arange(100, dtype=np.uint64)
    rows = []
    for i, (gone, more, linked) in enumerate([(0, 0, True), (30, 30, False), (31, 31, False), (2, 2, True)]):
        mask = np.ones(100, bool)
        mask[:gone] = False
        extra = np.arange(1000, 1000 + more, dtype=np.uint64)
        rows.append((bytes([i]), 100 - gone + more, np.packbits(mask).tobytes(), extra.tobytes(), linked, not linked, True))
    frame = pd.DataFrame(rows, columns=["node", "n", "mask", "extra", "linked", "near", "other"])
    assert list(near_dedup.block_links(frame)) == [(b"\1", b"\2")] and len(base) == 100


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in links], "a string, b string")
    got = {r["node"]: r["label"] for r in components.connected_components(df).collect()}
    assert got == {f"{i:04}": "0000" for i in range(41)} | {f"{i:04}": "0100" for i in range(100, 160)} | {"0200": "0200", "0201": "0200"}
