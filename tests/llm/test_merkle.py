import zlib
from collections import Counter
from hashlib import sha256

import pytest
from edge_cases import DOCS, edge_rows, words
from pyspark.sql import functions as F

from scorecraft.llm import merkle
from scorecraft.llm.common import lower_ascii


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if f is None else f"{len(f.encode())}:{f}" for f in fields])


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """Root, and for each leaf its runs of siblings with its place in them."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for way, i in zip(ways, at):
            run = level[i - i % 16 : i - i % 16 + 16]
            way.append((run[: i % 16], run[i % 16 + 1 :]))
        at = [i // 16 for i in at]
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], ways


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        shown = leaf_of(doc_id, text, lang, source, n)
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            shown = leaf_of(doc_id, lowered(text), lang, source, n)
        key = (source is not None, (source or "").encode())
        groups.setdefault(key, []).append(((doc_id is not None, doc_id or 0), leaf_of(doc_id, text, lang, source, n), shown))
    keys = sorted(groups)
    trees = {}
    for key in keys:
        groups[key].sort()
        trees[key] = tree([leaf for _, leaf, _ in groups[key]])
    root, tops = tree([trees[key][0] for key in keys])
    out = Counter()
    for key, top in zip(keys, tops):
        for ((known, doc_id), leaf, shown), way in zip(groups[key], trees[key][1]):
            way = way + top
            f = shown
            for left, right in way:
                f = h(*left, f, *right)
            proof = h(*[x for left, right in way for x in left + right])
            out[(doc_id if known else None, leaf, trees[key][0], root, proof, f, f == root)] += 1
    return out


def judged(docs, height=merkle.HEIGHT):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = merkle.document_leaves(docs, tampered, lower_ascii(F.col("text")))
    return Counter(tuple(r) for r in merkle.proofs(merkle.build_manifest(leaves, height)).collect())


def test_addresses_are_a_layout():
    for levels in range(1, 5):
        places = merkle.addresses(levels)
        assert [len(p) for p in places] == [16**d for d in range(levels)]
        flat = sorted(int(x) for p in places for x in p)
        assert flat == list(range(len(flat)))
    # four levels: a top tree of two, and below it trees of two, each contiguous
    root, second, third, leaves = merkle.addresses(4)
    assert root[0] == 0 and list(second) == list(range(1, 17))
    assert third[3] == 17 + 3 * 17 and list(leaves[48:64]) == list(range(third[3] + 1, third[3] + 17))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 250, 256])
def test_block_nodes_by_address(n):
    digests = [sha256(bytes([i])).digest() for i in range(n)]
    edges = merkle.edges_for(n)
    nodes, root = merkle.build_block(digests, edges)
    expected, ways = tree([d.hex() for d in digests])
    assert root.hex() == expected
    runs = merkle.leaf_runs(nodes, edges, n)
    for i in range(n):
        steps = merkle.steps_of(runs, i)
        assert merkle.fold(digests[i], steps) == root
        assert merkle.proof_digest(steps) == h(*[x for left, right in ways[i] for x in left + right])


def test_edge_rows(edge):
    assert judged(edge) == brute(edge_rows())


@pytest.mark.parametrize("height", [1, 2])
def test_large_source_many_sources_and_equal_rows(spark, scratch, height):
    rows = [(i, words(i, 3), "en", "hot", 1) for i in range(700)]
    rows += [(7, "Same Row", "en", "hot", 1)] * 300
    rows += [(2000 + i, words(i, 2).upper(), "de", f"s{i % 40}", i) for i in range(90)]
    rows += [(5000, "X", None, None, None)]
    docs = spark.read.parquet(scratch(spark.createDataFrame(rows, DOCS)))
    got = judged(docs, height)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_empty_table(spark, empty):
    assert judged(empty) == Counter()
    rows = [(5, "Only", "en", "a", 4)]
    assert judged(spark.createDataFrame(rows, DOCS)) == brute(rows)
