import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import lm
from scorecraft.llm.common import fold

from edge_cases import edge_rows


def brute(rows, train, mu, added):
    texts = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    uni, pairs, before = Counter(), Counter(), Counter()
    for i, t in texts:
        if train(i):
            uni.update(t)
            pairs.update(zip([b"\n", *t], t))
            before.update([b"\n", *t[:-1]])
    total, kinds = sum(uni.values()), len(uni)
    out = []
    for i, t in texts:
        base = [(uni[w] + added) / (total + added * (kinds + 1)) for w in t]
        full = [(pairs[v, w] + mu * p) / (before[v] + mu) for v, w, p in zip([b"\n", *t], t, base)]
        out.append((i, len(t), sum(uni[w] > 0 for w in t), total, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4], round(r[4], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def in_fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


@pytest.mark.parametrize("block_bytes", [500, 1 << 23])
def test_scores_against_brute_force(spark, edge, block_bytes):
    got = lm.score_texts(edge, train=fold(F.col("doc_id")) != 1, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), brute([(i, t) for i, t, *_ in edge_rows()], lambda i: in_fold(i) != 1, lm.MU, lm.ADDED))


def test_rows_of_a_filtered_table(spark, edge):
    some = edge.filter("doc_id % 2 = 0 OR doc_id IS NULL")
    want = brute([(i, t) for i, t, *_ in edge_rows() if i is None or i % 2 == 0], lambda i: in_fold(i) != 1, lm.MU, lm.ADDED)
    same(lm.score_texts(some, train=fold(F.col("doc_id")) != 1, block_bytes=2000).collect(), want)


def test_no_training_text_and_empty_table(spark, edge, empty):
    got = lm.score_texts(edge, train=F.lit(False)).collect()
    same(got, brute([(i, t) for i, t, *_ in edge_rows()], lambda i: False, lm.MU, lm.ADDED))
    assert lm.score_texts(empty, train=F.lit(True)).collect() == []


def test_predictions_of_a_state_add_up_to_one():
    block = lm.Block(["a b a c", "b b c", "a"])
    words, pairs = block.told(np.array([True, True, True]))
    total, kinds = words[1:].sum(), len(words) - 1
    base = (words + 0.5) / (total + 0.5 * (kinds + 1))
    for state in (0, 2, 3, 4):
        seen = dict(zip(block.pairs, pairs))
        p = [(seen.get(state * block.size + w, 0) + 7 * base[w]) / (words[state] + 7) for w in range(1, block.size)]
        unknown = 7 / (words[state] + 7) * 0.5 / (total + 0.5 * (kinds + 1))
        assert abs(sum(p) + unknown - 1) < 1e-12


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
    assert len(lm.unpack_keys(lm.pack_keys(keys[:0]))) == 0
    assert (lm.part_of(keys, 7) == [int(k) >> 32 and (int(k) >> 32) * 7 >> 32 for k in keys]).all()


def test_model_beats_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_texts(docs, train=fold(F.col("doc_id")) != 1).filter(fold(F.col("doc_id")) == 1)
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.95 * base
