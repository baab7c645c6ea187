import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scorecraft.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def brute(rows, k, every):
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, qv in {(i, tuple(v)) for i, v in ints if i is not None and i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for i, v in ints if i != q)
        out.update((q, r, None if null else i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, null, i) in enumerate(scored[:k], 1))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(500 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(600, None), (610, [1.0, None] * 4), (620, [float("nan")] * 8), (630, [float("inf")] * 8), (None, rows[3][1])]
    rows += [(640, []), (650, [0.5, -0.5]), (660, [0.0] * 8), (10, rows[10][1]), (20, rows[50][1])]
    df = spark.createDataFrame([(i, v, 0, 7) for i, v in rows], SCHEMA).repartition(3)
    for options in ({}, {"candidates_per_block": 40, "queries_per_block": 7}):
        got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, **options).collect()
        assert Counter(map(tuple, got)) == brute(rows, 5, 10)


def test_huge_components_few_rows_and_empty_table(spark):
    rows = [(0, [1e30, 2.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [1e-3, 3.0])]
    df = spark.createDataFrame([(i, v, 0, 7) for i, v in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0).collect()
    assert Counter(map(tuple, got)) == brute(rows, 5, 3)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 3 == 0).collect() == []
