"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are turned into integers. A component's position is a term, and the
candidates of a block with a weight other than 0 there are its posting list.
Each query row scatters its own weights times the postings' into a dense array
of one score per candidate; a partition selection takes the k best of the
block, and the blocks' winners are merged by rank.

Scale: queries and candidates are dealt into blocks by hash and each pair of
blocks is one group of bounded size, so neither side is broadcast and no group
grows with the data. What is sent is queries x candidate blocks + candidates x
query blocks; larger blocks send less and need more memory.

Defined cases: vectors that are null or hold null or non-finite components
take no part; an empty vector scores 0; vectors of unequal length are compared
over the positions that both have; scores beyond a long end at its limits.
Rows with a null id are candidates (after all others in a tie), never queries.
Repeated rows with the same id and vector are one query, and no candidate of
themselves; as candidates each counts. Fewer candidates than k give all of
them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
SCALE = 256
CANDIDATES_PER_BLOCK = 1 << 15
QUERIES_PER_BLOCK = 1 << 10
#: Scores held at once, in one dense array.
SCORES = 1 << 20


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``__id, __vec`` (array of double holding whole numbers) of the valid rows."""
    vec = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    big = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.col(vector_col).isNotNull() & F.forall(
        big, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return table.filter(sound).select(F.col(id_col).cast("long").alias("__id"), vec.alias("__vec"))


def postings(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position, the rows with a weight there and the weights."""
    lengths = np.fromiter((len(v) for v in vectors), np.int64, len(vectors))
    rows = np.repeat(np.arange(len(vectors)), lengths)
    flat = np.concatenate(vectors) if vectors else np.empty(0)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    filled = flat != 0
    rows, flat, place = rows[filled], flat[filled], place[filled]
    order = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place, minlength=int(lengths.max(initial=0))))
    return [(rows[p], flat[p]) for p in np.split(order, ends[:-1])] if len(ends) else []


def whole(values: np.ndarray, exact: bool) -> np.ndarray:
    """Integers: longs where every sum fits, else Python's."""
    return values.astype(np.int64) if exact else np.array([int(v) for v in values], dtype=object)


def best(scores: np.ndarray, skip: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, lower positions first in a tie;
    partition selection, then a sort of the few."""
    live = np.flatnonzero(~skip)
    if len(live) > k:
        s = scores[live]
        floor = np.partition(s, len(s) - k)[len(s) - k]
        above = live[s > floor]
        live = np.concatenate([above, live[s == floor][: k - len(above)]])
    return live[np.lexsort((live, -scores[live]))] if scores.dtype != object else np.array(
        sorted(live, key=lambda i: (-scores[i], i)), dtype=np.int64
    )


def search_block(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> Iterator[tuple]:
    """``query, vec_id, score`` of the k best candidates of a block."""
    order = np.lexsort((candidates["__id"].fillna(0).to_numpy(np.int64), candidates["__id"].isna().to_numpy()))
    candidates = candidates.iloc[order]
    vecs = [np.asarray(v, dtype=np.float64) for v in candidates["__vec"]]
    lists = postings(vecs)
    null = candidates["__id"].isna().to_numpy()
    ids = candidates["__id"].fillna(0).to_numpy(np.int64)
    wide = max((len(v) for v in vecs), default=0)
    top = max((np.abs(v).max(initial=0) for v in vecs), default=0)
    rows = [np.asarray(v, dtype=np.float64) for v in queries["__vec"]]
    peak = max((np.abs(v).max(initial=0) for v in rows), default=0)
    exact = top * peak * max(wide, 1) < 2.0**62 and max(top, peak) < 2.0**62
    lists = [(at, whole(w, exact)) for at, w in lists]
    many = max(1, SCORES // max(len(ids), 1))
    for at in range(0, len(rows), many):
        part = rows[at : at + many]
        scores = np.zeros((len(part), len(ids)), dtype=np.int64 if exact else object)
        for term, (docs, weights) in enumerate(lists):
            for acc, q in zip(scores, part):
                if term < len(q) and q[term] != 0:
                    acc[docs] += weights * int(q[term])
        for acc, query, qid in zip(scores, queries["__query"][at : at + many], queries["__id"][at : at + many]):
            for i in best(acc, (ids == qid) & ~null, k):
                score = max(-(1 << 63), min((1 << 63) - 1, int(acc[i])))
                yield query, None if null[i] else int(ids[i]), score


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    candidates_per_block: int = CANDIDATES_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` is a condition on the id column."""
    flagged = vectors.select(id_col, vector_col, F.coalesce(is_query, F.lit(False)).alias("__q"))
    sound = integer_vectors(flagged, id_col, vector_col, scale)
    ids = integer_vectors(flagged.filter("__q"), id_col, vector_col, scale)
    n, n_queries = sound.count(), ids.count()
    n_cb, n_qb = math.ceil(n / candidates_per_block) or 1, math.ceil(n_queries / queries_per_block) or 1
    deal = lambda blocks: F.pmod(F.xxhash64("__id", "__vec"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = (
        ids.filter(F.col("__id").isNotNull()).distinct()
        .withColumn("__query", F.struct(F.col("__id").alias("id"), F.xxhash64("__vec").alias("h")))
        .withColumn("qb", deal(n_qb)).withColumn("cb", each(n_cb))
    )
    candidates = sound.withColumn("cb", deal(n_cb)).withColumn("qb", each(n_qb))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = list(search_block(left, right, k)) if len(left) and len(right) else []
        return pd.DataFrame({
            "qid": [q["id"] for q, _, _ in got], "qh": [q["h"] for q, _, _ in got],
            "vec_id": pd.array([v for _, v, _ in got], dtype="Int64"), "score": [s for _, _, s in got],
        })

    found = candidates.groupBy("cb", "qb").cogroup(queries.groupBy("cb", "qb")).applyInPandas(
        search, "qid long, qh long, vec_id long, score long"
    )
    rank = F.row_number().over(
        Window.partitionBy("qid", "qh").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    )
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("qid").alias("query_id"), "rank", "vec_id", "score"
    )
