"""Toxicity by a linear classifier of character n-grams with naive Bayes scales.

A text's features are the hashed n-grams (``ORDERS`` characters, lower case,
blanks as one space) that it holds, each once. Over all labelled texts Spark
counts how many texts of each class hold a bucket; the log-count ratio of the
classes scales the feature. Buckets whose share differs between the classes by
less than ``Z`` standard errors are left out. A row is divided by its norm, and
a logistic regression over the scaled features gives the weights.

Counting reads every labelled text. The regression is fitted on a sample of at
most about ``SAMPLE`` of them (by a hash of the row's file and place, a copy
being written first if ``learn_from`` is no plain read of files), on the driver,
in arrays that these bounds limit. Weights (2 * 2**BITS floats) are broadcast. Scoring
reads every whole text once, without a shuffle.

Defined cases: null and empty texts have no features and get the bias alone;
null labels and ids are not learned from; of several labels of an id the more
frequent counts, 1 in a tie; labelled copies count each; with labels of one
class only, or none, every score is that class's smoothed share (0.5 with
none); an empty table gives no rows; other columns are not read. Texts of any
length are read whole, one at a time with its n-grams as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import file_backed, row_hash, small_batches, stage
from scorecraft.llm.linear import fit_logistic, hashed, sampled, sigmoid

ORDERS, BITS, Z, SAMPLE = (3, 5, 7), 20, 6.0, 8_000
#: Ranges of buckets that the counts are added up in.
RANGES = 64


def buckets(text: str | None) -> np.ndarray:
    """The hashed n-grams of a text, with repeats."""
    chars = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = chars.astype(np.uint64)
    rolling, out = np.zeros(len(chars), np.uint64), []
    for n in range(1, min(max(ORDERS), len(chars)) + 1):
        rolling = rolling[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :]
        if n in ORDERS:
            out.append(hashed(rolling, BITS))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of class 1, and of class 0, hold each bucket."""
    width = (1 << BITS) // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.uint32)
        for batch in batches:
            for text, label in zip(batch.column("__text"), batch.column("__label").to_pylist()):
                held[label, np.unique(buckets(text.as_py()))] += 1
        parts = [held[:, i * width : (i + 1) * width] for i in range(RANGES)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(RANGES), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())],
            names=["part", "counts"],
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(b), np.uint32).astype(np.uint64) for b in rows["counts"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.tobytes()]})

    schema = "part int, counts binary"
    got = labelled.select("__text", "__label").mapInArrow(count, schema).groupBy("part").applyInPandas(add, schema).collect()
    held = np.zeros((2, 1 << BITS), np.uint64)
    for row in got:
        held[:, row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.uint64).reshape(2, width)
    return held[1].astype(np.float64), held[0].astype(np.float64)


def ratios(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int, z: float) -> np.ndarray:
    """The log-count ratio of each bucket, 0 for those left out."""
    share = (ones + zeros) / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    ratio = np.log((ones + 1) / (ones + 1).sum()) - np.log((zeros + 1) / (zeros + 1).sum())
    return np.where(np.abs(ones / n1 - zeros / n0) >= z * error, ratio, 0.0)


def held_features(texts: Iterator[str | None], chosen: np.ndarray) -> Iterator[np.ndarray]:
    for text in texts:
        own = buckets(text)
        yield np.unique(own[chosen[own]])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, z: float):
    """(scaled weights, squared scales, bias) by bucket, or a share alone."""
    votes = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("__label")
    )
    # the same join at every size: both sides by id, hot ids split by AQE
    texts = file_backed(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")))
    texts = texts.select("__id", "__text", row_hash().alias("__at"))
    labelled = stage(texts.join(votes.hint("merge"), "__id").select("__text", "__label", "__at"), "toxicity-labelled")
    n1, n0 = labelled.agg(F.count_if(F.col("__label") == 1), F.count_if(F.col("__label") == 0)).first()
    if not n1 or not n0:
        return None, None, float(np.log((n1 + 0.5) / (n0 + 0.5)))
    scale = ratios(*class_counts(labelled), n1, n0, z)
    chosen = labelled.sparkSession.sparkContext.broadcast(scale != 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held_features(batch.column("__text").to_pylist(), chosen.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__label"), pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary())],
                names=["label", "features"],
            )

    part = labelled.filter(sampled(F.col("__at"), n1 + n0, sample)).select("__text", "__label")
    rows = part.mapInArrow(features, "label int, features binary").toPandas()
    found = [np.frombuffer(f, np.int32) for f in rows["features"]]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    used = np.flatnonzero(scale)
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    unit = lambda v: (v / np.sqrt(max((v**2).sum(), 1.0))).astype(np.float32)
    columns = np.concatenate([place[f] for f in found] + [np.empty(0, np.int32)])
    values = np.concatenate([unit(scale[f]) for f in found] + [np.empty(0, np.float32)])
    w, b = fit_logistic(columns, lengths, values, rows["label"].to_numpy(float), len(used), l2=1e-5)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = w * scale[used]
    return weight, (scale**2).astype(np.float32), b


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    z: float = Z,
) -> DataFrame:
    """``id, score, predicted`` of every row of ``docs``, learned from the rows
    of ``learn_from`` that have a label."""
    weight, squares, bias = train(learn_from, labels, id_col, text_col, label_col, sample, z)
    share = docs.sparkSession.sparkContext.broadcast((weight, squares, bias))
    kind = docs.schema[id_col].dataType.simpleString()

    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sq, b = share.value
        for batch in batches:
            if w is None:
                sums = np.zeros(batch.num_rows)
            else:
                found = held_features(batch.column("__text").to_pylist(), sq != 0)
                sums = np.array([w[f].sum(dtype=np.float64) / np.sqrt(max(sq[f].sum(dtype=np.float64), 1.0)) for f in found])
            p = sigmoid(sums + b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                names=["__id", "score", "predicted"],
            )

    scored = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(
        score, f"__id {kind}, score double, predicted int"
    )
    return scored.select(F.col("__id").alias(id_col), "score", "predicted")
