"""Logistic regression on sparse rows, for the bounded samples that the text
classifiers are fitted on, and helpers of their distributed parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Values that a step of a fit looks at together.
CHUNK = 1 << 19


def sampled(key: Column, rows: int, limit: int) -> Column:
    """Whether a row is in a sample of about ``limit`` of ``rows`` rows, by a
    hash that is the row's own (``row_hash``): copies and nulls are thinned like
    all other rows, and the same files give the same sample at each run."""
    if rows <= limit:
        return F.lit(True)
    return F.pmod(key, F.lit(1 << 30)) < F.lit(int(limit / rows * (1 << 30)))


def hashed(values: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of 64-bit values, by the upper bits of a product."""
    x = values * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(
    columns: np.ndarray, lengths: np.ndarray, values: np.ndarray, y: np.ndarray, features: int,
    steps: int = 200, rate: float = 0.5, l2: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias for targets between 0 and 1, by AdaGrad on the whole
    sample. Row i has the next ``lengths[i]`` of ``columns`` and ``values``.
    Each step goes through the rows in chunks, which bounds its memory."""
    columns, values = columns.astype(np.int32), values.astype(np.float32)
    w, b = np.zeros(features), 0.0
    gw, gb = np.full(features, 1e-8), 1e-8
    ends = np.append(0, np.cumsum(lengths))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, max(ends[-1], 1), CHUNK)), [0, len(lengths)]))
    for _ in range(steps if len(y) else 0):
        dw, db = l2 * w, 0.0
        for first, last in zip(cuts[:-1], cuts[1:]):
            c, v = columns[ends[first] : ends[last]], values[ends[first] : ends[last]]
            row = np.repeat(np.arange(last - first), lengths[first:last])
            wrong = sigmoid(np.bincount(row, w[c] * v, last - first) + b) - y[first:last]
            dw += np.bincount(c, wrong[row] * v, features) / len(y)
            db += float(wrong.sum()) / len(y)
        gw += dw**2
        gb += db**2
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)
    return w, b
