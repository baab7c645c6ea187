"""Quality by weak labels: heuristic labellers, EM, and a hashed linear scorer.

Eight overlapping labellers look at a text and vote good, bad or nothing.
Spark counts how often each pattern of votes occurs over the whole corpus (at
most 3**8 patterns); expectation-maximisation on these counts estimates the
share of good documents and, for each labeller, how it votes on good and on bad
ones (false alarms on good ones are held at ``FALSE_ALARM`` at most). The posterior of a document's pattern is its label. A logistic regression
over hashed word shapes is trained on these labels and scores each document; it
judges by all of the text where the labellers see single symptoms.

The counts cover all documents; the regression is fitted on a sample of about
``SAMPLE`` of them at most (by a hash of the row's file and place, a copy of the
texts being written first if ``docs`` is no plain read of files), on the driver. Scoring reads
every whole text once, without a shuffle; the weights (2**BITS floats) and the
posteriors are broadcast.

Repeated words are counted in windows of ``WINDOW`` words over the whole text,
so that a clean text of any length counts as its parts do; what repeats at a
greater distance is seen by its repeated lines only.

Defined cases: null and blank texts get no votes and no features: their
posterior and score are the estimated share of good documents; short texts get
fewer votes; repeated rows count each; ties cannot occur but for a score of
exactly 0.5, which is kept; an empty table gives no rows; all columns pass
through ``keep_good``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.llm.common import file_backed, row_hash, small_batches
from scorecraft.llm.linear import fit_logistic, hashed, sampled, sigmoid

BITS, SAMPLE, EM_STEPS = 18, 16_000, 100
BAD, GOOD, NONE = 0, 1, 2
#: The labellers' limits are extremes: on good documents they vote bad this often at most.
FALSE_ALARM = 0.01
#: Texts with fewer words tell too little for the labellers of shares.
ENOUGH = 20
#: Words are looked for again in so many at a time: the share of words that have
#: come before rises with the length of any text.
WINDOW = 1000


def between(value: float, good: float, bad: float) -> int:
    """Good up to one limit, bad from another on."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def repeated(words: list[str]) -> int:
    """How many words have come before in their window, over the whole text."""
    return sum(len(w) - len(set(w)) for w in (words[i : i + WINDOW] for i in range(0, len(words), WINDOW)))


class Signals:
    """What the labellers look at."""

    def __init__(self, text: str):
        self.words = text.split()
        self.n = len(self.words)
        chars = sum(map(len, self.words)) or 1
        lines = [x for x in text.split("\n") if x.strip()]
        letters = sum(map(str.isalpha, text)) or 1
        shared = Counter(lines)
        self.repeats = sum(map(eq, self.words, self.words[1:])) / max(self.n, 1)
        self.again = repeated(self.words) / max(self.n, 1)
        self.upper = sum(map(str.isupper, text)) / letters
        self.symbols = 1 - sum(map(str.isalnum, text)) / chars
        self.bars = text.count("|") / max(self.n, 1)
        self.same_lines = sum(c for c in shared.values() if c > 1) / max(len(lines), 1)
        self.length = chars / max(self.n, 1)
        self.ends = sum(w[-1] in ".,;:!?" for w in self.words) / max(self.n, 1)


#: Each labeller: the words it needs, and its vote.
LABELLERS = {
    "repeated words": (ENOUGH, lambda s: between(s.repeats, 0.05, 0.2)),
    "distinct words": (ENOUGH, lambda s: between(s.again, 0.5, 0.7)),
    "capitals": (1, lambda s: between(s.upper, 0.1, 0.5)),
    "symbols": (ENOUGH, lambda s: between(s.symbols, 0.06, 0.12)),
    "table bars": (ENOUGH, lambda s: between(s.bars, 0.0, 0.1)),
    "repeated lines": (ENOUGH, lambda s: between(s.same_lines, 0.0, 0.6)),
    "word length": (ENOUGH, lambda s: GOOD if 3.5 <= s.length <= 6 else BAD if s.length < 2.5 or s.length > 9 else NONE),
    "sentences": (ENOUGH, lambda s: GOOD if 0.05 <= s.ends <= 0.3 else BAD if s.ends < 0.02 or s.ends > 0.6 else NONE),
}


def votes(text: str | None) -> list[int]:
    s = Signals(text or "")
    return [vote(s) if s.n >= need else NONE for need, vote in LABELLERS.values()]


def pattern(text: str | None) -> int:
    return sum(v * 3**j for j, v in enumerate(votes(text)))


def pattern_votes(code: int) -> list[int]:
    return [code // 3**j % 3 for j in range(len(LABELLERS))]


# -- the weak-label model -----------------------------------------------------------


def pattern_counts(docs: DataFrame, text_col: str) -> dict[int, int]:
    small_batches(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(pattern(t.as_py()) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"]
        )

    counted = docs.select(text_col).mapInArrow(look, "pattern int, n long")
    return {r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def expectation_maximisation(counts: dict[int, int], steps: int = EM_STEPS) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of good documents, P(vote | class) by labeller, class and vote,
    posterior of good by pattern). Starts from the votes' majority."""
    codes = sorted(counts)
    ballots = np.array([pattern_votes(c) for c in codes]).reshape(len(codes), len(LABELLERS))
    n = np.array([counts[c] for c in codes], float)
    good = ((ballots == GOOD).sum(1) + 1) / ((ballots != NONE).sum(1) + 2)
    # one bad sign outweighs several good ones: most labellers see one symptom only
    good = np.where((ballots == BAD).any(1), np.minimum(good, 0.4), good)
    prior, rates = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(steps if len(codes) else 0):
        weight = np.stack([n * (1 - good), n * good])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        for j in range(len(LABELLERS)):
            for v in range(3):
                rates[j, :, v] = (weight[:, ballots[:, j] == v].sum(1) + 0.1) / (weight.sum(1) + 0.3)
            if rates[j, 1, BAD] > FALSE_ALARM:
                rates[j, 1, [GOOD, NONE]] *= (1 - FALSE_ALARM) / (1 - rates[j, 1, BAD])
                rates[j, 1, BAD] = FALSE_ALARM
        log = np.log([1 - prior, prior])[:, None] + sum(
            np.where(ballots[:, j] == NONE, 0.0, np.log(rates[j][:, ballots[:, j]])) for j in range(len(LABELLERS))
        )
        good = sigmoid(log[1] - log[0])
    return float(prior), rates, dict(zip(codes, map(float, good)))


# -- the scorer -----------------------------------------------------------------------


class Shape(dict):
    """Characters by class: capital, letter, digit, or themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return self[code]


RUN = re.compile(r"(\S)\1+")


def features(text: str | None, shapes: Shape, hashes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: the root of each feature's share of the words, for
    word shapes (runs as one), neighbouring equal words, and repeated words."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    counts = Counter(RUN.sub(r"\1", text.translate(shapes)).split())
    counts["= before"] = sum(map(eq, words, words[1:]))
    counts["= earlier"] = repeated(words)
    for name in counts.keys() - hashes.keys():
        hashes[name] = xxhash.xxh3_64_intdigest(name)
    place = hashed(np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts)), BITS)
    return place, np.sqrt(np.fromiter(counts.values(), float, len(counts)) / len(words))


def fit(docs: DataFrame, text_col: str, sample: int) -> tuple[np.ndarray, float, float, dict[int, float]]:
    """(weights, bias, share of good documents, posteriors)."""
    counts = pattern_counts(docs, text_col)
    prior, _, posterior = expectation_maximisation(counts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, hashes = Shape(), {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [features(t, shapes, hashes) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([pattern(t) for t in texts], pa.int32()),
                    pa.array([p.astype(np.int32).tobytes() for p, _ in found], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
                ],
                names=["pattern", "place", "value"],
            )

    total, texts = sum(counts.values()), docs.select(text_col)
    if total > sample:
        texts = file_backed(texts)
    rows = texts.filter(sampled(row_hash(), total, sample)).select(text_col).mapInArrow(read, "pattern int, place binary, value binary").toPandas()
    place = [np.frombuffer(p, np.int32) for p in rows["place"]]
    value = [np.frombuffer(v, np.float32) for v in rows["value"]]
    used, columns = np.unique(np.concatenate([*place, np.empty(0, np.int32)]), return_inverse=True)
    y = np.array([posterior[p] for p in rows["pattern"]])
    lengths = np.fromiter(map(len, place), np.int64, len(place))
    w, b = fit_logistic(columns, lengths, np.concatenate([*value, np.empty(0, np.float32)]).astype(float), y, len(used), l2=1e-5)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return weights, b, prior, posterior


def score_quality(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` as ``__c0, __c1, ...`` with ``votes`` (one
    letter per labeller), ``posterior``, ``score`` and ``kept``."""
    share = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, sample))
    fields = [T.StructField(f"__c{i}", f.dataType) for i, f in enumerate(docs.schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, prior, posterior = share.value
        shapes, hashes = Shape(), {}
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            if len(hashes) > 1 << BITS:
                hashes.clear()
            codes = [pattern(t) for t in texts]
            scores = []
            for t in texts:
                place, value = features(t, shapes, hashes)
                scores.append(float(sigmoid(float(weights[place] @ value) + bias)) if len(place) else prior)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in fields],
                    pa.array(["".join("bg-"[v] for v in pattern_votes(c)) for c in codes], pa.string()),
                    pa.array([posterior.get(c, prior) for c in codes], pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array([s >= 0.5 for s in scores], pa.bool_()),
                ],
                names=[*[f.name for f in fields], "votes", "posterior", "score", "kept"],
            )

    schema = T.StructType([
        *fields, T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
    ])
    return docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)], F.col(text_col).alias("__text")) \
        .mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with its columns."""
    return score_quality(docs, text_col, sample).filter("kept").select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)]
    )
