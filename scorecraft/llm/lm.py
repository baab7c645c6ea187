"""Language-model scoring by a weighted backoff automaton.

A bigram model with Dirichlet smoothing over additively smoothed unigrams:
p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU). As an automaton: a state for each
word of the training texts, one for a text's start and the root; an arc for
each bigram seen, with log10 p(w | v); a failure arc from each state to the
root, with log10 of MU / (c(v) + MU); and the root's arcs, with log10 p(w). A
text is read once from left to right: it carries its state, takes the arc of
the next token or fails to the root first, and adds up the weights.

The whole automaton would grow with the corpus, so no worker holds it.
1. Documents are taken in blocks of neighbouring rows of a file. A block asks, by 64-bit
   keys, for all its words and bigrams, and tells how often each stands in its
   own training texts. Requests go to parts of the key space as packed arrays.
2. A part adds up what it was told by all blocks and answers each request with
   the counts over the whole corpus, in the order of the request.
3. A block with its answers compiles the automaton of its own words and bigrams
   and runs its texts through it, all texts of the block in step.

Scale: blocks and parts have about ``BLOCK_BYTES`` of text each, whatever the
corpus's size; frequent words are summed within a block before anything is
sent, and each part gets an equal share of hashed keys. Only the three totals
come to the driver. Two of n distinct n-grams share a 64-bit key with a chance
of n^2 / 2^65 in all.

Defined cases: a null or blank text is one end token; ids that are null count
as empty text for the fold; repeated rows count each; an empty table gives no
rows; with no training text every token has the same probability; other
columns are not read. Texts of any length are scored whole: a block holds at
least one text, so the longest one bounds a worker's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import file_backed, located, scrambled, small_batches, stage

#: Weight of the unigrams in a state's prediction, and the count added to each unigram.
MU, ADDED = 50.0, 0.5
BLOCK_BYTES = 8 << 20
# No word holds a separator, so these stand for a text's start and end.
START, END = b"\n", b" "


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


class Block:
    """Tokens of some texts as codes, with the distinct words and bigrams."""

    def __init__(self, texts: list[str | None]):
        index = {START: 0, END: 1}
        rows = []
        for text in texts:
            words = (text or "").encode().lower().split()
            rows.append([index.setdefault(w, len(index)) for w in words])
            rows[-1].append(1)
        self.lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.tokens = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.size = len(index)
        before = np.roll(self.tokens, 1)
        before[self.starts] = 0
        self.pairs, self.pair_of = np.unique(before * self.size + self.tokens, return_inverse=True)
        self.word_keys = scrambled(np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index)))
        left, right = self.pairs // self.size, self.pairs % self.size
        self.pair_keys = scrambled(scrambled(self.word_keys[left]) + self.word_keys[right])
        self.word_order, self.pair_order = np.argsort(self.word_keys), np.argsort(self.pair_keys)

    def told(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often words and bigrams stand in the texts of ``train``; for the
        start, the number of these texts."""
        chosen = np.repeat(train, self.lengths)
        words = np.bincount(self.tokens[chosen], minlength=self.size)
        words[0] = train.sum()
        return words, np.bincount(self.pair_of[chosen], minlength=len(self.pairs))

    def cuts(self, keys: np.ndarray, parts: int) -> np.ndarray:
        """Where the parts of the key space begin and end in sorted keys."""
        return np.searchsorted(part_of(keys, parts), np.arange(parts + 1))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def start_key() -> np.uint64:
    return scrambled(np.array([xxhash.xxh3_64_intdigest(START)], np.uint64))[0]


def requests(rows: DataFrame, parts: int) -> DataFrame:
    """``part, block, lo, hi, words, word_n, pairs, pair_n`` of consecutive
    rows (lo to hi) of a block."""

    small_batches(rows.sparkSession)

    def ask(texts: list, train: list, block: int, lo: int, hi: int) -> Iterator[tuple]:
        own = Block(texts)
        word_n, pair_n = own.told(np.array(train, bool))
        words, pairs = own.word_keys[own.word_order], own.pair_keys[own.pair_order]
        word_n, pair_n = word_n[own.word_order].astype(np.uint32), pair_n[own.pair_order].astype(np.uint32)
        w, p = own.cuts(words, parts), own.cuts(pairs, parts)
        for i in np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0)):
            a, b, c, d = w[i], w[i + 1], p[i], p[i + 1]
            yield (int(i), block, lo, hi, pack_keys(words[a:b]), packed(word_n[a:b]), pack_keys(pairs[c:d]), packed(pair_n[c:d]))

    def batch_of(asked: Iterator[tuple]) -> pa.RecordBatch:
        columns = list(zip(*asked))
        kinds = [pa.int64()] * 4 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["part", "block", "lo", "hi", "words", "word_n", "pairs", "pair_n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, train, block, lo, hi, size = [], [], None, 0, 0, 0
        for batch in batches:
            for text, learn, own, row in zip(*(batch.column(c).to_pylist() for c in ("__text", "__train", "__block", "__row"))):
                if texts and (own != block or row <= hi or size > 2 * BLOCK_BYTES):
                    yield batch_of(ask(texts, train, block, lo, hi))
                    texts, train, size = [], [], 0
                if not texts:
                    block, lo = own, row
                hi, size = row, size + len(text or "")
                texts.append(text)
                train.append(learn)
        if texts:
            yield batch_of(ask(texts, train, block, lo, hi))

    return rows.select("__text", "__train", "__block", "__row").mapInArrow(
        run, "part long, block long, lo long, hi long, words binary, word_n binary, pairs binary, pair_n binary"
    )


def answers(asked: DataFrame) -> DataFrame:
    """``block, lo, hi, part, word_n, pair_n``, and one row per part with block
    null, the part's training tokens as lo and its distinct ones as hi."""

    def total(blobs: pd.Series, counts: pd.Series) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        keys = [unpack_keys(b) for b in blobs]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, np.concatenate([unpacked(c, np.uint32) for c in counts]), len(distinct)).astype(np.uint64)
        return distinct, n, np.split(n[place], np.cumsum([len(k) for k in keys])[:-1])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        words, n, word_n = total(rows["words"], rows["word_n"])
        _, _, pair_n = total(rows["pairs"], rows["pair_n"])
        n = n[words != start_key()]
        part = rows["part"].iloc[0]
        out = [*zip(rows["block"], rows["lo"], rows["hi"], rows["part"], map(packed, word_n), map(packed, pair_n)),
               (None, int(n.sum()), int((n > 0).sum()), part, None, None)]
        names = ["block", "lo", "hi", "part", "word_n", "pair_n"]
        columns = dict(zip(names, map(list, zip(*out))))
        return pd.DataFrame(columns | {"block": pd.array(columns["block"], "Int64")})  # a null must not make floats of them

    return asked.groupBy("part").applyInPandas(
        answer, "block long, lo long, hi long, part long, word_n binary, pair_n binary"
    )


def run_automaton(block: Block, word_n: np.ndarray, pair_n: np.ndarray, total: int, kinds: int, mu: float, added: float):
    """Per text: tokens, known tokens, unigram score and the automaton's score.

    States are the codes of the words; 1, the end's, is never left, so it
    serves as the root. The start's state is 0.
    """
    root = 1
    trained = word_n > 0
    base = np.log10((word_n + added) / (total + added * (kinds + 1)))
    seen = np.flatnonzero(pair_n > 0)
    left, right = block.pairs[seen] // block.size, block.pairs[seen] % block.size
    arcs = block.pairs[seen]  # ascending: state * size + token
    weight = np.log10((pair_n[seen] + mu * 10.0 ** base[right]) / (word_n[left] + mu))
    fail = np.log10(mu / (word_n + mu))
    fail[root] = 0.0
    to = np.where(trained, np.arange(block.size), root)
    score, order = np.zeros(len(block.lengths)), np.argsort(-block.lengths, kind="stable")
    state = np.full(len(order), 0 if trained[0] else root, np.int64)
    starts, lengths = block.starts[order], block.lengths[order]
    live = len(order)
    for step in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths[:live], -step, "left"))  # the longest texts come first
        token = block.tokens[starts[:live] + step]
        key = state[:live] * block.size + token
        at = np.minimum(np.searchsorted(arcs, key), max(len(arcs) - 1, 0))
        hit = (arcs[at] == key) & (state[:live] != root) if len(arcs) else np.zeros(live, bool)
        score[:live] += np.where(hit, weight[at] if len(arcs) else 0.0, fail[state[:live]] + base[token])
        state[:live] = to[token]
    scores = np.empty(len(order))
    scores[order] = score
    sums = lambda x: np.add.reduceat(x, block.starts) if len(block.starts) else np.empty(0)
    return block.lengths, sums(trained[block.tokens].astype(np.int64)), sums(base[block.tokens]), scores


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    mu: float = MU,
    added: float = ADDED,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every row;
    ``train`` (a condition on the columns) names those to learn from."""
    base = located(file_backed(docs).select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(train, F.lit(False)).alias("__train")
    ))
    rows_n, size = base.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("__text"), F.lit(0)) + 1)).first()
    blocks = max(1, math.ceil((size or 0) / block_bytes))
    per_block = max(1, math.ceil(rows_n / blocks))
    rows = base.select(
        "__id", "__text", "__train", "__row",
        F.xxhash64("__file", F.floor(F.col("__row") / per_block)).alias("__block"),
    )
    told = stage(answers(requests(rows, blocks)), "lm-answers")
    totals = told.filter(F.col("block").isNull()).agg(F.sum("lo"), F.sum("hi")).first()
    total, kinds = totals[0] or 0, totals[1] or 0

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        left = left.sort_values("__row")
        for (lo, hi), got in right.groupby(["lo", "hi"]):
            mine = left[(left["__row"] >= lo) & (left["__row"] <= hi)]
            own = Block(mine["__text"].tolist())
            got = got.sort_values("part")
            word_n, pair_n = np.empty(own.size), np.empty(len(own.pairs))
            word_n[own.word_order] = np.concatenate([unpacked(b, np.uint64) for b in got["word_n"]])
            pair_n[own.pair_order] = np.concatenate([unpacked(b, np.uint64) for b in got["pair_n"]])
            n, known, unigram, automaton = run_automaton(own, word_n, pair_n, total, kinds, mu, added)
            out.append(pd.DataFrame({
                "__id": mine["__id"].to_numpy(), "n_tokens": n, "n_known": known, "base_score": unigram, "score": automaton,
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["__id", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["__id"].dataType.simpleString()
    scored = rows.select("__id", "__text", "__row", "__block").groupBy("__block").cogroup(
        told.filter(F.col("block").isNotNull()).groupBy("block")
    ).applyInPandas(score, f"__id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("__id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
