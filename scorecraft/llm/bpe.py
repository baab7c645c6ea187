"""Byte-level BPE by a minimal acyclic transducer of frequent words.

Words (the pieces that the tokenizer's split pattern makes of a text) are
counted over the whole corpus. The most frequent ones are merged once and
compiled into an automaton that shares prefixes and suffixes; the arcs of a
word's path add up to its ordinal, which points at its ids. The automaton, the
merge table and the vocabulary are one file of plain arrays that every worker
maps into memory. A text's words are looked up in the automaton, all distinct
words of a batch at once; words that it does not hold are merged exactly, again
all at once. Decoding joins the vocabulary's bytes.

Scale: one pass counts (a bounded counter per task, summed by Spark; only the
``words`` most frequent come to the driver), one encodes, without a shuffle.
The file's size is bounded by ``words`` and the vocabulary. A worker holds one
block of texts and at most two generations of ``MEMO`` looked-up words.

Defined cases: a null text is an empty one and has no ids; the end-of-text
mark in a text is its one special id, as the tokenizer file says; texts of any
length are encoded whole; repeated rows are encoded each; an empty table gives
no rows and an automaton without words; other columns pass through, unless
they have the name of an added one, which wins.
"""

from __future__ import annotations

import json
import mmap
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.llm.common import scratch_path, small_batches, stage, write_shared

#: Frequent words in the automaton; entries of a task's counter; looked-up words of a worker's generation.
WORDS, COUNTER, MEMO = 1 << 15, 1 << 18, 1 << 17
#: Characters of text that a worker handles at a time.
BLOCK = 1 << 20

# The split pattern of the tokenizer's byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Ranges that became letters or numbers after Unicode 16, by which the tokenizer splits.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Ids of pieces are below this, so a pair of them fits in a long.
PAIR = 1 << 21


class Splitter:
    """Texts into words, as bytes of the text; specials are kept apart."""

    def __init__(self, specials: dict[str, int]):
        later = "".join("-".join(rf"\U{x:0>8}" for x in r.split("-")) for r in LATER.split())
        letters, numbers = rf"[\p{{L}}--[{later}]]", rf"[\p{{N}}--[{later}]]"
        strict = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]")
        strict = strict.replace(r" ?\p{L}+", f" ?{letters}+").replace(r" ?\p{N}+", f" ?{numbers}+")
        self.fast, self.strict = regex.compile(SPLIT), regex.compile("(?V1)" + strict)
        self.later, self.end = re.compile(f"[{later}]"), int(LATER[:4], 16)
        # the same pattern with its classes spelled out, for texts of characters below the first later letter
        low = SPLIT.replace(r"\S", rf"[^{self.low_class('s')}]").replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(map(self.low_class, ("s", "p{L}", "p{N}"))) + "]")
        for name in ("s", "p{L}", "p{N}"):
            low = low.replace(f"\\{name}", f"[{self.low_class(name)}]")
        self.low = re.compile(low)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.low.findall(text)
        highest = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()
        if highest < self.end:
            return self.low.findall(text)
        return (self.strict if self.later.search(text) else self.fast).findall(text)

    def low_class(self, name: str) -> str:
        """The ranges of a character class below the first later letter."""
        chars = "".join(map(chr, range(self.end)))
        return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(rf"\{name}+", chars))

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of text and, with True, specials."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False


# -- compiling --------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_tokenizer(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Vocabulary, merges in order, and special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = lambda piece: bytes(letters[c] for c in piece)
    vocab = {raw(piece): i for piece, i in spec["model"]["vocab"].items()}
    merges = [tuple(raw(p) for p in (m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    return vocab, merges, {t["content"]: t["id"] for t in spec["added_tokens"]}


def merge_table(vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> dict[str, np.ndarray]:
    """Pairs of ids in ascending order, the rank of each and what it becomes."""
    pairs = np.array([vocab[a] * PAIR + vocab[b] for a, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int32)
    order = np.argsort(pairs, kind="stable")
    return {
        "pair": pairs[order], "rank": order.astype(np.int32), "made": made[order],
        "single": np.array([vocab[bytes([b])] for b in range(256)], np.int32),
    }


def vocabulary_bytes(vocab: dict[bytes, int], specials: dict[str, int]) -> dict[str, np.ndarray]:
    by_id = {i: p for p, i in vocab.items()} | {i: s.encode() for s, i in specials.items()}
    pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return {
        "piece_end": np.cumsum([len(p) for p in pieces]).astype(np.int64),
        "piece": np.frombuffer(b"".join(pieces), np.uint8),
    }


def automaton(words: Sequence[bytes], ids: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of ascending distinct words. An arc's
    output is the number of words before those that it leads to, among the
    words that pass its state: along a word the outputs add up to its ordinal."""
    known: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []  # of frozen states: (byte, state)
    final: list[bool] = []
    path: list[tuple[list, bool]] = [([], False)]  # open states along the word before: frozen arcs, final
    before = b""

    def freeze(down_to: int) -> None:
        while len(path) - 1 > down_to:
            own, end = path.pop()
            key = (end, tuple(own))
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(own)
                final.append(end)
            path[-1][0].append((before[len(path) - 1], state))

    for word in words:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        freeze(same)
        path.extend(([], False) for _ in range(len(word) - same))
        path[-1] = (path[-1][0], True)
        before = word
    freeze(0)
    root = len(arcs)
    arcs.append(path[0][0])
    final.append(path[0][1])
    holds = []  # words from each state on; targets are frozen before their sources
    key, to, out = [], [], []
    for state, own in enumerate(arcs):
        n = int(final[state])
        for byte, target in own:
            key.append(state << 8 | byte)
            to.append(target)
            out.append(n)
            n += holds[target]
        holds.append(n)
    return {
        "arc": np.array(key, np.int64), "to": np.array(to, np.int32), "out": np.array(out, np.int32),
        "final": np.array(final, np.uint8), "root": np.array([root], np.int64),
        "ids_end": np.cumsum([len(x) for x in ids]).astype(np.int64),
        "ids": np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.uint32),
    }


def packed(arrays: dict[str, np.ndarray], extra: dict) -> bytes:
    """Arrays one after the other, each at a multiple of 8, after a JSON index."""
    index, at, body = {}, 0, []
    for name, a in arrays.items():
        index[name] = (str(a.dtype), at, len(a))
        blob = a.tobytes()
        body.append(blob + bytes(-len(blob) % 8))
        at += len(body[-1])
    head = json.dumps({"arrays": index, **extra}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(body)


# -- looking up ---------------------------------------------------------------------


class Lexicon:
    """The compiled file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(data[:8], "little")
        head = json.loads(data[8 : 8 + size])
        for name, (kind, at, n) in head["arrays"].items():
            setattr(self, name, np.frombuffer(data, kind, n, 8 + size + at))
        self.specials = head["specials"]
        self.splitter = Splitter(self.specials)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: list[bytes] = []

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The words' places in the automaton, -1 for words it does not hold."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), self.root[0], np.int64)
        total = np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self.arc) else np.empty(0, np.int64)
        step = 0
        while len(live):
            live = live[lengths[live] > step]
            key = state[live] << 8 | text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.to[at]
            total[live] += self.out[at]
            step += 1
        held = (state >= 0) & (lengths > 0) & (len(self.arc) > 0)
        held[held] = self.final[state[held]] == 1
        return np.where(held, total, -1)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' places in the merge table, -1 for pairs that are not merged."""
        pair = left * PAIR + right
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, at, -1)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by the merges, one after the other, and where each
        word's end: in each word the pair of lowest rank is merged wherever it
        stands, from the left, until none is left. Only pairs next to a merge are
        looked up again."""
        text = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.single[text].astype(np.int64)
        if not hasattr(self, "byte_places"):
            every = self.single.astype(np.int64)
            self.byte_places = self.places(np.repeat(every, 256), np.tile(every, 256))
        none = np.iinfo(np.int32).max
        at = np.full(len(sym), -1, np.int64)  # of the pair that begins here
        inner = word[:-1] == word[1:]
        at[:-1][inner] = self.byte_places[text[:-1][inner].astype(np.int64) * 256 + text[1:][inner]]
        ranked = np.where(at >= 0, self.rank[at], none)
        done_word, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low_of = np.repeat(np.minimum.reduceat(ranked, first), np.diff(np.append(first, len(word))))
            over = low_of == none
            done_word.append(word[over])
            done_sym.append(sym[over])
            take = np.flatnonzero((ranked == low_of) & ~over)
            # equal neighbours overlap: within a run of adjacent places every other one counts
            run = np.append(True, np.diff(take) != 1) if len(take) else np.empty(0, bool)
            place = np.arange(len(take)) - np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(take))))
            take = take[place % 2 == 0]
            sym[take] = self.made[at[take]]
            keep = ~over
            keep[take + 1] = False
            moved = (np.cumsum(keep) - 1)[take]
            word, sym, at, ranked = word[keep], sym[keep], at[keep], ranked[keep]
            beside = np.zeros(len(sym) + 1, bool)  # the last place stands for the one before the first
            beside[moved] = beside[moved - 1] = True
            again = np.flatnonzero(beside[:-1])
            at[again], ranked[again] = -1, none
            again = again[again < len(sym) - 1]
            again = again[word[again] == word[again + 1]]
            at[again] = self.places(sym[again], sym[again + 1])
            again = again[at[again] >= 0]
            ranked[again] = self.rank[at[again]]
        word, sym = np.concatenate([*done_word, np.empty(0, np.int64)]), np.concatenate([*done_sym, np.empty(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return sym[order].astype("<u4"), np.cumsum(np.bincount(word.astype(np.int64), minlength=len(words)))

    def learn(self, words: set[str]) -> None:
        """Put words that are not there yet into the memo. A full one becomes the
        older generation, whose words come back as they are met."""
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.older, self.memo, new = self.memo, {}, words
        known = [w for w in new if w in self.older]
        self.memo.update(zip(known, map(self.older.__getitem__, known)))
        new = [w for w in new if w not in self.older] if known else list(new)
        raw = [w.encode() for w in new]
        places = self.ordinals(raw)
        ids, starts = self.ids.tobytes(), np.append(0, self.ids_end) * 4
        held = np.flatnonzero(places >= 0)
        for i, a, b in zip(held.tolist(), starts[places[held]].tolist(), starts[places[held] + 1].tolist()):
            self.memo[new[i]] = ids[a:b]
        unseen = np.flatnonzero(places < 0).tolist()
        merged, ends = self.merged([raw[i] for i in unseen])
        merged, at = merged.tobytes(), 0
        for i, end in zip(unseen, (ends * 4).tolist()):
            self.memo[new[i]] = merged[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut, words = [], set()
        for text in texts:
            parts = [(p if special else self.splitter.words(p), special) for p, special in self.splitter.parts(text)]
            cut.append(parts)
            words.update(*[p for p, special in parts if not special])
        self.learn(words)
        look = self.memo.__getitem__
        return [
            b"".join(self.specials[p].to_bytes(4, "little") if special else b"".join(map(look, p)) for p, special in parts)
            for parts in cut
        ]

    def decode(self, packed_ids: list[bytes]) -> list[str]:
        if not self.pieces:
            starts, text = np.append(0, self.piece_end).tolist(), self.piece.tobytes()
            self.pieces = [text[a:b] for a, b in zip(starts, starts[1:])]
        piece = self.pieces.__getitem__
        return [b"".join(map(piece, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in packed_ids]


def blocks(values: list, size=len) -> Iterator[list]:
    """Consecutive values of up to ``BLOCK`` in all, or one."""
    part, total = [], 0
    for v in values:
        if part and total + size(v) > BLOCK:
            yield part
            part, total = [], 0
        part.append(v)
        total += size(v)
    if part:
        yield part


# -- the operator ---------------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word, n``: words between separators over all texts, as they stand."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )
        for batch in batches:
            for text in batch.column(0):
                seen.update((text.as_py() or "").encode().split())
                if len(seen) > COUNTER:
                    yield flush()
                    seen.clear()
        yield flush()

    small_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = WORDS) -> str:
    """Compile the corpus's frequent words for a tokenizer file; the name of
    the file that every worker then has."""
    spark = docs.sparkSession
    counts = stage(word_counts(docs, text_col), "words")
    # at most 16 * words words can have this share of the text: what the driver and each task's top hold is bounded
    least = (counts.agg(F.sum("n")).first()[0] or 0) / (16 * words)
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words).collect()
    vocab, merges, specials = read_tokenizer(tokenizer)
    splitter, often = Splitter(specials), Counter()
    for row in top:
        word = bytes(row["word"]).decode("utf-8", "replace")
        for piece in {*splitter.words(word), *splitter.words(" " + word)}:
            often[piece.encode()] += row["n"]
    chosen = sorted(w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:words])
    tables = merge_table(vocab, merges)
    merger = Lexicon.__new__(Lexicon)
    merger.__dict__.update(tables)
    ids, ends = merger.merged(chosen)
    arrays = tables | vocabulary_bytes(vocab, specials) | automaton(chosen, np.split(ids, ends[:-1]) if chosen else [])
    path = scratch_path(spark, "lexicon") + ".bin"
    write_shared(spark, path, packed(arrays, {"specials": specials}))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def by_place(fields: Sequence[T.StructField]) -> list[Column]:
    """The fields' columns under names that none of an input's can clash with."""
    return [F.col(f"`{f.name}`").alias(f"__c{i}") for i, f in enumerate(fields)]


def encode(docs: DataFrame, lexicon: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``: little-endian unsigned 32-bit ids."""
    fields = [f for f in docs.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(SparkFiles.get(lexicon))
        for batch in batches:
            texts = [t or "" for t in batch.column(len(fields)).to_pylist()]
            ids = [x for part in blocks(texts) for x in own.encode(part)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], pa.array(ids, pa.large_binary()).cast(pa.binary())],
                names=[*[f.name for f in fields], out],
            )

    schema = T.StructType([*fields, T.StructField(out, T.BinaryType())])
    return docs.select(*by_place(fields), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def decode(rows: DataFrame, lexicon: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of their ids; bytes that are not
    UTF-8 become replacement characters."""
    fields = [f for f in rows.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(SparkFiles.get(lexicon))
        for batch in batches:
            ids = [x or b"" for x in batch.column(len(fields)).to_pylist()]
            texts = [x for part in blocks(ids) for x in own.decode(part)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], pa.array(texts, pa.string())],
                names=[*[f.name for f in fields], out],
            )

    schema = T.StructType([*fields, T.StructField(out, T.StringType())])
    return rows.select(*by_place(fields), F.col(f"`{ids_col}`").alias("__ids")).mapInArrow(run, schema)
