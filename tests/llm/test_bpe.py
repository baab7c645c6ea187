import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from scorecraft.llm import bpe

from edge_cases import edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def lexicon(tmp_path_factory):
    """A compiled file of a few words."""
    vocab, merges, specials = bpe.read_tokenizer(PATH)
    words = sorted({b" the", b"the", b" other", b" others", b"a", b"ab", b" mother", b"\n", " Ünï".encode()})
    tables = bpe.merge_table(vocab, merges)
    merger = bpe.Lexicon.__new__(bpe.Lexicon)
    merger.__dict__.update(tables)
    ids, ends = merger.merged(words)
    arrays = tables | bpe.vocabulary_bytes(vocab, specials) | bpe.automaton(words, np.split(ids, ends[:-1]))
    path = tmp_path_factory.mktemp("bpe") / "lexicon.bin"
    path.write_bytes(bpe.packed(arrays, {"specials": specials}))
    return bpe.Lexicon(str(path)), words


def test_automaton_holds_its_words_alone_and_shares_suffixes(lexicon):
    own, words = lexicon
    others = [b"", b"t", b" th", b" othe", b" otherss", b"b", b"abc", b"x"]
    places = own.ordinals(words + others).tolist()
    assert places == list(range(len(words))) + [-1] * len(others)
    assert len(own.final) < sum(map(len, words)) * 0.7


def texts(n):
    rng = random.Random(3)
    alphabets = [
        "abcdefghij ABC  \n\t", "0123456789 .,;'\"!?-_", "äöüßéèñ çÀ ", "中文字 日本　", "\U0001f600\U0001f1e9‍́x ",
        "\x00\x1c\x85\xa0  \r\n", "aaaaaaaaab ", "՘꟎\U00010940\U000323b0 a1", "'s't're've'm'll'd ", "<|endoftext|> <|",
    ]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(0, 60)))
    scalars = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    yield "".join(chr(rng.choice(scalars)) for _ in range(3000))
    yield "<|endoftext|><|endoftext|> a<|endoftext|>"
    yield "word " * 20_000 + "x" * 3000


def test_ids_and_round_trip_against_the_library(lexicon, library):
    own, _ = lexicon
    every = list(texts(1500))
    want = [library.encode(t, add_special_tokens=False).ids for t in every]
    got = own.encode(every)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert own.decode(got) == every == [library.decode(w, skip_special_tokens=False) for w in want]


def test_decoding_of_any_ids(lexicon, library):
    own, _ = lexicon
    ids = [[random.Random(i).randrange(50257) for _ in range(i)] for i in range(60)]
    got = own.decode([np.array(x, "<u4").tobytes() for x in ids])
    assert got == [library.decode(x, skip_special_tokens=False) for x in ids]


def test_split_pattern_over_all_characters(library):
    split = bpe.Splitter({})
    letters = {b: c for c, b in bpe.byte_letters().items()}
    for first in range(0, 0x110000, 256):
        chars = [chr(c) for c in range(first, first + 256) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b 1{c}2  {c}x" for c in chars)
        want = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(text)]
        assert ["".join(letters[b] for b in w.encode()) for w in split.words(text)] == want, hex(first)


def test_operator_on_edge_cases(spark, edge, empty, library):
    name = bpe.compile_lexicon(edge, PATH, words=20)
    rows = bpe.decode(bpe.encode(edge, name), name)
    assert rows.columns == [*[c for c in edge.columns if c != "ids"], "ids", "decoded"]
    for r in rows.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    assert rows.count() == len(edge_rows())
    none = bpe.compile_lexicon(empty, PATH)
    assert bpe.decode(bpe.encode(empty, none), none).collect() == []
    some = bpe.encode(edge.select("doc_id", "text"), none)  # an automaton without words
    assert {hashlib.sha256(r["ids"]).digest() for r in some.collect()} == {hashlib.sha256(r["ids"]).digest() for r in rows.collect()}


def test_merging_file_formats():
    vocab, merges, specials = bpe.read_tokenizer(PATH)
    assert len(vocab) == 50256 and len(merges) == 50000 and specials == {"<|endoftext|>": 50256}
    assert len(bpe.byte_letters()) == 256
