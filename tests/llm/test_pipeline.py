import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
DROP = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables, columns = [docs.collect()], docs.columns
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SMALL), "test")
        tables.append(docs.collect())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    start, good, distinct, apart, mixed, encoded = tables
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    clean = [r["doc_id"] for r in start if labels.get(r["doc_id"]) == 1]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)

    groups = defaultdict(list)
    for r in good:
        groups[r["text"].translate(DROP)].append((-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in distinct} == {min(g)[1] for g in groups.values()}

    sets = [(r["doc_id"], shingles(r["text"])) for r in distinct]
    low = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((low[i], low[j]))
                low = {k: x if v == y else v for k, v in low.items()}
    assert {r["doc_id"] for r in apart} == set(low.values())

    times = Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= set(low.values())
    words, taken = Counter(), Counter()
    for r in apart:
        words[r["source"]] += len(r["text"].encode().split())
        taken[r["source"]] += times[r["doc_id"]] * len(r["text"].encode().split())
    assert abs(sum(taken.values()) - sum(words.values())) < 0.2 * sum(words.values())

    library, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r["doc_id"]: r["text"] for r in start}
    assert Counter(r["doc_id"] for r in encoded) == times
    for r in encoded:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] * 4 == len(r["ids"])


def test_edge_cases_pass_through_every_stage(spark, edge, empty):
    for docs in (edge, empty):
        for _, function in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(function(spark, docs, SMALL), "test")
        assert docs.count() >= 0


def test_registered(spark):
    names = [f"op{n}_" for n in range(1, 11)] + ["pipeline"]
    queries, sql = entry.queries(), entry.oracle_sql()
    assert all(any(q.startswith(n) for q in queries) for n in names) and set(sql) <= set(queries)
