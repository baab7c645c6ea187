from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import linear, quality, toxicity
from scorecraft.llm.common import fold

from edge_cases import edge_rows, words

SMALL = "/root/testdata/sf0.01"


def test_quality_against_the_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs.select("doc_id", "text")).join(labels, F.col("__c0") == F.col("doc_id")).collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)
    clean = [r for r in rows if r["quality"] == 1]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert sum((r["posterior"] >= 0.5) == bool(r["quality"]) for r in rows) >= 0.97 * len(rows)


def test_em_finds_the_accuracies_of_simulated_labellers():
    rng = np.random.default_rng(2)
    n, counts, right = 20_000, Counter(), []
    truth = rng.random(n) < 0.8
    hit, false = rng.uniform(0.3, 0.8, 8), 0.005
    for good in truth:
        vote = np.where(rng.random(8) < (false if good else hit), quality.BAD, np.where(rng.random(8) < 0.2, quality.NONE, quality.GOOD))
        counts[int(sum(v * 3**j for j, v in enumerate(vote)))] += 1
        right.append((int(sum(v * 3**j for j, v in enumerate(vote))), good))
    share, rates, posterior = quality.expectation_maximisation(dict(counts))
    assert abs(share - 0.8) < 0.03 and np.abs(rates[:, 0, quality.BAD] - hit).max() < 0.06
    assert np.mean([(posterior[c] >= 0.5) == g for c, g in right]) > 0.97


def test_quality_on_edge_cases(spark, edge, empty):
    scored = quality.score_quality(edge)
    rows = scored.collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if not (r["__c1"] or "").split()}
    assert len(blank) == 1  # the share of good documents
    assert len({(r["__c1"], r["score"]) for r in rows}) == len({r["__c1"] for r in rows})
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.keep_good(empty).collect() == []
    nulls = empty.union(spark.createDataFrame([(None,) * 5], empty.schema))
    assert quality.keep_good(nulls).count() <= 1


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id")) == 0
    rows = toxicity.score_toxicity(docs, labels, docs.filter(~held_out)).filter(held_out).join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    # some of the small table's toxic labels are of texts whose words were garbled
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


def test_toxicity_on_edge_cases(spark, edge, empty):
    marks = [(i, i % 2) for i, *_ in edge_rows() if i is not None] + [(1, 0), (1, 1), (None, 1), (2, None), (3, 7)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    rows = toxicity.score_toxicity(edge, labels, edge).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in edge_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    one = toxicity.score_toxicity(edge, labels.filter("toxic = 0"), edge).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["predicted"] == 0
    none = toxicity.score_toxicity(edge, labels.limit(0), edge).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.score_toxicity(empty, labels, empty).collect() == []


def test_toxicity_learns_a_word(spark):
    rows = [(i, words(i, 40) + (" vexing " if i % 4 == 0 else " pleasing ") + words(i + 1000, 40), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = docs.filter("doc_id < 300")
    got = toxicity.score_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic"), seen).filter("doc_id >= 300").collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)


def test_logistic_regression_separates():
    rng = np.random.default_rng(1)
    y = (rng.random(500) < 0.5).astype(float)
    columns = np.stack([y.astype(int), rng.integers(2, 30, 500)], 1).ravel()
    w, b = linear.fit_logistic(columns, np.full(500, 2), np.ones(1000), y, 30)
    assert w[1] - w[0] > 2 and abs(b) < 3


def _crowded(spark, scratch, text):
    """9,000 rows of which a third hold ``text``, the others one text each."""
    rows = [(i, text if i % 3 == 0 else f"{words(i, 30)} t{i}", int(i % 2)) for i in range(9000)]
    return spark.read.parquet(scratch(spark.createDataFrame(rows, "doc_id long, text string, toxic int")))


@pytest.mark.parametrize("text", [None, "the same words in a great many rows " * 5])
def test_fit_samples_thin_copies_and_nulls_like_other_rows(spark, scratch, monkeypatch, text):
    docs, fits = _crowded(spark, scratch, text), []

    def spy(columns, lengths, values, y, features, **kw):
        fits.append((lengths, y))
        return linear.fit_logistic(columns, lengths, values, y, features, **kw)

    monkeypatch.setattr(quality, "fit_logistic", spy)
    monkeypatch.setattr(toxicity, "fit_logistic", spy)
    seen = []
    for module in (quality, toxicity):
        monkeypatch.setattr(module, "sampled", lambda *a: seen.append(linear.sampled(*a)) or seen[-1])
    quality.fit(docs, "text", 900)
    toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), "doc_id", "text", "toxic", 900, 6.0)
    assert all(750 < len(y) < 1050 for _, y in fits)
    # a frame that no file backs is sampled by the rows of its written copy
    quality.fit(spark.createDataFrame(docs.collect(), docs.schema), "text", 900)
    assert len(fits) == 3 and 750 < len(fits[2][1]) < 1050
    crowd = docs.filter(F.col("text").eqNullSafe(F.lit(text))).filter(seen[0]).count()
    assert 220 < crowd < 380


def test_a_long_clean_document_is_judged_like_its_parts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    clean = docs.join(labels.filter("quality = 1"), "doc_id").filter("lang = 'en'").orderBy("doc_id").select("text").limit(4000)
    parts, n = [r["text"] for r in clean.collect()], 0
    long, i = [], 0
    while n < 300_000:
        long.append(parts[i % len(parts)])
        n, i = n + len(long[-1].split()), i + 1
    text = "\n".join(long)
    distinct = list(quality.LABELLERS).index("distinct words")
    assert quality.votes(text)[distinct] == quality.GOOD
    assert quality.votes(" ".join(["the same few words"] * 75_000))[distinct] == quality.BAD
    place = quality.hashed(np.array([quality.xxhash.xxh3_64_intdigest("= earlier")], np.uint64), quality.BITS)
    at, value = quality.features(text, quality.Shape(), {})
    assert value[at == place] ** 2 < 0.5
    few = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = quality.score_quality(few.union(spark.createDataFrame([(-1, text)], few.schema))).filter("__c0 = -1").collect()
    assert rows[0]["kept"] and rows[0]["posterior"] >= 0.5
