"""The classifiers' queries against plain versions: the whole way from texts to
scores, with dictionaries and dense matrices."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from edge_cases import edge_rows, words

from scorecraft.llm import quality, toxicity

MASK = (1 << 64) - 1


def bucket(value, bits):
    for _ in range(2):
        value = value * 0xD6E8FEB86659FD93 & MASK
        value ^= value >> 32 if _ == 0 else 0
    return value >> (64 - bits)


def logistic(rows, y, features, l2):
    """AdaGrad on a dense matrix: 200 steps of the whole sample."""
    x = np.zeros((len(rows), len(features)))
    for i, row in enumerate(rows):
        for name, value in row.items():
            x[i, features[name]] = value
    w, b, gw, gb = np.zeros(len(features)), 0.0, np.full(len(features), 1e-8), 1e-8
    for _ in range(200):
        wrong = 1 / (1 + np.exp(-(x @ w + b))) - y
        dw, db = l2 * w + x.T @ wrong / len(y), wrong.mean()
        gw, gb = gw + dw**2, gb + db**2
        w, b = w - 0.5 * dw / np.sqrt(gw), b - 0.5 * db / math.sqrt(gb)
    return w, b


# -- quality ------------------------------------------------------------------------


def ballot(text):
    """b, g or - of the eight labellers."""
    w = text.split()
    n, chars = max(len(w), 1), sum(map(len, w)) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(c.isalpha() for c in text) or 1
    windows = [w[i : i + 1000] for i in range(0, len(w), 1000)]
    ends = sum(x[-1] in ".,;:!?" for x in w) / n
    length = chars / n
    low = lambda v, good, bad: "g" if v <= good else "b" if v >= bad else "-"
    found = [
        low(sum(a == b for a, b in zip(w, w[1:])) / n, 0.05, 0.2), low(sum(len(x) - len(set(x)) for x in windows) / n, 0.5, 0.7),
        low(sum(c.isupper() for c in text) / letters, 0.1, 0.5), low(1 - sum(c.isalnum() for c in text) / chars, 0.06, 0.12),
        low(text.count("|") / n, 0.0, 0.1), low(sum(c for c in Counter(lines).values() if c > 1) / max(len(lines), 1), 0.0, 0.6),
        "g" if 3.5 <= length <= 6 else "b" if length < 2.5 or length > 9 else "-",
        "g" if 0.05 <= ends <= 0.3 else "b" if ends < 0.02 or ends > 0.6 else "-",
    ]
    need = [20, 20, 1, 20, 20, 20, 20, 20]
    return "".join(v if len(w) >= k else "-" for v, k in zip(found, need))


def posteriors(ballots):
    """EM over the documents one by one."""
    good = []
    for v in ballots:
        g = (v.count("g") + 1) / (8 - v.count("-") + 2)
        good.append(min(g, 0.4) if "b" in v else g)
    for _ in range(100):
        prior = (sum(good) + 1) / (len(ballots) + 2)
        rates = []
        for j in range(8):
            own = []
            for k in (0, 1):
                weight = [g if k else 1 - g for g in good]
                share = {v: (sum(x for x, b in zip(weight, ballots) if b[j] == v) + 0.1) / (sum(weight) + 0.3) for v in "bg-"}
                if k and share["b"] > 0.01:
                    share = {v: 0.01 if v == "b" else share[v] * 0.99 / (1 - share["b"]) for v in "bg-"}
                own.append(share)
            rates.append(own)
        for i, v in enumerate(ballots):
            odds = math.log(prior) - math.log(1 - prior)
            odds += sum(math.log(rates[j][1][x]) - math.log(rates[j][0][x]) for j, x in enumerate(v) if x != "-")
            good[i] = 1 / (1 + math.exp(-odds))
    return prior, good


def shapes(text):
    w = text.split()
    if not w:
        return {}
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text)
    counts = Counter(re.sub(r"(\S)\1+", r"\1", shape).split())
    counts["= before"] = sum(a == b for a, b in zip(w, w[1:]))
    counts["= earlier"] = sum(len(x) - len(set(x)) for x in (w[i : i + 1000] for i in range(0, len(w), 1000)))
    out = Counter()
    for name, c in counts.items():
        out[bucket(xxhash.xxh3_64_intdigest(name), 18)] += math.sqrt(c / len(w))
    return out


def test_quality_against_a_plain_version(spark):
    texts = [r[1] for r in edge_rows()] + [f"Clean words, number {i}. {words(i, 60)} and an end." for i in range(60)]
    texts += [" ".join(["| spam |"] * (20 + i)) for i in range(10)] + ["SHOUT " * (25 + i) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["__c0"]: r for r in quality.score_quality(docs).collect()}
    ballots = [ballot(t or "") for t in texts]
    prior, good = posteriors(ballots)
    found = [shapes(t or "") for t in texts]
    features = {name: i for i, name in enumerate(sorted({n for f in found for n in f}))}
    w, b = logistic(found, np.array(good), features, 1e-5)
    for i in range(len(texts)):
        assert got[i].votes == ballots[i]
        assert got[i].posterior == pytest.approx(good[i], abs=1e-6)
        score = 1 / (1 + math.exp(-(sum(w[features[n]] * v for n, v in found[i].items()) + b))) if found[i] else prior
        assert got[i].score == pytest.approx(score, abs=2e-3)
        assert got[i].kept == (got[i].score >= 0.5)


# -- toxicity -----------------------------------------------------------------------


def grams(text):
    """Buckets of the 3-, 5- and 7-grams of a text, each once."""
    chars = [ord(c) for c in f" {' '.join((text or '').lower().split())} "]
    out = set()
    for n in (3, 5, 7):
        for i in range(len(chars) - n + 1):
            value = 0
            for c in chars[i : i + n]:
                value = (value * 0x9E3779B97F4A7C15 + c) & MASK
            out.add(bucket(value, 20))
    return out


def test_toxicity_against_a_plain_version(spark):
    rows = [(i, words(i, 12) + (" vexing" if i % 5 == 0 else " pleasing") + f" t{i % 7}", int(i % 5 == 0)) for i in range(150)]
    rows += [(200, None, 0), (201, "", 1), (202, rows[0][1], 1), (203, "vexing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic"), docs.drop("toxic")).collect()}
    known = [(grams(t), y) for _, t, y in rows if y is not None]
    n1, n0 = sum(y for _, y in known), sum(1 - y for _, y in known)
    ones, zeros = Counter(), Counter()
    for held, y in known:
        (ones if y else zeros).update(held)
    every, size = set(ones) | set(zeros), 1 << 20
    all1, all0 = sum(ones.values()) + size, sum(zeros.values()) + size
    scale = {}
    for k in every:
        share = (ones[k] + zeros[k]) / (n1 + n0)
        error = math.sqrt(max(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        if abs(ones[k] / n1 - zeros[k] / n0) >= toxicity.Z * error:
            scale[k] = math.log((ones[k] + 1) / all1) - math.log((zeros[k] + 1) / all0)

    def row(held):
        own = {k: scale[k] for k in held if k in scale}
        norm = math.sqrt(max(sum(v * v for v in own.values()), 1.0))
        return {k: v / norm for k, v in own.items()}

    features = {k: i for i, k in enumerate(sorted(scale))}
    w, b = logistic([row(h) for h, _ in known], np.array([y for _, y in known], float), features, 1e-5)
    for i, text, _ in rows:
        score = 1 / (1 + math.exp(-(sum(w[features[k]] * v for k, v in row(grams(text)).items()) + b)))
        assert got[i].score == pytest.approx(score, abs=2e-3)
        assert got[i].predicted == (got[i].score >= 0.5)
    assert len(features) > 5 and got[200].score == pytest.approx(1 / (1 + math.exp(-b)), abs=2e-3)
