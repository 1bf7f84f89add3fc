import random
import re
from collections import Counter
from math import exp, log, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trialframe.llm import toxicity as T

RNG = random.Random(6)
CLEAN = [f"{a}{b}" for a in ("riv", "hill", "tow", "lan", "gar") for b in ("er", "en", "ing", "s", "al", "o")]


def sentence(bad):
    w = [RNG.choice(CLEAN) for _ in range(RNG.randrange(3, 9))]
    if bad:
        w.insert(RNG.randrange(len(w)), RNG.choice(["nastyword", "uglyterm", "badstemmed", "badstemming"]))
    return " ".join(w).capitalize() + RNG.choice([".", "!", "?"])


def corpus(n):
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        k = RNG.randrange(1, 15)
        at = RNG.randrange(k) if toxic else -1
        rows.append((i, " ".join(sentence(j == at) for j in range(k)), int(toxic)))
    return rows


def test_held_out_texts_and_sentences(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels.where(T.learnable(F.col("doc_id"))))
    extra = spark.createDataFrame([(900, None, 1), (901, "", 1), (902, "You BADSTEMMER here. Fine hill.", 1), (903, "Lané river. Söme uglyterm, thing!\nHill.", 1), (904, "hills. " * 20_000 + "nastyword", 1)], docs.schema)
    out = {r.doc_id: r.toxicity for r in T.score_texts(docs.unionByName(extra), model).collect()}
    held = {r.doc_id for r in docs.where(~T.learnable(F.col("doc_id"))).collect()}
    wrong = [i for i, _, y in rows if i in held and (out[i].score >= T.THRESHOLD) != bool(y)]
    assert len(held) > 80 and len(wrong) <= 2
    assert out[900].score == out[901].score == 0 and out[900].offending == []
    assert out[902].score >= 0.7  # an unseen word with a known beginning
    text = "Lané river. Söme uglyterm, thing!\nHill."
    assert [text[o.start : o.end].strip() for o in out[903].offending] == ["Söme uglyterm, thing!"]
    assert out[904].score >= 0.7
    for i, t, y in rows:
        t = t.lower()
        if y and out[i].score >= 0.7:
            assert any(("nasty" in t[o.start : o.end]) or ("ugly" in t[o.start : o.end]) or ("badstem" in t[o.start : o.end]) for o in out[i].offending)


def test_noisy_or_of_sentences():
    model = T.ToxicityModel(np.array([5]), np.array([1.0]), -0.5)
    lookup = np.zeros(1 << T.BITS, np.int16)
    b, _ = T.features(np.frombuffer(b"bad", np.uint8), np.array([0, 3]))
    lookup[b[0]] = 1
    p = 1 / (1 + np.exp(-0.5))
    score, found = model.score(pa.array(["bad. bad. ok", "ok", None]), lookup, keep=0.6)
    assert abs(score[0] - (1 - (1 - p) ** 2)) < 1e-9 and score[1] == score[2] == 0
    assert [(o["start"], o["end"]) for o in found[0]] == [(0, 4), (4, 9)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs, none)
    assert {r.toxicity.score for r in T.score_texts(docs, model).collect()} == {0.0}
    one = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert T.labelled(docs, one, "doc_id", "text", "toxic").select("i", "y").collect() == [(1, 1), (1, 1)]
    assert T.score_texts(docs.limit(0), model).count() == 0


def test_model_does_not_depend_on_partitions(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    one, many = (T.fit(docs.repartition(n, "doc_id"), labels) for n in (1, 200))
    assert len(one.buckets) >= 4 and one.buckets.tolist() == many.buckets.tolist()
    assert np.allclose(one.weights, many.weights, atol=1e-6) and abs(one.bias - many.bias) < 1e-6


def test_selection_equals_counting_by_hand(spark):
    rows = corpus(300)
    have = [{b for w in re.findall(r"[a-z0-9]+", t.lower()) for b in T.features(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0].tolist()} for _, t, _ in rows]
    a, b = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
    p, n = Counter(f for (*_, y), h in zip(rows, have, strict=True) for f in h if y), Counter(f for (*_, y), h in zip(rows, have, strict=True) for f in h if not y)
    tried = [f for f in p if p[f] >= T.LEAST_TEXTS]
    limit = max(2.0, NormalDist().inv_cdf(1 - T.FALSE_FEATURES / len(tried)))
    odds = {f: log((p[f] + 0.5) / (a - p[f] + 0.5)) - log((n[f] + 0.5) / (b - n[f] + 0.5)) for f in tried}
    want = sorted(f for f in tried if odds[f] > T.LEAST_ODDS and odds[f] / sqrt(1 / (p[f] + 0.5) + 1 / (n[f] + 0.5)) > limit)
    got = T.select_features(spark.createDataFrame([(t, y) for _, t, y in rows], "t string, y int"))
    assert got.tolist() == want and 4 <= len(want) < 30


def test_fit_reaches_the_minimum_of_the_noisy_or_loss():
    rng = random.Random(2)
    y = np.array([i % 2 for i in range(60)])
    sent = [[rng.randrange(4) for _ in range(6)] for _ in y]
    feat = [[rng.randrange(5) if not t or rng.random() < 0.7 else 5 for _ in range(6)] for t in y]
    ridge, weight = 1e-2, 3.0
    model = T.train(np.arange(6), y, sent, feat, steps=3000, rate=0.02, ridge=ridge, weight=weight)

    def loss(x):
        total = 0.0
        for t, ss, fs in zip(y, sent, feat, strict=True):
            clean = 1.0
            for s in set(ss):
                z = x[-1] + sum(x[f] for q, f in zip(ss, fs, strict=True) if q == s)
                clean *= 1 - 1 / (1 + exp(-z))
            total -= weight * log(1 - clean) if t else log(clean)
        return total / len(y) + ridge / 2 * float(x[:-1] @ x[:-1])

    at = np.r_[model.weights, model.bias]
    slope = [(loss(at + e) - loss(at - e)) / 2e-4 for e in 1e-4 * np.eye(7)]
    assert max(map(abs, slope)) < 2e-3, slope


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "fine.", 5, "x", 2)], "doc_id long, text string, score int, offending string, toxicity int")
    out = T.score_texts(docs, T.ToxicityModel(np.array([5]), np.array([1.0]), -0.5))
    assert sorted(out.columns) == sorted(docs.columns) and out.first().score == 5 and out.first().toxicity.score == 0
