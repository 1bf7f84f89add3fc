import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from trialframe.llm import language_id as L

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ung ein der pf", "cc": "éau que è ou ç"}


def corpus(n=240):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        s = SYLLABLES[lang].split()
        rows.append((i, " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (1003, "kalomi", None), (None, "sch ung", "bb"), (1005, "SCHUNG EINDER " * 20_000, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, score int")
    model = L.fit(L.learnable(df))
    out = {r.doc_id: r for r in L.identify(df, model).withColumn("h", L.held_out(F.col("doc_id"))).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and all(out[r[0]].h for r in held)
    assert sum(out[i].language.lang == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(out[i].language.lang == "und" and out[i].language.score == 0 for i in (1000, 1001, 1002))
    assert out[1003].language.lang == "aa" and out[1005].language.lang == "bb" and out[1005].score == 7
    assert all(0 <= r.language.score <= 1 for r in out.values())
    strange = spark.createDataFrame([(1, "ωψξ ζθφ ωωψ")], "doc_id long, text string")
    assert L.identify(strange, model).first().language.rejected


def test_labels_of_held_out_rows_are_not_learned(spark):
    df = spark.createDataFrame(corpus(120), "doc_id long, text string, lang string")
    spoiled = df.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = L.fit(L.learnable(df)), L.fit(L.learnable(spoiled))
    assert a.langs == b.langs and (a.centroids == b.centroids).all() and (a.idf == b.idf).all()


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = L.fit(L.learnable(df))
    assert L.identify(df, model).first().language.lang == "und"
    assert L.identify(df.limit(0), model).count() == 0


def test_frequencies_cover_all_rows(spark):
    df = spark.createDataFrame(corpus(90), "doc_id long, text string, lang string").repartition(5)
    counts, n = L.document_frequencies(df, "text")
    texts = [r[1] for r in corpus(90)]
    assert n == 90
    assert (counts == sum((c > 0).sum(0) for _, c in L.vectors(texts_array(texts)))).all()


def texts_array(texts):
    import pyarrow as pa

    return pa.array(texts)


def test_equals_plain_cosines(spark):
    """Counts by n-gram, weights and cosines without arrays; n-grams meet in a bucket as the definition says."""
    full = (1 << 64) - 1

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & full
        return x ^ (x >> 31)

    model = L.fit(spark.createDataFrame(corpus(150), "doc_id long, text string, lang string"))
    texts = [r[1] for r in corpus(30)] + ["Éau  QUE, 12 sch!", "ka"]
    names, score, _ = model.predict(texts_array(texts))
    for t, name, got in zip(texts, names, score, strict=True):
        t = " ".join(re.findall(r"[^\W\d_]+", t.lower()))
        counts = Counter()
        for n in L.GRAMS:
            for k in range(len(t) - n + 1):
                counts[mixed(sum(ord(c) * int(L._SLOT[j + 8 * n]) for j, c in enumerate(t[k : k + n])) & full) % L.BUCKETS] += 1
        x = {b: math.log1p(c) * model.idf[b] for b, c in counts.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        cosines = [sum(v * c[b] for b, v in x.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert model.langs[best] == name and abs(min(1, max(0, cosines[best])) - got) < 1e-9


def test_a_clashing_column_is_replaced(spark):
    df = spark.createDataFrame([(1, "ka lo", 5, "x")], "doc_id long, text string, language int, score string")
    out = L.identify(df, L.fit(spark.createDataFrame(corpus(60), "doc_id long, text string, lang string"))).first()
    assert out.language.lang == "aa" and out.score == "x"
