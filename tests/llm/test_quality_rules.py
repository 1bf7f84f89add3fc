import re

from pyspark.sql import functions as F

from trialframe.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(t):
    w = WORD.findall(t or "")
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_equal_plain_ones(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [
        None, "", "   \n\t", "one", "a b c d e a b c d e f", "the cat sat on the mat and the dog ran to it\n" * 3, "é 😀 ## a|b <x>\n\n é 😀 ## a|b <x>\n",
        "x y z " * 9, " lead and trail  ", long, "A\x0bB\x1cC\x85D E", "to be or not to be that is the question and this is it",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = F.col("quality_verdict")
    rows = Q.with_quality(df).select("doc_id", *[q[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]).collect()
    for r in rows:
        assert tuple(r)[1:7] == plain(texts[r.doc_id]), texts[r.doc_id]
        assert not (r[6] and r[7])


def test_verdicts(spark):
    good = "the river and the hill are in the valley where people of the town walk with dogs for an hour each day"
    bad = ["### *** $$$ " * 8, "SALE!! NOW!! BUY!! " + "THE!! AND!! OF!! IN!! IT!! IS!! BE!! ON!!", "short text", None, "zq " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([good, *bad])], "doc_id long, text string")
    assert [r.doc_id for r in Q.keep_good(df).collect()] == [0]


def test_one_native_projection_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", 2, 3)], "doc_id long, text string, w int, quality_verdict int")
    out = Q.with_quality(df)
    assert out.columns == ["doc_id", "text", "w", "quality_verdict"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert Q.keep_good(df.limit(0)).columns == df.columns and Q.keep_good(df.limit(0)).count() == 0


def test_thresholds_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    assert Q.keep_good(df, rules=()).count() == 1
    assert Q.keep_good(df, rules=(Q.Rule("mean_word_length", high=2),)).count() == 0
