import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe import catalog
from trialframe.functions import expr, text
from trialframe.operators import gates, ledger, split, vector


def test_draws_equal_plain_ones(spark):
    rows = [(g, i, (i * 7 + g) % 5 - 2) for g in range(2) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, item long, v int").repartition(5)
    draws = 300
    bit = lambda i, d: hashlib.sha256(f"{d // 256}|{i}".encode()).digest()[d % 256 // 8] >> (7 - d % 8) & 1
    want = {(g, d + 1): sum(v * (1 - 2 * bit(i, d)) for h, i, v in rows if h == g) for g in range(2) for d in range(0, draws, 37)}
    got = {(r.g, r.perm): r.total for r in gates.permutation_sums(df, "item", "v", draws, ["g"]).collect()}
    assert len(got) == 2 * draws and {k: got[k] for k in want} == want
    assert gates.permutation_sums(df, "item", "v", draws, []).count() == draws


def test_resamples_are_those_of_a_bootstrap(spark):
    counts = gates.poisson_counts(list(range(3000)), 64)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.03 and counts.max() >= 5
    rng = np.random.default_rng(3)
    x = rng.normal(10, 2, 2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "item long, v double")
    low, high, mean = gates.intervals(gates.bootstrap_means(df, "item", "v", 2000, []), []).first()
    plain = np.percentile(rng.choice(x, (2000, len(x))).mean(axis=1), [2.5, 97.5])
    assert abs(mean - x.mean()) < 0.02 and np.allclose([low, high], plain, atol=0.02)


def plain_mmr(x, q, k, weight):
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x, q, out = unit(x), unit(q), []
    while len(out) < min(k, len(x)):
        score = weight * (x @ q) - ((1 - weight) * (x @ x[out].T).max(axis=1) if out else 0)
        out.append(min((i for i in range(len(x)) if i not in out), key=lambda i: (-score[i], i)))
    return out


@pytest.mark.parametrize("width", [4, 64])
def test_lazy_choice_equals_the_plain_one(spark, width):
    rng = np.random.default_rng(1)
    x = {g: rng.normal(size=(n, 6)) for g, n in (("a", 300), ("b", 120), ("c", 3))}
    rows = [(g, i, v.tolist()) for g, xs in x.items() for i, v in enumerate(xs)]
    pool = spark.createDataFrame(rows, "g string, id int, v array<double>").withColumn("q", F.array(*[F.lit(float(j)) for j in range(1, 7)]))
    for weight in (0.5, 1.0):
        got = {}
        for r in vector.mmr(pool, "g", "id", "v", "q", 50, weight, width).orderBy("g", "rank").collect():
            got.setdefault(r.g, []).append(r.id)
        assert got == {g: plain_mmr(xs, np.arange(1.0, 7.0), 50, weight) for g, xs in x.items()}


def test_a_row_that_points_away_from_the_first_choice_is_found(spark):
    # Of two candidates at a time: c is above what the first scan's last had, but d, which it left out, rises higher.
    rows = [(1, "a", [0.3, 0.95, 0.0, 0.0]), (1, "c", [0.2, -0.3, 0.93, 0.0]), (1, "d", [0.1, -0.99, 0.0, 0.0]), (1, "e", [0.05, 0.1, 0.0, 0.99])]
    pool = spark.createDataFrame(rows, "g int, id string, v array<float>").withColumn("q", F.array(*[F.lit(x).cast("float") for x in (1.0, 0.0, 0.0, 0.0)]))
    for width in (2, 64):
        assert [r.id for r in vector.mmr(pool, "g", "id", "v", "q", 2, width=width).orderBy("rank").collect()] == ["a", "d"]


def test_equal_vectors_are_taken_by_key(spark):
    # 997 copies of each of three vectors stand at many places of batches of any length.
    x = np.random.default_rng(5).normal(size=(3, 61)).astype("float32")
    rows = [(1, i, x[i % 3].tolist()) for i in range(2991)]
    pool = spark.createDataFrame(rows, "g int, id int, v array<float>").withColumn("q", F.array(*[F.lit(float(v)) for v in x.sum(axis=0)]))
    first = plain_mmr(x.astype(float), x.sum(axis=0).astype(float), 3, 0.5)
    got = [r.id for r in vector.mmr(pool.repartition(7, "id"), "g", "id", "v", "q", 3).orderBy("rank").collect()]
    assert got == first


def test_choice_of_more_rows_equals_its_sql(spark):
    data, name = "/root/testdata/sf0.1", "mmr_rerank"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    got = {tuple(r) for r in catalog.QUERIES[name](spark, data).select("label", "vec_id", "rank").collect()}
    assert got == set(c.execute(catalog.ORACLES[name]).fetchall())


def test_a_sample_fetches_texts_for_drawn_rows_alone(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("s"), F.repeat(F.lit("text "), 50).alias("text"))
    out = split.golden_sample(df, F.col("id"), "s", 5)
    assert out.columns == ["id", "s", "text", "number"] and sorted(r.number for r in out.collect()) == list(range(1, 16))
    assert "Exchange hash" not in out._jdf.queryExecution().executedPlan().toString()
    thin = split.bottom_k(df, F.col("id"), "s", 5, 7)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in thin and "WindowGroupLimit" in thin


def test_numbers_are_shown_plainly(spark):
    shown = {0.0001: "0.0001", 0.00123: "0.00123", 12345678.0: "12345678.0", 1e15: "1000000000000000.0", 1e16: "1e+16", 1e-5: "1e-05", -1.5e-7: "-1.5e-07", 2.5e22: "2.5e+22",
             0.0: "0.0", 7.0: "7.0", -12345678.5: "-12345678.5", 0.1: "0.1", 123456789012.25: "123456789012.25", float("inf"): "inf", float("-inf"): "-inf"}
    df = spark.createDataFrame([(v,) for v in shown], "v double")
    assert {r.v: r.t for r in df.select("v", text.shown_number(F.col("v")).alias("t")).collect()} == shown
    assert spark.range(1).select(text.shown_number(F.lit(12345678))).first()[0] == "12345678" and spark.range(1).select(text.shown_number(F.lit(float("nan")))).first()[0] == "nan"
    one = spark.range(1).select(text.render_history(F.lit(0.0001), F.lit(None).cast("double"), F.lit(None).cast("double"), F.array(F.lit("line"))).alias("h"), text.bullets(F.array(F.lit("a/*"), F.lit("b"))).alias("b")).first()
    assert one.h.split("\n")[2:] == ["- baseline (untouched tree): 0.0001", "- incumbent: unscored", "- best kept: none", "line"] and one.b == "- `a/*`\n- `b`"


def test_millionths_are_summed(spark):
    df = spark.createDataFrame([(0.00004,), (0.00016,), (0.000001,)], "usd double")
    assert float(df.agg(F.sum(expr.money(F.col("usd")))).first()[0]) == 0.000201


def test_reservations_under_two_caps(spark):
    events = [  # call, kind, usd, wall, refusal, spent usd, reserved usd, spent wall, reserved wall
        ("a", "check", 4.0, 10.0, None, 0, 4, 0, 10), ("b", "check", 7.0, 1.0, "max_usd", 0, 4, 0, 10), ("c", "check", 1.0, 95.0, "max_wall", 0, 4, 0, 10),
        ("d", "check", None, 1.0, "undeclared", 0, 4, 0, 10), ("a", "record", 1.5, 3.0, None, 1.5, 0, 3, 0), ("b", "check", 8.5, 1.0, None, 1.5, 8.5, 3, 1),
        ("b", "release", None, None, None, 1.5, 0, 3, 0), ("b", "release", None, None, None, 1.5, 0, 3, 0), ("x", "record", 0.25, 2.0, None, 1.75, 0, 5, 0), ("c", "record", 9.0, 0.0, None, 10.75, 0, 5, 0),
        ("e", "check", 0.0, 0.0, "max_usd", 10.75, 0, 5, 0),
    ]
    df = spark.createDataFrame([(1, k, *e[:4]) for k, e in enumerate(events)], "u int, o int, call string, kind string, usd double, wall double")
    got = ledger.reservations(df, "u", "o", "call", "kind", "usd", "wall", 10.0, 100.0).orderBy("o").collect()
    assert [tuple(r)[4:] for r in got] == [e[4:] for e in events]
    free = ledger.reservations(df, "u", "o", "call", "kind", "usd", "wall", None, None).where("refusal is not null").collect()
    assert sorted(r.refusal for r in free) == ["open", "undeclared"]
    with pytest.raises(ValueError, match="cap"):
        ledger.reservations(df, "u", "o", "call", "kind", "usd", "wall", -1.0, None)
