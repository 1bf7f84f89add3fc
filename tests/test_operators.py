"""Known values and edge cases of the operators."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe import catalog
from trialframe.functions import expr, text
from trialframe.operators import bakeoff, batch_jobs, cost, gates, ledger, lifecycle, metrics, spatial, split, tables, train_data, vector


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_sign_test_is_exact(spark):
    df = spark.createDataFrame([(7, 0), (0, 7), (3, 3), (60, 40), (0, 0), (3000, 2800)], "w int, l int")
    got = [r.p for r in df.select(gates.sign_test_p(F.col("w"), F.col("l")).alias("p")).collect()]
    want = [min(1, 2 * sum(math.comb(w + n, k) for k in range(min(w, n) + 1)) / 2 ** (w + n)) if w + n else 1 for w, n in [(7, 0), (0, 7), (3, 3), (60, 40), (0, 0), (3000, 2800)]]
    assert got == pytest.approx(want, rel=1e-9) and got[0] == pytest.approx(0.015625)


def test_confusion_counts_and_empty(spark):
    rows = [(t == "T", p == "T", 1) for t, p in ("TT", "TT", "TF", "FT", "FF", "FF", "FF")]
    r = metrics.confusion(spark.createDataFrame(rows, "t boolean, p boolean, g int"), F.col("t"), F.col("p"), ["g"]).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (2, 1, 1, 3)
    assert r.accuracy == pytest.approx(5 / 7) and r.precision == r.recall == r.f1 == pytest.approx(2 / 3)
    none = metrics.confusion(spark.createDataFrame([(None, None, 1)], "t boolean, p boolean, g int"), F.col("t"), F.col("p"), ["g"]).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, True, 0.9), (1, True, 0.5), (1, False, 0.5), (1, False, 0.1), (2, True, 0.3), (2, None, 0.2)], "g int, y boolean, s double")
    got = {r.g: r.auc for r in metrics.rank_auc(df, F.col("y"), F.col("s"), ["g"]).collect()}
    assert got[1] == pytest.approx(0.875) and math.isnan(got[2])


def test_thresholds(spark):
    df = spark.createDataFrame([("a", s) for s in (0.1, 0.2, 0.3, 0.9, 0.95)] + [("b", 0.5)] * 3, "g string, s double")
    got = {r.g: (r.threshold, r.fires) for r in metrics.budget_threshold(df, "s", 2, ["g"]).collect()}
    assert got == {"a": (0.9, 2), "b": (None, 0)}


def outputs(spark, rows):
    return spark.createDataFrame(rows, "arm string, arm_idx int, item long, field string, vnum double, vstr string")


def test_absent_fields_lower_means_and_agreement(spark):
    rows = [("a", 0, i, "x", 1.0, None) for i in range(8)] + [("b", 1, i, "x", 1.0, None) for i in range(7)]
    rows += [("a", 0, i, "t", None, "u") for i in range(8)] + [("b", 1, i, "t", float(i), None) for i in range(8)]
    out = outputs(spark, rows)
    n = bakeoff.item_count(out)
    means = {(r.arm, r.field): r["mean"] for r in bakeoff.mean_by_field(out, n).collect()}
    assert means["b", "x"] == 7 / 8
    assert {r.arm: r.agreement for r in bakeoff.agreement(out).collect()} == {"a": 7 / 16, "b": 7 / 16}
    differ = {(r.arm, r.field): r.disagreement for r in bakeoff.field_disagreement(out, "a", n).collect()}
    assert differ == {("b", "x"): 1 / 8, ("b", "t"): 1.0}


def test_nan_equals_nothing_and_viability(spark):
    rows = [(a, k, 0, f, v, None) for k, a in enumerate("ab") for f, v in (("x", math.nan), ("viable", 1.0 if a == "b" else 0.0), ("m", 0.9 - k * 0.5))]
    out = outputs(spark, rows)
    assert {r.agreement for r in bakeoff.agreement(out).collect()} == {1 / 3} or {r.agreement for r in bakeoff.agreement(out).collect()} == {0.0}
    board = {r.arm: (r.rank, r.winner) for r in bakeoff.leaderboard(out.where("field <> 'x'"), "m", "m").collect()}
    assert board == {"b": (1, True), "a": (2, False)}


def test_split_sizes_and_determinism(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, label int")
    a, b = (split.stratified_split(df, F.col("id"), ["label"]) for _ in range(2))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    counts = {(r.label, r.bucket): r["count"] for r in a.groupBy("label", "bucket").count().collect()}
    assert counts == {(k, b): n for k in (0, 1) for b, n in (("train", 15), ("valid", 2), ("test", 3))}
    assert split.overlaps(a, "id").count() == 0
    with pytest.raises(ValueError):
        split.stratified_split(df, F.col("id"), ["label"], 0.9, 0.2)
    assert split.dedupe(df.union(df), F.col("id").cast("string"), F.col("label")).count() == 40


def test_digest_ignores_order_not_repeats(spark):
    df = spark.createDataFrame([(1, t) for t in "abc"], "g int, t string")
    d = lambda x: split.dataset_digest(x, F.col("t"), ["g"]).first().digest
    assert d(df) == d(df.orderBy(F.desc("t"))) and len(d(df)) == 16 and d(df.union(df)) != d(df)


def test_batches_run_on_over_epochs(spark):
    out = split.batch_plan(spark.range(5), F.col("id"), 2, 3)
    assert sorted(r.position for r in out.collect()) == list(range(15))
    assert out.groupBy("batch").count().where("count > 2").count() == 0


def test_journal_walk(spark):
    df = spark.createDataFrame([("e", i, m) for i, m in enumerate([0.5, 0.7, 0.7, None, 0.9])], "e string, u int, m double")
    for direction, want in (("max", "keep keep discard crash keep"), ("min", "keep discard discard crash discard")):
        v = ledger.running_verdicts(df, "e", "u", "m", direction)
        assert [r.verdict for r in v.orderBy("u").collect()] == want.split()
    r = ledger.journal_report(ledger.running_verdicts(df, "e", "u", "m"), "e", "u", "m").first()
    assert (r.units, r.kept, r.crashes, r.best_metric, r.best_unit, r.next_unit) == (5, 3, 1, 0.9, 4, 5)


def test_ledger_of_reservations(spark):
    rows = [("c", 1, 1, "reserved", 2.0), ("c", 1, 2, "completed", 1.5), ("c", 2, 3, "reserved", 9.0), ("c", 2, 4, "reserved", 2.0), ("c", 3, 5, "rejected", 0.0), ("c", 4, 6, "infra_aborted", 0.0)]
    df = spark.createDataFrame(rows, "campaign string, seq int, line int, event string, usd double")
    r = ledger.ledger_totals(df, "campaign", "seq", "line", "usd").first()
    assert (float(r.spent), float(r.reserved), float(r.total)) == (1.5, 2.0, 3.5)
    assert ledger.consecutive_failures(df, "campaign", "line").first().failures == 2
    assert [r.streak for r in ledger.running_streak(df, "campaign", "line").orderBy("line").collect()] == [0, 0, 0, 0, 1, 2]


def test_registry_restarts_at_the_last_register(spark):
    rows = [("r", 1, "register", 0.0), ("r", 2, "bind", 1.0), ("r", 3, "register", 0.0), ("r", 4, "terminal", 5.0), ("q", 1, "bind", 1.0)]
    df = spark.createDataFrame(rows, "run string, line int, op string, v double")
    assert [tuple(r) for r in ledger.fold_registry(df, "run", "line", "v").collect()] == [("r", 3, None, 5.0, 1)]


def test_admission_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([40, 70, 60, 1])], "e string, o int, cents long")
    got = [(r.admitted, r.running) for r in ledger.admitted(df, "e", "o", "cents", 100).orderBy("o").collect()]
    assert got == [(True, 40), (False, 40), (True, 100), (False, 100)]


def test_upsert_insert_once_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert sorted(map(tuple, tables.upserted(old, new.select("k", "v", "o"), ["k"], F.col("o")).select("k", "v").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    fresh, conflicts = tables.insert_once(old, new.select("k", "v"), ["k"], "v")
    assert [r.k for r in fresh.collect()] == [3] and {r.v for r in conflicts.collect()} == {"x", "y"}
    assert sorted(tuple(r) for r in tables.diff(old, new.where("o = 1").select("k", "v"), "k", "v").collect()) == [(1, "a", None), (2, "b", "x"), (3, None, "z")]


def test_unpriced_model_raises(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 2_000_000), ("m", 0, 0)], "model string, input_tokens long, output_tokens long")
    prices = spark.sql("select 'm' model, cast(10 as decimal(10,4)) input_price, cast(10 as decimal(10,4)) output_price")
    assert float(cost.cost_by_model(calls, prices).first().usd) == 30.0
    with pytest.raises(Exception, match="no price for model"):
        cost.cost_by_model(calls, prices.withColumn("model", F.lit("n"))).collect()


def test_masks_shift_by_one(spark):
    df = spark.createDataFrame([("ab", "abcd")], "p string, t string").select(train_data.char_codes(F.col("p")).alias("p"), train_data.char_codes(F.col("t")).alias("t"))
    m = train_data.completion_mask(F.col("p"), F.col("t"), 0.5)
    r = df.select(*[c.alias(k) for k, c in m.items()]).first()
    assert (r.inputs, r.targets, r.weights) == ([97, 98, 99], [98, 99, 100], [0.0, 0.5, 0.5])
    assert df.select(expr.common_prefix(F.col("p"), F.col("t")).alias("n")).first().n == 2


def test_batches_within_budgets(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(257)] + [(2, i, 100_000) for i in range(3)], "g int, o long, c long")
    got = train_data.packed_batches(df, ["g"], "o", "c", 256, 240_000).groupBy("g", "batch").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 256), (1, 1, 1), (2, 0, 2), (2, 1, 1)]


def test_deltas_of_growing_text(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(["a", "a", "a b", "a b c"])], "s string, o int, t string")
    assert [(r.o, r.delta) for r in train_data.text_deltas(df, "s", "o", "t").orderBy("o").collect()] == [(0, "a"), (2, "b"), (3, "c")]


def test_mmr_prefers_diverse(spark):
    rows = [(1, "a", [1.0, 0.0, 0.0]), (1, "c", [0.9, 0.1, 0.0]), (1, "b", [0.0, 1.0, 0.0])]
    pool = spark.createDataFrame(rows, "g int, id string, v array<double>").withColumn("q", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    for weight, want in ((1.0, ["a", "c"]), (0.3, ["a", "b"])):
        assert [r.id for r in vector.mmr(pool, "g", "id", "v", "q", 2, weight).orderBy("rank").collect()] == want


def test_readings_are_reconciled(spark):
    cols = "page int, k int, text string, x double, y double, w double, h double, confidence double"
    a = spark.createDataFrame([(1, 1, "100", 0.0, 0.0, 40.0, 10.0, 0.9), (1, 2, "same", 100.0, 0.0, 40.0, 10.0, 0.9)], cols)
    b = spark.createDataFrame([(1, 1, "700", 2.0, 1.0, 40.0, 10.0, 0.8), (1, 2, "Same", 101.0, 1.0, 40.0, 10.0, 0.8), (1, 3, "extra", 0.0, 500.0, 40.0, 10.0, 0.7)], cols)
    got = {(r.text, r.origin, round(r.confidence, 3)) for r in spatial.reconciled(a, b, "page", "k").collect()}
    assert got == {("100", "contradicted", 0.4), ("same", "kept", 0.9), ("extra", "added", 0.7)}
    # A contradiction beside an agreement counts, and the least confidence is that of all near readings.
    again = spark.createDataFrame([(1, 1, "100", 3.0, 1.0, 40.0, 10.0, 0.75), (1, 2, "700", 5.0, 1.0, 40.0, 10.0, 0.8), (1, 4, "S\u00a0ame ", 101.0, 1.0, 40.0, 10.0, 0.5)], cols)
    got = {(r.text, r.origin, round(r.confidence, 3)) for r in spatial.reconciled(a, again, "page", "k").collect()}
    assert got == {("100", "contradicted", 0.375), ("same", "contradicted", 0.25)}
    plan = spatial.near_pairs(a, b, "page", "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pages_with_both_readings_in_a_row_are_reconciled_there(spark):
    rng = np.random.default_rng(7)
    token = "array<struct<k: int, text: string, x: double, y: double, w: double, h: double, confidence: double>>"

    def reading(n, first):
        xs, ys = rng.uniform(-200, 200, n).round(1), rng.uniform(-100, 100, n).round(1)
        return [(first + i, [None, "a", "A", "b "][rng.integers(4)], float(x), float(y), float(rng.integers(1, 9)), 4.0, [None, 0.5, 0.7, 0.9][rng.integers(4)]) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]

    rows = [(p, reading(rng.integers(0, 90), 0), reading(rng.integers(0, 90), 0)) for p in range(40)]
    # Reach is open; places without a number are near nothing; a page without one reading, without any, and in two rows.
    rows += [(40, [(0, "x", 0.0, 0.0, 2.0, 2.0, 0.9)], [(0, "y", 15.0, 0.0, 2.0, 2.0, 0.8), (1, "y", 14.9, 9.9, 2.0, 2.0, 0.8), (2, "y", None, 0.0, 2.0, 2.0, 0.8)])]
    rows += [(41, None, reading(3, 0)), (42, reading(3, 0), None), (43, None, None), (44, reading(30, 0), reading(30, 0)), (44, reading(30, 30), reading(30, 30)), (45, [(0, "x", 1e300, 0.0, 2.0, 2.0, 0.9)], [(0, "y", 1e300, 0.0, 2.0, 2.0, 0.8)])]
    pages = spark.createDataFrame(rows, f"page int, tokens {token}, supplement {token}").repartition(3, "page")
    got = Counter(map(tuple, spatial.reconciled_pages(pages, "page", "k", columns=("k", "text", "x")).collect()))
    want = Counter()
    whole = {p: ([t for q, a, _ in rows if q == p for t in a or []], [t for q, _, b in rows if q == p for t in b or []]) for p, _, _ in rows}
    near = lambda s, t: None not in (s[2], t[2]) and abs(s[2] + s[4] / 2 - t[2] - t[4] / 2) < 15 and abs(s[3] + s[5] / 2 - t[3] - t[5] / 2) < 10
    for p, (a, b) in whole.items():
        for s in a:
            met = [t for t in b if near(s, t)]
            clash = any(s[1] and t[1] and s[1].strip().lower() != t[1].strip().lower() for t in met)
            known = [c for c in (s[6], *(t[6] for t in met)) if c is not None]
            want[(p, *s[:3], (min(known) * 0.5 if known else None) if clash else s[6], "contradicted" if clash else "kept")] += 1
        for t in b:
            if not any(near(s, t) for s in a):
                want[(p, *t[:3], t[6], "added")] += 1
    assert got == want and {k[-1] for k in want} == {"kept", "contradicted", "added"}
    ensemble = spatial.ensemble_pages(pages, "page", "k", lambda t: F.col("page") % 2 == 1, columns=("k", "text", "x"))
    odd = Counter((p, *t[:3], t[6], "kept") for p, (a, _) in whole.items() if p % 2 for t in a)
    even = Counter({k: n for k, n in want.items() if k[0] % 2 == 0 and whole[k[0]][0]})
    assert Counter(map(tuple, ensemble.collect())) == odd + even


def test_readings_are_reconciled_without_a_shuffle_of_tokens(spark):
    for name in ("ocr_cross_validate", "ensemble_tokens"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hash") == 1


def test_lines_follow_their_first_token(spark):
    cols = "page int, text string, x double, y double, h double"
    t = spark.createDataFrame([(1, "world", 200.0, 0.0, 10.0), (1, "hello", 0.0, 4.0, 10.0), (1, "next", 0.0, 11.0, 10.0), (1, "low", 0.0, 40.0, 10.0)], cols)
    got = [(r.line, r.text) for r in spatial.layout_lines(t, "page").orderBy("line").collect()]
    assert got == [(0, "hello world"), (1, "next"), (2, "low")]
    # One centre, two heights: the upper edges are 15 apart, but it is one line.
    two = spark.createDataFrame([(1, "tall", 50.0, 0.0, 40.0), (1, "small", 0.0, 15.0, 10.0)], cols)
    assert [(r.line, r.text) for r in spatial.layout_lines(two, "page").collect()] == [(0, "small tall")]


def test_markdown(spark):
    cases = {"# Head": "Head", "**b** and *i* `c`": "b and i c", "| a | b |\n|---|:-:|\n| 1 | 2 |": "a b\n1 2", "```\n# raw | x\n```\nafter": "# raw | x\nafter", "\n\n__u__ _v_\n": "u v", "####### seven": "####### seven",
             "\t# Head\r\nbody\r": "Head\nbody", "| **a | b** |": "a b", "~~~\n **raw**\n\n~~~\n*x*": " **raw**\nx", "## **Bold Title**": "Bold Title", "| Sym | Px |\n|:-:|--:|\n| ES | *4200* |": "Sym Px\nES 4200", "```\nopen\n": "open"}
    df = spark.createDataFrame(list(cases.items()), "md string, want string")
    assert df.where(text.strip_markdown(F.col("md")) != F.col("want")).collect() == []


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\nb c`d\u0007" + "x" * 300,)], "t string")
    line = df.select(text.sanitize_history(F.col("t")).alias("x")).first().x
    assert line.startswith("a⏎b⏎c'd x") and len(line) == 240 and line.endswith("…")
    assert one(spark, text.family_of(F.col("n"), {"x": "fx", "y": "fy", "z": "fx"}), n="X-1/z") == "fx"
    assert one(spark, text.family_of(F.col("n"), {"x": "fx", "y": "fy"}), n="x y") is None
    assert tuple(one(spark, text.semantic_version(F.col("v")), v="2.10.3 (Tool)")) == (2, 10, 3)
    assert one(spark, text.image_media_type(F.unhex(F.col("h"))), h="89504E470D0A1A0A00") == "image/png"
    assert tuple(one(spark, text.env_pair(F.col("l")), l="A = 'b=c'")) == ("A", "b=c")
    assert one(spark, text.env_pair(F.col("l")), l="# A=b") is None
    assert one(spark, text.after_fences(F.col("l")), l="x\n==========\nbody\n==========\ny") == "body"
    assert one(spark, expr.retry_delay(F.col("a")), a=10) == 30.0
    assert one(spark, expr.token_estimate(F.col("t")), t="😀éabcdefg") == 2
    assert one(spark, expr.framed_key(F.lit("1"), F.lit(2))) != one(spark, expr.framed_key(F.lit("12"), F.lit("")))


def test_batch_jobs(spark):
    expected = spark.range(4).withColumnRenamed("id", "k")
    back = spark.createDataFrame([(0, "completed"), (1, "failed")], "k long, status string")
    results = batch_jobs.with_expired(expected, back, "k")
    assert sorted(tuple(r) for r in results.collect()) == [(0, "completed"), (1, "failed"), (2, "expired"), (3, "expired")]
    assert [r.k for r in batch_jobs.resubmits(results, spark.createDataFrame([(2,)], "k long"), "k").collect()] == [3]
    events = spark.createDataFrame([("f", "intent"), ("g", "intent"), ("g", "submitted"), ("h", "result")], "file string, event string")
    assert [r.file for r in batch_jobs.dangling(events, "file").collect()] == ["f"]
    assert one(spark, batch_jobs.batch_status(F.col("s"), {"in_progress": "running"}), s="in_progress") == "running"
    with pytest.raises(Exception, match="unknown batch status"):
        one(spark, batch_jobs.batch_status(F.col("s"), {"in_progress": "running"}), s="odd")


def test_gates(spark):
    diffs = spark.createDataFrame([("a", i, 1) for i in range(12)] + [("b", i, (-1) ** i) for i in range(12)], "arm string, item int, diff int")
    got = {r.arm: r for r in gates.permutation_gate(diffs, "item", "diff", 400, ["arm"], F.lit(0.05), 0.1).collect()}
    assert got["a"].passed and got["a"].p < 0.02 and not got["b"].passed
    assert one(spark, expr.uplift(F.col("c"), F.col("b")), c=1.2, b=1.0) == pytest.approx(0.2)
    assert one(spark, expr.uplift(F.col("c"), F.col("b"), "min"), c=1.2, b=0.0) == pytest.approx(-1200)
    assert one(spark, metrics.preference_loss(F.lit(0.0))) == pytest.approx(math.log(2))
    assert one(spark, metrics.normalized(F.lit(5.0), F.lit(4.0), F.lit(2.0))) == 1.0


def test_running_sums_equal_windows(spark):
    from pyspark.sql import Window

    from trialframe.operators.ranges import numbered, numeric_bucket, running

    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 0, F.col("id") * 37 % 401).alias("s"), F.col("id").alias("v")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    order = [F.asc_nulls_first("s"), F.col("v")]
    out = running(df, ["g"], numeric_bucket(df, "s", 8), order, {"t": F.col("v")})
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    assert out.count() == 500 and out.withColumn("want", F.sum("v").over(w)).where("t <> want").count() == 0
    n = numbered(df, [], numeric_bucket(df, "s", 8), order, "n")
    assert sorted(r.n for r in n.collect()) == list(range(1, 501))
    assert numbered(df.limit(0), [], numeric_bucket(df.limit(0), "s"), order, "n").count() == 0


def test_lags_and_maxima_over_buckets_equal_windows(spark):
    from pyspark.sql import Window

    from trialframe.operators.ranges import before, numeric_bucket, reached

    df = spark.range(300).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 401).alias("s"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("v"))
    w = Window.partitionBy("g").orderBy("s")
    out = before(df, ["g"], numeric_bucket(df, "s", 8), [F.col("s")], {"b": F.col("v")}).withColumn("want", F.lag("v").over(w))
    assert out.count() == 300 and out.where("not (b <=> want)").count() == 0
    top = reached(df, ["g"], numeric_bucket(df, "s", 8), [F.col("s")], {"m": F.col("v")}).withColumn("want", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert top.where("not (m <=> want)").count() == 0


def test_ledger_events_of_every_kind(spark):
    rows = [(1, 1, "reserved", 2.0), (1, 2, "completed", 1.5), (2, 3, "reserved", 2.0), (3, 4, "rejected", 0.0)]
    df = spark.createDataFrame([("c", *r) for r in rows], "campaign string, seq int, line int, event string, usd double").withColumn("reason", F.lit("bad paths"))
    r = ledger.ledger_totals(df, "campaign", "seq", "line", "usd").first()
    assert (float(r.total), ledger.experiments_run(df, "campaign").first().runs) == (3.5, 1)
    assert ledger.consecutive_failures(df, "campaign", "line").first().failures == 1
    assert [x.seq for x in ledger.open_reservations(df, "campaign", "seq", "line", "usd").collect()] == [2]  # rejected releases nothing
    assert ledger.failure_reasons(df, "campaign", "line", "seq", "reason", 3).first().reasons == "round 3 rejected: bad paths"
    more = df.unionByName(spark.createDataFrame([("c", 2, 5, "reconciled", 2.0, ""), ("c", 4, 6, "preflight_failed", 1.0, "x"), ("c", 5, 7, "aborted", 0.5, "y"), ("c", 6, 8, "infra_aborted", 0.25, "z")], df.schema))
    assert float(ledger.ledger_totals(more, "campaign", "seq", "line", "usd").first().spent) == 5.25
    assert [r.streak for r in ledger.running_streak(more, "campaign", "line").orderBy("line").collect()] == [0, 0, 0, 1, 0, 1, 0, 1]
    assert ledger.failure_reasons(more, "campaign", "line", "seq", "reason", 2).first().reasons == "round 5 aborted: y; round 6 infra_aborted: z"


def test_request_keys(spark):
    key = lambda url, method="get", body=None, version=1: one(spark, lifecycle.request_key(F.col("u"), F.lit(method), F.lit(body).cast("string"), version), u=url)
    assert len({key(u) for u in ("http://h/x", "https://h/x", "https://h:8443/x", "http://h:0/x")}) == 4
    assert key("https://h/x") == key("https://h:443/x") == key("HTTPS://H/x") == key("https://h/x", "GET")
    assert key("http://h/x?b=2&a=1") == key("http://h/x?a=1&b=2") != key("http://h/x?a=1&b=3")
    assert key("http://h/x", version=1) != key("http://h/x", version=2) and key("http://h/x", body="q") != key("http://h/x")
    parts = ["1", "GET", "http", "h", "80", "/", "a=1+x&b=%2A~", ""]
    assert key("http://h?b=*%7E&a=1%20x#f") == hashlib.sha256("\0".join(parts).encode()).hexdigest()


def test_topic_leakage(spark):
    def report(**arms):
        rows = [(1, a, v) for a, vs in arms.items() for v in vs]
        return metrics.topic_leakage(spark.createDataFrame(rows, "g int, arm string, v double"), F.col("v"), F.col("arm"), ["g"]).first()

    leaky = report(author=[1.0, 1.0], foreign=[0.0, 0.0], style_swapped=[0.0, 0.0], topic_matched=[1.0, 1.0])
    assert (leaky.style_swap_drop, leaky.topic_match_inflation, leaky.leakage, leaky.refused) == (1.0, 1.0, 1.0, False)
    signed = report(author=[0.0], foreign=[2.0], style_swapped=[1.0], topic_matched=[3.0])
    assert (signed.style_swap_drop, signed.topic_match_inflation) == (0.5, -0.5) and signed.leakage == 0.5
    none = report(author=[1.0], foreign=[1.0], style_swapped=[0.0], topic_matched=[0.0])
    assert none.refused and none.leakage is None


def test_calibration_refuses_what_cannot_discriminate(spark):
    df = spark.createDataFrame([(1, 0.9, 0.1), (2, 1.0, 0.2), (3, 0.5, 0.5), (4, math.nan, 0.0), (5, None, 0.0)], "k int, ceiling double, floor double")
    got = {r.k: r.refusal for r in metrics.calibration_refusals(df, 1e-9, saturation_at=1.0).collect()}
    assert got == {1: None, 2: "pinned", 3: "no spread", 4: "non-finite", 5: "non-finite"}


def test_liveness(spark):
    reg = spark.createDataFrame([("alpha", 1, 7), ("beta", 2, None), ("gamma", 3, 9), ("delta", 4, None), ("eps", None, None), ("zeta", None, None)], "run string, pid int, pgid int")
    table = spark.createDataFrame([(1, 7, "python alpha --x"), (2, 5, "python other"), (3, 1, "python gamma"), (9, 1, "python my-eps2"), (8, 1, "run eps")], "pid int, pgid int, command string")
    state = lambda *a: {r.run: (r.state, r.pid) for r in lifecycle.liveness(reg, *a[:1], "run", "pid", "pgid", "command", *a[1:]).collect()}
    assert state(table) == {"alpha": ("live", 1), "beta": ("dead", 2), "gamma": ("dead", 3), "delta": ("dead", 4), "eps": ("live", 8), "zeta": ("dead", None)}
    alive = spark.createDataFrame([(1,), (2,)], "pid int")
    assert state(None, alive) == {"alpha": ("live", 1), "beta": ("live", 2), "gamma": ("dead", 3), "delta": ("dead", 4), "eps": ("unknown", None), "zeta": ("unknown", None)}


def test_directions(spark):
    df = spark.createDataFrame([("e", i, m) for i, m in enumerate([0.5, 0.7, 0.4, None, 0.4])], "e string, u int, m double")
    v = ledger.running_verdicts(df, "e", "u", "m", "min")
    r = ledger.journal_report(v, "e", "u", "m", "min").first()
    assert (r.kept, r.best_metric, r.best_unit) == (2, 0.4, 2)
    s = lifecycle.metric_summary(v, "e", "u", "m", "min").first()
    assert (s.baseline, s.best, round(s.uplift, 9)) == (0.5, 0.4, 0.1)
    for direction, probe, want in (("max", 1.1, "ready"), ("max", 0.9, "unreachable"), ("min", 0.9, "ready"), ("min", 1.1, "unreachable")):
        assert one(spark, lifecycle.preflight(F.lit(1.0), F.lit(1.05), F.lit(probe), direction=direction)) == want


def test_bootstrap_verdicts(spark):
    q = spark.createDataFrame([("base", 0.4, 0.5, 0.45), ("up", 0.6, 0.7, 0.65), ("touch", 0.5, 0.6, 0.55), ("down", 0.1, 0.2, 0.15)], "arm string, low double, high double, mean double")
    promoted = lambda d, f: {r.arm for r in gates.bootstrap_verdicts(q, "arm", "base", d, f).where("promote").collect()}
    assert promoted("max", 0.0) == {"up"} and promoted("max", 0.3) == set() and promoted("min", 0.0) == {"down"}
