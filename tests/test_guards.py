"""Known values of guards, packets, provider batches, training preparation and retrospectives."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trialframe.functions import codec, text
from trialframe.operators import bakeoff, batch_jobs, cost, gates, golden, guards, lifecycle, retros, split, tables, train_data


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_scoring_boundary(spark):
    rows = [("src/a.py", "100644"), ("src/sub/b.py", "100644"), ("eval/x/y.py", "100644"), ("src/a.py", "120000"), ("other.py", "100644"), ("src/conftest.py", "100644"), ("src/p.pth", "000000"), ("src/eval.py", "000000")]
    df = spark.createDataFrame(rows, "path string, mode string")
    out = guards.immutable_violations(df, "path", "mode", ["src/**"], ["eval/**", "src/eval.py"])
    assert sorted((r.path, r.reason) for r in out.collect()) == sorted([("src/a.py", "symlink"), ("eval/x/y.py", "immutable"), ("other.py", "outside"), ("src/conftest.py", "auto-loader"), ("src/p.pth", "auto-loader"), ("src/eval.py", "immutable")])


def test_predicates(spark):
    assert [one(spark, guards.escapes_workdir(F.col("p")), p=p) for p in ("", "/a", "a/../b", "a/b", ".")] == [True, True, True, False, True]
    assert [one(spark, guards.unbounded_glob(F.col("p")), p=p) for p in ("**/x", "*", "a/**", "*.py")] == [True, True, False, False]
    assert [one(spark, guards.positive_int(F.col("n")), n=n) for n in (1.0, 0.0, 1.5, float("inf"), -2.0)] == [True, False, False, False, False]
    assert one(spark, guards.budget_low(F.lit(8), F.lit(0.0), F.lit(10), F.lit(None).cast("double"))) is False
    assert one(spark, guards.budget_low(F.lit(9), F.lit(0.0), F.lit(10), F.lit(None).cast("double"))) is True
    assert one(spark, guards.budget_low(F.lit(0), F.lit(75.0), F.lit(10), F.lit(100.0))) is True
    assert [one(spark, guards.failure_class(F.col("e")), e=e) for e in ("AccountingIntegrityError", "ConnectionResetError", "CandidateFault", "KeyError")] == ["accounting", "infra", "candidate", "candidate"]
    assert one(spark, guards.unknown_fields(F.array(F.lit("b"), F.lit("z"), F.lit("a")), ["b"])) == ["a", "z"]
    cases = [(10, 6, 2, 10, 6, None), (9, 9, 2, 10, 6, "partial"), (10, 9, 1, 10, 6, "constant decider"), (10, 5, 2, 10, 6, "below floor")]
    for n, a, k, g, f, want in cases:
        assert one(spark, guards.agreement_refusal(*(F.lit(v) for v in (n, a, k, g, f)))) == want


def test_invariants_run_in_order(spark):
    df = spark.range(5)
    checks = [("none", lambda x: x.where("id > 9")), ("big", lambda x: x.where("id > 3")), ("never", lambda x: x.where("1 / 0 > 1"))]
    with pytest.raises(guards.Refused, match="big"):
        guards.blocking_invariants(df, checks)
    guards.blocking_invariants(df, checks[:1])
    both = guards.key_differences(df, spark.range(2, 7), "id")
    assert sorted(map(tuple, both.collect())) == [(0, "left"), (1, "left"), (5, "right"), (6, "right")]


def test_golden_packets(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"text {i}") for i in range(12)], "k long, s string, t string")
    rows = golden.drawn(df, "k", "s", 3)
    assert sorted(r.number for r in rows.collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(guards.Refused, match="fewer than 7"):
        golden.drawn(df, "k", "s", 7)
    p = golden.packet(rows, "k", "t", "Good?", "# Head").first()
    held = sorted((r.number, r.k, r.t) for r in rows.collect())
    want = "\n".join(["# Head", *("\n".join([f"## Row {n}", "", "~~~text", t, "~~~", "", "**Q: Good?**", "", "- Answer (`yes` / `no`): ", "", "---", ""]) for n, _, t in held)])
    assert p.packet_md == want and (p.n, p.floor) == (6, 4)
    assert p.rows_sha256 == hashlib.sha256(json.dumps([[n, str(k)] for n, k, _ in held], separators=(",", ":")).encode()).hexdigest()
    manifest = golden.packet(rows, "k", "t", "Good?", "# Head")
    assert golden.verified(want, manifest).count() == 1
    with pytest.raises(guards.Refused):
        golden.verified(want + " ", manifest)
    labels = rows.select(F.col("number").alias("row"), F.col("k").alias("row_id"), F.lit("yes").alias("label"))
    assert all(r.label for r in golden.read_labels(labels, manifest).collect())
    with pytest.raises(guards.Refused):
        golden.read_labels(labels.where("row > 1"), manifest)
    with pytest.raises(Exception, match="not yes or no"):
        golden.read_labels(labels.withColumn("label", F.lit("maybe")), manifest).collect()


def test_provider_batches(spark):
    for provider, states in batch_jobs.BATCH_STATES.items():
        for theirs, ours in states.items():
            assert one(spark, batch_jobs.batch_status(F.col("s"), states), s=theirs) == ours, provider
    body = {"model": "m", "messages": [{"role": "user", "content": "añb\n\"q\""}, {"content": [{"text": "cd"}]}], "n": 5}
    assert one(spark, batch_jobs.text_chars(F.col("b")), b=json.dumps(body)) == 1 + 4 + 7 + 2
    most = lambda **k: one(spark, batch_jobs.request_tokens(F.col("b"))[1], b=json.dumps(k))
    assert [most(max_tokens=7, maxOutputTokens=9), most(max_output_tokens=8), most(maxOutputTokens=9), most(x=1)] == [7, 8, 9, 1024]
    r = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 1.0)], "id string, usd double")
    assert batch_jobs.admitted_batch(r, "id", "usd", 10.0).first().refusal == "duplicate ids: a"
    assert batch_jobs.admitted_batch(r.distinct(), "id", "usd", 2.5).first().refusal == "over max_usd"
    assert batch_jobs.admitted_batch(r.distinct(), "id", "usd", 3.0).first().refusal is None
    with pytest.raises(ValueError):
        batch_jobs.admitted_batch(r, "id", "usd", float("nan"))
    lines = spark.createDataFrame([(json.dumps({"custom_id": "x", "result": {"type": "odd"}}),)], "t string")
    with pytest.raises(Exception, match="unknown result type"):
        batch_jobs.provider_items(lines, "anthropic", "t").collect()


def test_training_preparation(spark):
    df = spark.createDataFrame([(i, list(range(i))) for i in range(20)], "k long, t array<int>")
    plan, dropped = train_data.prepared(df, "k", ["t"], 10, 4, 7)
    rows = plan.collect()
    assert dropped == 9 and len(rows) == 28 and sorted({r.step for r in rows}) == list(range(7))
    assert all(len([r for r in rows if r.step == s]) == 4 for s in range(7))
    first = {r.k for r in rows if r.step < 2} | {r.k for r in rows if r.step == 2 and r.slot < 3}
    assert first == set(range(11))  # the pool is used up before it is shuffled anew
    assert sorted(train_data.prepared(df, "k", ["t"], 10, 4, 7, base_step=5)[0].select("step").distinct().collect()) == [(5,), (6,)]
    with pytest.raises(ValueError, match="fewer than one batch"):
        train_data.prepared(df, "k", ["t"], 2, 4, 7)
    assert split.batch_steps(df, F.col("k"), 4, 2).count() == 8
    assert one(spark, train_data.interleaved(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))) == [1, 3, 2, 4]


def test_retrospectives(spark):
    j = spark.createDataFrame([("e", 0, 0.5, "keep", "log"), ("e", 1, 0.7, "keep", "log"), ("e", 2, None, "crash", "log"), ("z", 0, None, "crash", "log")], "e string, u int, m double, verdict string, log string")
    got = {r.e: json.loads(r.evidence) for r in retros.evidence(j, "e", "u", "m").collect()}
    assert got["z"] == {"report": {"crashes": 1, "kept": 0, "units": 1}, "rows": [{"metric": None, "unit": 0, "verdict": "crash"}]}
    assert got["e"]["metrics"]["baseline"] == 0.5 and "log" not in json.dumps(got)
    kept = '{"experiment":"e","baseline":1.0,"best_metric":2.0,"uplift":1.0,"verdict":{"outcome":"improved"}}'
    none = '{"experiment":"z","kept":false,"verdict":{"outcome":"flat"}}'
    assert tuple(one(spark, retros.from_record(F.col("r")), r=kept)) == ("e", True, 1.0, 2.0, 1.0, "improved")
    assert one(spark, retros.from_record(F.col("r")), r=none).kept is False
    assert one(spark, retros.rendered_retro(retros.from_record(F.col("r"))), r=none) == "z: flat (no candidate kept; incumbent baseline stands)"
    for bad in (kept.replace('"uplift":1.0,', ""), none.replace("}}", '},"x":1}'), "junk"):
        with pytest.raises(Exception, match="not a retrospective"):
            one(spark, retros.from_record(F.col("r")), r=bad)
    states = spark.createDataFrame([("a", "live"), ("b", "dead"), ("c", "dead"), ("d", "unknown")], "run string, state string")
    told = states.where("run = 'b'").select("run")
    assert {r.run: r.resolution for r in retros.orphan_scan(states, told, "run").collect()} == {"a": "live", "b": "accounted", "c": "latched", "d": "unknown"}


def test_texts_states_and_samples(spark):
    at = lambda t: tuple(one(spark, text.location(F.col("t")), t=t))
    assert [at(t) for t in ("host:/x", "a/b:c", "[::1]:p", "plain", "h:")] == [("host", "/x"), (None, "a/b:c"), ("[::1]", "p"), (None, "plain"), ("h", "")]
    assert one(spark, text.has_form(F.col("t"), "version"), t="v001-20240101-0123456789ab") and not one(spark, text.has_form(F.col("t"), "name"), t="a b")
    row = one(spark, text.handle_json(F.lit("modal"), F.lit("r"), F.lit("v")))
    assert json.loads(row) == {"backend": "modal", "repo": "r", "revision": "v"} and tuple(one(spark, text.read_handle(F.lit(row)))) == ("modal", "r", "v")
    with pytest.raises(Exception, match="unknown state backend"):
        one(spark, text.read_handle(F.lit('{"backend":"other"}')))
    assert one(spark, codec.f32_from_s16(F.unhex(F.lit("0040ff7f01")))) == pytest.approx([0.5, 32767 / 32768])
    assert one(spark, codec.json_objects(F.lit('x {"b":1,"a":[{}]} {bad {"c":2}'))) == ['{"a":[{}],"b":1}', '{"c":2}']
    spans = F.array(F.struct(F.lit(1.5).alias("end")))
    empty = F.slice(spans, 1, 0)
    assert [one(spark, codec.clip_duration(a, b)) for a, b in ((spans, empty), (empty, spans), (empty, empty))] == [1.5, 1.5, 0.0]


def test_tables_and_costs(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(2)
    for v in (1, 1, 2):
        assert tables.cached(spark, f"file://{tmp_path}", "ns", v, "ab" * 16, make).count() == 2
    assert len(made) == 2
    with pytest.raises(ValueError):
        tables.cached(spark, f"file://{tmp_path}", "../x", 1, "ab" * 16, make)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = tables.updated(df, spark.createDataFrame([(2, None), (3, "z")], df.schema), "k", ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, None)]
    best = tables.best_checkpoint(spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.9), ("r", 3, 0.9)], "r string, step int, s double"), "r", "step", "s").first()
    assert (best.step, best.s) == (2, 0.9)
    files = spark.createDataFrame([("a.tmp-1", 0), ("b.tmp-1", 0), ("b.tmp-1.heartbeat", 900_000), ("c.tmp-1.heartbeat", 0), ("d.tmp-1", 900_000), ("e.bin", 0)], "name string, at long")
    assert sorted(r.name for r in tables.reapable(files, "name", "at", 1_000_000).collect()) == ["a.tmp-1", "c.tmp-1.heartbeat"]
    prices = spark.sql("select 'm' model, cast(1 as decimal(10,4)) input_price, cast(2 as decimal(10,4)) output_price")
    calls = cost.metered(spark.createDataFrame([("m", "x" * 8, "y" * 12), ("m", "x" * 8, None)], "model string, p string, a string"), prices, "p", "a").collect()
    assert sorted((float(r.reserved), float(r.spent)) for r in calls) == [(0.00205, 0.0), (0.00205, 0.000008)]
    bad = lifecycle.nested_not_finite(F.create_map(F.lit("g"), F.create_map(F.lit("k"), F.lit(float("nan")), F.lit("o"), F.lit(1.0))))
    assert one(spark, bad) == ["g.k"]


def test_corrected_gate(spark):
    rows = [(i, float(i), float(-i), i >= 20) for i in range(40)]  # the candidate ranks by truth, the incumbent against it
    df = spark.createDataFrame(rows, "k int, c double, i double, y boolean")
    gate = lambda **k: gates.corrected_gate(df, "c", "i", F.col("y"), F.lit(True), -19.5, **k).first()
    r = gate(harmful_favors_incumbent=False)
    assert (r.budget, r.fires, r.wins, r.losses) == (20, 20, 20, 20) and r.p == 1.0 and not r.promote
    assert (r.cell_auc, r.incumbent_auc) == (1.0, 0.0) and r.auc_not_regressed and r.budget_held
    won = gates.corrected_gate(df, "c", "i", F.col("y"), F.col("y"), -19.5, harmful_favors_incumbent=False).first()
    assert (won.wins, won.losses, won.coverage_sig, won.promote) == (20, 0, True, True)
    assert gates.corrected_gate(df, "c", "i", F.col("y"), F.col("y"), -19.5, harmful_favors_incumbent=True).first().promote is False
    assert gate().promote is None
    one_class = gates.corrected_gate(df, "c", "i", F.lit(True), F.col("y"), -19.5, harmful_favors_incumbent=False).first()
    assert not one_class.auc_not_regressed and not one_class.promote
    tied = df.withColumn("c", F.lit(1.0))
    assert gates.corrected_gate(tied, "c", "i", F.col("y"), F.lit(True), -19.5).first().fires == 0  # a tie over budget is left out whole
    assert gates.rate_budget(2.5, 130) == 3
    with pytest.raises(ValueError):
        gates.rate_budget(1.0, 0)


def test_only_a_winner_beyond_the_baseline_is_promoted(spark):
    board = spark.createDataFrame([("base", 1, False), ("up", 2, True), ("more", 3, False)], "arm string, rank int, winner boolean")
    passed = spark.createDataFrame([("up", True), ("more", True)], "arm string, passed boolean")
    assert {r.arm: r.passed_gate for r in bakeoff.gated(board, passed, "base").collect()} == {"base": False, "up": True, "more": False}
    assert not bakeoff.gated(board, passed, "up").where("passed_gate").count()
