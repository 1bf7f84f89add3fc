"""Journals, corpora, manifests, keyed tables on disk, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from trialframe.operators import ledger
from trialframe.operators.tables import memoized
from trialframe.sources import corpus, journal, manifest
from trialframe.streaming import journals

SCHEMA = "unit string, status string"


def put(tmp_path, name, lines):
    tmp_path.mkdir(exist_ok=True, parents=True)
    (tmp_path / name).write_text("\n".join(lines))
    return str(tmp_path)


ROWS = [json.dumps({"unit": u, "status": s}) for u, s in (("a", "done"), ("b", "error"), ("b", "done"), ("c", "error"))]


def test_order_and_blank_lines(spark, tmp_path):
    got = journal.read_journal(spark, put(tmp_path, "j.jsonl", [ROWS[0], "", *ROWS[1:], ""]), SCHEMA).orderBy("line").collect()
    assert [(r.line, r.unit) for r in got] == [(0, "a"), (2, "b"), (3, "b"), (4, "c")]
    assert {r.unit: r.status for r in journal.latest_status(journal.read_journal(spark, str(tmp_path), SCHEMA), "unit").collect()} == {"a": "done", "b": "done", "c": "error"}


@pytest.mark.parametrize(("policy", "torn", "middle"), [("skip_torn_tail", 4, None), ("skip_bad", 4, 4), ("strict", None, None), ("skip_middle", None, 4)])
def test_policies(spark, tmp_path, policy, torn, middle):
    for name, lines, want in (("t", [*ROWS, '{"unit": "d", "st'], torn), ("m", [*ROWS[:2], "{oops", *ROWS[2:]], middle)):
        df = journal.read_journal(spark, put(tmp_path / name, "j.jsonl", lines), SCHEMA, policy)
        if want is None:
            with pytest.raises(Exception, match="undecodable line"):
                df.collect()
        else:
            assert df.count() == want


def test_validity_is_part_of_the_policy(spark, tmp_path):
    path = put(tmp_path, "j.jsonl", [*ROWS, json.dumps({"unit": "e", "status": "odd"})])
    legal = F.col("status").isin("done", "error")
    assert journal.read_journal(spark, path, SCHEMA, "skip_torn_tail", legal).count() == 4
    with pytest.raises(Exception, match="undecodable"):
        journal.read_journal(spark, path, SCHEMA, "skip_middle", legal).collect()
    with pytest.raises(ValueError):
        journal.read_journal(spark, path, SCHEMA, "other")


def test_append_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("e", 0), ("e", 4)], "x string, u int")
    journal.append_journal(df, str(tmp_path / "j"))
    journal.append_journal(df.withColumn("u", F.col("u") + 1), str(tmp_path / "j"))
    back = spark.read.schema("x string, u int").json(str(tmp_path / "j"))
    assert journal.resume_units(back, "x", "u").first().next_unit == 6


def test_corpora(spark, tmp_path):
    m = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    put(tmp_path, "train.jsonl", [json.dumps({"messages": m}), "", json.dumps({"messages": m})])
    got = corpus.read_sft(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in got] == ["train:0", "train:2"] and got[0].completion[0].content == "a" and len(got[0].prompt) == 1
    put(tmp_path / "p", "x.jsonl", [json.dumps({"prompt": m[:1], "chosen": m[1:], "rejected": m[1:]})])
    assert corpus.read_preferences(spark, str(tmp_path / "p")).first().chosen[0].content == "a"
    put(tmp_path / "r", "x.jsonl", [json.dumps({"custom_id": "k", "body": {"n": 1}})])
    assert tuple(corpus.read_requests(spark, str(tmp_path / "r")).first()) == ("k", '{"n":1}')


def test_manifests(spark, tmp_path):
    put(tmp_path / "d" / "e", "f.txt", ["x"])
    put(tmp_path / "d", "._f.txt", ["x"])
    tree = manifest.tree_manifest(spark, str(tmp_path / "d")).collect()
    assert [r.path.rpartition("/")[2] for r in tree] == ["f.txt"] and tree[0].length == 1
    lines = spark.createDataFrame([(f"{tree[0].sha256}  e/f.txt",), ("junk",)], "value string")
    assert [tuple(r) for r in manifest.parse_manifest(lines).collect()] == [("e/f.txt", tree[0].sha256)]
    raw = spark.createDataFrame([(1, ":100644 120000 a b M\u0000p q\u0000:000000 100644 c d A\u0000r\u0000"), (2, "")], "c int, raw string")
    assert [(r.path, r.dst_mode) for r in manifest.tree_changes(raw, "raw").collect()] == [("p q", "120000"), ("r", "100644")]


def test_memo_is_made_once(spark, tmp_path):
    made = []
    for _ in range(2):
        out = memoized(spark, f"file://{tmp_path}/memo", lambda: made.append(1) or spark.range(3))
        assert out.count() == 3
    assert made == [1]


def test_streams_equal_their_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = f"{tmp_path}/events"
    events.repartitionByRange(3, "ts").write.parquet(src)
    stream = lambda: journals.events_stream(spark, src, 1)
    journals.tail_to(stream(), f"{tmp_path}/out", f"{tmp_path}/c1")
    journals.tail_to(stream(), f"{tmp_path}/out", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    journals.counts_to(stream(), ["event_type"], f"{tmp_path}/n", f"{tmp_path}/c2")
    assert sorted(map(tuple, journals.read_counts(spark, f"{tmp_path}/n").collect())) == sorted(map(tuple, events.groupBy("event_type").count().collect()))


def test_versions_pointer_and_upserts(spark, tmp_path):
    from trialframe.sources import versions as V

    root = f"file://{tmp_path}/t"
    assert V.versions(spark, root) == [] and V.current(spark, root) is None
    with pytest.raises(KeyError):
        V.read_current(spark, root)
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    first = V.upsert(df, root, ["k"], F.col("o"), "20240101")
    second = V.upsert(spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], df.schema), root, ["k"], F.col("o"), "20240102")
    assert V.versions(spark, root) == [first, second] and first.startswith("v001-20240101-") and V.current(spark, root) == second
    assert sorted((r.k, r.v) for r in V.read_current(spark, root).collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert V.register(df.orderBy(F.desc("k")), root, "20240103")[-12:] == first[-12:]
    assert V.rollback(spark, root) == first and V.doomed(spark, root, 1) == [second]
    V.promote(spark, root, "v002")
    assert V.current(spark, root) == second
    with pytest.raises(KeyError, match="v009"):
        V.promote(spark, root, "v009")


def test_failure_budget_and_phases(spark, tmp_path):
    from trialframe.sources import versions as V

    rows = spark.createDataFrame([(1, True), (2, None)], "u int, failed boolean")
    V.append_within_budget(rows, f"{tmp_path}/s", "failed", 1)
    with pytest.raises(V.FailureBudgetExceeded, match="2 failures"):
        V.append_within_budget(rows, f"{tmp_path}/s", "failed", 1)
    phases = spark.createDataFrame([("built",)], "phase string")
    V.require_phase(phases, "built")
    for at in ("2", "1"):
        V.mark_phase(spark, f"{tmp_path}/phases", "built", at)
    assert [tuple(r) for r in V.marked_phases(spark, f"{tmp_path}/phases").collect()] == [("built", "1")]
    with pytest.raises(LookupError):
        V.require_phase(phases, "shipped")
