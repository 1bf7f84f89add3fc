from pyspark.sql import functions as F

from trialframe.operators import judging as J
from trialframe.operators.lifecycle import vote_key

JUDGES = "judge string, family string, provider string, model string, verdict_schema string, max_usd double"
ROWS = "judge string, row_id string, candidate string, reference string"


class Asked:
    """A stub that prefers what is longer, and keeps what it was asked."""

    def __init__(self, always=None):
        self.questions, self.always = [], always

    def __call__(self, q):
        self.questions += [(r.judge, r.row_id) for r in q.collect()]
        n = F.length("slot_a") - F.length("slot_b")
        said = F.when(n > 0, "a").when(n < 0, "b").otherwise("tie")
        return q.withColumn("preferred", F.lit(self.always) if self.always else said)


def setting(spark, green=True, family="a", cap=None, controls=True):
    judges = spark.createDataFrame([("j", family, "p", "m", "s", cap)], JUDGES)
    golden = spark.createDataFrame([("j", green)], "judge string, green boolean")
    pairs = [("j", f"c{i}", kind, text, "same size") for i in range(12) for kind, text in (("paraphrase", "size same"), ("garbage", ""))] if controls else []
    rows = spark.createDataFrame([("j", f"r{i}", "x" * (i + 1), "xx") for i in range(4)], ROWS)
    return judges, golden, spark.createDataFrame(pairs, "judge string, row_id string, kind string, candidate string, reference string"), rows


def votes(spark, ask, cache=None, usd=1.0, **kw):
    judges, golden, controls, rows = setting(spark, **kw)
    cache = spark.createDataFrame([], "key string, vote string") if cache is None else cache
    cleared = J.clearances(judges, controls, golden, ask, "g", 3)
    return J.judged(rows, cleared, cache, ask, ("v1", "d1"), 3, usd)


def test_a_green_judge_buys_what_is_asked(spark):
    ask = Asked()
    got = {r.row_id: (r.vote, r.origin, r.refusal) for r in votes(spark, ask).collect()}
    assert got == {"r0": ("loss", "bought", None), "r1": ("tie", "bought", None), "r2": ("win", "bought", None), "r3": ("win", "bought", None)}
    assert {q for q in ask.questions if "control" in q[1]} == {("j", f"c{i}|control-{k}") for i in range(12) for k in ("paraphrase", "garbage")}


def test_a_red_stage_buys_no_vote(spark):
    for kw, ask, why, control in (
        ({"family": "g"}, Asked(), "same family", 0), ({"family": None}, Asked(), "unknown family", 0), ({"green": False}, Asked(), "golden gate", 0),
        ({"controls": False}, Asked(), "no controls", 0), ({}, Asked("a"), "garbage", 24), ({"cap": 3.5}, Asked(), "spend", 24),
    ):
        got = votes(spark, ask, **kw).collect()
        assert {(r.vote, r.origin, r.refusal) for r in got} == {(None, None, why)} and len(got) == 4
        assert len({q for q in ask.questions if "control" in q[1]}) == control
        assert not [q for q in ask.questions if "control" not in q[1]], why


def test_hits_need_the_whole_key_and_are_kept(spark):
    *_, rows = setting(spark)
    key = lambda digest: vote_key(*[F.lit(x) for x in ("p", "m", "s", "v1", digest)], F.col("row_id"), F.col("candidate"), F.col("reference"), F.lit(3))
    cache = rows.where("row_id < 'r2'").select(key("d1").alias("key"), F.lit("win").alias("vote")).unionByName(rows.where("row_id = 'r2'").select(key("d0").alias("key"), F.lit("loss").alias("vote")))
    ask = Asked()
    out = votes(spark, ask, cache, cap=2.0)
    assert {r.row_id: (r.vote, r.origin) for r in out.collect()} == {"r0": ("win", "cache"), "r1": ("win", "cache"), "r2": ("win", "bought"), "r3": ("win", "bought")}
    assert {q[1] for q in ask.questions if "control" not in q[1]} == {"r2", "r3"}
    again, kept = Asked(), J.remembered(cache, out)
    assert {r.origin for r in votes(spark, again, kept, cap=0.0).collect()} == {"cache"}
    assert kept.count() == 5 and not [q for q in again.questions if "control" not in q[1]]


def test_a_gate_is_proved_or_refused(spark):
    import pytest

    from trialframe.operators import golden
    from trialframe.operators.guards import Refused

    gate = spark.createDataFrame([(10, 6)], "n long, floor long")
    report = lambda *v: spark.createDataFrame([v], "n long, agree long, panel_labels long")
    assert golden.proved(report(10, 6, 2), gate).count() == 1
    for v, why in (((9, 9, 2), "partial"), ((10, 10, 1), "constant decider"), ((10, 5, 2), "below floor")):
        with pytest.raises(Refused, match=why):
            golden.proved(report(*v), gate)
