"""Judging in stages: families, a golden gate, controls, clearance, cached votes, the spend at the boundary, and the buy.

Votes are bought through `ask`, a function of a DataFrame of questions (judge, row_id, slot_a, slot_b) that adds
`preferred`, a, b or tie. It is called for controls of judges whose gate is green, and for the rows that are left when
controls and cache have been looked at; for no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.operators.lifecycle import vote_key
from trialframe.sources.shared import stored

#: The least shares of paraphrases judged as ties and of garbage judged as a loss.
MIN_PARAPHRASE_TIE, MIN_GARBAGE_LOSS = 0.5, 0.9

Ask = Callable[[DataFrame], DataFrame]


def candidate_first(row_id: Column, seed: int) -> Column:
    """A coin of the row's own: is the candidate in slot a?"""
    digest = F.sha2(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed))).cast("binary"), 256)
    return F.conv(F.right(digest, F.lit(1)), 16, 10).cast("int") % 2 == 0


def asked(rows: DataFrame, ask: Ask, row_id: str, seed: int) -> DataFrame:
    """rows (judge, row_id, candidate, reference, ...) with the vote that the answer to their question is: win, loss or tie."""
    first = candidate_first(F.col(row_id), seed)
    slots = rows.withColumns({"slot_a": F.when(first, F.col("candidate")).otherwise(F.col("reference")), "slot_b": F.when(first, F.col("reference")).otherwise(F.col("candidate"))})
    won = (F.col("preferred") == "a") == candidate_first(F.col(row_id), seed)
    vote = F.when(F.col("preferred") == "tie", "tie").when(won, "win").otherwise("loss")
    return ask(slots).withColumn("vote", vote).drop("slot_a", "slot_b", "preferred")


def controls_report(votes: DataFrame) -> DataFrame:
    """(judge, n_paraphrase, n_garbage, paraphrase_tie_rate, garbage_loss_rate) of votes (judge, kind, vote)."""
    paraphrase, garbage = F.col("kind") == "paraphrase", F.col("kind") == "garbage"
    rate = lambda kind, vote: F.coalesce(F.try_divide(F.count_if(kind & (F.col("vote") == vote)), F.count_if(kind)), F.lit(0.0))
    return votes.groupBy("judge").agg(
        F.count_if(paraphrase).alias("n_paraphrase"), F.count_if(garbage).alias("n_garbage"), rate(paraphrase, "tie").alias("paraphrase_tie_rate"), rate(garbage, "loss").alias("garbage_loss_rate")
    )


def controls_refusal(report: DataFrame, min_tie: float = MIN_PARAPHRASE_TIE, min_loss: float = MIN_GARBAGE_LOSS) -> Column:
    """Why a report does not clear its judge, else null: no controls, garbage that got through, then paraphrases told apart."""
    c = lambda n: F.coalesce(report[n], F.lit(0))
    return F.when((c("n_paraphrase") == 0) | (c("n_garbage") == 0), "no controls").when(c("garbage_loss_rate") < min_loss, "garbage").when(c("paraphrase_tie_rate") < min_tie, "paraphrase")


def clearances(judges: DataFrame, controls: DataFrame, golden: DataFrame, ask: Ask, generator_family: str, seed: int) -> DataFrame:
    """judges (judge, family, ...) with their report and `refusal`, null where votes may be bought.

    golden: (judge, green). Controls (judge, row_id, kind, candidate, reference) are asked anew for each judge of another
    family whose gate is green, never served from a cache.
    """
    early = F.when(F.col("family").isNull(), "unknown family").when(F.col("family") == generator_family, "same family").when(~F.coalesce("green", F.lit(False)), "golden gate")
    gated = stored(judges.join(golden, "judge", "left").withColumn("early", early))
    pairs = controls.join(gated.where("early is null").select("judge"), "judge")
    votes = asked(pairs.withColumn("row_id", F.concat("row_id", F.lit("|control-"), "kind")), ask, "row_id", seed)
    report = stored(controls_report(votes))
    held = gated.join(report, "judge", "left")
    return held.withColumn("refusal", F.coalesce("early", controls_refusal(held))).drop("early", "green")


def judged(rows: DataFrame, cleared: DataFrame, cache: DataFrame, ask: Ask, context: tuple[str, str], seed: int, usd: float) -> DataFrame:
    """(judge, row_id, key, vote, origin, refusal) of rows (judge, row_id, candidate, reference).

    A judge that is not cleared gives nothing, from the cache neither. Of the others' rows those whose whole key is in the
    cache (key, vote) are served; the rest is bought if its projected cost is within the judge's max_usd (null: no cap),
    checked before any of it is asked for. origin is cache or bought.
    """
    version, digest = context
    key = vote_key(F.col("provider"), F.col("model"), F.col("verdict_schema"), F.lit(version), F.lit(digest), F.col("row_id"), F.col("candidate"), F.col("reference"), F.lit(seed))
    names = ["judge", "provider", "model", "verdict_schema", "max_usd", "refusal"]
    held = rows.join(cleared.select(*names), "judge", "left").withColumn("refusal", F.when(F.col("provider").isNull(), "unknown judge").otherwise(F.col("refusal"))).withColumn("key", key)
    refused = held.where("refusal is not null").select("judge", "row_id", "key", F.lit(None).cast("string").alias("vote"), F.lit(None).cast("string").alias("origin"), "refusal")
    open_ = held.where("refusal is null")
    known = cache.groupBy("key").agg(F.min("vote").alias("vote"))
    served = open_.join(known, "key").select("judge", "row_id", "key", "vote", F.lit("cache").alias("origin"), "refusal")
    missing = stored(open_.join(cache.select("key"), "key", "left_anti"))
    over = missing.groupBy("judge").agg(((F.count("*") * F.lit(usd)) > F.first("max_usd")).alias("over"))
    boundary = missing.join(over, "judge").withColumn("over", F.coalesce("over", F.lit(False)))
    bought = asked(boundary.where("not over"), ask, "row_id", seed).select("judge", "row_id", "key", "vote", F.lit("bought").alias("origin"), "refusal")
    unpaid = boundary.where("over").select("judge", "row_id", "key", F.lit(None).cast("string").alias("vote"), F.lit(None).cast("string").alias("origin"), F.lit("spend").alias("refusal"))
    return refused.unionByName(served).unionByName(bought).unionByName(unpaid)


def remembered(cache: DataFrame, votes: DataFrame) -> DataFrame:
    """The cache (key, vote) with what was bought; a key that is there keeps its vote."""
    new = votes.where("origin = 'bought'").groupBy("key").agg(F.min("vote").alias("vote"))
    return cache.select("key", "vote").unionByName(new.join(cache.select("key"), "key", "left_anti"))
