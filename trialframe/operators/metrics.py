"""Evaluation metrics as aggregations: confusion, AUC, alert budgets, calibration, leakage, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.expr import finite, safe_div
from trialframe.operators.ranges import numeric_bucket, running


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str]) -> DataFrame:
    """Counts and ratios of a binary prediction by group; empty denominators give 0."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return counts.withColumns({
        "accuracy": safe_div(tp + tn, tp + tn + fp + fn), "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn),
    })


def rank_auc(df: DataFrame, positive: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks; NaN where only one class occurs.

    Scores are counted by value first; the negatives below each score are a running sum over distinct scores.
    """
    keys = list(by or [])
    held = df.select(*keys, positive.alias("y"), score.alias("s")).where("s is not null and y is not null")
    counts = held.groupBy(*keys, "s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    summed = running(counts, keys, numeric_bucket(counts, "s"), [F.col("s")], {"reached": F.col("neg")})
    won = F.col("pos") * (F.col("reached") - F.col("neg") + F.col("neg") / 2)
    sums = summed.withColumn("won", won).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    area = F.when((F.col("pos") == 0) | (F.col("neg") == 0), F.lit(float("nan"))).otherwise(F.col("won") / (F.col("pos") * F.col("neg").cast("double")))
    return sums.select(*keys, "pos", "neg", area.alias("auc"))


def one_against_rest_auc(df: DataFrame, label: str, score: Column) -> DataFrame:
    """(label, pos, neg, auc) of each label against all others, from counts by score and label: no row is repeated."""
    own = df.select(label, score.alias("s")).where(F.col("s").isNotNull() & F.col(label).isNotNull()).groupBy(label, "s").agg(F.count("*").alias("own"))
    every = own.groupBy("s").agg(F.sum("own").alias("every"))
    reached = running(every, [], numeric_bucket(every, "s"), [F.col("s")], {"all_reached": F.col("every")})
    mine = running(own, [label], numeric_bucket(own, "s"), [F.col("s")], {"own_reached": F.col("own")})
    below = (F.col("all_reached") - F.col("every")) - (F.col("own_reached") - F.col("own"))
    won = F.col("own") * (below + (F.col("every") - F.col("own")) / 2)
    sums = mine.join(reached, "s").groupBy(label).agg(F.sum(won).alias("won"), F.sum("own").alias("pos"))
    total = own.agg(F.sum("own").alias("total"))
    held = sums.crossJoin(F.broadcast(total)).withColumn("neg", F.col("total") - F.col("pos"))  # one row
    return held.select(label, "pos", "neg", F.when(F.col("neg") == 0, F.lit(float("nan"))).otherwise(F.col("won") / (F.col("pos") * F.col("neg").cast("double"))).alias("auc"))


def budget_threshold(df: DataFrame, score: str, budget: Column | int, by: list[str]) -> DataFrame:
    """(by, threshold, fires): the lowest score that at most budget rows reach; null where every score fires too often."""
    counts = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"))
    fits = running(counts, by, -numeric_bucket(counts, "s"), [F.desc("s")], {"reached": F.col("n")}).withColumn("ok", F.col("reached") <= budget)
    return fits.groupBy(*by).agg(F.min(F.when(F.col("ok"), F.col("s"))).alias("threshold"), F.coalesce(F.max(F.when(F.col("ok"), F.col("reached"))), F.lit(0)).cast("long").alias("fires"))


def calibration(df: DataFrame, score: Column, ceiling: Column, floor: Column, by: list[str]) -> DataFrame:
    """(by, ceiling, floor): mean scores of the rows of either role."""
    return df.groupBy(*by).agg(F.avg(F.when(ceiling, score)).alias("ceiling"), F.avg(F.when(floor, score)).alias("floor"))


def normalized(score: Column, ceiling: Column, floor: Column) -> Column:
    """The score between floor and ceiling, clamped to 0 and 1; null where they are not apart."""
    x = F.try_divide(score - floor, ceiling - floor)
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


#: Fixed value: the leakage from which a judge counts as following the topic.
LEAKAGE_TOLERANCE = 0.5
ARMS = ("author", "foreign", "style_swapped", "topic_matched")


def topic_leakage(df: DataFrame, score: Column, arm: Column, by: list[str]) -> DataFrame:
    """How far a score follows the topic instead of the style, by group; arm is one of `ARMS`.

    The drop of restyled author texts and the rise of topic-matched foreign texts are signed shares of the spread
    between the author's and the foreign mean; leakage is the larger. Where the spread is zero, not finite or not
    known there is none, and `refused` is true.
    """
    out = df.groupBy(*by).agg(*[F.avg(F.when(arm == a, score.cast("double"))).alias(a) for a in ARMS])
    author, foreign, swapped, matched = (F.col(a) for a in ARMS)
    spread = author - foreign
    usable = F.coalesce(finite(spread) & (spread != 0), F.lit(False))
    share = lambda x: F.when(usable, F.try_divide(x, spread))
    held = out.withColumns({"style_swap_drop": share(author - swapped), "topic_match_inflation": share(matched - foreign), "refused": ~usable})
    return held.withColumn("leakage", F.greatest("style_swap_drop", "topic_match_inflation"))


def calibration_refusals(df: DataFrame, min_spread: float, saturation_at: float | None = None, epsilon: float = 1e-9) -> DataFrame:
    """(…, refusal): why bounds (ceiling, floor) cannot be used, else null: not finite, pinned at a maximum, no spread."""
    c, f = F.col("ceiling"), F.col("floor")
    pinned = F.lit(False) if saturation_at is None else c >= saturation_at - epsilon
    return df.withColumn("refusal", F.when(~finite(c) | ~finite(f), "non-finite").when(pinned, "pinned").when(c - f <= min_spread, "no spread"))


def weighted_loss(logprobs: Column, weights: Column) -> tuple[Column, Column]:
    """Negative weighted sum of log probabilities, and the weights' sum, of one sequence."""
    total = F.aggregate(F.zip_with(logprobs, weights, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return -total, F.aggregate(weights, F.lit(0.0), lambda s, x: s + x.cast("double"))


def preference_margin(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    return F.lit(beta) * ((chosen - ref_chosen) - (rejected - ref_rejected))


def preference_loss(margin: Column) -> Column:
    """-log sigmoid(margin), without overflow."""
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
