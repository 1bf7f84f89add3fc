"""Bake-offs of arms over a corpus, from long outputs (arm, arm_idx, item, field, vnum, vstr).

A field that an arm did not give for an item has no row; that differs from a null value. All counts come from one
grouping by (item, field), in which an arm has at most one row, so groups are as small as the number of arms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.functions.expr import safe_div


def same_value(a: Column, b: Column) -> Column:
    """Numbers by value (NaN equals nothing), texts by text; a number never equals a text."""
    num = F.coalesce((a["vnum"] == b["vnum"]) & ~F.isnan(a["vnum"]), F.lit(False))
    none = a["vnum"].isNull() & a["vstr"].isNull() & b["vnum"].isNull() & b["vstr"].isNull()
    return num | F.coalesce(a["vstr"] == b["vstr"], F.lit(False)) | none


def item_count(outputs: DataFrame) -> DataFrame:
    return outputs.agg(F.count_distinct("item").alias("n_items"))


def mean_by_field(outputs: DataFrame, n_items: DataFrame) -> DataFrame:
    """(arm, arm_idx, field, mean): the sum of a numeric field over the number of all items."""
    sums = outputs.where(F.col("vnum").isNotNull()).groupBy("arm", "arm_idx", "field").agg(F.sum("vnum").alias("total"))
    return sums.crossJoin(F.broadcast(n_items)).select("arm", "arm_idx", "field", safe_div(F.col("total"), F.col("n_items")).alias("mean"))


def pair_counts(outputs: DataFrame) -> DataFrame:
    """(arm, other, field, shared, equal): cells that two arms both have, and those in which they agree."""
    cells = outputs.groupBy("item", "field").agg(F.collect_list(F.struct("arm", "vnum", "vstr")).alias("v"))
    pairs = cells.select("field", F.explode("v").alias("a"), "v").select("field", "a", F.explode("v").alias("b")).where(F.col("a.arm") != F.col("b.arm"))
    return pairs.groupBy(F.col("a.arm").alias("arm"), F.col("b.arm").alias("other"), "field").agg(
        F.count("*").alias("shared"), F.count_if(same_value(F.col("a"), F.col("b"))).alias("equal")
    )


def cell_counts(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("arm", "field").agg(F.count("*").alias("cells"))


def _arm_pairs(outputs: DataFrame, by_field: bool) -> DataFrame:
    """(arm, other[, field], shared, equal, cells, other_cells) for all ordered pairs of arms."""
    keys = ["field"] if by_field else []
    counts = cell_counts(outputs)
    arms = counts.select("arm").distinct()
    fields = counts.select("field").distinct()
    grid = arms.crossJoin(arms.withColumnRenamed("arm", "other")).where("arm <> other")
    if by_field:
        grid = grid.crossJoin(fields)
    shared = pair_counts(outputs).groupBy("arm", "other", *keys).agg(F.sum("shared").alias("shared"), F.sum("equal").alias("equal"))
    own = counts.groupBy("arm", *keys).agg(F.sum("cells").alias("cells"))
    theirs = own.select(F.col("arm").alias("other"), *keys, F.col("cells").alias("other_cells"))
    out = grid.join(shared, ["arm", "other", *keys], "left").join(own, ["arm", *keys], "left").join(theirs, ["other", *keys], "left")
    return out.fillna(0, ["shared", "equal", "cells", "other_cells"])


def agreement(outputs: DataFrame) -> DataFrame:
    """(arm, agreement): the mean, over the other arms, of equal cells among cells that either has; 1 without peers."""
    union = F.col("cells") + F.col("other_cells") - F.col("shared")
    pairs = _arm_pairs(outputs, False).withColumn("same", F.when(union == 0, F.lit(1.0)).otherwise(safe_div(F.col("equal"), union)))
    arms = outputs.select("arm").distinct()
    return arms.join(pairs.groupBy("arm").agg(F.avg("same").alias("same")), "arm", "left").select("arm", F.coalesce("same", F.lit(1.0)).alias("agreement"))


def field_disagreement(outputs: DataFrame, baseline: str, n_items: DataFrame) -> DataFrame:
    """(arm, field, disagreement): items whose value differs from the baseline's, over all items."""
    pairs = _arm_pairs(outputs, True).where(F.col("other") == baseline)
    differs = F.col("cells") + F.col("other_cells") - F.col("shared") - F.col("equal")
    return pairs.crossJoin(F.broadcast(n_items)).select("arm", "field", safe_div(differs, F.col("n_items")).alias("disagreement"))


def ranked(metrics: DataFrame, primary: str, tiebreak: str, viable: str = "viable") -> DataFrame:
    """rank and is_viable of each arm: where any arm declares viability, it takes a mean of 1; ties keep arm order."""
    wide = metrics.groupBy("arm", "arm_idx").agg(
        *[F.max(F.when(F.col("field") == f, F.col("mean"))).alias(a) for f, a in ((primary, "primary"), (tiebreak, "tie"), (viable, "viability"))]
    )
    declared = F.max(F.col("viability").isNotNull()).over(Window.partitionBy(F.lit(1)))
    wide = wide.withColumn("is_viable", ~declared | (F.coalesce("viability", F.lit(0.0)) >= 1.0))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("is_viable"), F.desc(F.coalesce("primary", F.lit(0.0))), F.desc(F.coalesce("tie", F.lit(0.0))), "arm_idx")
    return wide.withColumn("rank", F.row_number().over(order))


def leaderboard(outputs: DataFrame, primary: str, tiebreak: str) -> DataFrame:
    """One row per arm: its means, agreement, viability, rank and whether it wins."""
    n = item_count(outputs)
    board = ranked(mean_by_field(outputs, n), primary, tiebreak).join(agreement(outputs), "arm")
    return board.withColumn("winner", F.col("is_viable") & (F.col("rank") == 1))


def gated(board: DataFrame, gates: DataFrame, baseline: str) -> DataFrame:
    """board with passed_gate: only a winner that is not the baseline and whose own gate passed."""
    held = board.join(gates.select("arm", F.col("passed").alias("__passed")), "arm", "left")
    return held.withColumn("passed_gate", F.col("winner") & (F.col("arm") != baseline) & F.coalesce("__passed", F.lit(False))).drop("__passed")
