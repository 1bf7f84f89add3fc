"""Promotion statistics: exact sign test, matched alert gates, permutation and bootstrap gates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.operators.metrics import rank_auc
from trialframe.operators.ranges import numeric_bucket, running


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p at one half; 1 without pairs. Terms are summed in logarithms, so any size works."""
    n = (wins + losses).cast("double")
    low = F.least(wins, losses).cast("int")
    start = F.struct((-n * math.log(2)).alias("t"), F.exp(-n * math.log(2)).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        t = acc["t"] + F.log((n - k + 1) / k)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    tail = F.aggregate(F.when(low >= 1, F.sequence(F.lit(1), low)).otherwise(F.expr("cast(array() as array<int>)")), start, step, lambda acc: acc["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


#: Coins that one digest gives, and counts of 16 bits; items that meet all draws at once.
COINS, COUNTS, ITEMS = 256, 16, 256
#: Chances of a Poisson count of mean 1 to be at most 0, 1, ..., in parts of 65,536; a count is how many a number reaches.
POISSON = tuple(int(65536 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(8))


_POISSON_COUNTS = np.searchsorted(np.array(POISSON), np.arange(65536), "right").astype(float)


def _digests(items: list, blocks: int) -> np.ndarray:
    """For every item, the SHA-256 of `block|item` of each block, end to end."""
    return np.frombuffer(b"".join(hashlib.sha256(f"{b}|{i}".encode()).digest() for i in items for b in range(blocks)), np.uint8).reshape(len(items), -1)


def coins(items: list, draws: int) -> np.ndarray:
    """1 or -1 for every item and draw: the bits of its digests, 1 for a bit of 0."""
    bits = np.unpackbits(_digests(items, -(-draws // COINS)), axis=1)[:, :draws]
    return 1.0 - 2.0 * bits


def poisson_counts(items: list, draws: int) -> np.ndarray:
    """How often each draw takes every item: Poisson counts of mean 1 from 16 bits each, as a bootstrap of rows that come
    one by one takes them."""
    numbers = _digests(items, -(-draws // COUNTS)).view(">u2")[:, :draws]
    return _POISSON_COUNTS[numbers]


def draw_sums(df: DataFrame, item: str, value: str, draws: int, by: list[str], weights: Callable[[list, int], np.ndarray]) -> DataFrame:
    """(by, draw, total, weight): for each draw, the sum of weights times values and of weights over all items.

    A task multiplies a block of weights, items by draws, with the values of its rows, and holds one vector of sums a
    group. So nothing is expanded: rows are dealt by item once, as each costs its draws, and the rows of an item share its
    weights; sums that meet grow with the draws and tasks. They are exact where values are whole numbers.
    """
    names = [f"g{j}" for j in range(len(by))]
    held = df.select(*[F.col(c).cast("string").alias(n) for n, c in zip(names, by, strict=True)], F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("v")).where("v is not null")
    context = df.sparkSession.sparkContext
    held = held.repartition(max(context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "item").sortWithinPartitions("item")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = list(zip(*(batch.column(j).to_pylist() for j in range(len(names))), strict=True)) if names else [()] * batch.num_rows
            items, v = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_numpy()
            for lo in range(0, len(items), ITEMS):
                places: dict[str, int] = {}
                at = np.array([places.setdefault(i, len(places)) for i in items[lo : lo + ITEMS]])
                w = weights(list(places), draws)
                own, x = groups[lo : lo + ITEMS], v[lo : lo + ITEMS]
                for g in dict.fromkeys(own):
                    mine = np.array([o == g for o in own])
                    # Values and rows by item, so that an item's weights are taken once.
                    by_item = np.stack([np.bincount(at[mine], x[mine], len(places)), np.bincount(at[mine], minlength=len(places))])
                    total = sums.setdefault(g, np.zeros((2, draws)))
                    total += by_item @ w
        for g, (total, weight) in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([c] * draws, pa.string()) for c in g], pa.array(np.arange(1, draws + 1)), pa.array(total), pa.array(weight)], names=[*names, "draw", "total", "weight"])

    out = held.mapInArrow(fold, ", ".join([*(f"{n} string" for n in names), "draw long", "total double", "weight double"]))
    out = out.groupBy(*names, "draw").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    return out.select(*[F.col(n).cast(df.schema[c].dataType).alias(c) for n, c in zip(names, by, strict=True)], "draw", "total", "weight")


def permutation_sums(diffs: DataFrame, item: str, diff: str, permutations: int, by: list[str]) -> DataFrame:
    """(by, perm, total): the sum of the differences with signs flipped by a reproducible coin per item."""
    return draw_sums(diffs, item, diff, permutations, by, coins).select(*by, F.col("draw").alias("perm"), "total")


def permutation_gate(diffs: DataFrame, item: str, diff: str, permutations: int, by: list[str], alpha: Column, min_lift: float) -> DataFrame:
    """(by, n, mean_diff, p, passed): one-sided paired sign-flip test; (exceeding + 1) / (permutations + 1)."""
    seen = diffs.groupBy(*by).agg(F.sum(diff).alias("observed"), F.count("*").alias("n"), F.avg(F.col(diff).cast("double")).alias("mean_diff"))
    flipped = permutation_sums(diffs, item, diff, permutations, by).join(seen.select(*by, "observed"), by)
    p = flipped.groupBy(*by).agg(((F.count_if(F.col("total") >= F.col("observed")) + 1) / F.lit(permutations + 1.0)).alias("p"))
    return seen.join(p, by).withColumn("passed", (F.col("mean_diff") >= min_lift) & (F.col("p") < alpha)).drop("observed")


def bootstrap_means(samples: DataFrame, item: str, value: str, resamples: int, by: list[str]) -> DataFrame:
    """(by, boot, mean): means of resamples with replacement, each item counted a reproducible Poisson number of times.

    A resample has as many rows as the sample on average, not exactly; its mean is by its own number of rows.
    """
    sums = draw_sums(samples, item, value, resamples, by, poisson_counts).where("weight > 0")
    return sums.select(*by, F.col("draw").alias("boot"), (F.col("total") / F.col("weight")).alias("mean"))


def intervals(means: DataFrame, by: list[str]) -> DataFrame:
    """(by, low, high, mean): the central 95 percent of the resampled means, and their mean."""
    both = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*by).agg(both.alias("q"), F.avg("mean").alias("mean")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "mean")


def bootstrap_verdicts(bounds: DataFrame, arm: str, incumbent: str, direction: str, floor: float) -> DataFrame:
    """bounds with promote: intervals that do not touch and a margin of the resampled means beyond floor.

    The incumbent's bounds are one row.
    """
    own = bounds.where(F.col(arm) == incumbent).limit(1).select(F.col("low").alias("__l"), F.col("high").alias("__h"), F.col("mean").alias("__m"))
    apart = ~((F.col("__l") <= F.col("high")) & (F.col("low") <= F.col("__h")))
    margin = (F.col("mean") - F.col("__m")) * (1 if direction == "max" else -1)
    return bounds.crossJoin(F.broadcast(own)).withColumn("promote", apart & (margin > floor)).drop("__l", "__h", "__m")


def matched_threshold(df: DataFrame, score: str, budget: DataFrame) -> DataFrame:
    """One row (thr): the lowest score that at most budget rows reach, ties whole; null where every score is reached by more."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    reached = running(counts, [], -numeric_bucket(counts, "s"), [F.desc("s")], {"reached": F.col("n")}).crossJoin(F.broadcast(budget.select("budget")))  # one row
    return reached.where("reached <= budget").agg(F.min("s").alias("thr"))


def corrected_gate(df: DataFrame, candidate: str, incumbent: str, label: Column, warranted: Column, threshold: float, harmful_favors_incumbent: bool | None = None) -> DataFrame:
    """One row: the paired gate of a candidate that fires as often as the incumbent does above its threshold.

    Where only one of them fires on a warranted row it wins or loses coverage; an exact sign test judges that. To be
    promoted the candidate must win significantly, hold the budget, have no smaller AUC (one of a single class is none)
    and no harm against it; while harm is not judged, promote is null.
    """
    held = df.select(F.col(candidate).alias("__c"), F.col(incumbent).alias("__i"), label.alias("__y"), F.coalesce(warranted, F.lit(False)).alias("__w")).withColumn("__was", F.coalesce(F.col("__i") > threshold, F.lit(False)))
    thr = matched_threshold(held, "__c", held.agg(F.count_if("__was").alias("budget")))
    fired = held.crossJoin(F.broadcast(thr)).withColumn("__fires", F.coalesce(F.col("__c") >= F.col("thr"), F.lit(False)))  # one row
    only = lambda a, b: F.count_if(F.col("__w") & F.col(a) & ~F.col(b))
    out = fired.agg(F.count_if("__was").alias("budget"), F.count_if("__fires").alias("fires"), only("__fires", "__was").alias("wins"), only("__was", "__fires").alias("losses"))
    for name, score in (("cell_auc", "__c"), ("incumbent_auc", "__i")):
        out = out.crossJoin(F.broadcast(rank_auc(held, F.col("__y"), F.col(score)).select(F.col("auc").alias(name))))  # one row
    out = out.withColumn("p", sign_test_p(F.col("wins"), F.col("losses")))
    better = ~F.isnan("cell_auc") & ~F.isnan("incumbent_auc") & (F.col("cell_auc") >= F.col("incumbent_auc"))
    out = out.withColumns({"coverage_sig": (F.col("p") < 0.05) & (F.col("wins") > F.col("losses")), "budget_held": F.col("fires") <= F.col("budget"), "auc_not_regressed": better})
    free = F.col("coverage_sig") & F.col("budget_held") & F.col("auc_not_regressed")
    return out.withColumn("promote", F.lit(None).cast("boolean") if harmful_favors_incumbent is None else free & F.lit(not harmful_favors_incumbent))


def rate_budget(fires_per_100: float, total_turns: int) -> int:
    """How many fires a rate allows over so many turns."""
    if total_turns <= 0 or fires_per_100 < 0:
        raise ValueError("turns must be above 0 and the rate not below")
    return math.floor(fires_per_100 * total_turns / 100)
