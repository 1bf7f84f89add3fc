"""Deterministic splits, samples, batches and digests of row pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.functions.expr import order_free_digest, seeded_key, text_digest
from trialframe.operators.ranges import hash_bucket, numbered
from trialframe.sources.shared import stored

SEED = 1729


def dedupe(df: DataFrame, digest: Column, order: Column) -> DataFrame:
    """One row per content digest, the first in order."""
    cols = df.columns
    held = df.select(F.struct(*cols).alias("r"), digest.alias("d"), order.alias("o"))
    return held.groupBy("d").agg(F.min_by("r", "o").alias("r")).select("r.*")


def stratified_split(df: DataFrame, key: Column, by: list[str], train: float = 0.75, valid: float = 0.10, seed: int = SEED) -> DataFrame:
    """df with bucket train, valid or test, each stratum cut at rounded shares (half to even) of its seeded order."""
    if not (0 < train < 1 and 0 <= valid < 1 and train + valid <= 1 + 1e-9):
        raise ValueError("shares must be positive and sum to at most 1")
    named = [f"__s{i}" for i in range(len(by))]
    held = df.withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in zip(named, by, strict=True)}).withColumn("__k", seeded_key(seed, key))
    ranked = numbered(held, named, hash_bucket(F.col("__k")), [F.col("__k")], "__r")
    sizes = held.groupBy(*named).agg(F.count("*").alias("__n"))
    ranked = ranked.join(sizes, named) if named else ranked.crossJoin(F.broadcast(sizes))
    first = F.bround(F.col("__n") * F.lit(train), 0)
    second = first + F.bround(F.col("__n") * F.lit(valid), 0)
    bucket = F.when(F.col("__r") <= first, "train").when(F.col("__r") <= second, "valid").otherwise("test")
    return ranked.withColumn("bucket", bucket).select(*df.columns, "bucket")


def overlaps(split: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one bucket; no row if the buckets are disjoint."""
    return split.groupBy(key).agg(F.count_distinct("bucket").alias("buckets")).where("buckets > 1")


def dataset_digest(df: DataFrame, text: Column, by: list[str]) -> DataFrame:
    """(by, n, digest): content digest of a group of rows, whatever their order: of the digests of the rows whose digests
    begin alike, so that no task holds a group."""
    rows = df.select(*by, text_digest(text).alias("__d"))
    parts = rows.groupBy(*by, F.substring("__d", 1, 3).alias("__p")).agg(F.count("*").alias("__n"), order_free_digest(F.col("__d"), 64).alias("__d"))
    return parts.groupBy(*by).agg(F.sum("__n").alias("n"), order_free_digest(F.col("__d")).alias("digest"))


#: Drawn rows that are broadcast to the table they come from.
BROADCAST_DRAWN = 1_000_000


def bottom_k(df: DataFrame, key: Column, stratum: str, size: int, seed: int | str) -> DataFrame:
    """(key, stratum) of the size rows of each stratum that come first in a seeded order.

    Only keys are looked at; a task hands on size rows of a stratum at most, so what is shuffled follows from the strata.
    """
    thin = df.select(key.alias("__key"), F.col(stratum).alias("__s")).withColumn("__k", seeded_key(seed, F.col("__key")))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__k"))
    return thin.withColumn("__r", place).where(F.col("__r") <= size).select("__key", "__s")


def golden_sample(df: DataFrame, key: Column, stratum: str, size: int, seed: int = 7) -> DataFrame:
    """size rows of each stratum by seeded order, numbered from 1 in a second one; key names a row.

    The other columns are fetched for the drawn keys alone.
    """
    second = bottom_k(df, key, stratum, size, seed).withColumn("__k", seeded_key(f"order{seed}", F.col("__key")))
    drawn = stored(numbered(second, [], hash_bucket(F.col("__k")), [F.col("__k")], "number").select("__key", "__s", F.col("number").cast("int").alias("number")))
    few = F.broadcast(drawn) if drawn.count() <= BROADCAST_DRAWN else drawn
    return df.join(few, (key == F.col("__key")) & F.col(stratum).eqNullSafe(F.col("__s"))).select(*df.columns, "number")


def short_strata(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """Strata with fewer rows than a sample takes."""
    return df.groupBy(stratum).agg(F.count("*").alias("n")).where(F.col("n") < size)


def batch_plan(df: DataFrame, key: Column, size: int, epochs: int, seed: int = SEED) -> DataFrame:
    """df repeated per epoch in a new seeded order, with the global position and batch number; epochs run on."""
    n = df.agg(F.count("*").alias("__n"))
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("__k", seeded_key(seed, F.col("epoch"), key))
    held = numbered(rows, ["epoch"], hash_bucket(F.col("__k")), [F.col("__k")], "__r").crossJoin(F.broadcast(n))
    placed = held.withColumn("position", F.col("epoch") * F.col("__n") + F.col("__r") - 1)
    return placed.withColumn("batch", F.floor(F.col("position") / size)).select(*df.columns, "epoch", "position", "batch")


def batch_steps(df: DataFrame, key: Column, size: int, steps: int, seed: int = SEED) -> DataFrame:
    """(…, step, slot): exactly steps batches of size rows, reshuffled whenever the pool is used up.

    A pool smaller than one batch is refused.
    """
    n = df.count()
    if n < size:
        raise ValueError(f"{n} rows are fewer than one batch of {size}")
    plan = batch_plan(df, key, size, -(-size * steps // n), seed).where(F.col("position") < size * steps)
    return plan.select(*df.columns, F.col("batch").alias("step"), (F.col("position") % size).alias("slot"))
