"""Keyed tables on Parquet: last write wins, insert once with conflicts, versions behind a pointer, diffs of keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last in order."""
    held = df.select(F.struct(*df.columns).alias("r"), *keys, order.alias("__o"))
    return held.groupBy(*keys).agg(F.max_by("r", "__o").alias("r")).select("r.*")


def upserted(existing: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """existing with new rows in place of those with their keys; of several new rows the last."""
    fresh = last_per_key(new, keys, order)
    return existing.join(fresh, keys, "left_anti").unionByName(fresh.select(*existing.columns))


def insert_once(existing: DataFrame, new: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are new, and rows whose key is held with another value."""
    fresh = new.join(existing, keys, "left_anti")
    held = existing.select(*keys, F.col(value).alias("held"))
    return fresh, new.join(held, keys).where(~F.col(value).eqNullSafe(F.col("held")))


def leaderboard(cells: DataFrame, experiment: str, metric: str, order: list[str], limit: int, descending: bool = True) -> DataFrame:
    """The best cells of each experiment with their rank; cells without a metric do not take part."""
    by = F.desc(metric) if descending else F.asc(metric)
    w = Window.partitionBy(experiment).orderBy(by, *order)
    return cells.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right) of keys whose values differ or that one side lacks, by one full outer join."""
    a = left.select(key, F.col(value).alias("left"))
    b = right.select(key, F.col(value).alias("right"))
    return a.join(b, key, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def pending(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units without a done record."""
    return units.join(done.select(key).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def doomed_versions(versions: DataFrame, name: str, number: str, promoted: str, keep: int) -> DataFrame:
    """Versions beyond the newest `keep` of their name that are not promoted."""
    w = Window.partitionBy(name).orderBy(F.desc(number))
    return versions.withColumn("age", F.row_number().over(w)).where((F.col("age") > keep) & ~F.col(promoted))


def rollback_targets(versions: DataFrame, name: str, number: str, promoted: str) -> DataFrame:
    """The version before the promoted one, by number."""
    prior = F.lag(number).over(Window.partitionBy(name).orderBy(number))
    return versions.withColumn("rollback_to", prior).where(F.col(promoted)).select(name, number, "rollback_to")


def memoized(spark, path: str, make) -> DataFrame:
    """The table at path; made and written there if it is not."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


NAMESPACE = re.compile(r"[A-Za-z0-9._-]+")


def cached(spark: SparkSession, root: str, namespace: str, version: int, key: str, make) -> DataFrame:
    """The table under namespace, version and key (a digest of what it was made from), made there if it is not.

    Another version never serves a table of this one; a bad namespace or key is refused before anything is read.
    """
    if not NAMESPACE.fullmatch(namespace) or not re.fullmatch(r"[0-9a-f]{32,64}", key):
        raise ValueError(f"bad cache address {namespace!r}, {key!r}")
    return memoized(spark, f"{root}/{namespace}/v{version}/{key[:2]}/{key}", make)


def updated(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the columns of changes in the rows with their keys; keys that df lacks add nothing."""
    new = changes.select(F.col(key).alias("__k"), F.struct(*columns).alias("__new"))
    held = df.join(new, F.col(key) == F.col("__k"), "left")
    return held.withColumns({c: F.when(F.col("__k").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}).drop("__k", "__new")


def best_checkpoint(df: DataFrame, by: str, step: str, score: str) -> DataFrame:
    """(by, step, score): the first of the steps with the largest score."""
    return df.groupBy(by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(step)).alias("o"))).alias("b")).select(by, (-F.col("b.o")).alias(step), F.col("b.s").alias(score))


#: How old a staging file is when it may be swept, and the ending of the marks of those in use.
STALE_SECONDS, HEARTBEAT = 604_800, ".heartbeat"


def reapable(files: DataFrame, name: str, seconds: str, now: float) -> DataFrame:
    """files (name, time of last change) that a sweep may remove: old staging files whose mark is not fresh, and old marks."""
    cutoff = now - STALE_SECONDS
    fresh = files.where(F.endswith(F.col(name), F.lit(HEARTBEAT)) & (F.col(seconds) >= cutoff)).select(F.regexp_replace(name, "[.]heartbeat$", "").alias(name)).distinct()
    old = files.where((F.col(seconds) < cutoff) & F.contains(F.col(name), F.lit(".tmp-")))
    return old.join(fresh, name, "left_anti")
