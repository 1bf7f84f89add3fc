"""Progress of append-only files from observations of their size, and alarms of runs that are live but quiet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observed(df: DataFrame, keys: list[str], time: str, size: str, device: str, inode: str) -> DataFrame:
    """df with grew and last_growth of the file that keys name, as each observation finds it.

    A file's first observation counts as growth. A new inode or device is measured from 0; a file that became shorter
    has not grown, and is measured from its new size on. A missing file has the size 0 and no inode, so its return is a
    new file. Observations of one time are taken in the order of their sizes.
    """
    w = Window.partitionBy(*keys).orderBy(time, size)
    before = {c: F.lag(c).over(w) for c in (size, device, inode)}
    first = F.row_number().over(w) == 1
    other = ~(F.col(device).eqNullSafe(before[device]) & F.col(inode).eqNullSafe(before[inode]))
    baseline = F.when(F.col(device).isNotNull() & other, F.lit(0)).otherwise(before[size])
    held = df.withColumn("grew", first | (F.col(size) > baseline))
    return held.withColumn("last_growth", F.max(F.when(F.col("grew"), F.col(time))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def held_since(df: DataFrame, keys: list[str], time: str, holder: str) -> DataFrame:
    """df with live_since, the time since which the same holder is seen; null where there is none. One row a time."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = (F.row_number().over(w) == 1) | ~F.col(holder).eqNullSafe(F.lag(holder).over(w))
    since = F.max(F.when(F.col("__new"), F.col(time))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__new", new).withColumn("live_since", F.when(F.col(holder).isNotNull(), since)).drop("__new")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def watched(df: DataFrame, run: str, kind: str, time: str, size: str, device: str, inode: str, holder: str, seconds: float) -> DataFrame:
    """(run, time, live, quiet_s, alarm) of each check: what one run's files, observed at one time, say.

    A run is quiet since the last growth of any of its files, or since its present holder came, whatever is later.
    """
    files = observed(df, [run, kind], time, size, device, inode)
    checks = files.groupBy(run, time).agg(F.max("last_growth").alias("growth"), F.max(holder).alias(holder))
    # The last growth of files that this check did not look at counts too.
    w = Window.partitionBy(run).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    checks = held_since(checks.withColumn("growth", F.max("growth").over(w)), [run], time, holder)
    since = F.greatest("growth", F.coalesce("live_since", F.col(time)))
    quiet = seconds_between(F.col(time), since)
    return checks.select(run, time, F.col(holder).isNotNull().alias("live"), quiet.alias("quiet_s"), (F.col(holder).isNotNull() & (quiet >= seconds)).alias("alarm"))
