"""Running sums and positions over ordered rows of any number, without one task that holds a whole group.

Rows are dealt into buckets that follow the order; sums run within a bucket, and the sums of the buckets before, a few
rows per group, are added. A bucket is an expression over a row, so a repeated task deals alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket on average, and buckets at most. Small tables have a single one.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 1024


def numbers(values: list[float]) -> Column:
    """A constant array of doubles."""
    return F.expr(f"array({', '.join(f'{v!r}D' for v in values)})") if values else F.expr("cast(array() as array<double>)")


def numeric_bucket(df: DataFrame, column: str, n: int | None = None) -> Column:
    """The bucket of a number by approximate quantiles of the column; equal numbers share one, nulls come first.

    Without n, the number of buckets follows from the rows, counted in the same pass.
    """
    value = F.col(column).cast("double")
    shares = numbers([k / (n or MOST_BUCKETS) for k in range(1, n or MOST_BUCKETS)])
    rows, found = df.select(F.count(value), F.percentile_approx(value, shares, 10_000)).first() if n is None or n > 1 else (0, None)
    most = min(MOST_BUCKETS, max(1, -(-rows // BUCKET_ROWS))) if n is None else n
    if n is None:
        found = [found[k * MOST_BUCKETS // most - 1] for k in range(1, most)] if found else None
    cuts = [float(c) for c in sorted(set(found or [])) if math.isfinite(c)]
    if not cuts:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    # Two looks at about the square root of the cuts each: the group of cuts first, then the cuts of that group.
    width = math.isqrt(len(cuts) - 1) + 1
    group = F.size(F.filter(numbers(cuts[width - 1 :: width]), lambda c: c < value))
    inside = F.size(F.filter(F.slice(numbers(cuts), group * width + 1, F.lit(width)), lambda c: c < value))
    return F.when(value.isNull(), F.lit(-1)).otherwise(group * width + inside)


def hash_bucket(key: Column) -> Column:
    """The bucket of a hexadecimal key: its first two digits, which follow its order and are even."""
    return F.substring(key, 1, 2)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of each value up to and including the row, in the order within its keys."""
    held = df.withColumn("__b", bucket)
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = held.withColumns({f"__w_{n}": F.sum(c).over(within) for n, c in sums.items()})
    return _with_before(held, rows, keys, "sum", sums)


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], into: str) -> DataFrame:
    """df with the position from 1 in the order within its keys."""
    return running(df, keys, bucket, order, {into: F.lit(1).cast("long")})


def reached(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with the largest value of each up to and including the row, in the order within its keys; null before any."""
    held = df.withColumn("__b", bucket)
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = held.withColumns({f"__w_{n}": F.max(c).over(within) for n, c in values.items()})
    return _with_before(held, rows, keys, "max", values)


def before(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with the value of the row before, in the order within its keys: a lag over any number of rows.

    The first row of a bucket takes the value from the last bucket before that has rows.
    """
    held = df.withColumn("__b", bucket)
    within = Window.partitionBy(*keys, "__b").orderBy(*order)
    rows = held.withColumns({f"__l_{n}": F.struct(F.lag(c).over(within).alias("v")) for n, c in values.items()}).withColumn("__r", F.row_number().over(within))
    last = held.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__c")).agg(*[F.max_by(F.struct(c.alias("v")), F.struct(*order)).alias(f"__t_{n}") for n, c in values.items()])
    past = Window.partitionBy(*([f"__k_{k}" for k in keys] or [F.lit(0)])).orderBy("__c")
    last = last.withColumns({f"__p_{n}": F.lag(f"__t_{n}").over(past) for n in values})
    out = _joined(rows, last, keys).withColumns({n: F.when(F.col("__r") == 1, F.col(f"__p_{n}.v")).otherwise(F.col(f"__l_{n}.v")) for n in values})
    return out.drop("__r", "__b", "__c", *[f"__k_{k}" for k in keys], *[f"__{p}_{n}" for p in "ltp" for n in values])


def _joined(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    on = F.col("__b").eqNullSafe(F.col("__c"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(totals, on)


def _with_before(held: DataFrame, rows: DataFrame, keys: list[str], kind: str, values: dict[str, Column]) -> DataFrame:
    fold = {"sum": F.sum, "max": F.max}[kind]
    totals = held.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__c")).agg(*[fold(c).alias(f"__t_{n}") for n, c in values.items()])
    past = Window.partitionBy(*([f"__k_{k}" for k in keys] or [F.lit(0)])).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__p_{n}": fold(f"__t_{n}").over(past) for n in values})
    w, p = (lambda n: F.col(f"__w_{n}")), (lambda n: F.col(f"__p_{n}"))
    both = (lambda n: w(n) + F.coalesce(p(n), F.lit(0))) if kind == "sum" else (lambda n: F.greatest(w(n), p(n)))
    out = _joined(rows, totals, keys).withColumns({n: both(n) for n in values})
    return out.drop("__b", "__c", *[f"__k_{k}" for k in keys], *[f"__{p}_{n}" for p in "wtp" for n in values])
