"""Cost of calls by model, with small price tables, and drift of what served them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.ranges import before, numeric_bucket

#: A price table is a hand-kept list; more rows than this are joined by a shuffle.
BROADCAST_PRICES = 10_000


def priced(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """calls with usd from prices per million input and output tokens; a model without a price raises."""
    few = prices.limit(BROADCAST_PRICES + 1).count() <= BROADCAST_PRICES
    held = calls.join(F.broadcast(prices) if few else prices, model, "left")
    usd = (F.col("input_tokens").cast("decimal(18,0)") * F.col("input_price") + F.col("output_tokens").cast("decimal(18,0)") * F.col("output_price")) / F.lit(1_000_000)
    missing = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce(F.col(model), F.lit("null"))))
    return held.withColumn("usd", F.when(F.col("input_price").isNull(), missing.cast("double").cast("decimal(38,12)")).otherwise(usd))


def cost_by_model(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    return priced(calls, prices, model).groupBy(model).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("usd").alias("usd"))


def drift(calls: DataFrame, model: str, order: str, served: str) -> DataFrame:
    """Calls whose server differs from that of the model's call before; nulls are no drift. A model may have any number of calls."""
    held = before(calls, [model], numeric_bucket(calls, order), [F.col(order)], {"before": F.col(served)})
    return held.where(F.col("before") != F.col(served))


def running_spend(df: DataFrame, entity: str, order: str, amount: Column) -> DataFrame:
    """df with step and spent: position and running sum within the entity."""
    w = Window.partitionBy(entity).orderBy(order)
    return df.withColumns({"step": F.row_number().over(w), "spent": F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))})


#: Fixed value: output tokens that a call reserves before it is made.
OUTPUT_ALLOWANCE = 1024


def metered(calls: DataFrame, prices: DataFrame, prompt: str, answer: str, model: str = "model") -> DataFrame:
    """calls with tokens (a quarter of the code points), reserved, spent and released usd; a call without an answer spends nothing."""
    given, got = F.floor(F.length(prompt) / 4), F.floor(F.length(answer) / 4)
    held = priced(calls.withColumns({"input_tokens": given, "output_tokens": F.lit(OUTPUT_ALLOWANCE)}), prices, model).withColumnRenamed("usd", "reserved").drop("input_price", "output_price")
    out = priced(held.withColumn("output_tokens", F.coalesce(got, F.lit(0))), prices, model).withColumnRenamed("usd", "spent").drop("input_price", "output_price")
    out = out.withColumn("spent", F.when(F.col(answer).isNull(), F.lit(0)).otherwise(F.col("spent")))
    return out.withColumn("released", F.col("reserved") - F.col("spent"))
