"""Queries on call telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators import cost
from trialframe.plans.base import query, table

PRICES = {"error": ("0.15", "0.60"), "click": ("0.25", "1.25"), "view": ("3.00", "15.00"), "signup": ("1.00", "5.00"), "purchase": ("5.00", "25.00")}

_C = "c AS (SELECT event_id, event_type AS model, (props ->> '$.k')::BIGINT AS k FROM events)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), (k % 3).alias("served"), (k * 10).alias("input_tokens"), k.alias("output_tokens"))


@query(f"""
WITH {_C}, l AS (SELECT event_id, model, k % 3 AS served, lag(k % 3) OVER (PARTITION BY model ORDER BY event_id) AS before FROM c)
SELECT event_id, model, served, before FROM l WHERE before <> served""")
def telemetry_drift(spark: SparkSession, d: str) -> DataFrame:
    return cost.drift(calls(spark, d), "model", "event_id", "served").select("event_id", "model", "served", "before")


_P = ", ".join(f"('{m}', {i}::DECIMAL(10,4), {o}::DECIMAL(10,4))" for m, (i, o) in PRICES.items())


@query(f"""
WITH {_C}, p(model, i, o) AS (VALUES {_P})
SELECT c.model, count(*) AS calls, sum(k * 10)::BIGINT AS input_tokens, sum(k)::BIGINT AS output_tokens, round(sum(k * 10 * i::DOUBLE + k * o::DOUBLE) / 1000000, 6) AS usd FROM c JOIN p ON c.model = p.model GROUP BY c.model""")
def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    rows = ", ".join(f"('{m}', cast({i} as decimal(10,4)), cast({o} as decimal(10,4)))" for m, (i, o) in PRICES.items())
    prices = spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, input_price, output_price)")
    return cost.cost_by_model(calls(spark, d), prices).withColumn("usd", F.round(F.col("usd").cast("double"), 6))
