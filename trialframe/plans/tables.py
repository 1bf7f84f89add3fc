"""Queries on keyed tables: leaderboards, upserts, baselines, pending work, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.expr import uplift
from trialframe.operators import batch_jobs, tables
from trialframe.plans.base import query, table

_C = "c AS (SELECT o_orderpriority AS experiment, o_orderkey AS unit, o_orderstatus AS arm, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS metric FROM orders)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("experiment"), F.col("o_orderkey").alias("unit"), F.col("o_orderstatus").alias("arm"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("metric")
    )


@query(f"WITH {_C} SELECT experiment, unit, arm, metric, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY metric DESC, unit, arm) AS rank FROM c WHERE metric IS NOT NULL) WHERE rank <= 10")
def cells_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return tables.leaderboard(cells(spark, d), "experiment", "metric", ["unit", "arm"], 10)


@query(f"WITH {_C} SELECT experiment, unit, arm, metric FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY metric DESC, unit, arm) AS rank FROM c WHERE metric IS NOT NULL) WHERE rank = 1")
def cells_best(spark: SparkSession, d: str) -> DataFrame:
    return tables.leaderboard(cells(spark, d), "experiment", "metric", ["unit", "arm"], 1).drop("rank")


@query(f"""
WITH {_C}, w AS (SELECT *, 0 AS version FROM c WHERE unit % 3 = 0 UNION ALL SELECT experiment, unit, arm, round(metric * 2, 4), 1 FROM c WHERE unit % 6 = 0),
n AS (SELECT experiment, unit, arm, arg_max(metric_, version) AS metric FROM (SELECT *, struct_pack(m := metric) AS metric_ FROM w) GROUP BY ALL)
SELECT experiment, unit, arm, metric FROM c WHERE unit % 3 <> 0 UNION ALL SELECT experiment, unit, arm, metric.m FROM n""")
def cells_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    new = c.where("unit % 3 = 0").withColumn("version", F.lit(0)).unionByName(c.where("unit % 6 = 0").withColumns({"metric": F.round(F.col("metric") * 2, 4), "version": F.lit(1)}))
    fresh = tables.upserted(c, new, ["experiment", "unit", "arm"], F.col("version"))
    return fresh


@query("""
WITH b AS (SELECT o_custkey, o_orderstatus AS arm, max(o_totalprice) AS metric FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
n AS (SELECT o_custkey, o_orderstatus AS arm, max(o_totalprice) AS metric FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT n.o_custkey, n.arm, n.metric, b.metric AS held, CASE WHEN b.metric IS NULL THEN 'inserted' ELSE 'conflict' END AS outcome
FROM n LEFT JOIN b ON n.o_custkey = b.o_custkey AND n.arm = b.arm WHERE b.metric IS NULL OR b.metric <> n.metric""")
def baseline_insert_once_conflicts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = lambda k: o.where(F.col("o_orderkey") % k == 0).groupBy("o_custkey", F.col("o_orderstatus").alias("arm")).agg(F.max("o_totalprice").alias("metric"))
    fresh, conflicts = tables.insert_once(side(2), side(3), ["o_custkey", "arm"], "metric")
    cols = ["o_custkey", "arm", "metric", "held", "outcome"]
    return fresh.withColumns({"held": F.lit(None).cast("double"), "outcome": F.lit("inserted")}).select(*cols).unionByName(conflicts.withColumn("outcome", F.lit("conflict")).select(*cols))


@query("""
WITH b AS (SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS baseline FROM orders GROUP BY o_custkey)
SELECT o_orderkey, round((o_totalprice - baseline) / greatest(abs(baseline), 0.001), 6) AS uplift FROM orders o JOIN b ON o.o_custkey = b.o_custkey""")
def uplift_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Every order against its customer's first."""
    o = table(spark, d, "orders")
    b = o.groupBy("o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("baseline"))
    return o.join(b, "o_custkey").select("o_orderkey", F.round(uplift(F.col("o_totalprice"), F.col("baseline")), 6).alias("uplift"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0 OR o_totalprice > 2.2 * (SELECT avg(o_totalprice) FROM orders)) d ON c_custkey = o_custkey")
def pending_customers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("mean"))
    done = o.crossJoin(F.broadcast(mean)).where((F.col("o_orderkey") % 50 == 0) | (F.col("o_totalprice") > 2.2 * F.col("mean"))).select(F.col("o_custkey").alias("c_custkey"))
    return tables.pending(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("""
WITH ret AS (SELECT DISTINCT l_orderkey AS key, 'completed' AS status FROM lineitem WHERE l_linenumber = 3),
x AS (SELECT o_orderkey AS key FROM orders ANTI JOIN ret ON o_orderkey = key)
SELECT key, CASE WHEN key % 4 = 0 THEN 'retried' ELSE 'resubmit' END AS action FROM x""")
def expired_resubmits(spark: SparkSession, d: str) -> DataFrame:
    """Orders without a third line have expired; those divisible by four were retried."""
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    returned = table(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("key")).distinct().withColumn("status", F.lit("completed"))
    results = batch_jobs.with_expired(expected, returned, "key")
    retried = results.where("status = 'expired' and key % 4 = 0").select("key")
    again = batch_jobs.resubmits(results, retried, "key").withColumn("action", F.lit("resubmit"))
    return again.unionByName(retried.withColumn("action", F.lit("retried")))


@query("""
WITH e AS (SELECT o_orderkey AS file, 'intent' AS event FROM orders UNION ALL SELECT l_orderkey, 'submitted' FROM lineitem WHERE l_returnflag = 'R')
SELECT file, count(*) AS events FROM e GROUP BY file HAVING bool_or(event = 'intent') AND NOT bool_or(event = 'submitted')""")
def dangling_attempts(spark: SparkSession, d: str) -> DataFrame:
    intents = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.lit("intent").alias("event"))
    sent = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.lit("submitted").alias("event"))
    return batch_jobs.dangling(intents.unionByName(sent), "file").select("file", "events")


@query("""
WITH v AS (SELECT o_custkey AS name, o_orderkey AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age FROM orders),
p AS (SELECT *, age = 2 AS promoted FROM v)
SELECT name, number, 'prune' AS action, NULL::BIGINT AS rollback_to FROM p WHERE age > 3 AND NOT promoted
UNION ALL SELECT name, number, 'rollback', prior FROM (SELECT *, lag(number) OVER (PARTITION BY name ORDER BY number) AS prior FROM p) WHERE promoted""")
def registry_prune_rollback(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as versions, the last but one promoted."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("number"), (F.row_number().over(w) == 2).alias("promoted"))
    gone = tables.doomed_versions(v, "name", "number", "promoted", 3).select("name", "number", F.lit("prune").alias("action"), F.lit(None).cast("long").alias("rollback_to"))
    back = tables.rollback_targets(v, "name", "number", "promoted").select("name", "number", F.lit("rollback").alias("action"), "rollback_to")
    return gone.unionByName(back)
