"""Queries on serialised values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import codec
from trialframe.plans.base import query, table


@query("""
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || CASE WHEN p_size > 10 THEN p_size::VARCHAR ELSE 'null' END || '}') AS digest FROM part""")
def canonical_digests(spark: SparkSession, d: str) -> DataFrame:
    j = codec.canonical_json(size=F.when(F.col("p_size") > 10, F.col("p_size")), key=F.col("p_partkey"), brand=F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.sha2(j.cast("binary"), 256).alias("digest"))


@query("""
WITH l AS (SELECT json_object('custom_id', 'c' || o_orderkey, 'result', CASE o_orderstatus
    WHEN 'F' THEN json_object('type', 'succeeded', 'message', json_object('content', json_array(json_object('type', 'text', 'text', o_orderpriority), json_object('type', 'tool', 'text', 'x'), json_object('type', 'text', 'text', '!'))))
    WHEN 'O' THEN json_object('type', 'errored', 'error', json_object('message', 'overloaded')) ELSE json_object('type', 'expired') END) AS j FROM orders),
p AS (SELECT j, j ->> '$.result.type' AS t, from_json(j -> '$.result.message.content', '[{"type":"VARCHAR","text":"VARCHAR"}]') AS c FROM l)
SELECT j ->> '$.custom_id' AS custom_id, CASE t WHEN 'succeeded' THEN 'completed' WHEN 'errored' THEN 'failed' WHEN 'canceled' THEN 'canceled' ELSE t END AS status,
       CASE WHEN t = 'succeeded' THEN array_to_string(list_transform(list_filter(c, lambda x: x.type = 'text'), lambda x: x.text), '') END AS content, j ->> '$.result.error.message' AS error FROM p""")
def provider_results(spark: SparkSession, d: str) -> DataFrame:
    """Orders as result lines, and what they decode to."""
    o, s = table(spark, d, "orders"), F.col("o_orderstatus")
    text = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    message = F.when(s == "F", F.struct(F.array(text(F.col("o_orderpriority")), F.struct(F.lit("tool").alias("type"), F.lit("x").alias("text")), text(F.lit("!"))).alias("content")))
    error = F.when(s == "O", F.struct(F.lit("overloaded").alias("message")))
    kind = F.when(s == "F", "succeeded").when(s == "O", "errored").otherwise("expired")
    line = F.to_json(F.struct(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("custom_id"), F.struct(kind.alias("type"), message.alias("message"), error.alias("error")).alias("result")))
    return o.select(codec.provider_result(line).alias("r")).select("r.*")


@query("""
SELECT vec_id, len(embedding)::INT AS samples, round(list_sum(list_transform(embedding, lambda v: round(v::DOUBLE * 1000) / 32768.0::DOUBLE)), 5) AS total FROM embeddings""")
def pcm_samples(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as 16-bit samples in bytes, decoded again."""
    low = lambda v: F.pmod(F.round(v.cast("double") * 1000).cast("int"), F.lit(65536))
    hexed = F.array_join(F.transform("embedding", lambda v: F.concat(F.lpad(F.hex(low(v) % 256), 2, "0"), F.lpad(F.hex(F.floor(low(v) / 256)), 2, "0"))), "")
    s = table(spark, d, "embeddings").select("vec_id", codec.f32_from_s16(F.unhex(hexed)).alias("s"))
    return s.select("vec_id", F.size("s").alias("samples"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query(r"""
WITH r AS (SELECT c_custkey, 'Sure {here: ' || json_object('v', c_mktsegment) || ' and {"broken: ' || json_object('v', c_nationkey::VARCHAR) || '}} done' AS reply FROM customer)
SELECT c_custkey, array_to_string(regexp_extract_all(reply, '\{"v":"([^"]*)"\}', 1), ' ') AS objects FROM r""")
def embedded_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects inside noisy replies, in their order."""
    reply = F.concat(F.lit("Sure {here: "), F.to_json(F.struct(F.col("c_mktsegment").alias("v"))), F.lit(' and {"broken: '), F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("v"))), F.lit("}} done"))
    values = F.transform(codec.json_objects(reply), lambda x: F.get_json_object(x, "$.v"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.filter(values, lambda v: v.isNotNull()), " ").alias("objects"))
