"""Queries on embeddings: nearest vectors, diverse re-ranking."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators import embedding, vector
from trialframe.plans.base import query, table
from trialframe.sources import versions
from trialframe.sources.shared import new_folder


@query("""
WITH i AS (SELECT doc_id AS id, sha256(text) AS digest FROM documents)
SELECT id, digest, 8::INT AS dims, ('0x' || substr(digest, 1, 2))::INT::DOUBLE AS first, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS again, 0::BIGINT AS idle FROM i""")
def refreshed_index(spark: SparkSession, d: str) -> DataFrame:
    """An index of all texts, filled when a fifth of them had other words, brought up to date, and once more for nothing.

    The model is a stub: the first bytes of a text's digest.
    """
    docs, root = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), new_folder(spark)
    old = docs.withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit(" then"))).otherwise(F.col("text")))
    model = lambda texts: [list(hashlib.sha256(t.encode()).digest()[:8]) for t in texts]
    done = [embedding.refresh_index(spark, t, root, date, model) for t, date in ((old, "20240101"), (docs, "20240102"), (docs, "20240103"))]
    held = versions.read_current(spark, root)
    return held.select("id", "digest", F.size("vector").alias("dims"), F.col("vector")[0].cast("double").alias("first"), F.lit(done[1]).cast("long").alias("again"), F.lit(done[2]).cast("long").alias("idle"))


@query("""
WITH s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT query, vec_id, rank::INT AS rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vector.cosine_top_k(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


def _picked(k: int) -> str:
    """The CTEs of pick k: the best of what is left by similarity to the query and to the earlier picks."""
    earlier = ", ".join(f"(SELECT embedding FROM p{j} WHERE p{j}.label = s.label)" for j in range(1, k))
    gone = " AND ".join(f"s.vec_id <> (SELECT vec_id FROM p{j} WHERE p{j}.label = s.label)" for j in range(1, k)) or "true"
    score = "sim" if k == 1 else f"0.5 * sim - 0.5 * list_max(list_transform([{earlier}], lambda v: list_cosine_similarity(s.embedding::DOUBLE[], v::DOUBLE[])))"
    return f"""p{k} AS (SELECT label, vec_id, embedding FROM (SELECT s.label, s.vec_id, s.embedding, row_number() OVER (PARTITION BY s.label ORDER BY {score} DESC, s.vec_id) AS r FROM s WHERE {gone}) WHERE r = 1)"""


@query(f"""
WITH q AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
s AS (SELECT e.label, e.vec_id, e.embedding, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e JOIN q ON q.label = (e.label + 1) % 10),
{_picked(1)}, {_picked(2)}, {_picked(3)}
SELECT label, vec_id, 1 AS rank FROM p1 UNION ALL SELECT label, vec_id, 2 FROM p2 UNION ALL SELECT label, vec_id, 3 FROM p3""")
def mmr_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Three diverse vectors of each label for the first vector of the next one."""
    e = table(spark, d, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query")).select(((F.col("label") + 9) % 10).alias("label"), "query")
    return vector.mmr(e.join(q, "label"), "label", "vec_id", "embedding", "query", 3)
