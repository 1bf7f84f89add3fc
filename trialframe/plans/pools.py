"""Queries on row pools: splits, samples, digests, batches, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.expr import text_digest
from trialframe.operators import split, tables
from trialframe.plans.base import query, table
from trialframe.sources import manifest
from trialframe.sources.shared import new_folder

_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1)"
_SPLIT = f"""
{_ONCE},
k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('1729|' || doc_id)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM once),
split AS (SELECT doc_id, lang, CASE WHEN r <= round_even(n * 0.75::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.75::DOUBLE, 0) + round_even(n * 0.10::DOUBLE, 0) THEN 'valid' ELSE 'test' END AS bucket FROM k)"""


def split_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    once = split.dedupe(docs.select("doc_id", "lang", "text"), text_digest(F.col("text")), F.col("doc_id")).drop("text")
    return split.stratified_split(once, F.col("doc_id"), ["lang"])


@query(f"WITH {_SPLIT} SELECT doc_id, lang, bucket FROM split")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(spark, d)


@query(f"WITH {_SPLIT} SELECT bucket, count(*) AS n, (SELECT count(*) FROM (SELECT doc_id FROM split GROUP BY doc_id HAVING count(DISTINCT bucket) > 1)) AS shared FROM split GROUP BY bucket")
def split_disjoint_check(spark: SparkSession, d: str) -> DataFrame:
    s = split_documents(spark, d)
    shared = split.overlaps(s, "doc_id").agg(F.count("*").alias("shared"))
    return s.groupBy("bucket").agg(F.count("*").alias("n")).crossJoin(F.broadcast(shared))


@query("""
WITH p AS (SELECT lang, count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS d FROM documents GROUP BY lang, substr(sha256(text), 1, 3))
SELECT lang, sum(n)::BIGINT AS n, substr(sha256(string_agg(d, '' ORDER BY d)), 1, 16) AS digest FROM p GROUP BY lang""")
def dataset_digest(spark: SparkSession, d: str) -> DataFrame:
    return split.dataset_digest(table(spark, d, "documents"), F.col("text"), ["lang"])


@query("""
WITH s AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id)) AS r FROM documents) WHERE r <= 5)
SELECT doc_id, lang, row_number() OVER (ORDER BY md5('order7|' || doc_id))::INT AS number FROM s""")
def golden_sample(spark: SparkSession, d: str) -> DataFrame:
    return split.golden_sample(table(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id"), "lang", 5)


@query("""
WITH h AS (SELECT l.doc_id, l.quality, (n_chars >= 500)::INT AS panel FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT count(*) AS n, count(*) FILTER (quality = panel) AS agreed, round(count(*) FILTER (quality = panel) / count(*), 6) AS rate,
       CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (quality = panel) < count(*) // 2 + 1 THEN 'below floor' ELSE 'ok' END AS reason FROM h""")
def golden_agreement(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    n, agreed = F.count("*"), F.count_if(F.col("quality") == (F.col("n_chars") >= 500).cast("int"))
    out = h.agg(n.alias("n"), agreed.alias("agreed"))
    reason = F.when(F.col("n") == 0, "empty").when(F.col("agreed") < F.floor(F.col("n") / 2) + 1, "below floor").otherwise("ok")
    return out.select("n", "agreed", F.round(F.try_divide("agreed", "n"), 6).alias("rate"), reason.alias("reason"))


@query("""
WITH e AS (SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('1729|' || epoch || '|' || doc_id)) - 1 AS r FROM labels, range(0, 3) t(epoch)), n AS (SELECT count(*) AS n FROM labels)
SELECT doc_id, epoch::INT AS epoch, (epoch * n + r)::BIGINT AS position, ((epoch * n + r) // 16)::BIGINT AS batch FROM e, n""")
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    out = split.batch_plan(table(spark, d, "labels").select("doc_id"), F.col("doc_id"), 16, 3)
    return out.select("doc_id", "epoch", F.col("position").cast("long").alias("position"), "batch")


_ALTERED = "CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END"


@query(f"""
WITH a AS (SELECT doc_id AS path, sha256(text) AS l FROM documents WHERE doc_id % 13 <> 0),
b AS (SELECT doc_id AS path, sha256({_ALTERED}) AS r FROM documents WHERE doc_id % 17 <> 0)
SELECT coalesce(a.path, b.path) AS path, l AS "left", r AS "right" FROM a FULL JOIN b ON a.path = b.path WHERE l IS DISTINCT FROM r""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), text_digest(F.col("text")).alias("sha256"))
    b = docs.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("path"), text_digest(F.expr(_ALTERED)).alias("sha256"))
    return tables.diff(a, b, "path", "sha256")


@query("SELECT 'ns=' || source AS namespace, count(DISTINCT (lang, doc_id % 3)) AS entries, sum(strlen(text) + 1)::BIGINT AS size FROM documents GROUP BY source")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """Entries and bytes of each namespace of a tree of files: a version for a language, an entry for a third of its texts."""
    path, entry = new_folder(spark), (F.col("doc_id") % 3).cast("string")
    rows = table(spark, d, "documents").select(F.col("source").alias("ns"), F.concat(F.lit("v"), "lang").alias("v"), F.lit("0").alias("shard"), entry.alias("entry"), F.col("text").alias("value"))
    rows.repartition("ns", "v", "entry").write.partitionBy("ns", "v", "shard", "entry").text(path)
    return manifest.cache_statistics(spark, path)


@query("SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_id_violations(spark: SparkSession, d: str) -> DataFrame:
    return tables.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"])


@query("""
WITH x AS (SELECT doc_id, text, 'v1' AS held FROM documents), i AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' old' ELSE text END) AS digest FROM documents WHERE doc_id % 3 <> 0)
SELECT x.doc_id, CASE WHEN i.digest IS NULL THEN 'new' ELSE 'changed' END AS state FROM x LEFT JOIN i ON x.doc_id = i.doc_id WHERE i.digest IS NULL OR i.digest <> sha256(text)""")
def text_digests_upsert(spark: SparkSession, d: str) -> DataFrame:
    from trialframe.operators.vector import to_embed

    docs = table(spark, d, "documents")
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    index = docs.where("doc_id % 3 <> 0").select("doc_id", text_digest(old).alias("digest"))
    return to_embed(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), index, "doc_id", "digest").select("doc_id", "state")
