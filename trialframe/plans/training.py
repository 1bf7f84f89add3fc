"""Queries on training data: examples, pairs, masks, losses, batches, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.functions.expr import dot, token_estimate
from trialframe.operators import chat, metrics, train_data
from trialframe.plans.base import query, table


def chats(spark: SparkSession, d: str) -> DataFrame:
    return train_data.conversations(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query()
def chat_masks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as masked examples of a public tokenizer: sizes, the prompt's boundary and a check sum of the targets."""
    import public_tokenizers

    rows = train_data.sft_examples(chats(spark, d)).select("conv_id", "prompt", F.array("completion").alias("completion"))
    out = chat.masked_examples(rows, "conv_id", "prompt", "completion", public_tokenizers.path("word_bpe_49k.json"))
    weighed = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    return out.select("conv_id", F.size("targets").alias("n"), "cut", weighed.cast("long").alias("weighed"), F.crc32(F.array_join("targets", ",")).alias("targets_crc32"))


@query("""
SELECT conv_id, (count(*) - 1)::INT AS prompt_turns, arg_max(role, turn) AS completion_role, arg_max(text, turn) AS completion,
       (sum(length(text)) - arg_max(length(text), turn))::BIGINT AS prompt_chars FROM conversations GROUP BY conv_id""")
def sft_examples(spark: SparkSession, d: str) -> DataFrame:
    x = train_data.sft_examples(chats(spark, d))
    chars = F.aggregate("prompt", F.lit(0).cast("long"), lambda s, m: s + F.length(m["content"]))
    return x.select("conv_id", F.size("prompt").alias("prompt_turns"), F.col("completion.role").alias("completion_role"), F.col("completion.content").alias("completion"), chars.alias("prompt_chars"))


@query("""
WITH a AS (SELECT conv_id, arg_max(text, turn) AS chosen FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT * FROM (SELECT conv_id, chosen, lead(chosen) OVER (ORDER BY conv_id) AS rejected FROM a) WHERE rejected IS NOT NULL""")
def dpo_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The last assistant turn of each conversation is preferred to that of the next."""
    a = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("chosen"))
    placed = train_data.dense_position(a, "conv_id")
    return train_data.preference_pairs(placed, "conv_id", "chosen").select("conv_id", "chosen", "rejected")




@query("""
WITH m AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS full_text, arg_max(text, turn) AS last FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, length(full_text) AS n, length(full_text) - length(last) AS cut FROM m)
SELECT conv_id, n::INT AS tokens, (n - 1)::INT AS targets, (n - greatest(cut, 1))::DOUBLE AS weight FROM n WHERE n > 1""")
def completion_mask(spark: SparkSession, d: str) -> DataFrame:
    """Characters as tokens; only the last turn's weigh."""
    x = train_data.sft_examples(chats(spark, d))
    text = F.concat(F.array_join(F.transform("prompt", lambda m: m["content"]), ""), F.col("completion.content"))
    x = x.select("conv_id", train_data.char_codes(F.array_join(F.transform("prompt", lambda m: m["content"]), "")).alias("p"), train_data.char_codes(text).alias("t")).where(F.size("t") > 1)
    mask = train_data.completion_mask(F.col("p"), F.col("t"))
    return x.select("conv_id", F.size("t").alias("tokens"), F.size(mask["targets"]).alias("targets"), F.aggregate(mask["weights"], F.lit(0.0), lambda s, v: s + v).alias("weight"))


@query("""
WITH e AS (SELECT label, list_transform(embedding, lambda v: -abs(v::DOUBLE)) AS lp, list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM embeddings)
SELECT label, round(sum(-list_dot_product(lp, w)) / sum(list_sum(w)), 4) AS loss, count(*) AS sequences FROM e GROUP BY label""")
def sequence_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: -F.abs(v.cast("double"))).alias("lp"))
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 2 == 0, 1.0).otherwise(0.5))
    loss, weight = metrics.weighted_loss(F.col("lp"), w)
    return e.groupBy("label").agg(F.round(F.sum(loss) / F.sum(weight), 4).alias("loss"), F.count("*").alias("sequences"))


@query("""
WITH p AS (SELECT a.label, 0.1 * ((a.embedding[1]::DOUBLE - a.embedding[2]::DOUBLE) - (b.embedding[1]::DOUBLE - b.embedding[2]::DOUBLE)) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
SELECT label, count(*) AS pairs, round(avg(m), 6) AS margin, round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 6) AS loss, round(avg((m > 0)::INT), 6) AS accuracy FROM p GROUP BY label""")
def dpo_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    x = lambda k: F.col("embedding")[k].cast("double")
    a = e.where("vec_id % 2 = 0").select("vec_id", "label", x(0).alias("pc"), x(1).alias("rc"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), x(0).alias("pr"), x(1).alias("rr"))
    m = metrics.preference_margin(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"))
    p = a.join(b, "vec_id").withColumn("m", m)
    return p.groupBy("label").agg(
        F.count("*").alias("pairs"), F.round(F.avg("m"), 6).alias("margin"), F.round(F.avg(metrics.preference_loss(F.col("m"))), 6).alias("loss"), F.round(F.avg((F.col("m") > 0).cast("int")), 6).alias("accuracy")
    )


@query("SELECT role, count(*) AS turns, sum(length(text) // 4)::BIGINT AS tokens, max(length(text) // 4)::BIGINT AS longest FROM conversations GROUP BY role")
def batch_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = token_estimate(F.col("text"))
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(t).alias("tokens"), F.max(t).alias("longest"))


@query("""
WITH RECURSIVE e AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (
  SELECT source, doc_id, k, 0::BIGINT AS batch, 1::BIGINT AS n, n_chars AS s FROM e WHERE k = 1
  UNION ALL SELECT e.source, e.doc_id, e.k, CASE WHEN f.n + 1 > 8 OR f.s + e.n_chars > 6000 THEN f.batch + 1 ELSE f.batch END,
         CASE WHEN f.n + 1 > 8 OR f.s + e.n_chars > 6000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n + 1 > 8 OR f.s + e.n_chars > 6000 THEN e.n_chars ELSE f.s + e.n_chars END
  FROM f JOIN e ON e.source = f.source AND e.k = f.k + 1)
SELECT source, doc_id, batch FROM f""")
def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    return train_data.packed_batches(table(spark, d, "documents"), ["source"], "doc_id", "n_chars", 8, 6000)


@query("""
WITH c AS (SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS so_far FROM conversations),
p AS (SELECT *, coalesce(lag(so_far) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM c)
SELECT conv_id, turn, trim(substr(so_far, length(before) + 1)) AS delta FROM p WHERE trim(substr(so_far, length(before) + 1)) <> ''""")
def transcript_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as growing transcripts, and what each turn adds."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), "").alias("so_far"))
    return train_data.text_deltas(c, "conv_id", "turn", "so_far").select("conv_id", "turn", "delta")


@query("""
WITH k AS (SELECT label, avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS energy FROM embeddings GROUP BY label)
SELECT label, round(energy, 4) AS energy FROM k""")
def vector_energy(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(dot(e, e)), 4).alias("energy"))
