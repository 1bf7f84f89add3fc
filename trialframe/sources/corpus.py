"""Chat corpora and requests from JSON lines or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.sources.lines import numbered_lines

MESSAGES = "array<struct<role:string,content:string>>"


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(stem, line, text) of a file or of all files of a folder; blank lines are counted, but no rows."""
    stem = F.regexp_extract("source_file", "([^/]*)\\.[a-z]+$", 1)
    return numbered_lines(spark, path, glob, recursive=False).select(F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))).alias("stem"), "line", "text")


def read_sft(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(id, prompt, completion): all messages but the last, and the last; id is stem:line."""
    rows = _lines(spark, path, glob).withColumn("m", F.from_json("text", f"messages {MESSAGES}")["messages"])
    return rows.select(F.concat_ws(":", "stem", "line").alias("id"), F.slice("m", 1, F.size("m") - 1).alias("prompt"), F.array(F.element_at("m", -1)).alias("completion"))


def read_preferences(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(id, prompt, chosen, rejected)."""
    rows = _lines(spark, path, glob).withColumn("r", F.from_json("text", f"prompt {MESSAGES}, chosen {MESSAGES}, rejected {MESSAGES}"))
    return rows.select(F.concat_ws(":", "stem", "line").alias("id"), "r.prompt", "r.chosen", "r.rejected")


def read_requests(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(custom_id, body): a provider's batch requests, the body as JSON text."""
    rows = _lines(spark, path, glob)
    return rows.select(F.get_json_object("text", "$.custom_id").alias("custom_id"), F.get_json_object("text", "$.body").alias("body"))


def write_split(df: DataFrame, path: str, bucket: str) -> None:
    """JSON lines of each bucket in a folder of its name."""
    df.write.partitionBy(bucket).mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str, method: str) -> DataFrame:
    """A chat corpus for a training method, from JSON lines or, where the folder has them, Parquet files."""
    if method not in ("sft", "dpo"):
        raise ValueError(f"method must be sft or dpo, got {method}")
    from trialframe.sources.versions import file_names

    if any(n.endswith(".parquet") for n in file_names(spark, path)):
        rows, m = spark.read.parquet(path), F.col("messages") if method == "sft" else None
        if m is not None:
            return rows.select(F.col("id").cast("string").alias("id"), F.slice(m, 1, F.size(m) - 1).alias("prompt"), F.array(F.element_at(m, -1)).alias("completion"))
        return rows.select(F.col("id").cast("string").alias("id"), "prompt", "chosen", "rejected")
    return read_sft(spark, path) if method == "sft" else read_preferences(spark, path)
