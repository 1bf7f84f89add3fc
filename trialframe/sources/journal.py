"""Append-only JSON-line journals as DataFrames: line order kept, four policies for lines that cannot be decoded.

A journal file is written by one process, so its lines have an order; it is read in splits by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.sources.lines import numbered_lines

#: skip_torn_tail: a bad last line is dropped, any other raises. skip_bad: every bad line is dropped.
#: strict: any bad line raises. skip_middle: bad lines are dropped, but a bad last line raises.
POLICIES = ("skip_torn_tail", "skip_bad", "strict", "skip_middle")
_BAD = "_bad"


def read_journal(spark: SparkSession, path: str, schema: T.StructType | str, policy: str = "skip_torn_tail", valid=None, glob: str = "*.jsonl") -> DataFrame:
    """(source_file, line, fields of schema); valid: a further Column condition on the decoded fields.

    Blank lines count for the line number but are no rows. An empty folder gives an empty result.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField(_BAD, T.StringType())])
    held = numbered_lines(spark, path, glob).withColumn("r", F.from_json("text", full, {"columnNameOfCorruptRecord": _BAD}))
    bad = F.col("r").isNull() | F.col(f"r.{_BAD}").isNotNull()
    out = held.withColumn("bad", bad)
    if valid is not None:
        fields = out.select("*", *[F.col(f"r.{f.name}").alias(f.name) for f in kind.fields])
        out = fields.withColumn("bad", F.col("bad") | ~F.coalesce(valid, F.lit(False))).drop(*kind.fieldNames())
    raises = {"skip_torn_tail": ~F.col("is_last"), "skip_bad": F.lit(False), "strict": F.lit(True), "skip_middle": F.col("is_last")}[policy]
    message = F.concat(F.lit("undecodable line "), F.col("line").cast("string"), F.lit(" of "), F.col("source_file"))
    checked = out.where(F.when(F.col("bad") & raises, F.raise_error(message).cast("boolean")).otherwise(~F.col("bad")))
    return checked.select("source_file", F.col("line").cast("int").alias("line"), *[F.col(f"r.{f.name}").alias(f.name) for f in kind.fields])


def append_journal(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in new files of the journal's folder."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def resume_units(journal: DataFrame, entity: str, unit: str) -> DataFrame:
    """(entity, next_unit): one after the largest unit."""
    return journal.groupBy(entity).agg((F.max(unit) + 1).alias("next_unit"))


def latest_status(journal: DataFrame, unit: str) -> DataFrame:
    """(unit, status): an error stays pending, one done record settles a unit."""
    return journal.groupBy(unit).agg(F.when(F.max(F.col("status") == "done"), "done").otherwise("error").alias("status"))
