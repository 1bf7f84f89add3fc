"""Lines of text files with their numbers, read in splits: a file of any size is read by many tasks.

Spark cuts files into blocks and gives each line once. A line's number is its place in its block, which Spark's row ids
give without a shuffle, plus the lines of the blocks before: one pass counts these, a row per block. The pass also finds
the last line of each file that is not blank, which is all that is needed to judge a torn tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.sources.shared import stored

#: Blocks of all files whose offsets may be broadcast.
BROADCAST_BLOCKS = 200_000


def blank(text: Column) -> Column:
    return F.trim(text) == ""


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(source_file, line, text, is_last) of all lines that are not blank; blank ones count for the number, from 0."""
    options = {"lineSep": "\n", "recursiveFileLookup": recursive} | ({"pathGlobFilter": glob} if glob else {})
    raw = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("text"), F.monotonically_increasing_id().alias("at"),
    )
    blocks = raw.groupBy("source_file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max(F.when(~blank(F.col("text")), F.col("at"))).alias("final"))
    w = Window.partitionBy("source_file").orderBy("block")
    before = (F.sum("n").over(w) - F.col("n")).alias("before")
    blocks = blocks.select("source_file", "block", "first", before, (F.col("final") - F.col("first")).alias("final"))
    last = F.max(F.col("before") + F.col("final")).over(Window.partitionBy("source_file"))
    blocks = stored(blocks.withColumn("last", last).drop("final"))
    small = blocks.count() <= BROADCAST_BLOCKS
    line = F.col("at") - F.col("first") + F.col("before")
    held = raw.join(F.broadcast(blocks) if small else blocks, ["source_file", "block"]).where(~blank(F.col("text")))
    return held.select("source_file", line.alias("line"), "text", (line == F.col("last")).alias("is_last"))
