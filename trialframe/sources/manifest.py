"""File trees as (path, digest) tables and what changed between two of them."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators.tables import diff


#: Files up to so many bytes are digested as one value; larger ones are read piece by piece.
WHOLE_BYTES = 256 << 20


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of every file below root that has any bytes, from its metadata alone, the doubles of
    resource forks left out. Spark's readers pass over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.where(~F.startswith(F.element_at(F.split("path", "/"), -1), F.lit("._")))


def tree_manifest(spark: SparkSession, root: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, length, sha256) of every file below root, the doubles of resource forks left out.

    A file beyond whole_bytes (2 GB is the most that one value holds) is read in pieces by one task, from the path as the
    executors mount it; Spark's own readers give no pieces of binary files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = files.where((F.col("length") <= whole_bytes) & ~F.startswith(F.element_at(F.split("path", "/"), -1), F.lit("._"))).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = listed(spark, root).where(F.col("length") > whole_bytes).select("path", "length")

    def digest(batches):
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sha = hashlib.sha256()
                with open(unquote(path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path), "rb") as f:
                    while piece := f.read(1 << 20):
                        sha.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([sha.hexdigest()])], names=["path", "length", "sha256"])

    return small.unionByName(large.repartition("path").mapInArrow(digest, "path string, length long, sha256 string"))


def cache_statistics(spark: SparkSession, root: str) -> DataFrame:
    """(namespace, entries, size) of a cache's tree namespace/version/shard/entry, over all versions, from metadata alone.

    An entry is a file or a folder with all its files; those that are being staged do not count.
    """
    name = "^.*?" + re.escape(root.removeprefix("file://").removeprefix("file:").rstrip("/")) + "/([^/]+)/([^/]+)/([^/]+)/([^/]+)"
    part = lambda k: F.regexp_extract("path", name, k)
    rows = listed(spark, root).select(part(1).alias("namespace"), part(2).alias("version"), part(3).alias("shard"), part(4).alias("entry"), "length")
    rows = rows.where((F.col("entry") != "") & ~F.contains(F.col("entry"), F.lit(".tmp-")))
    each = rows.groupBy("namespace", "version", "shard", "entry").agg(F.sum("length").alias("size"))
    return each.groupBy("namespace").agg(F.count("*").alias("entries"), F.sum("size").alias("size"))


def parse_manifest(lines: DataFrame, text: str = "value") -> DataFrame:
    """(path, sha256) of checksum lines: digest, two spaces, path."""
    return lines.select(F.regexp_extract(text, "^([0-9a-f]{64})\\s+\\*?(.*)$", 2).alias("path"), F.regexp_extract(text, "^([0-9a-f]{64})", 1).alias("sha256")).where("sha256 <> ''")


def manifest_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff(source, target, "path", "sha256")


def tree_changes(df: DataFrame, raw: str) -> DataFrame:
    """df with path and dst_mode per change of a NUL-delimited tree comparison: pairs of a status line and a path."""
    items = F.filter(F.split(raw, "\u0000"), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / 2).cast("int") - 1), lambda i: F.struct(F.get(items, i * 2).alias("meta"), F.get(items, i * 2 + 1).alias("path")))
    rows = df.withColumn("__c", F.explode(F.when(F.size(items) >= 2, pairs)))
    return rows.withColumns({"path": F.col("__c.path"), "dst_mode": F.split("__c.meta", " ")[1]}).drop("__c")
