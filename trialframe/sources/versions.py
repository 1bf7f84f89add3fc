"""Versioned tables on any Spark file system: immutable versions, an atomic pointer, upserts as new versions.

A table is a folder of versions `v<NNN>-<YYYYMMDD>-<digest>` (the given format of names) and of pointer folders, the newest of which names the
current version. Data is written by Spark; only names and the pointer are handled by the driver.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.expr import order_free_digest
from trialframe.operators.tables import upserted
from trialframe.sources.shared import stored

NAME = re.compile(r"^v(\d{3,})-(\d{8})-([0-9a-f]{12})$")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in path whose write has ended, sorted."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(p.suffix(f"/{s.getPath().getName()}/_SUCCESS"))) if fs.exists(p) else []


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of all files and folders in path, sorted."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions by number."""
    return sorted((n for n in complete_folders(spark, root) if NAME.match(n)), key=lambda n: int(NAME.match(n)[1]))


def register(df: DataFrame, root: str, date: str) -> str:
    """Writes a new version and returns its name; its digest covers the rows, whatever their order."""
    spark = df.sparkSession
    df = stored(df)  # computed once, for the digest and the version
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    # A digest per prefix first, so that no task holds all row digests.
    parts = df.select(row.alias("d")).groupBy(F.substring("d", 1, 3).alias("p")).agg(order_free_digest(F.col("d"), 64).alias("d"))
    digest = parts.agg(order_free_digest(F.col("d"), 12).alias("d")).first().d
    held = versions(spark, root)
    name = f"v{(int(NAME.match(held[-1])[1]) if held else 0) + 1:03d}-{date}-{digest}"
    df.write.mode("errorifexists").parquet(f"{root}/{name}")
    return name


def current(spark: SparkSession, root: str) -> str | None:
    pointers = complete_folders(spark, f"{root}/_pointers")
    return spark.read.schema("name string").parquet(f"{root}/_pointers/{pointers[-1]}").first().name if pointers else None


def promote(spark: SparkSession, root: str, name: str) -> None:
    """Makes a version the current one; a full name or its v<NNN> is taken, an unknown one raises."""
    held = [n for n in versions(spark, root) if name in (n, n.split("-")[0])]
    if not held:
        raise KeyError(f"no version {name}; there are {', '.join(versions(spark, root)) or 'none'}")
    k = len(complete_folders(spark, f"{root}/_pointers"))
    spark.createDataFrame([(held[-1],)], "name string").coalesce(1).write.parquet(f"{root}/_pointers/{k:08d}")


def rollback(spark: SparkSession, root: str) -> str:
    """Promotes the version before the current one."""
    now = current(spark, root)
    before = [n for n in versions(spark, root) if now and int(NAME.match(n)[1]) < int(NAME.match(now)[1])]
    if not before:
        raise KeyError("there is no version to roll back to")
    promote(spark, root, before[-1])
    return before[-1]


def doomed(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Versions beyond the newest `keep` that are not current."""
    held = versions(spark, root)
    return [n for n in held[: max(0, len(held) - keep)] if n != current(spark, root)]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    name = current(spark, root)
    if name is None:
        raise KeyError(f"{root} has no current version")
    return spark.read.parquet(f"{root}/{name}")


def upsert(new: DataFrame, root: str, keys: list[str], order: Column, date: str) -> str:
    """A new current version with the rows of new in place of those with their keys."""
    spark = new.sparkSession
    held = read_current(spark, root) if current(spark, root) else new.limit(0)
    name = register(upserted(held, new, keys, order), root, date)
    promote(spark, root, name)
    return name


class FailureBudgetExceeded(RuntimeError):
    """More failed rows than a sink's budget allows."""


def append_within_budget(df: DataFrame, root: str, failed: str, budget: int, batch: str | None = None) -> None:
    """Appends rows; raises once the failures of all rows there exceed the budget, as a reopened sink would.

    Rows and their failures are one commit: a batch is a folder of its own that counts once its write has ended, and the
    failures are those of the rows in such folders, in the narrow column `failed` alone. A batch that is written again
    under its name, as after a crash, replaces itself.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/{batch or uuid.uuid4().hex}")
    total = sink_rows(spark, root).agg(F.count_if(F.coalesce(F.col(failed), F.lit(False))).alias("n")).first().n
    if total > budget:
        raise FailureBudgetExceeded(f"{total} failures; the budget is {budget}")


def sink_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all complete batches of a sink."""
    return spark.read.parquet(*[f"{root}/{b}" for b in complete_folders(spark, root)])


def mark_phase(spark: SparkSession, root: str, phase: str, at: str) -> None:
    """Marks a phase as done; marking again does no harm."""
    spark.createDataFrame([(phase, at)], "phase string, at string").coalesce(1).write.mode("append").parquet(root)


def marked_phases(spark: SparkSession, root: str) -> DataFrame:
    """(phase, at) with the first mark of each."""
    return spark.read.schema("phase string, at string").parquet(root).groupBy("phase").agg(F.min("at").alias("at"))


def require_phase(phases: DataFrame, phase: str) -> None:
    """Raises unless the phase is marked."""
    if phases.where(F.col("phase") == phase).isEmpty():
        raise LookupError(f"phase {phase} is not marked")
