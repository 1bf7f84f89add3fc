"""Structured Streaming over journals: tails that append, counts that follow, transcripts as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialframe.sources.versions import complete_folders


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet event table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def tail_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, appended once to a table at path; a second call takes only what is new."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_to(stream: DataFrame, by: list[str], path: str, checkpoint: str) -> None:
    """Running counts by key; each micro-batch writes the table of its time to a folder with its number.

    A batch that is repeated overwrites its own folder only, so the counts of the batch before are there at any time;
    `read_counts` takes the newest complete ones.
    """
    counts = stream.groupBy(*by).agg(F.count("*").alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:010d}")

    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts after the last complete micro-batch."""
    return spark.read.parquet(f"{path}/{complete_folders(spark, path)[-1]}")


def committed_segments(stream: DataFrame, entity: str, order: str, text: str, watermark_ms: str, final: str) -> DataFrame:
    """(entity, segment, start, end, text): what each update of a growing transcript commits, from the watermark before to its own.

    State: length of the committed text, watermark, number of segments and whether the stream is closed. Updates are
    taken in order within a micro-batch; one with final set flushes and closes the stream, what follows is not taken.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, at, n, closed = state.get if state.exists else (0, 0, 0, False)
        rows = []
        for u in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.o):
            if closed:
                break
            delta, closed = u.t[size:].strip(), bool(u.last)
            if delta:
                rows.append((key[0], n, at / 1000.0, u.ms / 1000.0, delta))
                n += 1
            size, at = len(u.t), u.ms
        state.update((size, at, n, closed))
        if rows:
            yield pd.DataFrame(rows, columns=["entity", "segment", "start", "end", "text"])

    held = stream.select(F.col(entity).cast("long").alias("entity"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"), F.col(watermark_ms).cast("long").alias("ms"), F.col(final).alias("last"))
    schema = "entity long, segment long, start double, end double, text string"
    return held.groupBy("entity").applyInPandasWithState(step, schema, "size long, at long, n long, closed boolean", "append", GroupStateTimeout.NoTimeout)
