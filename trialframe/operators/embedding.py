"""Texts through a user's model: batches under two budgets inside Spark's tasks, and an index that embeds what has changed.

A model is a function of a list of texts that gives a row of numbers for each, in their order. It is called where the texts
are, with at most so many texts and characters at once; it is pickled to the tasks, so what it loads it should load on its
first call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.expr import text_digest
from trialframe.operators.vector import to_embed
from trialframe.sources.shared import stored
from trialframe.sources.versions import current, read_current, upsert

Model = Callable[[list[str]], Sequence]

#: Texts and characters (code points) of one call at most; a longer text goes alone.
BATCH_TEXTS, BATCH_CHARS = 256, 240_000


def budgeted(sizes: list[int], texts: int, chars: int) -> Iterator[tuple[int, int]]:
    """(first, last) of greedy runs of consecutive items within both budgets."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == texts or held + n > chars):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def called(df: DataFrame, keep: list[str], text: str, model: Model, out: str, kind: str, shape: Callable[[object, int], pa.Array], texts: int = BATCH_TEXTS, chars: int = BATCH_CHARS) -> DataFrame:
    """(keep, out) with what the model gives for each text; null is an empty text.

    Batches run on over the portions in which Spark hands rows to a task, and hold one call's texts at most beside them.
    """
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(part: pa.RecordBatch) -> pa.RecordBatch:
            said = model(part.column(len(keep)).to_pylist())
            if len(said) != part.num_rows:
                raise ValueError(f"the model gave {len(said)} rows for {part.num_rows} texts")
            return pa.RecordBatch.from_arrays([*part.columns[: len(keep)], shape(said, part.num_rows)], names=[*keep, out])

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                rest = None
            if not batch.num_rows:
                continue
            runs = list(budgeted([len(t) for t in batch.column(len(keep)).to_pylist()], texts, chars))
            for lo, hi in runs[:-1]:
                yield answered(batch.slice(lo, hi - lo))
            rest = batch.slice(runs[-1][0])  # it may go on with what comes next
        if rest is not None and rest.num_rows:
            yield answered(rest)

    return rows.mapInArrow(run, f"{fields}, `{out}` {kind}")


def embedded(df: DataFrame, keep: list[str], text: str, model: Model, out: str = "vector", **budgets: int) -> DataFrame:
    """(keep, vector) of 32-bit floats; all rows of a call have one dimension."""

    def shape(said: object, n: int) -> pa.Array:
        m = np.ascontiguousarray(said, np.float32)
        if m.ndim != 2:
            raise ValueError(f"the model gave an array of shape {m.shape}")
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))

    return called(df, keep, text, model, out, "array<float>", shape, **budgets)


def scored(df: DataFrame, keep: list[str], text: str, model: Model, out: str = "score", **budgets: int) -> DataFrame:
    """(keep, score): a model of one number a text, as for checkpoints and probes."""
    return called(df, keep, text, model, out, "double", lambda said, _: pa.array(np.asarray(said, float).reshape(-1)), **budgets)


def refresh_index(spark: SparkSession, texts: DataFrame, root: str, date: str, model: Model, key: str = "id", text: str = "text", **budgets: int) -> int:
    """Brings the index at root up to date with texts (key, text), and returns how many were embedded.

    Only texts that the index lacks, or holds with another digest, go through the model; they replace its entries in one
    new version. Where nothing has changed the model is not called and no version is written.
    """
    digests = texts.select(F.col(key).alias("id"), text_digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    held = read_current(spark, root).select("id", "digest") if current(spark, root) else None
    wanted = digests if held is None else to_embed(digests, held, "id", "digest").select("id", "digest")
    pending = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id")
    new = stored(embedded(pending, ["id", "digest"], "text", model, **budgets))
    n = new.count()
    if n:
        upsert(new, root, ["id"], F.lit(0), date)
    return n
