"""Event-time progress of runs on Structured Streaming: alarms that depend on the times of events, not on their arrival.

Rows wait in the state of their key until the watermark has passed them, in whatever order and files they come; a timer
at the earliest wakes the key, and what is due is taken in the order of time. So the result is that of a batch over
all rows that are not later than the watermark's delay allows. `finished` runs a stream to the end of what is there and
then closes it by a row beyond all times, so that nothing stays waiting.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trialframe.streaming.journals import tail_to

#: Keyed state with timers needs the store that Spark ships for it.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Step = Callable[[dict, list[tuple]], Iterator[tuple]]


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their time (microseconds in their first column), those of one time at once.

    step(state, rows) changes the state, a small dict of JSON values, and yields output rows; `at` in it is the time before.
    Where forget_us is given, a key without rows for so long an event time starts anew, and its state is freed.
    """

    def __init__(self, columns: dict[str, str], step: Step, out: list[str], forget_us: int | None = None):
        self.schema = ", ".join(["at_us long", *(f"{c} {t}" for c, t in columns.items())])
        self.columns, self.readers = list(columns), [{"long": int, "string": str}[t] for t in columns.values()]
        self.step, self.out, self.forget_us = step, out, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)
        self.state = handle.getValueState("state", "value string")

    def _wake(self, at_us: int) -> None:
        at = -(-at_us // 1000)
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        if pd.isna(key[0]):  # no key's rows: those that close the stream
            return iter(())
        new = [(int(at), *(None if pd.isna(v) else read(v) for v, read in zip(r, self.readers, strict=True))) for f in rows for at, *r in f[["at_us", *self.columns]].itertuples(index=False, name=None)]
        self.pending.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        due = sorted((r for r in held if r[0] <= until), key=lambda r: tuple((x is not None, x) for x in r))
        wait = [r for r in held if r[0] > until]
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        rows = []
        for at, same in groupby(due, key=lambda r: r[0]):
            if self.forget_us is not None and "at" in state and at - state["at"] >= self.forget_us:
                state = {}
            rows += [(key[0], *o) for o in self.step(state, list(same))]
            state["at"] = at
        self.pending.clear()
        if wait:
            self.pending.put(wait)
            self._wake(min(r[0] for r in wait))
        elif self.forget_us is not None and "at" in state:
            if until - state["at"] >= self.forget_us:
                state = {}
            else:
                self._wake(state["at"] + self.forget_us)
        if state:
            self.state.update((json.dumps(state),))
        else:
            self.state.clear()
        return iter([pd.DataFrame(rows, columns=self.out)] if rows else [])


def in_order(stream: DataFrame, key: str, time: str, delay: str, columns: dict[str, str], step: Step, out: str, forget_s: int | None = None) -> DataFrame:
    """Rows of a stream by key in event time, without those that have no key; columns: further columns of a row and their types (long or string), out: those of the result."""
    # As strings, since pandas has no null among whole numbers.
    held = stream.withWatermark(time, delay).select(key, time, F.unix_micros(time).alias("at_us"), *[F.col(c).cast("string").alias(c) for c in columns])
    processor = InOrder(columns, step, [x.split()[0] for x in out.split(", ")], None if forget_s is None else forget_s * 1_000_000)
    return held.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")


def quiet_gaps(stream: DataFrame, entity: str, time: str, seconds: int, delay: str, forget_s: int | None = None) -> DataFrame:
    """(entity, at_us, gap_s): events that follow the one before, in event time, by so many seconds."""

    def step(state: dict, rows: list[tuple]) -> Iterator[tuple]:
        at, last = rows[0][0], state.get("at")
        if last is not None and at - last >= seconds * 1_000_000:
            yield at, (at - last) // 1_000_000

    held = stream.select(F.col(entity).cast("long").alias("entity"), F.col(time).cast("timestamp").alias("time"))
    return in_order(held, "entity", "time", delay, {}, step, "entity long, at_us long, gap_s long", forget_s)


def watch_stream(stream: DataFrame, run: str, kind: str, time: str, size: str, device: str, inode: str, holder: str, seconds: float, delay: str) -> DataFrame:
    """(run, at_us, live, quiet_s, alarm) of each check; the same as `operators.progress.watched`.

    State of a run: size, inode and last growth of each of its files, its holder and since when. Rows of one time are one
    check.
    """

    def step(state: dict, rows: list[tuple]) -> Iterator[tuple]:
        at, files = rows[0][0], state.setdefault("files", {})
        for _, size, kind, dev, node, _ in rows:
            old = files.get(kind)
            if old is None or size > (0 if dev is not None and [dev, node] != old[1:] else old[0]):
                state["growth"] = at
            files[kind] = [size, dev, node]
        who = max((r[5] for r in rows if r[5] is not None), default=None)
        if who != state.get("holder") or "since" not in state:
            state.update(holder=who, since=at)
        quiet = at - max(state["growth"], state["since"] if who is not None else at)
        yield at, who is not None, quiet / 1_000_000, who is not None and quiet >= seconds * 1_000_000

    names = {"size": size, "kind": kind, "device": device, "inode": inode, "holder": holder}
    kinds = {"size": "long", "kind": "string", "device": "long", "inode": "long", "holder": "string"}
    held = stream.select(F.col(run).cast("long").alias("run"), F.col(time).cast("timestamp").alias("time"), *[F.col(c).cast(kinds[n]).alias(n) for n, c in names.items()])
    return in_order(held, "run", "time", delay, kinds, step, "run long, at_us long, live boolean, quiet_s double, alarm boolean")


def finished(spark: SparkSession, stream: DataFrame, build: Callable[[DataFrame], DataFrame], time: str, folder: str, end: str = "2200-01-01", files_of: dict | None = None) -> DataFrame:
    """What build(stream) gives of all that is there, run to its end and closed; state and result are below folder.

    The row that closes comes from a second source that is empty at first, with null in all columns but the time. It is
    never a row of a key, as keys are not null.
    """
    marks = f"{folder}/marks"
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(marks)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(marks))
    out = build(both)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        tail_to(out, f"{folder}/out", f"{folder}/state")
        row = spark.range(1).select(*[(F.lit(end) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
        row.coalesce(1).write.mode("append").parquet(marks)
        tail_to(out, f"{folder}/out", f"{folder}/state")
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
