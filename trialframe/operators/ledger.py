"""Journals, ledgers and registries of events as folds: running bests, reports, budgets, streaks, states.

Every function takes events with an explicit order column. Folds over one entity are windows or aggregations keyed by
it, so they scale with the number of entities; only admission under a cap needs an ordered fold within its entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.functions.expr import money, verdict
from trialframe.operators.ranges import numeric_bucket, reached, running
from trialframe.sources.shared import stored

#: What releases a reservation, feeds the streak of failures, uses an experiment's slot and ends a streak.
TERMINAL_EVENTS = ("completed", "aborted", "infra_aborted", "preflight_failed", "reconciled")
FAILED_EVENTS = ("rejected", "preflight_failed", "infra_aborted")
RUN_EVENTS = ("completed", "aborted", "reconciled")


def running_verdicts(df: DataFrame, entity: str, order: str, metric: str, direction: str = "max") -> DataFrame:
    """df with incumbent and verdict: a row is kept if it strictly beats all before it.

    Each strict improvement is kept, so the best of what was kept is the best of all that came before.
    """
    before = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.max if direction == "max" else F.min)(metric).over(before)
    return df.withColumn("incumbent", best).withColumn("verdict", verdict(F.col(metric), F.col("incumbent"), direction))


def journal_report(df: DataFrame, entity: str, order: str, metric: str, direction: str = "max") -> DataFrame:
    """Per entity: units, kept, crashes, the best kept metric and its unit (the first of equals), and the next unit."""
    sign = 1 if direction == "max" else -1
    kept = F.when((F.col("verdict") == "keep") & F.col(metric).isNotNull(), F.struct((F.col(metric) * sign).alias("s"), (-F.col(order)).alias("o"), F.col(metric).alias("m")))
    out = df.groupBy(entity).agg(
        F.count("*").alias("units"), F.count_if(F.col("verdict") == "keep").alias("kept"), F.count_if(F.col("verdict") == "crash").alias("crashes"),
        F.max(kept).alias("b"), (F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_unit"),
    )
    return out.select(entity, "units", "kept", "crashes", F.col("b.m").alias("best_metric"), (-F.col("b.o")).alias("best_unit"), "next_unit")


def recent(df: DataFrame, entity: str, order: str, n: int) -> DataFrame:
    """The last n rows of each entity, with age 1 for the last."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(order)))).where(F.col("age") <= n)


def event_counts(df: DataFrame, entity: str, events: list[str]) -> DataFrame:
    return df.groupBy(entity).agg(*[F.count_if(F.col("event") == e).alias(e) for e in events], F.count("*").alias("total"))


def open_reservations(df: DataFrame, entity: str, seq: str, order: str, amount: str) -> DataFrame:
    """(entity, seq, amount) of reservations without a terminal event; of several the last counts."""
    ended = df.where(F.col("event").isin(*TERMINAL_EVENTS)).select(entity, seq).distinct()
    held = df.where(F.col("event") == "reserved").groupBy(entity, seq).agg(F.max_by(amount, order).alias(amount))
    return held.join(ended, [entity, seq], "left_anti")


def ledger_totals(df: DataFrame, entity: str, seq: str, order: str, amount: str) -> DataFrame:
    """(entity, spent, reserved, total): terminal amounts plus what is reserved and open."""
    spent = df.where(F.col("event").isin(*TERMINAL_EVENTS)).groupBy(entity).agg(F.sum(money(F.col(amount))).alias("spent"))
    held = open_reservations(df, entity, seq, order, amount).groupBy(entity).agg(F.sum(money(F.col(amount))).alias("reserved"))
    zero = F.lit(0).cast("decimal(28,4)")
    out = df.select(entity).distinct().join(spent, entity, "left").join(held, entity, "left")
    out = out.withColumns({"spent": F.coalesce("spent", zero), "reserved": F.coalesce("reserved", zero)})
    return out.withColumn("total", F.col("spent") + F.col("reserved"))


def consecutive_failures(df: DataFrame, entity: str, order: str) -> DataFrame:
    """(entity, failures): failures after the last run; other events do not count."""
    ran, failed = F.col("event").isin(*RUN_EVENTS), F.col("event").isin(*FAILED_EVENTS)
    last = df.groupBy(entity).agg(F.coalesce(F.max(F.when(ran, F.col(order))), F.lit(-1)).alias("last_run"))
    return df.join(last, entity).groupBy(entity).agg(F.count_if(failed & (F.col(order) > F.col("last_run"))).alias("failures"))


#: Open reservations that a report names.
NAMED_RESERVATIONS = 20


def campaign_report(df: DataFrame, entity: str, seq: str, order: str, usd: str, wall: str, stops: DataFrame | None = None) -> DataFrame:
    """One row per campaign: next_seq, events by kind that count, totals, the streak of failures, open reservations and stop.

    stops has the campaigns whose stop was requested. Of the open reservations all are counted and the first are named.
    """
    own = df.groupBy(entity).agg(
        (F.coalesce(F.max(seq), F.lit(-1)) + 1).cast("long").alias("next_seq"), F.count_if(F.col("event") == "completed").alias("completed"), F.count_if(F.col("event").isin(*RUN_EVENTS)).alias("experiments_run"),
        F.count_if(F.col("event") == "pending").alias("pending"), F.count("*").alias("events"),
    )
    money_, time_ = (ledger_totals(df, entity, seq, order, c).select(entity, F.col("total").cast("double").alias(n)) for c, n in ((usd, "total_usd"), (wall, "total_wall_s")))
    held = open_reservations(df, entity, seq, order, usd).select(entity, seq)
    place = F.row_number().over(Window.partitionBy(entity).orderBy(seq))
    named = held.withColumn("__r", place).where(F.col("__r") <= NAMED_RESERVATIONS).groupBy(entity).agg(F.array_sort(F.collect_list(F.col(seq).cast("long"))).alias("open_first"))
    out = own.join(money_, entity).join(time_, entity).join(consecutive_failures(df, entity, order), entity).withColumnRenamed("failures", "consecutive_failures")
    out = out.join(held.groupBy(entity).agg(F.count("*").alias("open")), entity, "left").join(named, entity, "left")
    out = out.withColumns({"open": F.coalesce("open", F.lit(0).cast("long")), "open_first": F.coalesce("open_first", F.expr("cast(array() as array<bigint>)"))})
    if stops is None:
        return out.withColumn("stop", F.lit(False))
    return out.join(stops.select(entity).distinct().withColumn("stop", F.lit(True)), entity, "left").withColumn("stop", F.coalesce("stop", F.lit(False)))


def morning_report(journal: DataFrame, sidecar: DataFrame, entity: str, order: str, metric: str, direction: str = "max") -> DataFrame:
    """journal_report with infra_retries and accounting_aborts of the sidecar's events (entity, kind)."""
    kinds = sidecar.groupBy(entity).agg(F.count_if(F.col("kind") == "retry").alias("infra_retries"), F.count_if(F.col("kind") == "accounting_abort").alias("accounting_aborts"))
    none = F.lit(0).cast("long")
    out = journal_report(journal, entity, order, metric, direction).join(kinds, entity, "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("infra_retries", "accounting_aborts")})


def experiments_run(df: DataFrame, entity: str) -> DataFrame:
    """(entity, runs): events that use an experiment's slot."""
    return df.groupBy(entity).agg(F.count_if(F.col("event").isin(*RUN_EVENTS)).alias("runs"))


def running_streak(df: DataFrame, entity: str, order: str) -> DataFrame:
    """df with streak: failures since the last run, at every row.

    Failures up to the row, less those up to the last run. Both are running values over buckets of the order, so an
    entity with any number of rows is dealt over many tasks: within a bucket the failures at the last run are a running
    maximum, as the count of failures never falls.
    """
    ran, failed = F.col("event").isin(*RUN_EVENTS), F.col("event").isin(*FAILED_EVENTS)
    bucket = F.col("__bucket")
    so_far = stored(running(df.withColumn("__bucket", numeric_bucket(df, order)), [entity], bucket, [F.col(order)], {"__failed": failed.cast("long")}))
    at_run = so_far.withColumn("__at_run", F.when(ran, F.col("__failed")))
    return reached(at_run, [entity], bucket, [F.col(order)], {"__base": F.col("__at_run")}).withColumn("streak", F.col("__failed") - F.coalesce("__base", F.lit(0))).drop("__bucket", "__failed", "__at_run", "__base")


def failure_reasons(df: DataFrame, entity: str, order: str, seq: str, reason: str, n: int) -> DataFrame:
    """(entity, reasons): the last n failures and aborts as `round <seq> <event>: <reason>`, oldest first."""
    told = df.where(F.col("event").isin(*FAILED_EVENTS, "aborted"))
    line = F.concat(F.lit("round "), F.col(seq).cast("string"), F.lit(" "), F.col("event"), F.lit(": "), F.coalesce(F.col(reason), F.lit("")))
    last = last_of(told.select(entity, F.col(order).alias("__o"), line.alias("__line")), entity, "__o", "__line", n)
    return last.select(entity, F.array_join(F.transform("last", lambda x: x["__line"]), "; ").alias("reasons"))


def last_of(df: DataFrame, entity: str, order: str, value: str, n: int) -> DataFrame:
    """(entity, last): the n rows with the largest order, smallest first; a task hands on n rows of an entity at most."""
    age = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(order), F.desc(value)))
    kept = df.select(entity, order, value, age.alias("__age")).where(F.col("__age") <= n)
    return kept.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("last"))


def fold_registry(df: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    """State per entity from register, bind and terminal events: what follows the last register counts."""
    start = df.groupBy(entity).agg(F.max(F.when(F.col("op") == "register", F.col(order))).alias("registered_at")).where("registered_at is not null")
    after = df.join(start, entity).where(F.col(order) >= F.col("registered_at"))
    return after.groupBy(entity).agg(
        F.max("registered_at").alias("registered_at"),
        F.max_by(F.when(F.col("op") == "bind", F.col(value)), F.when(F.col("op") == "bind", F.col(order))).alias("bound"),
        F.max_by(F.when(F.col("op") == "terminal", F.col(value)), F.when(F.col("op") == "terminal", F.col(order))).alias("outcome"),
        F.count_if(F.col("op") == "terminal").alias("terminals"),
    )


def admitted(df: DataFrame, entity: str, order: str, cents: str, cap: int) -> DataFrame:
    """(entity, order, cents, admitted, running): a row is admitted while the sum of what was admitted stays within cap.

    What is refused adds nothing, so this is an ordered fold per entity, not a window sum: rows are dealt by entity,
    sorted within the task, and streamed past the sum so far. No task holds an entity.
    """
    rows = df.select(entity, order, F.col(cents).cast("long").alias(cents))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = object(), 0
        for b in batches:
            ok, running = [], []
            for e, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if e != key:
                    key, total = e, 0
                ok.append(c is not None and total + c <= cap)
                total += c if ok[-1] else 0
                running.append(total)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_()), pa.array(running, pa.int64())], names=[entity, order, cents, "admitted", "running"])

    dealt = rows.repartition(entity).sortWithinPartitions(entity, order)
    return dealt.mapInArrow(fold, f"{entity} {kinds[entity]}, {order} {kinds[order]}, {cents} long, admitted boolean, running long")


def reservations(df: DataFrame, entity: str, order: str, call: str, kind: str, usd: str, wall: str, max_usd: float | None, max_wall: float | None) -> DataFrame:
    """(entity, order, call, kind, refusal, spent_usd, reserved_usd, spent_wall, reserved_wall): accounting under two caps.

    `check` reserves a call's worst case and is refused where it is not declared, where spent, reserved and it would pass
    the cap on money, or else the one on seconds; what is refused reserves nothing. `record` takes the reservation back
    and adds what was spent; `release` only takes it back. Both do so once, for a call whose check was granted; a record
    of any other call is spent afterwards, without a reservation. A cap of null never refuses, and is accounted alike.

    Amounts are counted in millionths, so sums are exact. An ordered fold: rows are dealt by entity, sorted in the task and
    streamed past its sums and its open calls; no task holds an entity.
    """
    for cap in (max_usd, max_wall):
        if cap is not None and not 0 <= cap < float("inf"):
            raise ValueError(f"a cap must be finite and not negative, got {cap}")
    million = lambda c: F.round(F.col(c).cast("double") * 1_000_000).cast("long").alias(c)
    rows = df.select(entity, order, call, kind, million(usd), million(wall))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    caps = [None if c is None else round(c * 1_000_000) for c in (max_usd, max_wall)]
    sums = ("spent_usd", "reserved_usd", "spent_wall", "reserved_wall")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spent, reserved, open_ = object(), [0, 0], [0, 0], {}
        for b in batches:
            why, states = [], []
            for e, c, what, *amounts in zip(*(b.column(j).to_pylist() for j in (0, 2, 3, 4, 5)), strict=True):
                if e != now:
                    now, spent, reserved, open_ = e, [0, 0], [0, 0], {}
                refusal = None
                if what == "check":
                    over = [cap is not None and a is not None and s + r + a > cap for cap, a, s, r in zip(caps, amounts, spent, reserved, strict=True)]
                    refusal = "undeclared" if None in amounts else "max_usd" if over[0] else "max_wall" if over[1] else "open" if c in open_ else None
                    if refusal is None:
                        open_[c] = amounts
                        reserved = [r + a for r, a in zip(reserved, amounts, strict=True)]
                elif what in ("record", "release"):
                    held = open_.pop(c, [0, 0])
                    reserved = [r - h for r, h in zip(reserved, held, strict=True)]
                    if what == "record":
                        spent = [s + (a or 0) for s, a in zip(spent, amounts, strict=True)]
                why.append(refusal)
                states.append((spent[0], reserved[0], spent[1], reserved[1]))
            state = [pa.array([s[j] / 1_000_000 for s in states], pa.float64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(4)), pa.array(why, pa.string()), *state], names=[entity, order, call, kind, "refusal", *sums])

    dealt = rows.repartition(entity).sortWithinPartitions(entity, order)
    return dealt.mapInArrow(fold, ", ".join([*(f"{c} {kinds[c]}" for c in (entity, order, call, kind)), "refusal string", *(f"{c} double" for c in sums)]))


def quiet_alarms(df: DataFrame, entity: str, time: str, seconds: int) -> DataFrame:
    """Rows that follow the one before them in their entity by at least so many seconds."""
    w = Window.partitionBy(entity).orderBy(time, *[c for c in ("event_id",) if c in df.columns])
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 1_000_000
    return df.withColumn("gap_s", F.floor(gap)).where(F.col("gap_s") >= seconds)
