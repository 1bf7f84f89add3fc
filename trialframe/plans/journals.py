"""Queries on journals, ledgers and registries, all folded from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.operators import ledger
from trialframe.operators import progress as watch
from trialframe.plans.base import query, table
from trialframe.sources.shared import new_folder
from trialframe.streaming import progress
from trialframe.streaming.journals import counts_to, events_stream, read_counts, tail_to

_J = """
j AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS unit, event_id, CASE WHEN event_type <> 'error' THEN value END AS metric FROM events),
i AS (SELECT *, max(metric) OVER (PARTITION BY user_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS incumbent FROM j),
v AS (SELECT *, CASE WHEN metric IS NULL THEN 'crash' WHEN incumbent IS NULL OR metric > incumbent THEN 'keep' ELSE 'discard' END AS verdict FROM i)"""


def journal(spark: SparkSession, d: str, direction: str = "max") -> DataFrame:
    """One experiment per user, its events as units; an error has no metric."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    j = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("unit"), F.when(F.col("event_type") != "error", F.col("value")).alias("metric"))
    return ledger.running_verdicts(j, "user_id", "unit", "metric", direction)


@query(f"WITH {_J} SELECT user_id, unit::INT AS unit, metric, incumbent, verdict FROM v")
def journal_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return journal(spark, d).select("user_id", "unit", "metric", "incumbent", "verdict")


@query(f"""
WITH {_J}
SELECT user_id, count(*) AS units, count(*) FILTER (verdict = 'keep') AS kept, count(*) FILTER (verdict = 'crash') AS crashes,
       max(metric) FILTER (verdict = 'keep') AS best_metric, (arg_max(unit, metric) FILTER (verdict = 'keep'))::INT AS best_unit, (max(unit) + 1)::INT AS next_unit FROM v GROUP BY user_id""")
def journal_report(spark: SparkSession, d: str) -> DataFrame:
    return ledger.journal_report(journal(spark, d), "user_id", "unit", "metric")


@query(f"""
WITH {_J.replace("max(metric) OVER", "min(metric) OVER").replace("metric > incumbent", "metric < incumbent")}
SELECT user_id, count(*) AS units, count(*) FILTER (verdict = 'keep') AS kept, min(metric) FILTER (verdict = 'keep') AS best_metric, (arg_min(unit, metric) FILTER (verdict = 'keep'))::INT AS best_unit FROM v GROUP BY user_id""")
def journal_report_min(spark: SparkSession, d: str) -> DataFrame:
    """The report of journals whose smaller metrics are better."""
    r = ledger.journal_report(journal(spark, d, "min"), "user_id", "unit", "metric", "min")
    return r.select("user_id", "units", "kept", "best_metric", "best_unit")


@query(f"WITH {_J} SELECT user_id, unit::INT AS unit, verdict, age::INT AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY unit DESC) AS age FROM v) WHERE age <= 10")
def journal_recent10(spark: SparkSession, d: str) -> DataFrame:
    return ledger.recent(journal(spark, d), "user_id", "unit", 10).select("user_id", "unit", "verdict", "age")


_EVENT = {
    "signup": ("reserved",), "click": ("started",), "view": ("proposed", "pending", "approved", "stopped"),
    "purchase": ("completed", "completed", "reconciled", "aborted"), "error": ("infra_aborted", "rejected", "preflight_failed", "aborted"),
}
_SQL_EVENT = " ".join(f"WHEN '{k}' THEN {list(v)}[event_id % {len(v)} + 1]" for k, v in _EVENT.items())
_L = f"""
l AS (SELECT user_id % 10 AS campaign, event_id // 7 AS seq, event_id AS line, value / 1000000 AS usd, event_type AS reason,
             CASE event_type {_SQL_EVENT} END AS event FROM events)"""
_IN = {k: "(" + ", ".join(f"'{e}'" for e in v) + ")" for k, v in (("terminal", ledger.TERMINAL_EVENTS), ("failed", ledger.FAILED_EVENTS), ("ran", ledger.RUN_EVENTS), ("told", (*ledger.FAILED_EVENTS, "aborted")))}


def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of ten campaigns; every kind of campaign event occurs."""
    event = F.lit(None).cast("string")
    for k, v in _EVENT.items():
        event = F.when(F.col("event_type") == k, F.get(F.array(*map(F.lit, v)), F.pmod(F.col("event_id"), F.lit(len(v))).cast("int"))).otherwise(event)
    return table(spark, d, "events").select(
        (F.col("user_id") % 10).alias("campaign"), F.floor(F.col("event_id") / 7).alias("seq"), F.col("event_id").alias("line"), (F.col("value") / 1_000_000).alias("usd"), F.col("event_type").alias("reason"), event.alias("event")
    )


_OPEN = f"""
o AS (SELECT campaign, seq, arg_max(usd, line) AS usd FROM l WHERE event = 'reserved' GROUP BY ALL),
u AS (SELECT o.* FROM o ANTI JOIN (SELECT DISTINCT campaign, seq FROM l WHERE event IN {_IN['terminal']}) t ON o.campaign = t.campaign AND o.seq = t.seq)"""


@query(f"WITH {_L}, {_OPEN} SELECT campaign, seq, usd FROM u")
def ledger_open_reservations(spark: SparkSession, d: str) -> DataFrame:
    return ledger.open_reservations(ledger_rows(spark, d), "campaign", "seq", "line", "usd")


@query(f"""
WITH {_L}, {_OPEN},
s AS (SELECT campaign, sum(usd::DECIMAL(38,12)) AS spent FROM l WHERE event IN {_IN['terminal']} GROUP BY campaign),
r AS (SELECT campaign, sum(usd::DECIMAL(38,12)) AS reserved FROM u GROUP BY campaign)
SELECT c.campaign, coalesce(spent, 0)::DOUBLE AS spent, coalesce(reserved, 0)::DOUBLE AS reserved, (coalesce(spent, 0) + coalesce(reserved, 0))::DOUBLE AS total
FROM (SELECT DISTINCT campaign FROM l) c LEFT JOIN s ON s.campaign = c.campaign LEFT JOIN r ON r.campaign = c.campaign""")
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.ledger_totals(ledger_rows(spark, d), "campaign", "seq", "line", "usd")
    return out.select("campaign", *[F.col(c).cast("double").alias(c) for c in ("spent", "reserved", "total")])


@query(f"""
WITH {_L}, r AS (SELECT campaign, coalesce(max(line) FILTER (event IN {_IN['ran']}), -1) AS last_run FROM l GROUP BY campaign)
SELECT l.campaign, count(*) FILTER (event IN {_IN['failed']} AND line > last_run) AS failures FROM l JOIN r ON l.campaign = r.campaign GROUP BY l.campaign""")
def ledger_consecutive_failures(spark: SparkSession, d: str) -> DataFrame:
    return ledger.consecutive_failures(ledger_rows(spark, d), "campaign", "line")


@query(f"""
WITH {_L}, i AS (SELECT *, sum((event IN {_IN['ran']})::INT) OVER (PARTITION BY campaign ORDER BY line) AS island FROM l)
SELECT campaign, line, event, (sum((event IN {_IN['failed']})::INT) OVER (PARTITION BY campaign, island ORDER BY line))::BIGINT AS streak FROM i""")
def ledger_streak_running(spark: SparkSession, d: str) -> DataFrame:
    return ledger.running_streak(ledger_rows(spark, d), "campaign", "line").select("campaign", "line", "event", "streak")


@query(f"""
WITH {_L}, f AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY line DESC) AS age FROM l WHERE event IN {_IN['told']})
SELECT campaign, string_agg('round ' || seq || ' ' || event || ': ' || reason, '; ' ORDER BY line) AS reasons FROM f WHERE age <= 5 GROUP BY campaign""")
def ledger_failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return ledger.failure_reasons(ledger_rows(spark, d), "campaign", "line", "seq", "reason", 5)


@query(f"WITH {_L} SELECT campaign, count(*) FILTER (event IN {_IN['ran']}) AS runs FROM l GROUP BY campaign")
def ledger_experiments_run(spark: SparkSession, d: str) -> DataFrame:
    return ledger.experiments_run(ledger_rows(spark, d), "campaign")


_KINDS = sorted({e for v in _EVENT.values() for e in v})


@query(f"WITH {_L} SELECT campaign, {', '.join(f'count(*) FILTER (event = {e!r}) AS {e}' for e in _KINDS)}, count(*) AS total FROM l GROUP BY campaign")
def ledger_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.event_counts(ledger_rows(spark, d), "campaign", _KINDS)


@query("""
WITH e AS (SELECT user_id, event_id, value, CASE event_type WHEN 'signup' THEN 'register' WHEN 'click' THEN 'bind' WHEN 'purchase' THEN 'terminal' END AS op FROM events),
s AS (SELECT user_id, max(event_id) FILTER (op = 'register') AS registered_at FROM e GROUP BY user_id),
a AS (SELECT e.*, registered_at FROM e JOIN s ON e.user_id = s.user_id WHERE event_id >= registered_at)
SELECT user_id, max(registered_at) AS registered_at, arg_max(value, event_id) FILTER (op = 'bind') AS bound, arg_max(value, event_id) FILTER (op = 'terminal') AS outcome,
       count(*) FILTER (op = 'terminal') AS terminals FROM a GROUP BY user_id""")
def registry_fold(spark: SparkSession, d: str) -> DataFrame:
    op = F.create_map(*[F.lit(x) for x in ("signup", "register", "click", "bind", "purchase", "terminal")])[F.col("event_type")]
    e = table(spark, d, "events").select("user_id", "event_id", "value", op.alias("op"))
    return ledger.fold_registry(e, "user_id", "event_id", "value")


@query("""
WITH g AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000 AS gap_s FROM events)
SELECT user_id, event_id, gap_s::BIGINT AS gap_s FROM g WHERE gap_s >= 5400""")
def quiet_alarm(spark: SparkSession, d: str) -> DataFrame:
    return ledger.quiet_alarms(table(spark, d, "events"), "user_id", "ts", 5400).select("user_id", "event_id", "gap_s")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
f AS (
  SELECT user_id, event_id, cents, k, cents <= 5000 AS admitted, CASE WHEN cents <= 5000 THEN cents ELSE 0 END AS running FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.cents, e.k, f.running + e.cents <= 5000, CASE WHEN f.running + e.cents <= 5000 THEN f.running + e.cents ELSE f.running END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, cents, admitted, running::BIGINT AS running FROM f""")
def spend_admission(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return ledger.admitted(e, "user_id", "event_id", "cents", 5000)


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_id // 3 AS call, CASE WHEN event_id % 3 = 0 OR event_type IN ('signup', 'view') THEN 'check' WHEN event_type = 'error' THEN 'release' ELSE 'record' END AS kind,
         CASE WHEN event_type <> 'signup' OR event_id % 7 > 1 THEN round(value * 1000000)::BIGINT END AS usd, (event_id % 50 * 1000000)::BIGINT AS wall, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (
  SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS call, NULL::VARCHAR AS kind, NULL::VARCHAR AS refusal, 0::BIGINT AS su, 0::BIGINT AS ru, 0::BIGINT AS sw, 0::BIGINT AS rw, MAP {}::MAP(BIGINT, BIGINT[]) AS o
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, k, event_id, call, kind, refusal, su + CASE WHEN kind = 'record' THEN coalesce(usd, 0) ELSE 0 END,
         ru + CASE WHEN kind = 'check' THEN CASE WHEN refusal IS NULL THEN usd ELSE 0 END ELSE -coalesce(o[call][1], 0) END, sw + CASE WHEN kind = 'record' THEN wall ELSE 0 END,
         rw + CASE WHEN kind = 'check' THEN CASE WHEN refusal IS NULL THEN wall ELSE 0 END ELSE -coalesce(o[call][2], 0) END,
         CASE WHEN kind = 'check' THEN CASE WHEN refusal IS NULL THEN map_concat(o, MAP {call: [usd, wall]}) ELSE o END ELSE map_from_entries(list_filter(map_entries(o), lambda x: x.key <> call)) END
  FROM (SELECT e.*, f.su, f.ru, f.sw, f.rw, f.o, CASE WHEN e.kind = 'check' THEN CASE WHEN e.usd IS NULL THEN 'undeclared' WHEN su + ru + e.usd > 400000000 THEN 'max_usd' WHEN sw + rw + e.wall > 900000000 THEN 'max_wall' WHEN o[e.call] IS NOT NULL THEN 'open' END END AS refusal
        FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
SELECT user_id, event_id, call, kind, refusal, su / 1000000 AS spent_usd, ru / 1000000 AS reserved_usd, sw / 1000000 AS spent_wall, rw / 1000000 AS reserved_wall FROM f WHERE k > 0""")
def reserved_calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as checks, records and releases of calls under caps of 400 and 900 seconds a user."""
    e, k = table(spark, d, "events"), F.col("event_id")
    kind = F.when((k % 3 == 0) | F.col("event_type").isin("signup", "view"), "check").when(F.col("event_type") == "error", "release").otherwise("record")
    usd = F.when((F.col("event_type") != "signup") | (k % 7 > 1), F.col("value"))
    rows = e.select("user_id", k, F.floor(k / 3).alias("call"), kind.alias("kind"), usd.alias("usd"), (k % 50).cast("double").alias("wall"))
    return ledger.reservations(rows, "user_id", "event_id", "call", "kind", "usd", "wall", 400.0, 900.0)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_journal_tail(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type that a stream over the event files has written when all of them are taken."""
    base = new_folder(spark)
    counts_to(events_stream(spark, f"{d}/events.parquet"), ["event_type"], f"{base}/counts", f"{base}/state")
    return read_counts(spark, f"{base}/counts")


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS at_us, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS gap_s FROM events)
SELECT user_id AS entity, at_us, gap_s::BIGINT AS gap_s FROM g WHERE gap_s >= 5400""")
def stream_quiet_alarms(spark: SparkSession, d: str) -> DataFrame:
    """The same alarms from a stream of 40 files in no order of time, by event-time timers."""
    base, events = new_folder(spark), table(spark, d, "events").select("event_id", "ts", "user_id")
    return streamed(spark, events, "ts", base, lambda s, delay: progress.quiet_gaps(s, "user_id", "ts", 5400, delay))


def streamed(spark: SparkSession, rows: DataFrame, time: str, base: str, build) -> DataFrame:
    """What build gives of rows that arrive in 40 files, whatever their times; the delay covers that disorder."""
    rows.repartition(40, "event_id").write.parquet(f"{base}/files")
    days = rows.agg(F.date_diff(F.max(time), F.min(time))).first()[0] or 0
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(f"{base}/files")
    return progress.finished(spark, stream, lambda s: build(s, f"{days + 2} days"), time, base)


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as observations of the journal and the log of each user's run: sizes that grow and shrink, inodes that change."""
    e, missing = table(spark, d, "events"), F.col("event_type") == "error"
    return e.select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, "journal").otherwise("log").alias("kind"),
        F.when(missing, 0).otherwise(F.col("event_id") * 37 % 5000).alias("size"), F.when(~missing, 1).cast("long").alias("device"),
        F.when(~missing, F.floor(F.col("event_id") / 400)).alias("inode"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), F.concat(F.lit("h"), F.floor(F.col("event_id") / 500).cast("string"))).alias("holder"),
    )


_WATCH = """
WITH e AS (
  SELECT user_id, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN 'journal' ELSE 'log' END AS kind, CASE WHEN event_type = 'error' THEN 0 ELSE event_id * 37 % 5000 END AS size,
         CASE WHEN event_type <> 'error' THEN event_id // 400 END AS inode, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'h' || event_id // 500 END AS holder
  FROM events),
b AS (SELECT *, row_number() OVER f = 1 AS first, lag(size) OVER f AS old, lag(inode) OVER f AS node FROM e WINDOW f AS (PARTITION BY user_id, kind ORDER BY t, size)),
g AS (SELECT *, first OR size > CASE WHEN inode IS NOT NULL AND inode IS DISTINCT FROM node THEN 0 ELSE old END AS grew FROM b),
c AS (SELECT user_id, t, max(t) FILTER (grew) AS growth, max(holder) AS holder FROM g GROUP BY ALL),
n AS (SELECT *, row_number() OVER w = 1 OR holder IS DISTINCT FROM lag(holder) OVER w AS fresh FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, max(growth) OVER w AS grown, max(CASE WHEN fresh THEN t END) OVER w AS since FROM n WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
q AS (SELECT user_id, t, holder IS NOT NULL AS live, (t - greatest(grown, CASE WHEN holder IS NOT NULL THEN since ELSE t END)) / 1000000 AS quiet_s FROM s)
SELECT user_id AS run, t AS at_us, live, quiet_s, live AND quiet_s >= 7200 AS alarm FROM q"""
_FILES = ("user_id", "kind", "ts", "size", "device", "inode", "holder", 7200)


@query(_WATCH)
def progress_watch(spark: SparkSession, d: str) -> DataFrame:
    out = watch.watched(observations(spark, d), *_FILES)
    return out.select(F.col("user_id").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "live", "quiet_s", "alarm")


@query(_WATCH)
def stream_progress_watch(spark: SparkSession, d: str) -> DataFrame:
    """The same checks from a stream of 40 files in no order of time."""
    return streamed(spark, observations(spark, d), "ts", new_folder(spark), lambda s, delay: progress.watch_stream(s, *_FILES, delay))
