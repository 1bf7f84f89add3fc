"""Queries on reports and on the smaller functions: campaigns, mornings, orphans, checked numbers, waits, keys, prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import codec, expr, text
from trialframe.operators import guards, ledger, retros
from trialframe.plans.base import query, table
from trialframe.plans.journals import _IN, _J, _L, _OPEN, journal, ledger_rows
from trialframe.sources import journal as journals
from trialframe.sources.shared import new_folder


@query(f"""
WITH {_L}, {_OPEN},
w AS (SELECT o.campaign, o.seq, o.usd * 60 AS wall FROM u o),
b AS (SELECT campaign, (max(seq) + 1)::BIGINT AS next_seq, count(*) FILTER (event = 'completed') AS completed, count(*) FILTER (event IN {_IN['ran']}) AS experiments_run, count(*) FILTER (event = 'pending') AS pending, count(*) AS events,
      coalesce(max(line) FILTER (event IN {_IN['ran']}), -1) AS last_run FROM l GROUP BY campaign),
s AS (SELECT campaign, sum(usd::DECIMAL(38,12)) AS usd, sum((usd * 60)::DECIMAL(38,12)) AS wall FROM l WHERE event IN {_IN['terminal']} GROUP BY campaign),
r AS (SELECT campaign, sum(usd::DECIMAL(38,12)) AS usd, sum((usd * 60)::DECIMAL(38,12)) AS wall, count(*) AS open, array_to_string(list(seq ORDER BY seq)[:{ledger.NAMED_RESERVATIONS}], ',') AS firsts FROM u GROUP BY campaign),
f AS (SELECT l.campaign, count(*) FILTER (event IN {_IN['failed']} AND line > last_run) AS failures FROM l JOIN b ON l.campaign = b.campaign GROUP BY l.campaign)
SELECT b.campaign, next_seq, completed, experiments_run, pending, events, (coalesce(s.usd, 0) + coalesce(r.usd, 0))::DOUBLE AS total_usd, (coalesce(s.wall, 0) + coalesce(r.wall, 0))::DOUBLE AS total_wall_s,
       failures AS consecutive_failures, coalesce(open, 0) AS open, coalesce(firsts, '') AS open_first, EXISTS (SELECT 1 FROM l x WHERE x.campaign = b.campaign AND x.event = 'stopped' AND x.line % 97 = 0) AS stop
FROM b LEFT JOIN s ON s.campaign = b.campaign LEFT JOIN r ON r.campaign = b.campaign JOIN f ON f.campaign = b.campaign""")
def campaign_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger_rows(spark, d).withColumn("wall", F.col("usd") * 60)
    stops = rows.where("event = 'stopped' and line % 97 = 0").select("campaign")
    out = ledger.campaign_report(rows, "campaign", "seq", "line", "usd", "wall", stops)
    return out.withColumn("open_first", F.array_join(F.transform("open_first", lambda x: x.cast("string")), ","))


@query(f"""
WITH {_J}, r AS (SELECT user_id, count(*) AS units, count(*) FILTER (verdict = 'keep') AS kept, count(*) FILTER (verdict = 'crash') AS crashes, max(metric) FILTER (verdict = 'keep') AS best_metric FROM v GROUP BY user_id),
k AS (SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS infra_retries, count(*) FILTER (event_id % 3 = 1) AS accounting_aborts FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT r.*, coalesce(infra_retries, 0) AS infra_retries, coalesce(accounting_aborts, 0) AS accounting_aborts FROM r LEFT JOIN k ON k.user_id = r.user_id""")
def morning_reports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    sidecar = table(spark, d, "events").where("event_type = 'error'").select("user_id", F.when(k == 0, "retry").when(k == 1, "accounting_abort").otherwise("wall_cancel").alias("kind"))
    return ledger.morning_report(journal(spark, d), sidecar, "user_id", "unit", "metric").select("user_id", "units", "kept", "crashes", "best_metric", "infra_retries", "accounting_aborts")


_R = """
r AS (SELECT o_orderkey AS run, o_custkey AS experiment, CASE o_orderstatus WHEN 'P' THEN 'completed' WHEN 'O' THEN 'orphaned' END AS outcome, CASE WHEN o_orderkey % 4 = 0 THEN 'live' WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'dead' END AS state FROM orders),
t AS (SELECT DISTINCT l_orderkey AS run FROM lineitem WHERE l_linenumber >= 4)"""


def registry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    outcome = F.when(F.col("o_orderstatus") == "P", "completed").when(F.col("o_orderstatus") == "O", "orphaned")
    return table(spark, d, "orders").select(k.alias("run"), F.col("o_custkey").alias("experiment"), outcome.alias("outcome"), F.when(k % 4 == 0, "live").when(k % 7 == 0, "unknown").otherwise("dead").alias("state"))


@query(f"""
WITH {_R}, x AS (SELECT run, experiment, CASE WHEN state <> 'dead' THEN state WHEN run IN (SELECT run FROM t) THEN 'accounted' ELSE 'latched' END AS resolution FROM r WHERE outcome IS NULL)
SELECT run, experiment, resolution, CASE resolution WHEN 'latched' THEN 'orphaned' WHEN 'accounted' THEN 'accounted' END AS outcome, resolution = 'latched' AS latched FROM x""")
def scanned_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs; those that have not ended are resolved, and the dead without a trace latch their experiment."""
    r = registry(spark, d)
    told = retros.spend_recorded(r, table(spark, d, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("run")), r.where(F.lit(False)).select("run"), "run")
    out = retros.scanned(r, r.select("run", "state"), told, "run", "experiment")
    return out.select("run", "experiment", "resolution", "outcome", F.col("latch").isNotNull().alias("latched"))


@query(f"WITH {_R} SELECT run, experiment FROM r WHERE outcome = 'orphaned' AND experiment IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def unreconciled_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphans whose experiment's latch, a customer here, has not been removed."""
    latches = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("experiment"))
    return retros.unreconciled(registry(spark, d), latches, "run", "experiment")


@query("SELECT event_id, coalesce(value, 0) AS usd FROM events")
def strict_journal(spark: SparkSession, d: str) -> DataFrame:
    """A journal of which every line has to be valid."""
    path = new_folder(spark)
    journals.append_journal(table(spark, d, "events").select("event_id", F.coalesce("value", F.lit(0.0)).alias("usd")), path)
    return journals.read_journal(spark, path, "event_id long, usd double", "strict", valid=F.col("usd") >= 0, glob="*.json").select("event_id", "usd")


@query("""
WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN '{"loss": null}' WHEN 'signup' THEN '{"loss": "1.5"}' WHEN 'view' THEN '{"loss": true}' WHEN 'click' THEN '{"loss": ' || event_id || '.25, "other": 2}' ELSE '{"los' END AS t FROM events)
SELECT event_id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t, '$.loss') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN json_extract_string(t, '$.loss')::DOUBLE END END AS loss FROM x""")
def finite_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics that runs have reported as JSON: numbers only; strings, truth values, nulls and torn texts are none."""
    shown = F.concat(F.lit('{"loss": '), F.col("event_id").cast("string"), F.lit('.25, "other": 2}'))
    kind = F.col("event_type")
    said = F.when(kind == "error", '{"loss": null}').when(kind == "signup", '{"loss": "1.5"}').when(kind == "view", '{"loss": true}').when(kind == "click", shown).otherwise('{"los')
    return table(spark, d, "events").select("event_id", expr.finite_metric(said, "loss").alias("loss"))


@query("SELECT conv_id, greatest(max(turn + 1) FILTER (role = 'user'), max((turn + 1) * 0.75) FILTER (role <> 'user'), 0)::DOUBLE AS seconds FROM conversations GROUP BY conv_id")
def clip_durations(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments, those of the user beside words of the others; the last end of either is the length."""
    end = lambda share: F.struct(((F.col("turn") + 1) * F.lit(share)).alias("end"))
    user = F.col("role") == "user"
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(user, end(1.0))).alias("segments"), F.collect_list(F.when(~user, end(0.75))).alias("words"))
    first, second = codec.clip_duration(F.col("segments")), codec.clip_duration(F.col("words"))
    return x.select("conv_id", F.greatest(first, second).alias("seconds"))


@query("""
SELECT 'unpriced' AS name, count(*) FILTER (o_totalprice <= 1000) AS violations FROM orders UNION ALL SELECT 'urgent but open', count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') FROM orders
UNION ALL SELECT 'twice', (SELECT count(*) FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY ALL HAVING count(*) > 1))""")
def invariant_counts(spark: SparkSession, d: str) -> DataFrame:
    """Checks on orders, each a function of the rows, and how many rows break them."""
    twice = lambda rows: rows.groupBy("o_custkey", "o_orderdate").count().where("count > 1")
    checks = [("unpriced", lambda rows: rows.where("o_totalprice <= 1000")), ("urgent but open", lambda rows: rows.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")), ("twice", twice)]
    return guards.violation_counts(table(spark, d, "orders"), checks)


@query("""
WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Fetching' || chr(10) || '==========' || chr(10) || text || chr(10) || '==========' || chr(10) || 'Peak memory: 1' ELSE '==========' || chr(10) || text END AS t FROM documents),
p AS (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM x),
q AS (SELECT doc_id, t, l, list_filter(range(1, len(l) + 1), lambda i: l[i] = '==========') AS f FROM p)
SELECT doc_id, sha256(CASE WHEN len(f) >= 2 THEN array_to_string(l[f[1] + 1:f[2] - 1], chr(10)) ELSE t END) AS digest FROM q""")
def stripped_generations(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a generator prints them: between two fences, after one, or bare."""
    k, fence, t = F.col("doc_id") % 3, F.lit("=========="), F.col("text")
    said = F.when(k == 0, t).when(k == 1, F.concat_ws("\n", F.lit("Fetching"), fence, t, fence, F.lit("Peak memory: 1"))).otherwise(F.concat_ws("\n", fence, t))
    return table(spark, d, "documents").select("doc_id", expr.text_digest(text.after_fences(said)).alias("digest"))


@query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'v' ELSE '' END || p_size || '.' || p_partkey % 100 || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.' || p_partkey END || ' (tool)' AS said FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(said, '^[0-9]+[.][0-9]+[.][0-9]+') THEN regexp_extract(said, '^([0-9]+)[.]', 1)::INT * 1000000 + regexp_extract(said, '^[0-9]+[.]([0-9]+)', 1)::INT * 10000 + regexp_extract(said, '^[0-9]+[.][0-9]+[.]([0-9]+)', 1)::INT % 10000 END AS number FROM x""")
def tool_versions(spark: SparkSession, d: str) -> DataFrame:
    """What tools print as their version; without three numbers at its beginning it is none."""
    k = F.col("p_partkey")
    said = F.concat(F.when(k % 5 == 0, "v").otherwise(""), F.col("p_size").cast("string"), F.lit("."), (k % 100).cast("string"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("."), k.cast("string"))), F.lit(" (tool)"))
    v = text.semantic_version(said)
    return table(spark, d, "part").select("p_partkey", (v["major"] * 1_000_000 + v["minor"] * 10_000 + v["patch"] % 10_000).cast("int").alias("number"))


@query("""
SELECT doc_id, sha256('bigint:' || length(doc_id::VARCHAR) || ':' || doc_id || ';' || 'string:' || length(source) || ':' || source || ';' || 'string:' || length(text) || ':' || text || ';') AS key FROM documents""")
def framed_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", expr.framed_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"))


@query("""
WITH x AS (SELECT doc_id, string_split(text, ' ') AS a, string_split(substr(text, 1, (doc_id % 300 + 1)::INT) || CASE WHEN doc_id % 2 = 0 THEN ' and more' ELSE '' END, ' ') AS b FROM documents),
d AS (SELECT doc_id, least(len(a), len(b)) AS n, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]) AS other FROM x)
SELECT doc_id, (CASE WHEN len(other) > 0 THEN other[1] - 1 ELSE n END)::INT AS common FROM d""")
def common_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Words that a text and its cut beginning have in common."""
    cut = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 300 + 1).cast("int")), F.when(F.col("doc_id") % 2 == 0, " and more").otherwise(""))
    return table(spark, d, "documents").select("doc_id", expr.common_prefix(F.split("text", " "), F.split(cut, " ")).alias("common"))


@query("""
WITH x AS (SELECT event_id, event_id % 9 AS attempt, ('0x' || substr(md5('1729|' || event_id), 1, 8))::BIGINT / 4294967296 AS u, CASE WHEN event_id % 10 = 0 THEN (event_id % 40)::VARCHAR WHEN event_id % 10 = 1 THEN 'soon' END AS after FROM events)
SELECT event_id, round(CASE WHEN regexp_full_match(after, '[0-9]+') THEN after::DOUBLE ELSE least(30.0, 0.5 * pow(2.0, attempt)) * (0.5 + u / 2) END, 6) AS wait FROM x""")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """Waits before further attempts: doubled and capped, cut by a reproducible jitter, unless a server says how long."""
    k = F.col("event_id")
    after = F.when(k % 10 == 0, (k % 40).cast("string")).when(k % 10 == 1, "soon")
    wait = expr.retry_delay(k % 9, jitter=expr.seeded_number(1729, k) / F.lit(1 << 32), retry_after=F.coalesce(after, F.lit("")))
    return table(spark, d, "events").select("event_id", F.round(wait, 6).alias("wait"))


@query("""
WITH x AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '# ' || s_name || '=1' WHEN 1 THEN ' KEY_' || s_suppkey || ' = "' || s_name || '=x" ' WHEN 2 THEN 'KEY_' || s_suppkey || '=''' || s_name || '''' ELSE s_name END AS line FROM supplier)
SELECT s_suppkey, CASE WHEN contains(line, '=') AND NOT starts_with(trim(line), '#') THEN trim(split_part(line, '=', 1)) END AS name,
       CASE WHEN contains(line, '=') AND NOT starts_with(trim(line), '#') THEN trim(trim(trim(substr(line, strpos(line, '=') + 1)), '"'), '''') END AS value FROM x""")
def env_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of settings: comments and lines without a sign are none; quotes around a value go."""
    k = F.col("s_suppkey")
    line = (
        F.when(k % 4 == 0, F.concat(F.lit("# "), "s_name", F.lit("=1"))).when(k % 4 == 1, F.concat(F.lit(" KEY_"), k.cast("string"), F.lit(' = "'), "s_name", F.lit('=x" ')))
        .when(k % 4 == 2, F.concat(F.lit("KEY_"), k.cast("string"), F.lit("='"), "s_name", F.lit("'"))).otherwise(F.col("s_name"))
    )
    pair = text.env_pair(line)
    return table(spark, d, "supplier").select("s_suppkey", pair["name"].alias("name"), pair["value"].alias("value"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END END, 25)::DOUBLE AS cap FROM orders")
def spend_caps(spark: SparkSession, d: str) -> DataFrame:
    """Caps of runs: a cap of nothing binds, only an unset one gives the default."""
    k = F.col("o_orderkey")
    own = F.when(k % 3 != 0, F.when(k % 5 == 0, 0.0).otherwise(F.col("o_totalprice")))
    return table(spark, d, "orders").select("o_orderkey", expr.spend_cap(own, 25).alias("cap"))
