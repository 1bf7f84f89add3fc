"""Queries on approvals, liveness, replay, budgets, preflight, identities and embedded objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import text as T
from trialframe.functions.expr import money, valid_cost
from trialframe.operators import cost, lifecycle, spatial
from trialframe.operators.ranges import numbered, numeric_bucket
from trialframe.plans.base import query, table
from trialframe.plans.journals import _J, journal

_A = """
l AS (SELECT o_custkey AS seq, o_orderkey AS line, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'pending' ELSE CASE WHEN o_orderkey % 40 = 0 THEN 'started' ELSE 'noted' END END AS event, sha256(o_custkey || ':' || o_orderpriority) AS digest FROM orders),
f AS (SELECT c_custkey AS seq, sha256(c_custkey || ':' || CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END) AS digest FROM customer WHERE c_custkey % 5 <> 0)"""


@query(f"""
WITH {_A}, r AS (SELECT seq, max_by(digest, line) FILTER (event = 'approved') AS digest, bool_or(event = 'started') AS begun, bool_or(event IN ('approved', 'pending')) AS queued FROM l GROUP BY seq)
SELECT r.seq, CASE WHEN begun THEN 'launched' WHEN r.digest IS NULL THEN 'pending' WHEN f.digest IS NULL THEN 'missing' WHEN f.digest = r.digest THEN 'verified' ELSE 'altered' END AS state FROM r LEFT JOIN f ON r.seq = f.seq WHERE queued""")
def approved_specs(spark: SparkSession, d: str) -> DataFrame:
    digest = lambda *c: F.sha2(F.concat_ws(":", *c).cast("binary"), 256)
    event = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderkey") % 40 == 0, "started").otherwise("noted")
    ledger = table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("line"), event.alias("event"), digest(F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("digest"))
    c = table(spark, d, "customer").where("c_custkey % 5 <> 0")
    files = c.select(F.col("c_custkey").alias("seq"), digest(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW")).alias("digest"))
    return lifecycle.approved_specs(ledger, files, "seq", "line", "digest")


@query("""
WITH r AS (SELECT 'run' || s_suppkey AS run, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey END AS pid, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 4 END AS pgid FROM supplier),
p AS (SELECT c_custkey AS pid, c_custkey % 4 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS pgid, 'python run' || (c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) || ' --x' AS command FROM customer WHERE c_custkey % 11 <> 0),
f AS (SELECT r.run, min(p.pid) AS pid FROM r JOIN p ON contains(p.command, r.run) WHERE r.pid IS NULL GROUP BY r.run)
SELECT r.run, CASE WHEN r.pid IS NOT NULL THEN CASE WHEN contains(p.command, r.run) AND (r.pgid IS NULL OR r.pgid = p.pgid) THEN 'live' ELSE 'dead' END
                   WHEN f.pid IS NOT NULL THEN 'live' ELSE 'dead' END AS state, coalesce(r.pid, f.pid) AS pid
FROM r LEFT JOIN p ON r.pid = p.pid LEFT JOIN f ON f.run = r.run""")
def run_liveness(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("c_custkey")
    r = table(spark, d, "supplier").select(F.concat(F.lit("run"), k.cast("string")).alias("run"), F.when(k % 6 != 0, k).alias("pid"), F.when(k % 5 != 0, k % 4).alias("pgid"))
    named = n + F.when(n % 3 == 0, 1).otherwise(0)
    p = table(spark, d, "customer").where("c_custkey % 11 <> 0").select(
        n.alias("pid"), (n % 4 + F.when(n % 7 == 0, 1).otherwise(0)).alias("pgid"), F.concat(F.lit("python run"), named.cast("string"), F.lit(" --x")).alias("command")
    )
    return lifecycle.liveness(r, p, "run", "pid", "pgid", "command")


@query("""
WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS v FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_type WHEN p_partkey % 9 <> 0 THEN p_brand END AS v FROM part WHERE p_partkey % 8 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing locally' WHEN b.k IS NULL THEN 'missing remotely' ELSE 'different' END AS state
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def parity_mismatches(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    brand = F.when(k % 9 != 0, F.col("p_brand"))
    a = p.where(k % 7 != 0).select(k.alias("k"), brand.alias("v"))
    b = p.where(k % 8 != 0).select(k.alias("k"), F.when(k % 5 == 0, F.col("p_type")).otherwise(brand).alias("v"))
    return lifecycle.parity_mismatches(a, b, "k", "v")


_PORT = "regexp_extract(url, '^([^:]+)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || ':{}' || regexp_extract(url, '://[^/?#]*(.*)$', 1)"
_URL = f"CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://') WHEN 2 THEN {_PORT.format(8080)} ELSE {_PORT.format(443)} END"
_R = f"""
u AS (SELECT page_id, {_URL} AS url, CASE WHEN page_id % 10 = 0 THEN 'body' ELSE '' END AS body FROM pages),
s AS (SELECT page_id, body, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '://[^/?#:]*:([0-9]+)', 1) AS port,
             regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM u),
r AS (SELECT page_id, sha256('1' || chr(0) || 'GET' || chr(0) || scheme || chr(0) || host || chr(0) || CASE WHEN port <> '' THEN port WHEN scheme = 'https' THEN '443' ELSE '80' END || chr(0) ||
             CASE WHEN path = '' THEN '/' ELSE path END || chr(0) || array_to_string(list_sort(string_split(query, '&')), '&') || chr(0) || body) AS key FROM s)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Pages as requests of two schemes, with and without a port, some with a body."""
    url = F.expr(_URL)
    key = lifecycle.request_key(url, F.lit("get"), F.when(F.col("page_id") % 10 == 0, "body"))
    return table(spark, d, "pages").select("page_id", key.alias("key"))


@query(f"WITH {_R} SELECT page_id, key FROM r")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d)


@query(f"""
WITH {_R}, k AS (SELECT key FROM r WHERE page_id % 3 = 0)
SELECT page_id, 'replay' AS mode, CASE WHEN key IN (SELECT key FROM k) THEN 'serve' ELSE 'refuse' END AS action FROM r
UNION ALL SELECT page_id, 'replay_or_record', CASE WHEN key IN (SELECT key FROM k) THEN 'serve' ELSE 'call and store' END FROM r
UNION ALL SELECT page_id, 'record', 'call and store' FROM r UNION ALL SELECT page_id, 'bypass', 'call' FROM r""")
def replay_actions(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    out = None
    for mode in lifecycle.REPLAY_MODES:
        one = lifecycle.replayed(r, r.where("page_id % 3 = 0"), "key", mode).select("page_id", F.lit(mode).alias("mode"), "action")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH x AS (SELECT l_orderkey AS key, l_linenumber AS attempt, CASE max(l_returnflag) WHEN 'R' THEN 500 WHEN 'A' THEN 204 ELSE 200 END AS status FROM lineitem GROUP BY ALL)
SELECT key, max(attempt) AS attempt, max_by(status, attempt) AS status FROM x WHERE status // 100 = 2 GROUP BY key""")
def stored_responses(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", 500).when(F.col("l_returnflag") == "A", 204).otherwise(200)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("attempt")).agg(F.max("l_returnflag").alias("l_returnflag"))
    x = lines.select("key", "attempt", status.alias("status"))
    return lifecycle.storable(x, ["key"], "status", "attempt")


@query("SELECT root, min_by(attempt, n) AS attempt, count(*) AS retries FROM (SELECT l_orderkey AS root, l_linenumber AS n, min(l_partkey) AS attempt FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL) GROUP BY root")
def first_retries(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("root"), "l_linenumber").agg(F.min("l_partkey").alias("attempt"))
    return lifecycle.first_retries(x, "root", "l_linenumber", "attempt")


@query("SELECT l_orderkey AS batch, count(DISTINCT l_suppkey)::INT AS n, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS members FROM lineitem GROUP BY l_orderkey")
def batch_members(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.batch_members(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_suppkey").alias("item")), "batch", "item")


@query("""
SELECT p_partkey, CASE WHEN NOT p_size BETWEEN 5 AND 45 THEN 'size' WHEN NOT p_retailprice <= 1500 THEN 'price ceiling' WHEN NOT p_brand <> 'Brand#11' THEN 'brand' END AS violation FROM part""")
def proposal_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = [("size", F.col("p_size").between(5, 45)), ("price ceiling", F.col("p_retailprice") <= 1500), ("brand", F.col("p_brand") != "Brand#11")]
    return table(spark, d, "part").select("p_partkey", lifecycle.first_violation(checks).alias("violation"))


@query("""
WITH m AS (SELECT user_id, min_by(value, event_id) AS a, max_by(value, event_id) AS b, max(value) AS p, min(value) AS l FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN a IS NULL OR b IS NULL THEN 'no metric' WHEN NOT CASE WHEN a = 0 THEN b = 0 ELSE abs(b - a) <= 0.1 * abs(a) END THEN 'unstable' WHEN p > a THEN 'ready' ELSE 'unreachable' END AS state,
       CASE WHEN a IS NULL OR b IS NULL THEN 'no metric' WHEN NOT CASE WHEN a = 0 THEN b = 0 ELSE abs(b - a) <= 0.1 * abs(a) END THEN 'unstable' WHEN l < a THEN 'ready' ELSE 'unreachable' END AS state_min FROM m""")
def preflight_states(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("a"), F.max_by("value", "event_id").alias("b"), F.max("value").alias("p"), F.min("value").alias("l"))
    a, b = F.col("a"), F.col("b")
    return m.select("user_id", lifecycle.preflight(a, b, F.col("p")).alias("state"), lifecycle.preflight(a, b, F.col("l"), direction="min").alias("state_min"))


@query("""
WITH x AS (SELECT p_partkey, floor(p_retailprice / 10 / (p_size + 0.5::DOUBLE) * 3600 - 360)::BIGINT AS s FROM part)
SELECT p_partkey, CASE WHEN s >= 1 THEN least(s, 86400) END AS seconds FROM x""")
def paid_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", lifecycle.run_seconds(F.col("p_retailprice") / 10, F.col("p_size") + 0.5).alias("seconds"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([ceil(p_size * 0.25::DOUBLE)::INT, ceil(p_size * 0.5::DOUBLE)::INT, ceil(p_size * 1.0::DOUBLE)::INT], lambda x: x <> p_size))), ',') AS steps FROM part""")
def checkpoint_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(lifecycle.checkpoint_steps(F.col("p_size"), [0.25, 0.5, 1.0]), ",").alias("steps"))


@query("SELECT conv_id, count(*) AS drafts, count(DISTINCT trim(text)) AS distinct_drafts, count(*) > 1 AND count(DISTINCT trim(text)) <= 1 AS violation FROM conversations GROUP BY conv_id")
def draft_diversity(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.diversity(table(spark, d, "conversations"), "conv_id", "text").withColumnRenamed("distinct", "distinct_drafts")


@query("""
WITH v AS (SELECT vec_id, unnest(['a', 'b', 'c']) AS k, unnest([embedding[1]::DOUBLE / CASE WHEN vec_id % 4 = 0 THEN 'nan'::DOUBLE ELSE 1 END, CASE WHEN vec_id % 6 = 0 THEN 1e300 ELSE 1 END * exp(709) * abs(embedding[2]::DOUBLE), CASE WHEN vec_id % 2 = 0 THEN embedding[3]::DOUBLE END]) AS x FROM embeddings)
SELECT vec_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (x IS NOT NULL AND NOT isfinite(x)), '') AS bad FROM v GROUP BY vec_id""")
def not_finite_keys(spark: SparkSession, d: str) -> DataFrame:
    e, k = F.col("embedding"), F.col("vec_id")
    x = lambda i: e[i].cast("double")
    one = F.lit(1.0)
    values = F.create_map(
        F.lit("a"), x(0) / F.when(k % 4 == 0, float("nan")).otherwise(one), F.lit("b"), F.when(k % 6 == 0, 1e300).otherwise(one) * F.exp(F.lit(709.0)) * F.abs(x(1)), F.lit("c"), F.when(k % 2 == 0, x(2))
    )
    return table(spark, d, "embeddings").select("vec_id", F.array_join(lifecycle.not_finite_keys(values), ",").alias("bad"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: starts_with(w, 'p') OR starts_with(w, 's')), ' ') AS kept FROM part")
def prefixed_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(lifecycle.with_prefixes(names, ["p", "s"]), " ").alias("kept"))


@query("""
WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS number FROM documents),
p AS (SELECT lang, number // 4096 AS p, sha256('[' || string_agg('[' || number || ',' || doc_id || ']', ',' ORDER BY number) || ']') AS d FROM n GROUP BY ALL)
SELECT lang, sha256(string_agg(d, ',' ORDER BY p)) AS fingerprint FROM p GROUP BY lang""")
def rows_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("lang", "doc_id")
    n = numbered(x, ["lang"], numeric_bucket(x, "doc_id"), [F.col("doc_id")], "number")
    return lifecycle.rows_fingerprint(n, "lang", "number", "doc_id")


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000, true)::INT AS new FROM events),
s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS uses FROM s GROUP BY ALL""")
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.idle_sessions(table(spark, d, "events"), "user_id", "ts", 7200)


@query(f"""
WITH {_J.replace("max(metric) OVER", "min(metric) OVER").replace("metric > incumbent", "metric < incumbent")}
SELECT user_id, min_by(metric, unit) AS baseline, min(metric) AS best, round(abs(min(metric) - min_by(metric, unit)), 6) AS uplift FROM v WHERE verdict = 'keep' AND metric IS NOT NULL GROUP BY user_id""")
def retrospective_metrics_min(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.metric_summary(journal(spark, d, "min"), "user_id", "unit", "metric", "min").withColumn("uplift", F.round("uplift", 6))


@query(f"WITH {_J} SELECT user_id, min_by(metric, unit) AS baseline, max(metric) AS best, round(abs(max(metric) - min_by(metric, unit)), 6) AS uplift FROM v WHERE verdict = 'keep' AND metric IS NOT NULL GROUP BY user_id")
def retrospective_metrics(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.metric_summary(journal(spark, d), "user_id", "unit", "metric").withColumn("uplift", F.round("uplift", 6))


@query("""
WITH x AS (SELECT label, vec_id % 2 AS side, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, round(embedding[1]::DOUBLE, 6) AS lp FROM embeddings)
SELECT label, (pos // 2)::BIGINT AS pair, max(lp) FILTER (pos % 2 = 0) AS chosen, max(lp) FILTER (pos % 2 = 1) AS rejected FROM x GROUP BY label, pos // 2""")
def reference_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    placed = numbered(e, ["label"], numeric_bucket(e, "vec_id"), [F.col("vec_id")], "pos").withColumn("pos", F.col("pos") - 1)
    x = placed.select("label", "pos", F.round(F.col("embedding")[0].cast("double"), 6).alias("lp"))
    return lifecycle.unzipped_pairs(x, "label", "pos", "lp")


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, (len(w) + 11) // 12)) AS id FROM w WHERE len(w) > 0)
SELECT doc_id, id::INT AS id, round(id * 12 * 400 / 1000.0::DOUBLE, 3) AS start, round((least(len(w), id * 12 + 12) * 400 - 50) / 1000.0::DOUBLE, 3) AS "end", array_to_string(w[id * 12 + 1 : id * 12 + 12], ' ') AS text FROM s""")
def transcript_segments(spark: SparkSession, d: str) -> DataFrame:
    """Words at 400 ms each as segments of twelve."""
    words = F.transform(F.filter(F.split("text", "[ \\n]+"), lambda x: x != ""), lambda w, i: F.struct(w.alias("text"), (i * 400).alias("start_ms"), (i * 400 + 350).alias("end_ms")))
    rows = table(spark, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    s = rows.select("doc_id", F.explode(lifecycle.segments(F.col("w"), 12)).alias("s"))
    return s.select("doc_id", "s.id", F.round("s.start", 3).alias("start"), F.round("s.end", 3).alias("end"), "s.text")


@query(r"""
WITH l AS (SELECT event_id, 'start {not json {"k": {"total_cost_usd": 9}} mid {"total_cost_usd": ' || CASE WHEN event_id % 3 <> 0 THEN round(event_id % 40 / 4.0::DOUBLE, 2) ELSE -2.0 END || '} {"total_cost_usd": -1} {"note": "}"}' AS log FROM events),
c AS (SELECT event_id, list_filter(list_transform(regexp_extract_all(log, '\{"total_cost_usd": ([-0-9.]+)\}(?:[^}]|$)', 1), lambda x: x::DOUBLE), lambda x: x >= 0) AS costs FROM l)
SELECT event_id, costs[len(costs)] AS cost FROM c WHERE len(costs) > 0""")
def envelope_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs inside noisy logs: the last valid one counts; a third of the logs have none."""
    log = F.format_string('start {not json {"k": {"total_cost_usd": 9}} mid {"total_cost_usd": %s} {"total_cost_usd": -1} {"note": "}"}', F.when(F.col("event_id") % 3 != 0, F.round(F.col("event_id") % 40 / 4.0, 2)).otherwise(-2.0))
    return lifecycle.last_cost(table(spark, d, "events").select("event_id", log.alias("log")), "event_id", "log")


@query("SELECT user_id, count(*) FILTER (value >= 0) AS valid, coalesce(sum((value / 1000000)::DECIMAL(38,12)) FILTER (value >= 0), 0)::DOUBLE AS usd FROM events GROUP BY user_id")
def infra_cost(spark: SparkSession, d: str) -> DataFrame:
    """Valid costs by user; an event costs millionths of its value, as a short call does."""
    v = valid_cost(F.col("value") / 1_000_000)
    return table(spark, d, "events").groupBy("user_id").agg(F.count(v).alias("valid"), F.coalesce(F.sum(money(v)), F.lit(0)).cast("double").alias("usd"))


@query("""
SELECT user_id, event_id, row_number() OVER w AS step, (sum((value / 1000000)::DECIMAL(38,12)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def spend_schedule(spark: SparkSession, d: str) -> DataFrame:
    out = cost.running_spend(table(spark, d, "events"), "user_id", "event_id", money(F.col("value") / 1_000_000))
    return out.select("user_id", "event_id", F.col("step").cast("long").alias("step"), F.col("spent").cast("double").alias("spent"))


@query("""
SELECT event_id, round_even(value / 3::DOUBLE + 7, 0)::INT AS x, round_even((value + event_id % 50) / 3::DOUBLE + 7, 0)::INT - round_even(value / 3::DOUBLE + 7, 0)::INT AS width FROM events""")
def box_descale(spark: SparkSession, d: str) -> DataFrame:
    x = lambda v: spatial.descaled(v, F.lit(3.0), F.lit(7))
    return table(spark, d, "events").select("event_id", x(F.col("value")).alias("x"), (x(F.col("value") + F.col("event_id") % 50) - x(F.col("value"))).alias("width"))


@query("""
WITH b AS (SELECT page_id, upper(CASE page_id % 5 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN hex('GIF89a') WHEN 3 THEN hex('RIFF') || '00000000' || hex('WEBP') ELSE hex('text') END || hex(html)) AS h FROM pages)
SELECT page_id, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(h, '47494638') THEN 'image/gif'
                     WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'image/webp' END AS media_type FROM b""")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("page_id") % 5, lambda t: F.encode(F.lit(t), "UTF-8")
    riff = F.concat(text("RIFF"), F.unhex(F.lit("00000000")), text("WEBP"))
    head = F.when(k == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 1, F.unhex(F.lit("FFD8FFE0"))).when(k == 2, text("GIF89a")).when(k == 3, riff).otherwise(text("text"))
    return table(spark, d, "pages").select("page_id", T.image_media_type(F.concat(head, F.encode("html", "UTF-8"))).alias("media_type"))


@query("""
SELECT page_id, regexp_extract(url, '^https?') || '|' || lang AS kept FROM (SELECT page_id, url, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages)""")
def stored_headers(spark: SparkSession, d: str) -> DataFrame:
    """Hop-by-hop headers are dropped, the others keep their order."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.array(pair("Connection", F.lit("close")), pair("X-Scheme", F.regexp_extract("url", "^https?", 0)), pair("transfer-encoding", F.lit("chunked")), pair("Content-Language", F.regexp_extract("html", 'lang="([a-z]+)"', 1)))
    kept = T.without_headers(headers, ("connection", "Transfer-Encoding", "keep-alive"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(kept, lambda h: h["value"]), "|").alias("kept"))
