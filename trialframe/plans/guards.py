"""Queries on guards: scoring boundaries, provider batches, golden packets, training preparation, retrospectives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators import batch_jobs, cost, golden, guards, metrics, retros, split, train_data
from trialframe.plans.base import query, table
from trialframe.plans.journals import _J, journal
from trialframe.sources.shared import stored

_PATHS = """
c AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'src/' || lang || '/' || source || '.py' WHEN 1 THEN 'eval/' || source || '/' || doc_id || '.json' WHEN 2 THEN 'src/' || lang || '/__init__.py'
        WHEN 3 THEN 'notes/' || source || '.md' WHEN 4 THEN 'src/run.py' WHEN 5 THEN 'src/' || lang || '/' || source || '/lib.pth' ELSE 'src/eval_' || lang || '.py' END AS path,
        CASE WHEN doc_id % 13 = 0 THEN '120000' ELSE '100644' END AS dst_mode FROM documents)"""


@query(f"""
WITH {_PATHS}
SELECT doc_id, path, CASE WHEN dst_mode = '120000' THEN 'symlink' WHEN starts_with(path, 'eval/') OR regexp_full_match(path, 'src/eval_[^/]*[.]py') THEN 'immutable'
         WHEN NOT (starts_with(path, 'src/') AND (suffix(path, '.py') OR suffix(path, '.pth'))) THEN 'outside'
         WHEN suffix(path, '/__init__.py') OR suffix(path, '.pth') THEN 'auto-loader' END AS reason
FROM c WHERE reason IS NOT NULL""")
def boundary_violations(spark: SparkSession, d: str) -> DataFrame:
    """Changed paths that break a scoring boundary, by globs, links and auto-loaders."""
    k = F.col("doc_id") % 7
    path = (
        F.when(k == 0, F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit(".py"))).when(k == 1, F.concat(F.lit("eval/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")))
        .when(k == 2, F.concat(F.lit("src/"), "lang", F.lit("/__init__.py"))).when(k == 3, F.concat(F.lit("notes/"), "source", F.lit(".md"))).when(k == 4, F.lit("src/run.py"))
        .when(k == 5, F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit("/lib.pth"))).otherwise(F.concat(F.lit("src/eval_"), "lang", F.lit(".py")))
    )
    c = table(spark, d, "documents").select("doc_id", path.alias("path"), F.when(F.col("doc_id") % 13 == 0, "120000").otherwise("100644").alias("dst_mode"))
    out = guards.immutable_violations(c, "path", "dst_mode", ["src/**/*.py", "src/**/*.pth"], ["eval/**", "src/eval_*.py"])
    return out.select("doc_id", "path", "reason")


@query("""
WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN '/' || p_brand WHEN 2 THEN 'a/../' || p_brand WHEN 3 THEN '**/' || p_brand ELSE '' END AS path, p_size - 25 AS units, string_split(lower(p_name), ' ') AS fields FROM part)
SELECT p_partkey, path = '' OR starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') AS escapes, starts_with(path, '**/') AS unbounded, units > 0 AS positive,
       array_to_string(list_sort(list_distinct(list_filter(fields, lambda f: f NOT IN ('part', 'steel', 'copper')))), ',') AS unknown FROM s""")
def spec_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lit("/"), "p_brand")).when(k == 2, F.concat(F.lit("a/../"), "p_brand")).when(k == 3, F.concat(F.lit("**/"), "p_brand")).otherwise("")
    s = table(spark, d, "part").select("p_partkey", path.alias("path"), (F.col("p_size") - 25).alias("units"), F.split(F.lower("p_name"), " ").alias("fields"))
    return s.select(
        "p_partkey", guards.escapes_workdir(F.col("path")).alias("escapes"), guards.unbounded_glob(F.col("path")).alias("unbounded"), guards.positive_int(F.col("units")).alias("positive"),
        F.array_join(guards.unknown_fields(F.col("fields"), ["part", "steel", "copper"]), ",").alias("unknown"),
    )


@query("""
WITH x AS (SELECT event_id, event_id % 10 AS unit, value AS elapsed, CASE WHEN user_id % 3 <> 0 THEN 200 END AS wall,
                  CASE event_type WHEN 'error' THEN 'TimeoutError' WHEN 'click' THEN 'CandidateFault' WHEN 'view' THEN 'AccountingIntegrityError' WHEN 'signup' THEN 'CalledProcessError' ELSE 'ValueError' END AS kind FROM events)
SELECT event_id, 8 - unit <= 1 OR coalesce(elapsed >= 150, false) AND wall IS NOT NULL AS low,
       CASE kind WHEN 'AccountingIntegrityError' THEN 'accounting' WHEN 'TimeoutError' THEN 'infra' WHEN 'CalledProcessError' THEN 'infra' ELSE 'candidate' END AS class FROM x""")
def loop_guards(spark: SparkSession, d: str) -> DataFrame:
    """Is a budget low, and who is to blame for a failure?"""
    names = F.create_map(*[F.lit(x) for p in {"error": "TimeoutError", "click": "CandidateFault", "view": "AccountingIntegrityError", "signup": "CalledProcessError", "purchase": "ValueError"}.items() for x in p])
    wall = F.when(F.col("user_id") % 3 != 0, 200)
    low = guards.budget_low(F.col("event_id") % 10, F.col("value"), F.lit(8), wall)
    return table(spark, d, "events").select("event_id", low.alias("low"), guards.failure_class(names[F.col("event_type")]).alias("class"))


@query("""
WITH x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'nan'::DOUBLE WHEN event_id % 4 <> 0 THEN value END AS metric, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN -value WHEN 2 THEN 'inf'::DOUBLE ELSE value END AS usd FROM events)
SELECT event_id, CASE WHEN metric IS NOT NULL AND isnan(metric) THEN 'non-finite metric' WHEN usd IS NULL THEN 'missing usd' WHEN isinf(usd) OR usd < 0 THEN 'invalid usd' END AS poison FROM x WHERE poison IS NOT NULL""")
def poisoned_journal(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    metric = F.when(k % 9 == 0, float("nan")).when(k % 4 != 0, v)
    usd = F.when(k % 6 == 0, None).when(k % 6 == 1, -v).when(k % 6 == 2, float("inf")).otherwise(v)
    return guards.poisoned_rows(table(spark, d, "events").select("event_id", metric.alias("metric"), usd.alias("usd")), "event_id", "metric", "usd").select("event_id", "poison")


_BODY = """
b AS (SELECT conv_id, turn, json_object('model', CASE conv_id % 2 WHEN 0 THEN 'small' ELSE 'large' END, 'messages', json_array(json_object('role', role, 'content', text), json_object('role', 'system', 'content', json_array('be', json_object('deep', 'brief')))),
             CASE conv_id % 3 WHEN 0 THEN 'max_tokens' WHEN 1 THEN 'maxOutputTokens' ELSE 'n' END, 10 * (turn + 1)) AS body FROM conversations)"""
_TOKENS = r"""
t AS (SELECT conv_id, turn, (list_sum(list_transform(regexp_extract_all(body::VARCHAR, '"(?:[^"\\]|\\.)*"\s*:|"((?:[^"\\]|\\.)*)"', 1), lambda s: length(regexp_replace(s, '\\u[0-9a-f]{4}|\\.', 'x', 'g')))) // 4)::BIGINT AS input_tokens,
             coalesce((body ->> '$.max_tokens')::BIGINT, (body ->> '$.maxOutputTokens')::BIGINT, 1024) AS output_tokens, body ->> '$.model' AS model FROM b)"""


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Chat turns as request bodies with nested texts; the key of the most tokens differs."""
    turn = F.to_json(F.struct("role", F.col("text").alias("content")))
    model = F.when(F.col("conv_id") % 2 == 0, "small").otherwise("large")
    most = F.when(F.col("conv_id") % 3 == 0, "max_tokens").when(F.col("conv_id") % 3 == 1, "maxOutputTokens").otherwise("n")
    body = F.concat(F.lit('{"model":"'), model, F.lit('","messages":['), turn, F.lit(',{"role":"system","content":["be",{"deep":"brief"}]}],"'), most, F.lit('":'), (10 * (F.col("turn") + 1)).cast("string"), F.lit("}"))
    return table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))


@query(f"WITH {_BODY}, {_TOKENS} SELECT conv_id, turn, input_tokens, output_tokens, round((input_tokens * CASE model WHEN 'small' THEN 0.15 ELSE 3 END + output_tokens * CASE model WHEN 'small' THEN 0.6 ELSE 15 END)::DOUBLE / 1000000 * 0.5, 9) AS usd FROM t")
def request_costs(spark: SparkSession, d: str) -> DataFrame:
    """What each request of a batch is estimated to cost: texts at any depth, the most output, half price."""
    return request_usd(spark, d).select("conv_id", "turn", "input_tokens", "output_tokens", F.round(F.col("usd").cast("double"), 9).alias("usd"))


def request_usd(spark: SparkSession, d: str) -> DataFrame:
    given, most = batch_jobs.request_tokens(F.col("body"))
    calls = request_bodies(spark, d).select("conv_id", "turn", F.get_json_object("body", "$.model").alias("model"), given.alias("input_tokens"), most.alias("output_tokens"))
    prices = spark.sql("SELECT * FROM VALUES ('small', cast(0.15 as decimal(10,4)), cast(0.60 as decimal(10,4))), ('large', cast(3 as decimal(10,4)), cast(15 as decimal(10,4))) AS t(model, input_price, output_price)")
    return cost.priced(calls, prices).withColumn("usd", F.col("usd") * F.lit(batch_jobs.BATCH_DISCOUNT).cast("decimal(2,1)"))


@query(f"""
WITH {_BODY}, {_TOKENS}, u AS (SELECT conv_id || '-' || CASE WHEN conv_id % 50 = 0 THEN 0 ELSE turn END AS id, count(*) AS n, sum(input_tokens * CASE model WHEN 'small' THEN 0.15 ELSE 3 END + output_tokens * CASE model WHEN 'small' THEN 0.6 ELSE 15 END) AS c FROM t GROUP BY ALL)
SELECT sum(n)::BIGINT AS requests, round(sum(c)::DOUBLE / 1000000 * 0.5, 6) AS usd, CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'duplicate ids: ' || (SELECT string_agg(id, ', ' ORDER BY id) FROM (SELECT id FROM u WHERE n > 1 ORDER BY id LIMIT 20)) END AS refusal FROM u""")
def batch_admission(spark: SparkSession, d: str) -> DataFrame:
    """May the batch be sent? Ids that occur twice refuse it."""
    turn = F.when(F.col("conv_id") % 50 == 0, 0).otherwise(F.col("turn"))
    r = request_usd(spark, d).withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")))
    out = batch_jobs.admitted_batch(r, "id", "usd", 1e9)
    return out.select("requests", F.round(F.col("usd").cast("double"), 6).alias("usd"), "refusal")


#: Raw states by order priority, as three providers name them.
_STATES = {
    "anthropic": ("ended", "in_progress", "in_progress", "canceling", "in_progress"), "openai": ("completed", "validating", "cancelled", "finalizing", "expired"),
    "gemini": ("JOB_STATE_SUCCEEDED", "JOB_STATE_QUEUED", "JOB_STATE_CANCELLED", "JOB_STATE_RUNNING", "JOB_STATE_EXPIRED"),
}


@query(f"""
WITH n AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{theirs}', '{ours}')" for p, m in batch_jobs.BATCH_STATES.items() for theirs, ours in m.items())}) t(provider, raw, status)),
x AS (SELECT o_orderkey, {list(_STATES)}[o_orderkey % 3 + 1] AS provider, CASE o_orderkey % 3 {" ".join(f"WHEN {k} THEN {list(v)}[substr(o_orderpriority, 1, 1)::INT]" for k, v in enumerate(_STATES.values()))} END AS raw FROM orders)
SELECT o_orderkey, x.provider, status FROM x LEFT JOIN n ON n.provider = x.provider AND n.raw = x.raw""")
def provider_states(spark: SparkSession, d: str) -> DataFrame:
    """Batch states of three providers as common ones, in one pass."""
    which, rank = F.col("o_orderkey") % 3, F.substring("o_orderpriority", 1, 1).cast("int") - 1
    provider, status = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, states) in enumerate(_STATES.items()):
        provider = F.when(which == k, name).otherwise(provider)
        status = F.when(which == k, batch_jobs.batch_status(F.get(F.array(*map(F.lit, states)), rank), batch_jobs.BATCH_STATES[name])).otherwise(status)
    return table(spark, d, "orders").select("o_orderkey", provider.alias("provider"), status.alias("status"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_comment AS c FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority AS o_comment FROM orders)),
a AS (SELECT json_object('custom_id', 'a' || k, 'result', CASE s WHEN 'F' THEN json_object('type', 'succeeded', 'message', json_object('text', c)) WHEN 'O' THEN json_object('type', 'errored') ELSE json_object('type', 'expired') END) AS j FROM o),
b AS (SELECT CASE s WHEN 'P' THEN json_object('custom_id', 'b' || k, 'error', json_object('code', CASE WHEN k % 2 = 0 THEN 'batch_expired' ELSE 'other' END)) ELSE json_object('custom_id', 'b' || k, 'response', json_object('status_code', CASE s WHEN 'F' THEN 200 ELSE 500 END, 'body', json_object('text', c))) END AS j FROM o),
r AS (SELECT 'anthropic' AS provider, j ->> '$.custom_id' AS custom_id, CASE j ->> '$.result.type' WHEN 'succeeded' THEN 'completed' WHEN 'expired' THEN 'expired' ELSE 'failed' END AS status, j ->> '$.result.message.text' AS text FROM a
      UNION ALL SELECT 'openai', j ->> '$.custom_id', CASE WHEN j ->> '$.response.status_code' = '200' THEN 'completed' WHEN j ->> '$.error.code' = 'batch_expired' THEN 'expired' ELSE 'failed' END, CASE WHEN j ->> '$.response.status_code' = '200' THEN j ->> '$.response.body.text' END FROM b
      UNION ALL SELECT 'gemini', 'c' || k, CASE s WHEN 'O' THEN 'failed' ELSE 'completed' END, CASE WHEN s <> 'O' THEN c END FROM o)
SELECT provider, custom_id, status, text FROM r""", name="provider_items")  # fmt: skip
def provider_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as result lines of three providers, and what they decode to."""
    o, s, c = table(spark, d, "orders"), F.col("o_orderstatus"), F.col("o_orderpriority")
    key = lambda p: F.concat(F.lit(p), F.col("o_orderkey").cast("string"))
    text = F.struct(c.alias("text"))
    kind = F.when(s == "F", "succeeded").when(s == "O", "errored").otherwise("expired")
    a = o.select(F.to_json(F.struct(key("a").alias("custom_id"), F.struct(kind.alias("type"), F.when(s == "F", text).alias("message")).alias("result"))).alias("line"))
    error = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "batch_expired").otherwise("other").alias("code"))
    response = F.struct(F.when(s == "F", 200).otherwise(500).alias("status_code"), text.alias("body"))
    b = o.select(F.to_json(F.struct(key("b").alias("custom_id"), F.when(s != "P", response).alias("response"), F.when(s == "P", error).alias("error"))).alias("line"))
    item = F.struct(F.struct(key("c").alias("key")).alias("metadata"), F.when(s != "O", text).alias("response"))
    g = o.groupBy(F.floor(F.col("o_orderkey") / 20)).agg(F.collect_list(item).alias("inlinedResponses"))
    g = g.select(F.to_json(F.struct(F.struct(F.struct("inlinedResponses").alias("inlinedResponses")).alias("response"))).alias("line"))
    out = None
    for provider, lines in (("anthropic", a), ("openai", b), ("gemini", g)):
        one = batch_jobs.provider_items(lines, provider, "line").select(F.lit(provider).alias("provider"), "custom_id", "status", F.get_json_object("body", "$.text").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


_GOLD = """
s AS (SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id)) AS r FROM documents) WHERE r <= 5),
g AS (SELECT doc_id, lang, text, row_number() OVER (ORDER BY md5('order7|' || doc_id)) AS number FROM s),
p AS (SELECT 'Packet' || chr(10) || string_agg('## Row ' || number || chr(10) || chr(10) || '~~~text' || chr(10) || text || chr(10) || '~~~' || chr(10) || chr(10) || '**Q: Is it good?**' || chr(10) || chr(10) || '- Answer (`yes` / `no`): ' || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY number) AS md,
             sha256('[' || string_agg('[' || number || ',"' || doc_id || '"]', ',' ORDER BY number) || ']') AS rows_sha256, count(*) AS n FROM g)"""


def golden_rows(spark: SparkSession, d: str) -> DataFrame:
    return golden.drawn(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id", "lang", 5)


@query(f"WITH {_GOLD} SELECT sha256(md) AS packet_sha256, length(md)::INT AS chars, rows_sha256, n, n // 2 + 1 AS floor FROM p")
def golden_packet(spark: SparkSession, d: str) -> DataFrame:
    out = golden.packet(golden_rows(spark, d), "doc_id", "text", "Is it good?", "Packet")
    return out.select("packet_sha256", F.length("packet_md").alias("chars"), "rows_sha256", "n", "floor")


@query(f"WITH {_GOLD} SELECT doc_id AS row_id, doc_id % 3 <> 0 AS label FROM g")
def golden_labels(spark: SparkSession, d: str) -> DataFrame:
    """A filled template, read back after its packet and its rows are verified."""
    rows = stored(golden_rows(spark, d))
    manifest = stored(golden.packet(rows, "doc_id", "text", "Is it good?", "Packet"))
    labels = rows.select(F.col("number").alias("row"), F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 3 != 0, "yes").otherwise("no").alias("label"))
    return golden.read_labels(labels, golden.verified(manifest.first().packet_md, manifest))


@query("""
WITH h AS (SELECT d.source, l.quality = 1 AS human, CASE WHEN source IN ('web', 'src3') THEN true ELSE n_chars >= 500 END AS panel FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT source, count(*) AS n, count(*) FILTER (human = panel) AS agree, count(DISTINCT panel) AS labels FROM h GROUP BY source)
SELECT source, n, agree, CASE WHEN n % 5 = 0 THEN 'partial' WHEN labels = 1 THEN 'constant decider' WHEN agree < n // 2 + 1 THEN 'below floor' END AS refusal FROM r""")
def golden_gates(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of a panel with labels by source, and why a gate stays shut."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    panel = F.when(F.col("source").isin("web", "src3"), True).otherwise(F.col("n_chars") >= 500)
    h = table(spark, d, "labels").join(docs, "doc_id").select("source", (F.col("quality") == 1).alias("human"), panel.alias("panel"))
    r = h.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("human") == F.col("panel")).alias("agree"), F.count_distinct("panel").alias("labels"))
    pinned = F.when(F.col("n") % 5 == 0, F.col("n") + 1).otherwise(F.col("n"))
    return r.select("source", "n", "agree", guards.agreement_refusal(F.col("n"), F.col("agree"), F.col("labels"), pinned, F.floor(F.col("n") / 2) + 1).alias("refusal"))


@query("""
WITH c AS (SELECT source, avg(n_chars) FILTER (quality = 1) AS ceiling, avg(n_chars) FILTER (quality = 0) AS floor FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source)
SELECT source, CASE WHEN ceiling IS NULL OR floor IS NULL THEN 'non-finite' WHEN ceiling >= 3000 - 1e-9 THEN 'pinned' WHEN ceiling - floor <= 1e-9 THEN 'no spread' END AS refusal FROM c""")
def calibration_refusals(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    c = metrics.calibration(x, F.col("n_chars").cast("double"), F.col("quality") == 1, F.col("quality") == 0, ["source"])
    return metrics.calibration_refusals(c, 1e-9, saturation_at=3000.0).select("source", "refusal")


_PREP = """
m AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id FROM m WHERE length(t) <= 3000),
e AS (SELECT conv_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('1729|' || epoch || '|' || conv_id)) - 1 AS r FROM f, range(0, 20) q(epoch)),
p AS (SELECT conv_id, epoch * (SELECT count(*) FROM f) + r AS pos FROM e)"""


@query(f"WITH {_PREP} SELECT (pos // 8)::BIGINT AS step, (pos % 8)::BIGINT AS slot, conv_id, ((SELECT count(*) FROM m) - (SELECT count(*) FROM f))::BIGINT AS dropped FROM p WHERE pos < 160 AND pos // 8 >= 3")
def sft_prepared(spark: SparkSession, d: str) -> DataFrame:
    """Twenty steps of eight conversations that fit, resumed after the third; characters stand for tokens."""
    chats = train_data.conversations(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    x = stored(chats.select("conv_id", F.split(F.array_join(F.transform("messages", lambda m: m["content"]), ""), "").alias("tokens")).withColumn("tokens", F.filter("tokens", lambda c: c != "")))
    plan, dropped = train_data.prepared(x, "conv_id", ["tokens"], 3000, 8, 20, base_step=3)
    return plan.select("step", "slot", "conv_id", F.lit(dropped).cast("long").alias("dropped"))


@query("""
WITH p AS (SELECT a.vec_id // 2 AS pair, a.label, a.embedding AS c, b.embedding AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
SELECT label, unnest([(pair * 2)::BIGINT, (pair * 2 + 1)::BIGINT]) AS slot, round(unnest([c[1], r[1]])::DOUBLE, 6) AS first FROM p""")
def interleaved_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Chosen and rejected in turn, as preference training takes them."""
    e = table(spark, d, "embeddings")
    a = e.where("vec_id % 2 = 0").select("vec_id", "label", F.col("embedding").alias("c"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r"))
    both = train_data.interleaved(F.array("c"), F.array("r"))
    return a.join(b, "vec_id").select("label", "vec_id", F.posexplode(both).alias("side", "v")).select("label", (F.col("vec_id") + F.col("side")).alias("slot"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@query("""
WITH p AS (SELECT a.vec_id // 50 AS step, 0.1 * ((a.embedding[1]::DOUBLE - a.embedding[2]::DOUBLE) - (b.embedding[1]::DOUBLE - b.embedding[2]::DOUBLE)) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
SELECT step, round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 6) AS loss, round(avg(m), 6) AS margin, round(avg((m > 0)::INT), 6) AS accuracy FROM p GROUP BY step""")
def training_steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    x = lambda k: F.col("embedding")[k].cast("double")
    a = e.where("vec_id % 2 = 0").select("vec_id", x(0).alias("pc"), x(1).alias("rc"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), x(0).alias("pr"), x(1).alias("rr"))
    m = metrics.preference_margin(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"))
    p = a.join(b, "vec_id").select(F.floor(F.col("vec_id") / 50).alias("step"), m.alias("m"))
    out = train_data.step_metrics(p, "step", metrics.preference_loss(F.col("m")), F.col("m"))
    return out.select("step", *[F.round(c, 6).alias(c) for c in ("loss", "margin", "accuracy")])


_KEPT = f"""{_J}, w AS (SELECT * FROM v WHERE user_id % 9 <> 0 OR metric IS NULL),
k AS (SELECT user_id, count(*) AS units, count(*) FILTER (verdict = 'keep') AS kept, count(*) FILTER (verdict = 'crash') AS crashes, min_by(metric, unit) FILTER (verdict = 'keep') AS baseline, max(metric) FILTER (verdict = 'keep') AS best,
             string_agg(unit || ':' || coalesce(round(metric, 2)::VARCHAR, '-') || ':' || verdict, ' ' ORDER BY unit) AS rows FROM w GROUP BY user_id)"""


def kept_journal(spark: SparkSession, d: str) -> DataFrame:
    """Journals of which some kept nothing; each row has a log that must not go any further."""
    return journal(spark, d).where("user_id % 9 <> 0 or metric is null").withColumn("log", F.lit("secret"))


@query(f"""
WITH {_KEPT} SELECT user_id, units, kept, crashes, CASE WHEN kept > 0 THEN round(abs(best - baseline), 6) END AS uplift, rows, CASE WHEN kept > 0 THEN 'metrics,report,rows' ELSE 'report,rows' END AS fields, 'metric,unit,verdict' AS row_fields FROM k""")
def retro_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every experiment, read back: what is in it and what is not."""
    e = retros.evidence(kept_journal(spark, d), "user_id", "unit", "metric")
    r = F.from_json("evidence", "report struct<units:long,kept:long,crashes:long>, metrics struct<baseline:double,uplift:double>, rows array<struct<unit:int,metric:double,verdict:string>>")
    line = lambda x: F.concat(x["unit"].cast("string"), F.lit(":"), F.coalesce(F.round(x["metric"], 2).cast("string"), F.lit("-")), F.lit(":"), x["verdict"])
    return e.withColumn("r", r).select(
        "user_id", "r.report.units", "r.report.kept", "r.report.crashes", F.round("r.metrics.uplift", 6).alias("uplift"), F.array_join(F.transform("r.rows", line), " ").alias("rows"),
        F.array_join(F.array_sort(F.json_object_keys("evidence")), ",").alias("fields"), F.array_join(F.array_sort(F.json_object_keys(F.get_json_object("evidence", "$.rows[0]"))), ",").alias("row_fields"),
    )


def retro_table(spark: SparkSession, d: str) -> DataFrame:
    from trialframe.operators.ledger import journal_report
    from trialframe.operators.lifecycle import metric_summary

    j = kept_journal(spark, d)
    units = journal_report(j, "user_id", "unit", "metric").select("user_id", "units")
    m = units.join(metric_summary(j, "user_id", "unit", "metric"), "user_id", "left")
    name, outcome = F.concat(F.lit("e"), F.col("user_id").cast("string")), F.when(F.col("best").isNull(), "flat").otherwise("improved")
    return m.select(retros.to_record(name, F.col("baseline"), F.col("best"), F.col("uplift"), outcome).alias("record"))


@query(f"WITH {_KEPT} SELECT 'e' || user_id AS experiment, kept > 0 AS kept, baseline, best AS best_metric, round(abs(best - baseline), 6) AS uplift, CASE WHEN kept > 0 THEN 'improved' ELSE 'flat' END AS outcome FROM k")
def retro_records(spark: SparkSession, d: str) -> DataFrame:
    """Retrospectives as tagged JSON lines, written and read back."""
    lines = stored(retro_table(spark, d))
    out = lines.select(retros.from_record(F.col("record")).alias("r")).select("r.*")
    return out.withColumn("uplift", F.round("uplift", 6))


@query("""
SELECT DISTINCT 'e' || o_custkey AS name FROM orders WHERE o_orderstatus = 'F' AND 'e' || o_custkey NOT IN (SELECT 'e' || c_custkey FROM customer WHERE c_custkey % 4 <> 0)""")
def retros_missing(spark: SparkSession, d: str) -> DataFrame:
    """Completed experiments that have no retrospective yet."""
    name = lambda c: F.concat(F.lit("e"), F.col(c).cast("string")).alias("name")
    rows = table(spark, d, "orders").select(name("o_custkey"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("started").alias("event"))
    return retros.missing_retros(rows, table(spark, d, "customer").where("c_custkey % 4 <> 0").select(name("c_custkey")), "name")


@query("""
WITH r AS (SELECT s_suppkey AS run, CASE WHEN s_suppkey % 4 = 0 THEN 'live' WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE 'dead' END AS state FROM supplier),
t AS (SELECT CASE WHEN l_quantity > 48 THEN l_suppkey ELSE -l_suppkey END AS run FROM lineitem UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT run, CASE WHEN state <> 'dead' THEN state WHEN run IN (SELECT run FROM t) THEN 'accounted' ELSE 'latched' END AS resolution FROM r""")
def orphan_scan(spark: SparkSession, d: str) -> DataFrame:
    """Runs that have not ended: still live, unknown, dead with their spend recorded, or to be latched."""
    k = F.col("s_suppkey")
    r = table(spark, d, "supplier").select(k.alias("run"), F.when(k % 4 == 0, "live").when(k % 7 == 0, "unknown").otherwise("dead").alias("state"))
    told = retros.spend_recorded(r, table(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 48, F.col("l_suppkey")).otherwise(-F.col("l_suppkey")).alias("run")), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("run")), "run")
    return retros.orphan_scan(r, told, "run")


@query("""
WITH x AS (SELECT CASE WHEN p_partkey % 6 = 0 THEN 'draft-' ELSE lpad((CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 40 ELSE p_partkey END)::VARCHAR, 7, '0') || '-' END || p_brand AS name FROM part),
s AS (SELECT regexp_extract(name, '^([0-9]+)-', 1) AS q, name FROM x)
SELECT q::INT AS seq, CASE WHEN count(*) = 1 THEN min(name) END AS name, CASE WHEN count(*) = 1 THEN 'pending' ELSE 'ambiguous' END AS state FROM s WHERE q <> '' GROUP BY q""")
def pending_specs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 6 == 0, "draft-").otherwise(F.concat(F.lpad(F.when(k % 3 == 0, k % 40).otherwise(k).cast("string"), 7, "0"), F.lit("-"))), "p_brand")
    return retros.pending_specs(table(spark, d, "part").select(name.alias("name")), "name")


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def key_set_differences(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a panel and of labels that only one side has."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return guards.key_differences(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "k")


@query("""
WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n FROM n WHERE n < 50""")
def short_strata(spark: SparkSession, d: str) -> DataFrame:
    """Strata that cannot give a sample of 50."""
    return split.short_strata(table(spark, d, "embeddings"), "label", 50)


@query("SELECT conv_id, count(*)::INT AS messages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 16")
def dataset_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first sixteen conversations, as they would be trained on."""
    chats = train_data.conversations(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return train_data.preview(chats.select("conv_id", F.size("messages").alias("messages"), chars.alias("chars")), "conv_id")


@query("""
WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS answered FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, length(text || answer)::INT - 1 AS targets, length(answer)::DOUBLE AS chosen_weight, length(answer || '!')::DOUBLE AS rejected_weight FROM t WHERE role = 'user' AND answered = 'assistant' AND length(text) > 0""")
def preference_masks(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn with its answer and a worse one as masked examples; characters stand for tokens."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumns({"answer": F.lead("text").over(w), "answered": F.lead("role").over(w)}).where("role = 'user' and answered = 'assistant' and length(text) > 0")
    codes = train_data.char_codes
    x = train_data.preference_example(codes(F.col("text")), codes(F.col("answer")), codes(F.concat("answer", F.lit("!"))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return t.withColumn("x", x).select("conv_id", "turn", F.size("x.chosen.targets").alias("targets"), total(F.col("x.chosen.weights")).alias("chosen_weight"), total(F.col("x.rejected.weights")).alias("rejected_weight"))
