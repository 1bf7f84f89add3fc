"""Queries on composed readings, tagged states, judge votes and rendered texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import text as T
from trialframe.functions.expr import jaccard, words
from trialframe.operators import cost, golden, ledger, lifecycle, retros, spatial, tables
from trialframe.plans.base import query, table
from trialframe.plans.guards import _GOLD, golden_rows
from trialframe.plans.journals import _IN, _J, _L, journal, ledger_rows
from trialframe.plans.pages import _T, readings
from trialframe.sources.shared import new_folder, stored

INSTRUCTION = "Reconcile the readings into one."


@query("""
WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'box-' || page_id || ':/data/x:y' WHEN 1 THEN './local:' || page_id WHEN 2 THEN '[fe80::1]:rel/path' WHEN 3 THEN '/abs/' || page_id ELSE 'name only' END AS target FROM pages)
SELECT page_id, CASE WHEN starts_with(target, '[') THEN split_part(target, ']', 1) || ']' WHEN strpos(target, ':') > 0 AND (strpos(target, '/') = 0 OR strpos(target, ':') < strpos(target, '/')) THEN split_part(target, ':', 1) END AS host,
       CASE WHEN starts_with(target, '[') THEN substr(target, strpos(target, ']:') + 2) WHEN strpos(target, ':') > 0 AND (strpos(target, '/') = 0 OR strpos(target, ':') < strpos(target, '/')) THEN substr(target, strpos(target, ':') + 1) ELSE target END AS path,
       regexp_full_match(target, '[A-Za-z0-9._-]+') AS is_name, regexp_full_match(md5(target), '[0-9a-f]{32}') AS is_digest FROM t""")
def locations(spark: SparkSession, d: str) -> DataFrame:
    """Transfer targets as host and path, and whether they are plain names."""
    k = F.col("page_id") % 5
    n = F.col("page_id").cast("string")
    target = (
        F.when(k == 0, F.concat(F.lit("box-"), n, F.lit(":/data/x:y"))).when(k == 1, F.concat(F.lit("./local:"), n)).when(k == 2, "[fe80::1]:rel/path")
        .when(k == 3, F.concat(F.lit("/abs/"), n)).otherwise("name only")
    )
    t = table(spark, d, "pages").select("page_id", target.alias("target"))
    at = T.location(F.col("target"))
    return t.select("page_id", at["host"].alias("host"), at["path"].alias("path"), T.has_form(F.col("target"), "name").alias("is_name"), T.has_form(F.md5(F.col("target").cast("binary")), "digest").alias("is_digest"))


@query("""
SELECT s_suppkey, ['tinker', 'local', 'modal'][s_suppkey % 3 + 1] AS backend, s_name AS first, CASE WHEN s_suppkey % 3 = 2 THEN s_nationkey::VARCHAR END AS second FROM supplier""")
def state_handles(spark: SparkSession, d: str) -> DataFrame:
    """Saved states of three back ends as tagged JSON, written and read back."""
    backend = F.get(F.array(F.lit("tinker"), F.lit("local"), F.lit("modal")), (F.col("s_suppkey") % 3).cast("int"))
    rows = table(spark, d, "supplier").select("s_suppkey", T.handle_json(backend, F.col("s_name"), F.col("s_nationkey").cast("string")).alias("row"))
    return stored(rows).select("s_suppkey", T.read_handle(F.col("row")).alias("h")).select("s_suppkey", "h.*")


_READ = """
a AS (SELECT page_id, html AS a, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '[aeiou]', 'x', 'g') ELSE upper(html) END AS b FROM pages),
w AS (SELECT page_id, a, b, list_distinct(list_filter(regexp_split_to_array(lower(a), '\\s+'), lambda x: x <> '')) AS u, list_distinct(list_filter(regexp_split_to_array(lower(b), '\\s+'), lambda x: x <> '')) AS v FROM a),
s AS (SELECT *, coalesce(len(list_intersect(u, v)) / nullif(len(list_distinct(u || v)), 0), 1) >= 0.6 AS agree FROM w)"""


@query(f"""WITH {_READ} SELECT page_id, agree, sha256(CASE WHEN agree THEN a ELSE '{INSTRUCTION}' || chr(10) || chr(10) || '--- Reading 1 ---' || chr(10) || a || chr(10) || chr(10) || '--- Reading 2 ---' || chr(10) || b END) AS outcome FROM s""")
def read_quality(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of a page: the first where they agree, else the prompt that merges them."""
    other = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "[aeiou]", "x")).otherwise(F.upper("html"))
    r = table(spark, d, "pages").select("page_id", F.col("html").alias("a"), other.alias("b"))
    agree = jaccard(words(F.col("a")), words(F.col("b"))) >= 0.6
    merged = T.merged_readings(F.array("a", "b"), INSTRUCTION)
    held = r.withColumn("agree", agree)
    return held.select("page_id", "agree", F.sha2(F.when(F.col("agree"), F.col("a")).otherwise(merged).cast("binary"), 256).alias("outcome"))


@query("""
WITH k AS (SELECT l.doc_id, l.quality, sha256('{"candidate_sha256":"' || sha256(text) || '","digest":"d1","judge":{"model":"' || CASE WHEN l.doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END || '","provider":"p","verdict_schema":"s"},"prompt_version":"1","reference_sha256":"' || sha256(lang) || '","row_id":"' || l.doc_id || '","seed":7,"v":1}') AS key FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT doc_id, key, CASE WHEN doc_id % 4 = 0 THEN CASE quality WHEN 1 THEN 'win' ELSE 'loss' END END AS vote, doc_id % 4 = 0 AS hit FROM k""")
def judge_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes by their full key; those cached under the same key are served, others are to be asked for."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    key = lambda model: lifecycle.vote_key(F.lit("p"), model, F.lit("s"), F.lit("1"), F.lit("d1"), F.col("doc_id"), F.col("text"), F.col("lang"), F.lit(7))
    rows = x.select("doc_id", "quality", key(F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2")).alias("key"))
    held = x.where("doc_id % 4 = 0 or doc_id % 5 = 0").select(key(F.when(F.col("doc_id") % 4 == 0, "m1").otherwise("m3")).alias("key"), F.when(F.col("quality") == 1, "win").otherwise("loss").alias("vote"))
    return lifecycle.served_votes(rows, held, "key").select("doc_id", "key", "vote", "hit")


@query(f"""
WITH {_J}
SELECT user_id, unit::INT AS unit, 'unit ' || unit || ' [' || verdict || '] metric=' || coalesce(metric::VARCHAR, 'unscored') || ' — event ' || event_id || '⏎''done''' AS line FROM v""")
def history_lines(spark: SparkSession, d: str) -> DataFrame:
    """Journal rows as sanitised lines of a prompt; breaks and marks in a description are shown, not kept."""
    said = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit("\n`done`"))
    return journal(spark, d).select("user_id", "unit", T.history_line(F.col("unit"), F.col("verdict"), F.col("metric"), said).alias("line"))


_HEAD = T.HISTORY_HEAD.replace("'", "''")


@query(f"""
WITH {_J}, m AS (SELECT *, CASE WHEN metric IS NOT NULL THEN metric / 1000000 END AS x FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY unit DESC) AS age FROM m),
b AS (SELECT user_id, max(x) FILTER (unit = 0) AS baseline, max(x) FILTER (verdict = 'keep') AS best FROM m GROUP BY user_id),
l AS (SELECT user_id, string_agg('unit ' || unit || ' [' || verdict || '] metric=' || coalesce(x::VARCHAR, 'unscored') || ' — event ' || event_id, chr(10) ORDER BY unit) AS lines FROM n WHERE age <= 10 GROUP BY user_id)
SELECT b.user_id, '{_HEAD}' || chr(10) || '- baseline (untouched tree): ' || coalesce(baseline::VARCHAR, 'unscored') || chr(10) || '- incumbent: ' || coalesce(best::VARCHAR, 'unscored') || chr(10)
       || '- best kept: ' || coalesce(best::VARCHAR, 'none') || chr(10) || lines AS history FROM b JOIN l ON b.user_id = l.user_id""")
def rendered_histories(spark: SparkSession, d: str) -> DataFrame:
    """What each experiment's next prompt is told: three scores, then the last ten units, oldest first; scores are small."""
    j = journal(spark, d).withColumn("metric", F.col("metric") / 1_000_000)
    scores = j.groupBy("user_id").agg(F.max(F.when(F.col("unit") == 0, F.col("metric"))).alias("baseline"), F.max(F.when(F.col("verdict") == "keep", F.col("metric"))).alias("best"))
    line = T.history_line(F.col("unit"), F.col("verdict"), F.col("metric"), F.concat(F.lit("event "), F.col("event_id").cast("string")))
    last = ledger.last_of(j.select("user_id", "unit", line.alias("line")), "user_id", "unit", "line", 10)
    held = scores.join(last, "user_id")
    return held.select("user_id", T.render_history(F.col("baseline"), F.col("best"), F.col("best"), F.transform("last", lambda x: x["line"])).alias("history"))


@query("""
SELECT n_nationkey, 'param:size=' || n_regionkey || ',pkg:' || lower(n_name) || '=' || length(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN ',pkg:size=1' ELSE '' END AS fingerprint FROM nation""")
def service_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Versions and parameters in two spaces of names, so that one cannot hide the other."""
    size = F.length("n_name").cast("string")
    packages = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lower("n_name"), size, F.lit("size"), F.lit("1"))).otherwise(F.create_map(F.lower("n_name"), size))
    out = lifecycle.parity_fingerprint(packages, F.create_map(F.lit("size"), F.col("n_regionkey").cast("string")))
    line = F.transform(F.array_sort(F.map_entries(out)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(line, ",").alias("fingerprint"))


@query("""
WITH j AS (SELECT p_partkey, to_json({'markdown': 'page ' || p_name, 'tokens': [{'text': p_brand, 'x': p_size, 'confidence': p_size / 100}, {'text': p_type, 'x': p_size + 1, 'confidence': p_retailprice / 10000}]}) AS d FROM part)
SELECT p_partkey, d->>'$.markdown' AS markdown, array_to_string(d->>'$.tokens[*].x', ',') AS xs, array_to_string(d->>'$.tokens[*].text', '|') AS texts,
       round((d->>'$.tokens[0].confidence')::DOUBLE + (d->>'$.tokens[1].confidence')::DOUBLE, 9) AS confidence, json_array_length(d, '$.tokens')::INT AS tokens FROM j""")
def document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents with tokens and boxes as JSON bytes, written and read back."""
    box = lambda x: F.struct(x.alias("x"), F.lit(0).alias("y"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    token = lambda x, t, c: F.struct(t.alias("text"), box(x).alias("box"), c.alias("confidence"))
    doc = F.struct(F.concat(F.lit("page "), "p_name").alias("markdown"), F.array(token(F.col("p_size"), F.col("p_brand"), F.col("p_size") / 100), token(F.col("p_size") + 1, F.col("p_type"), F.col("p_retailprice") / 10_000)).alias("tokens"))
    rows = stored(table(spark, d, "part").select("p_partkey", F.to_json(doc).cast("binary").alias("data")))
    kind = "markdown string, tokens array<struct<text:string,box:struct<x:int,y:int,width:int,height:int>,confidence:double>>"
    r = rows.select("p_partkey", F.from_json(F.col("data").cast("string"), kind).alias("d"))
    return r.select("p_partkey", "d.markdown", F.array_join(F.transform("d.tokens", lambda t: t["box"]["x"].cast("string")), ",").alias("xs"), F.array_join(F.transform("d.tokens", lambda t: t["text"]), "|").alias("texts"), F.round(F.col("d.tokens")[0]["confidence"] + F.col("d.tokens")[1]["confidence"], 9).alias("confidence"), F.size("d.tokens").alias("tokens"))


@query("""
WITH x AS (SELECT l_orderkey, CASE WHEN l_orderkey % 5 <> 0 THEN 'src/' || l_suppkey END AS path, l_extendedprice / 1000000000 AS q FROM lineitem)
SELECT l_orderkey, 'agent ' || (l_orderkey % 3) || ' edited ' || coalesce(string_agg(path, ', ' ORDER BY path), 'no files') || CASE WHEN l_orderkey % 2 = 0 THEN ' (reported loss=' || max(q) || ')' ELSE '' END AS description FROM x GROUP BY l_orderkey""")
def described_changes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("agent "), (k % 3).cast("string")).alias("label"), F.when(k % 5 != 0, F.concat(F.lit("src/"), F.col("l_suppkey").cast("string"))).alias("path"), F.when(k % 2 == 0, F.col("l_extendedprice") / 1_000_000_000).alias("reported"))
    return retros.described_change(rows, "l_orderkey", "label", "path", "loss", "reported")


@query(f"""
WITH {_L}, f AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY line DESC) AS age FROM l WHERE event IN {_IN['told']}),
r AS (SELECT campaign, string_agg('round ' || seq || ' ' || event || ': ' || reason, '; ' ORDER BY line) AS t FROM f WHERE age <= 8 GROUP BY campaign),
e AS (SELECT s_suppkey % 12 AS campaign, 'e' || s_suppkey || ': ' || CASE WHEN s_suppkey % 4 = 0 THEN 'flat (no candidate kept; incumbent baseline stands)' ELSE 'improved (baseline ' || s_nationkey::DOUBLE || ' -> best ' || (s_nationkey + 2)::DOUBLE || ', uplift 2.0)' END AS t FROM supplier),
g AS (SELECT campaign, string_agg(t, chr(10) ORDER BY t) AS retros FROM e GROUP BY campaign)
SELECT coalesce(g.campaign, r.campaign) AS campaign, coalesce(retros, '') AS retros, coalesce(CASE WHEN length(t) > 240 THEN substr(t, 1, 239) || '…' ELSE t END, '') AS failures FROM g FULL JOIN r ON g.campaign = r.campaign""")
def campaign_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What the next round of each campaign is told of failures and retrospectives."""
    k, b = F.col("s_suppkey"), F.col("s_nationkey").cast("double")
    flat = k % 4 == 0
    record = retros.to_record(F.concat(F.lit("e"), k.cast("string")), F.when(~flat, b), F.when(~flat, b + 2), F.when(~flat, 2.0), F.when(flat, "flat").otherwise("improved"))
    records = table(spark, d, "supplier").select((k % 12).alias("campaign"), record.alias("record"))
    failures = ledger.failure_reasons(ledger_rows(spark, d), "campaign", "line", "seq", "reason", 8)
    return retros.campaign_context(records, failures, "campaign", "record")


@query("""
WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'small' ELSE 'large' END AS model, length(text) // 4 AS i, CASE WHEN turn % 3 <> 2 THEN length(role || text) // 4 END AS o FROM conversations),
p AS (SELECT *, CASE model WHEN 'small' THEN 0.15 ELSE 3 END AS a, CASE model WHEN 'small' THEN 0.6 ELSE 15 END AS b FROM c)
SELECT conv_id, turn, i::BIGINT AS input_tokens, coalesce(o, 0)::BIGINT AS output_tokens, round((i * a + 1024 * b)::DOUBLE / 1000000, 9) AS reserved, round(CASE WHEN o IS NULL THEN 0 ELSE (i * a + o * b)::DOUBLE / 1000000 END, 9) AS spent,
       round((i * a + 1024 * b)::DOUBLE / 1000000 - CASE WHEN o IS NULL THEN 0 ELSE (i * a + o * b)::DOUBLE / 1000000 END, 9) AS released FROM p""")
def metered_calls(spark: SparkSession, d: str) -> DataFrame:
    """Turns as metered calls; a third have no answer and give back all that they reserved."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "small").otherwise("large").alias("model"), "text", F.when(F.col("turn") % 3 != 2, F.concat("role", "text")).alias("answer"))
    prices = spark.sql("SELECT * FROM VALUES ('small', cast(0.15 as decimal(10,4)), cast(0.60 as decimal(10,4))), ('large', cast(3 as decimal(10,4)), cast(15 as decimal(10,4))) AS t(model, input_price, output_price)")
    out = cost.metered(c, prices, "text", "answer")
    return out.select("conv_id", "turn", "input_tokens", F.col("output_tokens").cast("long").alias("output_tokens"), *[F.round(F.col(c).cast("double"), 9).alias(c) for c in ("reserved", "spent", "released")])


@query("""
WITH f AS (SELECT CASE WHEN event_id % 3 = 0 THEN (event_id // 3) || '.tmp-a.heartbeat' WHEN event_id % 3 = 1 THEN (event_id // 3) || '.tmp-a' ELSE event_id || '.bin' END AS name, (event_id % 11) * 100000 AS changed FROM events),
m AS (SELECT regexp_replace(name, '[.]heartbeat$', '') AS name FROM f WHERE suffix(name, '.heartbeat') AND changed >= 1000000 - 604800)
SELECT name, changed::BIGINT AS changed FROM f WHERE changed < 1000000 - 604800 AND contains(name, '.tmp-') AND name NOT IN (SELECT name FROM m)""")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """Staging files that a sweep may remove: older than a week, without a fresh mark."""
    k = F.col("event_id")
    third = F.floor(k / 3).cast("string")
    name = F.when(k % 3 == 0, F.concat(third, F.lit(".tmp-a.heartbeat"))).when(k % 3 == 1, F.concat(third, F.lit(".tmp-a"))).otherwise(F.concat(k.cast("string"), F.lit(".bin")))
    return tables.reapable(table(spark, d, "events").select(name.alias("name"), ((k % 11) * 100_000).cast("long").alias("changed")), "name", "changed", 1_000_000)


@query("""
WITH k AS (SELECT p_partkey, sha256('{"base":"' || p_brand || '","dataset":{"kind":"local","path":"' || p_type || '"},"hyperparams":{"steps":' || p_size || '},"lora":{"rank":8},"method":"' || CASE WHEN p_partkey % 2 = 0 THEN 'sft' ELSE 'dpo' END || '","name":"' || p_name || '-' || p_partkey || '"}') AS key, CASE WHEN p_partkey % 3 = 0 THEN 'seed' || p_partkey END AS resume_from FROM part),
s AS (SELECT p_partkey, p_size AS step FROM part WHERE p_partkey % 4 = 0)
SELECT k.key, CASE WHEN s.step IS NOT NULL THEN 'own' WHEN resume_from IS NOT NULL THEN 'seed' ELSE 'new' END AS choice, coalesce(s.step, 0)::INT AS from_step, CASE WHEN s.step IS NOT NULL THEN 'state' || k.p_partkey ELSE resume_from END AS handle FROM k LEFT JOIN s ON s.p_partkey = k.p_partkey""")
def resume_choices(spark: SparkSession, d: str) -> DataFrame:
    """Where each training run starts: at its own saved step, at a seed, or anew."""
    k = F.col("p_partkey")
    dataset = F.concat(F.lit('{"kind":"local","path":"'), "p_type", F.lit('"}'))
    key = lifecycle.run_key(F.concat("p_name", F.lit("-"), k.cast("string")), F.col("p_brand"), F.when(k % 2 == 0, "sft").otherwise("dpo"), F.lit('{"rank":8}'), F.concat(F.lit('{"steps":'), F.col("p_size").cast("string"), F.lit("}")), dataset)
    p = table(spark, d, "part").withColumn("key", key)
    specs = p.select("key", F.when(k % 3 == 0, F.concat(F.lit("seed"), k.cast("string"))).alias("resume_from"))
    states = p.where(k % 4 == 0).select("key", F.col("p_size").cast("int").alias("step"), F.concat(F.lit("state"), k.cast("string")).alias("handle"), F.lit("running").alias("status"))
    return lifecycle.resume_choice(specs, states, "key")


@query("""
WITH v AS (SELECT vec_id, g, k, CASE WHEN vec_id % 5 = 0 AND g = 'a' AND k = 'x' THEN 'nan'::DOUBLE WHEN vec_id % 3 = 0 AND g = 'b' THEN 'inf'::DOUBLE ELSE embedding[1]::DOUBLE END AS x FROM embeddings, (VALUES ('a', 'x'), ('a', 'y'), ('b', 'x')) t(g, k))
SELECT vec_id, coalesce(string_agg(g || '.' || k, ',' ORDER BY g || '.' || k) FILTER (NOT isfinite(x)), '') AS bad FROM v GROUP BY vec_id""")
def nested_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Names of metrics in groups whose values are no numbers."""
    k, x = F.col("vec_id"), F.col("embedding")[0].cast("double")
    a = F.create_map(F.lit("x"), F.when(k % 5 == 0, float("nan")).otherwise(x), F.lit("y"), x)
    b = F.create_map(F.lit("x"), F.when(k % 3 == 0, float("inf")).otherwise(x))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(lifecycle.nested_not_finite(F.create_map(F.lit("a"), a, F.lit("b"), b)), ",").alias("bad"))


@query("""
WITH x AS (SELECT source, n_chars > CASE WHEN source IN ('src1', 'src2') THEN -1 WHEN source = 'src3' THEN 1000000 ELSE 800 END AS fires FROM documents)
SELECT source, count(*) AS n, CASE WHEN bool_and(fires) THEN 'fires on all' WHEN NOT bool_or(fires) THEN 'abstains on all' END AS violation FROM x GROUP BY source""")
def constant_deciders(spark: SparkSession, d: str) -> DataFrame:
    limit = F.when(F.col("source").isin("src1", "src2"), -1).when(F.col("source") == "src3", 1_000_000).otherwise(800)
    return lifecycle.decider_violation(table(spark, d, "documents"), "source", F.col("n_chars") > limit)


@query("""
WITH x AS (SELECT p_partkey, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(p_name), '[^a-z]+'), lambda w: CASE w WHEN 'steel' THEN 'metal' WHEN 'copper' THEN 'metal' WHEN 'small' THEN 'size' WHEN 'large' THEN 'size' END), lambda f: f IS NOT NULL)) AS f FROM part)
SELECT p_partkey, CASE WHEN len(f) <> 1 THEN 'unknown family' WHEN f[1] = 'metal' THEN 'same family' END AS refusal FROM x""")
def cross_families(spark: SparkSession, d: str) -> DataFrame:
    """May a judge of one family grade a generator?"""
    known = {"steel": "metal", "copper": "metal", "small": "size", "large": "size"}
    return table(spark, d, "part").select("p_partkey", T.same_family(F.lit("metal"), F.col("p_name"), known).alias("refusal"))


@query(f"WITH {_GOLD} SELECT sha256(md) AS packet_sha256, rows_sha256, n, n // 2 + 1 AS floor, n AS listed, n AS unlabelled FROM p")
def packet_files(spark: SparkSession, d: str) -> DataFrame:
    """A packet written as files, its manifest and its template read back."""
    root, rows = new_folder(spark), stored(golden_rows(spark, d))
    golden.write_packet(rows, "doc_id", "lang", "text", "Is it good?", "Packet", root)
    blank = spark.read.schema("row int, row_id string, label string").json(f"{root}/labels_template").where("label is null").count()
    return golden.read_manifest(spark, root).select("packet_sha256", "rows_sha256", "n", "floor", F.size("rows").cast("long").alias("listed"), F.lit(blank).cast("long").alias("unlabelled"))


@query(f"""
WITH {_T},
k AS (SELECT a.page, a.tok, max(a.confidence) AS c, min(b.confidence) AS oc, bool_or(replace(replace(lower(a.text), 'ß', 'ss'), 'ς', 'σ') <> replace(replace(lower(b.text), 'ß', 'ss'), 'ς', 'σ')) AS differs
      FROM tok a LEFT JOIN sup b ON a.page = b.page AND abs((a.x + a.w / 2) - (b.x + b.w / 2)) < 15 AND abs((a.y + a.h / 2) - (b.y + b.h / 2)) < 10 WHERE a.page % 2 = 0 GROUP BY ALL),
f AS (SELECT page, count(*) AS n, sum(CASE WHEN differs THEN least(c, oc) * 0.5 ELSE c END) AS c FROM k GROUP BY page),
e AS (SELECT s.page, count(*) AS n, sum(s.confidence) AS c FROM sup s WHERE s.page % 2 = 0 AND s.tok >= 100000 GROUP BY s.page),
t AS (SELECT page, count(*) AS n, sum(confidence) AS c FROM tok WHERE page % 2 = 1 GROUP BY page)
SELECT f.page, f.n + coalesce(e.n, 0) AS n, round(f.c + coalesce(e.c, 0), 4) AS confidence FROM f LEFT JOIN e ON e.page = f.page UNION ALL SELECT page, n, round(c, 4) FROM t""")
def ensemble_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages by both readings; pages read as regions by the first alone."""
    out = spatial.ensemble_pages(readings(spark, d), "page", "tok", lambda t: F.col("page") % 2 == 1, columns=())
    return out.groupBy("page").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))
