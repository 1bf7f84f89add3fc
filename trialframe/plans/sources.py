"""Queries on sources and sinks: tables are written to the shared folder and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.expr import text_digest
from trialframe.operators import batch_jobs, tables, train_data, vector
from trialframe.plans.base import query, table
from trialframe.sources import corpus, journal, manifest, versions
from trialframe.sources.shared import new_folder
from trialframe.streaming import tail
from trialframe.streaming.journals import committed_segments, tail_to


def journal_files(spark: SparkSession, d: str, torn_middle: bool) -> str:
    """Events as the lines of four journals, each with a torn last line, and some lines in between that are none."""
    e = table(spark, d, "events").withColumn("k", F.col("user_id") % 4)
    good = F.to_json(F.struct("event_id", F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"), F.col("value").alias("usd")))
    line = F.when(F.col("event_id") % 101 == 0, "{not json").otherwise(good) if torn_middle else good
    rows = e.select("k", F.col("event_id").alias("at"), line.alias("value"))
    tail = e.select("k").distinct().select("k", F.lit(1 << 60).alias("at"), F.lit('{"event_id": 1, "sta').alias("value"))
    path = new_folder(spark)
    rows.unionByName(tail).repartition("k").sortWithinPartitions("k", "at").select("k", "value").write.partitionBy("k").text(path)
    return path


_ROW = "event_id long, status string, usd double"


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS line, event_id % 101 = 0 AS bad FROM events)
SELECT 'skip_torn_tail' AS policy, event_id, line::INT AS line, CASE event_type WHEN 'error' THEN 'error' ELSE 'done' END AS status, value AS usd FROM e
UNION ALL SELECT 'skip_bad', event_id, line, CASE event_type WHEN 'error' THEN 'error' ELSE 'done' END, value FROM e WHERE NOT bad AND value >= 10""")
def journal_policies(spark: SparkSession, d: str) -> DataFrame:
    """Journals with torn tails read as they are; with bad lines in between and a condition on rows, what is left."""
    files = lambda torn: journal_files(spark, d, torn)
    a = journal.read_journal(spark, files(False), _ROW, "skip_torn_tail", glob="*.txt").withColumn("policy", F.lit("skip_torn_tail"))
    b = journal.read_journal(spark, files(True), _ROW, "skip_bad", valid=F.col("usd") >= 10, glob="*.txt").withColumn("policy", F.lit("skip_bad"))
    return a.unionByName(b).select("policy", "event_id", "line", "status", "usd")


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'done' END AS status, value AS usd, user_id % 4 AS k FROM events""")
def journal_tail_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same journals followed as a stream of appended lines, in ranges of 64 KB; lines that were torn are left out."""
    path, base = journal_files(spark, d, False), new_folder(spark)
    tail_to(tail.journal_tail(spark, path, glob="*.txt", rangeBytes=str(1 << 16)), f"{base}/out", f"{base}/state")
    held = spark.read.schema("path string, device long, inode long, offset long, text string").parquet(f"{base}/out")
    k = F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k")
    return held.select(k, F.from_json("text", _ROW).alias("r")).where("r.status is not null").select("r.event_id", "r.status", "r.usd", "k")


@query("""
WITH e AS (SELECT user_id % 4 AS k, user_id, event_id, event_type FROM events)
SELECT user_id AS unit, CASE WHEN bool_or(event_type <> 'error') THEN 'done' ELSE 'error' END AS status FROM e GROUP BY user_id""")
def work_set(spark: SparkSession, d: str) -> DataFrame:
    """Work units appended to a journal in two runs; one done record settles a unit."""
    e = table(spark, d, "events").select(F.col("user_id").alias("unit"), F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"), "event_id")
    path = new_folder(spark)
    for k in (0, 1):
        journal.append_journal(e.where(F.col("event_id") % 2 == k).select("unit", "status"), path)
    return journal.latest_status(journal.read_journal(spark, path, "unit long, status string", "strict", glob="*.json"), "unit")


@query("SELECT user_id, (count(*))::INT AS next_unit FROM events GROUP BY user_id")
def resume_units(spark: SparkSession, d: str) -> DataFrame:
    from trialframe.plans.journals import journal as rows

    path = new_folder(spark)
    journal.append_journal(rows(spark, d).select("user_id", "unit"), path)
    back = journal.read_journal(spark, path, "user_id long, unit int", "skip_middle", glob="*.json")
    return journal.resume_units(back, "user_id", "unit").select("user_id", F.col("next_unit").cast("int").alias("next_unit"))


def written_chats(spark: SparkSession, d: str) -> str:
    chats = train_data.conversations(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    path = new_folder(spark)
    corpus.write_split(chats.select("conv_id", "messages", F.when(F.col("conv_id") % 10 == 0, "valid").otherwise("train").alias("bucket")), path, "bucket")
    return path


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) AS last FROM conversations WHERE conv_id % 10 <> 0 GROUP BY conv_id)
SELECT (n - 1)::INT AS prompt_turns, last AS completion, count(*) AS chats FROM c GROUP BY ALL""")
def chat_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Chats written as JSON lines by split; the training split read back as prompts and completions."""
    x = corpus.read_sft(spark, f"{written_chats(spark, d)}/bucket=train", glob="*.json")
    return x.groupBy(F.size("prompt").alias("prompt_turns"), F.col("completion")[0]["content"].alias("completion")).agg(F.count("*").alias("chats"))


@query("""
WITH a AS (SELECT conv_id, arg_max(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
n AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT q AS prompt, t AS chosen, lower(t) AS rejected, count(*) AS n FROM a JOIN n USING (conv_id) GROUP BY ALL""")
def preference_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Preferences as JSON lines and as Parquet read alike."""
    c = table(spark, d, "conversations")
    last = lambda role: c.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias(role))
    x = last("assistant").join(last("user"), "conv_id")
    say = lambda role, t: F.array(F.struct(F.lit(role).alias("role"), t.alias("content")))
    rows = x.select(F.col("conv_id").alias("id"), say("user", F.col("user")).alias("prompt"), say("assistant", F.col("assistant")).alias("chosen"), say("assistant", F.lower("assistant")).alias("rejected"))
    lines, files = new_folder(spark), new_folder(spark)
    rows.where("id % 2 = 0").write.json(lines)
    rows.where("id % 2 = 1").write.parquet(files)
    both = corpus.read_preferences(spark, lines, glob="*.json").unionByName(corpus.read_corpus(spark, files, "dpo"))
    text = lambda k: F.col(k)[0]["content"].alias(k)
    return both.groupBy(text("prompt"), text("chosen"), text("rejected")).agg(F.count("*").alias("n"))


@query("""SELECT 'r' || conv_id || '-' || turn AS custom_id, text AS content, role FROM conversations""")
def batch_requests(spark: SparkSession, d: str) -> DataFrame:
    """Turns written as a provider's request lines and read back."""
    body = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    r = table(spark, d, "conversations").select(F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("custom_id"), body.alias("body"))
    path = new_folder(spark)
    batch_jobs.request_lines(r, "custom_id", "body").write.text(path)
    back = corpus.read_requests(spark, path, glob="*.txt")
    return back.select("custom_id", F.get_json_object("body", "$.messages[0].content").alias("content"), F.get_json_object("body", "$.messages[0].role").alias("role"))


def tree(spark: SparkSession, d: str, changed: bool) -> DataFrame:
    """A folder of one file per language, and its manifest with paths below the root."""
    docs = table(spark, d, "documents").select("lang", "doc_id", F.col("doc_id").cast("string").alias("value"))
    if changed:
        docs = docs.where("lang <> 'es'").withColumn("value", F.when((F.col("lang") == "de"), F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    path = new_folder(spark)
    docs.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(path)
    return manifest.tree_manifest(spark, path).where(F.endswith("path", F.lit(".txt"))).select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("path"), "length", "sha256")


_TREE = "t AS (SELECT lang AS path, string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10) AS a, string_agg(doc_id || CASE WHEN lang = 'de' THEN '!' ELSE '' END, chr(10) ORDER BY doc_id) || chr(10) AS b FROM documents GROUP BY lang)"


@query(f"WITH {_TREE} SELECT path, strlen(a)::BIGINT AS length, sha256(a) AS sha256 FROM t")
def tree_manifest(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d, False)


@query(f"WITH {_TREE} SELECT path, sha256(a) AS \"left\", CASE WHEN path <> 'es' THEN sha256(b) END AS \"right\" FROM t WHERE path IN ('es', 'de')")
def tree_difference(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two trees, one of them from a checksum file that was written and parsed."""
    a = tree(spark, d, False)
    path = new_folder(spark)
    a.select(F.concat("sha256", F.lit("  "), "path").alias("value")).write.text(path)
    return manifest.manifest_diff(manifest.parse_manifest(spark.read.text(path)), tree(spark, d, True))


@query(f"WITH {_TREE} SELECT count(*) AS files, sum(strlen(a))::BIGINT AS bytes FROM t")
def sync_report(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d, False).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("SELECT p_partkey, 'src/' || p_brand AS path, CASE WHEN p_size % 5 = 0 THEN '120000' ELSE '100644' END AS dst_mode FROM part UNION ALL SELECT p_partkey, p_type, '000000' FROM part WHERE p_partkey % 2 = 0")
def tree_changes(spark: SparkSession, d: str) -> DataFrame:
    """Raw comparisons of two trees, NUL between fields, as changed paths with their modes."""
    one = lambda mode, path: F.concat(F.lit(":100644 "), mode, F.lit(" a b M\u0000"), path, F.lit("\u0000"))
    first = one(F.when(F.col("p_size") % 5 == 0, "120000").otherwise("100644"), F.concat(F.lit("src/"), "p_brand"))
    raw = F.concat(first, F.when(F.col("p_partkey") % 2 == 0, one(F.lit("000000"), F.col("p_type"))).otherwise(""))
    return manifest.tree_changes(table(spark, d, "part").select("p_partkey", raw.alias("raw")), "raw").select("p_partkey", "path", "dst_mode")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v, 'v002' AS current FROM customer")
def versioned_table(spark: SparkSession, d: str) -> DataFrame:
    """Two upserts of a versioned table, a third version, a rollback to the second."""
    root, c = new_folder(spark), table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit(0).alias("o"))
    versions.upsert(rows, root, ["k"], F.col("o"), "20240101")
    versions.upsert(rows.where("k % 3 = 0").withColumns({"v": F.lit("new"), "o": F.lit(1)}), root, ["k"], F.col("o"), "20240102")
    versions.upsert(rows.withColumn("v", F.lit("bad")), root, ["k"], F.col("o"), "20240103")
    name = versions.rollback(spark, root)
    return versions.read_current(spark, root).select("k", "v", F.lit(name.split("-")[0]).alias("current"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, count(DISTINCT event_id % 2) AS phases FROM events")
def failure_budget(spark: SparkSession, d: str) -> DataFrame:
    """Two appends within a budget of failures, and the phases marked on the way."""
    root = new_folder(spark)
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("failed"))
    for k in (0, 1):
        for _ in range(2):  # a batch that is written again counts once
            versions.append_within_budget(e.where(F.col("event_id") % 2 == k), f"{root}/sink", "failed", 1 << 40, f"batch{k}")
        versions.mark_phase(spark, f"{root}/phases", f"run{k}", "now")
    versions.require_phase(versions.marked_phases(spark, f"{root}/phases"), "run1")
    phases = versions.marked_phases(spark, f"{root}/phases").count()
    return versions.sink_rows(spark, f"{root}/sink").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures")).select("*", F.lit(phases).cast("long").alias("phases"))


@query("SELECT o_orderstatus, count(*) AS n, 1 AS version, 2 AS made FROM orders GROUP BY o_orderstatus UNION ALL SELECT o_orderstatus, count(*), 2, 2 FROM orders GROUP BY o_orderstatus")
def keyed_cache(spark: SparkSession, d: str) -> DataFrame:
    """A table asked for twice in each of two versions: made once a version."""
    root, made = new_folder(spark), []
    key = "0123456789abcdef0123456789abcdef"
    make = lambda: made.append(1) or table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    out = [tables.cached(spark, root, "orders", v, key, make).withColumn("version", F.lit(v)) for v in (1, 1, 2, 2)]
    return out[1].unionByName(out[3]).withColumn("made", F.lit(len(made)))


@query("""
SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'changed' ELSE 'new' END AS state FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 3 = 0""")
def embedding_index(spark: SparkSession, d: str) -> DataFrame:
    """An index without a third of the vectors and with old digests of a fifth, written, read, and what is to be embedded."""
    e = table(spark, d, "embeddings")
    digest = text_digest(F.col("vec_id").cast("string"))
    old = F.when(F.col("vec_id") % 5 == 0, "old").otherwise(digest)
    path = new_folder(spark)
    vector.write_index(e.where("vec_id % 3 <> 0 or vec_id % 5 = 0").withColumn("digest", old), path, "vec_id", "digest", "embedding")
    return vector.to_embed(e.select(F.col("vec_id").alias("id"), digest.alias("digest")), vector.read_index(spark, path), "id", "digest").select("id", "state")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'settled' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 0::DOUBLE ELSE o_totalprice::DOUBLE END AS price FROM orders")
def updated_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))
    changes = o.where("k % 4 = 0").select("k", F.lit("settled").alias("status"), F.lit(0.0).alias("price")).unionByName(spark.range(1).select((-F.col("id") - 1).alias("k"), F.lit("none").alias("status"), F.lit(1.0).alias("price")))
    return tables.updated(o, changes, "k", ["status", "price"])


@query("""
WITH s AS (SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL), m AS (SELECT user_id, max(value) AS value FROM s GROUP BY user_id)
SELECT m.user_id, min(event_id) AS event_id, m.value FROM m JOIN s ON s.user_id = m.user_id AND s.value = m.value GROUP BY m.user_id, m.value""")
def best_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return tables.best_checkpoint(table(spark, d, "events").where("value is not null"), "user_id", "event_id", "value")


@query("""
WITH c AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t, 1500 * (turn + 1) AS ms FROM conversations),
p AS (SELECT *, coalesce(lag(t) OVER w, '') AS before, coalesce(lag(ms) OVER w, 0) AS since FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT conv_id, turn, since, ms, regexp_replace(substr(t, length(before) + 1), '^\\s+|\\s+$', '', 'g') AS d FROM p WHERE turn <= 3)
SELECT conv_id AS entity, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS segment, since / 1000.0::DOUBLE AS start, ms / 1000.0::DOUBLE AS "end", d AS text FROM k WHERE d <> ''""")
def stream_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as growing transcripts in a stream; the fourth update is final, what follows is not taken."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), " ").alias("t"), (1500 * (F.col("turn") + 1)).alias("ms"), (F.col("turn") == 3).alias("last"))
    base = new_folder(spark)
    c.write.parquet(f"{base}/updates")
    stream = spark.readStream.schema(c.schema).parquet(f"{base}/updates")
    tail_to(committed_segments(stream, "conv_id", "turn", "t", "ms", "last"), f"{base}/out", f"{base}/state")
    return spark.read.schema("entity long, segment long, start double, end double, text string").parquet(f"{base}/out")
