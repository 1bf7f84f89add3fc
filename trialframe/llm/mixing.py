"""Mixing sources to target weights by thresholds on hashes, found from histograms; built-in functions only.

Every source gets a share of all words by its weight, at most `MOST` times its own size; what is cut there is shared
again by weight among the others. A source takes its documents whole as often as its target allows, and the rest of the
target once more from the documents whose key, an even hash, lies below a threshold. The threshold is found by
histograms: words are summed by source and the next digits of the key, the bucket in which the budget ends is refined by
further digits, all others are decided. The document at the threshold does not fit; further thresholds above it, for
documents no larger than what is left, fill the gap (`FILLS`), and one last document is taken if its source comes nearer to
its target by that. So a document is taken or not by a comparison with a few
numbers of its source: no rows are sorted, and every rerun decides alike.

Defined results: a null text has no words. Null is a source of its own, the last one; the empty string is another. A
source without words has the target 0, and documents without words take 0. A document is taken whole. Rows that are equal in id and text have equal keys and are taken or left
together; copies under other ids are apart. Very long texts are one document like others. A null id is an id like
others. An empty table gives an empty result. All columns of the input pass through `mixed`, whatever their names, except
those that it writes, which it replaces.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.llm.common import WORD_RE, durable, sized_broadcast, table

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times the words of its source, and no document is taken more often.
MOST = 3
#: Thresholds after the first, each for documents no larger than the gap that the one before left.
FILLS = 6
#: Hexadecimal digits of a key, and those that one histogram looks at.
KEY_DIGITS, BUCKET_DIGITS = 15, 3
#: Sources up to so many are broadcast to the documents: a row of a few hundred bytes each.
BROADCAST_SOURCES = 20_000

SUM = "decimal(38,0)"


def document_key(id_: Column, text: Column) -> Column:
    """An even key of 60 bits that depends on the row alone."""
    return F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, KEY_DIGITS)


def sizes(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, key) of every row, written once: all later steps read these few bytes instead of texts."""
    i, t, s = (F.col(f"`{c}`") for c in (id_, text, source))
    return durable(df.select(i.alias("id"), s.alias("source"), F.coalesce(F.regexp_count(t, F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"), document_key(i, t).alias("key")))


def weighed(sized: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, source_size, n, weight): the weights go round in the order of the sources by code points, null last.

    The position of a source is counted within ranges of sources, and the sources of the ranges before are added, so that
    no task holds them all.
    """
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(found.repartitionByRange(ranges, F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()))
    before = dealt.groupBy("range").agg(F.count("*").alias("in_range"))  # a row for each range
    before = before.select("range", (F.sum("in_range").over(Window.orderBy("range")) - F.col("in_range")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))) + F.col("before") - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    return dealt.join(F.broadcast(before), "range").select("source", "source_size", weight.alias("weight"))


def shared(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources with their target as the fraction share / shares; every round caps those that the last one left above.

    A round is one sum over the sources. Caps only grow in number, and so the rounds end; in general after a few.
    """
    cap, w = (F.col("source_size") * most).cast(SUM), F.col("weight").cast(SUM)
    total = sources.agg(F.sum(F.col("source_size").cast(SUM)), F.sum(w), F.count("*")).first()
    left, shares, above = int(total[0] or 0), int(total[1] or 0), -1
    while True:
        over = cap * F.lit(shares).cast(SUM) < w * F.lit(left).cast(SUM)
        r = sources.where(over).agg(F.sum(cap), F.sum(w), F.count("*")).first()
        if r[2] == above or r[2] == total[2]:
            break
        above, left, shares = r[2], int(total[0]) - int(r[0] or 0), int(total[1]) - int(r[1] or 0)
    # Without words, all is 0; else not all sources can be capped, as all caps together are more than all words.
    share = F.when(over, cap).otherwise(w * F.lit(left).cast(SUM))
    return sources.withColumns({"share": share, "shares": F.when(over, F.lit(1)).otherwise(F.lit(max(shares, 1))).cast(SUM)})


def thresholds(sized: DataFrame, sources: DataFrame, fills: int = FILLS) -> DataFrame:
    """sources with whole, how often all documents are taken, thresholds (low, cut, most) and extra: a document is taken
    once more where for one threshold low < key < cut and size <= most, or its key is extra.
    """
    spark = sized.sparkSession
    n = sources.count()
    budget = F.expr("share div shares")
    whole = F.when(F.col("source_size") > 0, F.expr("(share div shares) div source_size")).otherwise(0)
    state = durable(sources.withColumn("whole", whole).withColumn("left", budget - F.col("whole") * F.col("source_size")))
    rows = sized.where("size > 0").select(F.col("source").alias("of"), "size", "key")
    same = F.col("of").eqNullSafe(F.col("source"))
    cuts: list[DataFrame] = []
    short: list[DataFrame] = []
    last = state.select("source", F.lit("").alias("low"), "left")
    for _ in range(fills + 1):
        # One threshold: digits are fixed until the bucket in which the budget ends holds a single key.
        now = last.select("source", "low", F.col("left").alias("most"), F.col("left").alias("rest"), F.lit("").alias("prefix"), F.lit(None).cast("string").alias("cut"))
        held, done = now, []
        for level in range(KEY_DIGITS // BUCKET_DIGITS):
            hit = rows.join(sized_broadcast(held, n, BROADCAST_SOURCES), same).where("key > low and size <= most and startswith(key, prefix)")
            bucket = F.substring("key", level * BUCKET_DIGITS + 1, BUCKET_DIGITS)
            sums = hit.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("key").alias("first"), F.max("key").alias("final"))
            sums = durable(sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))))
            if level == 0:  # where all that fits one by one fits together, there is no such bucket
                total = sums.groupBy(F.col("source").alias("of")).agg(F.max("upto").alias("total"))
                left = F.col("rest") - F.coalesce("total", F.lit(0))
                short.append(now.join(total, same, "left").where(left > 0).select(F.col("source").alias("by"), left.alias("left")))
            both = sums.join(sized_broadcast(held.withColumnRenamed("source", "of"), n, BROADCAST_SOURCES), same).where(F.col("upto") > F.col("rest"))
            end = F.min_by(F.struct(F.col("upto") - F.col("words"), "bucket", "first", "final"), "bucket")
            ends = both.groupBy("source").agg(end.alias("end")).select(F.col("source").alias("of"), F.col("end.col1").alias("below"), "end.bucket", "end.first", "end.final")
            step = held.join(ends, same).select(
                "source", "low", "most", (F.col("rest") - F.col("below")).alias("rest"), F.concat("prefix", "bucket").alias("prefix"),
                F.when(F.col("first") == F.col("final"), F.col("first")).alias("cut"),
            )
            step = durable(step)
            done.append(step.where("cut is not null"))
            held = step.where("cut is null")
            if held.isEmpty():
                break
        found = done[0]
        for d in done[1:]:
            found = found.union(d)
        cuts.append(now.drop("cut", "rest", "prefix").join(found.select(F.col("source").alias("of"), "cut", "rest"), same, "left").select("source", "low", "most", "cut"))
        # Sources without such a bucket take all that fits; the others go on above the key that did not fit.
        short[-1] = durable(short[-1])
        last = durable(found.where("rest > 0").select("source", F.col("cut").alias("low"), F.col("rest").alias("left")))
        if last.isEmpty():
            break
    out = state.drop("left")
    for j, c in enumerate(cuts):
        # No low: the source was through before. No cut: nothing is above.
        c = c.select(F.col("source").alias("of"), F.struct("low", F.coalesce("cut", F.lit("~")).alias("cut"), "most").alias(f"t{j}"))
        out = out.join(c, same, "left").drop("of")
    each = F.array_compact(F.array(*[f"t{j}" for j in range(len(cuts))]))
    out = out.select("source", "source_size", "weight", (F.col("share").cast("double") / F.col("shares").cast("double")).alias("target"), "whole", each.alias("thresholds"))
    # What is still missing is less than any document that is left, or the thresholds are used up: one more document,
    # the smallest, is taken if that brings the source nearer to its target.
    gaps = last.select(F.col("source").alias("by"), "left")
    for g in short:
        gaps = gaps.unionByName(g)
    near = rows.join(sized_broadcast(durable(gaps), n, BROADCAST_SOURCES), F.col("of").eqNullSafe(F.col("by"))).where("size < 2 * left").drop("by")
    near = near.join(sized_broadcast(out.select("source", "thresholds"), n, BROADCAST_SOURCES), same).where(~below(F.col("key"), F.col("size"), F.col("thresholds")))
    peers = near.groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("left").alias("left")).where("words < 2 * left")
    extra = peers.groupBy("source").agg(F.min_by("key", F.struct("words", "key")).alias("extra")).withColumnRenamed("source", "of")
    return durable(out.join(extra, same, "left").drop("of"))


def below(key: Column, size: Column, thresholds_: Column) -> Column:
    """True for documents that a threshold takes."""
    return F.exists(thresholds_, lambda t: (key > t["low"]) & (key < t["cut"]) & (size <= t["most"]))


def copies(key: Column, size: Column, plan: dict[str, Column]) -> Column:
    """How often a document is taken, by its source's plan (whole, thresholds, extra)."""
    more = below(key, size, plan["thresholds"]) | F.coalesce(key == plan["extra"], F.lit(False))
    return plan["whole"] + F.when(more, 1).otherwise(0)


PLAN = ("whole", "thresholds", "extra")


def planned(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, fills: int = FILLS) -> DataFrame:
    """A row per source: source_size, weight, target, whole, thresholds, extra."""
    return thresholds(sized, durable(shared(durable(weighed(sized, weights)), most)), fills)


def mixed(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, into: str = "copies") -> DataFrame:
    """df with the number of times that the mix takes each row: the texts are read once more, and not written."""
    own = "p" + uuid.uuid4().hex
    plan = planned(sizes(df, id_, text, source), weights, most).select(F.col("source").alias(f"{own}_of"), F.struct(*PLAN).alias(own))
    t, p = F.col(f"`{text}`"), F.col(own)
    size = F.coalesce(F.regexp_count(t, F.lit(WORD_RE)), F.lit(0)).cast("long")
    times = copies(document_key(F.col(f"`{id_}`"), t), size, {c: p[c] for c in PLAN})
    held = df.join(sized_broadcast(plan, plan.count(), BROADCAST_SOURCES), F.col(f"`{source}`").eqNullSafe(F.col(f"{own}_of")))
    return held.withColumn(into, times.cast("int")).drop(own, f"{own}_of")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    sized = sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    plan = planned(sized).withColumnRenamed("source", "of")
    held = sized.join(sized_broadcast(plan, plan.count(), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    times = copies(F.col("key"), F.col("size"), {c: F.col(c) for c in PLAN})
    return held.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source", times.cast("int").alias("copies"))


def _oracle() -> str:
    """Thresholds as running sums in the order of the keys; peers (equal keys) come together."""
    out = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {KEY_DIGITS}) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, ({list(WEIGHTS)})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::HUGEINT AS w
  FROM d GROUP BY source),
u AS (
  SELECT a.source, a.source_size, a.w, {MOST} * a.source_size AS cap,
         sum(CASE WHEN b.source_size * a.w <= a.source_size * b.w THEN {MOST} * b.source_size ELSE 0 END) AS caps,
         sum(CASE WHEN b.source_size * a.w <= a.source_size * b.w THEN 0 ELSE b.w END) AS free, sum(b.source_size) AS total
  FROM s a, s b GROUP BY ALL),
v AS (SELECT *, caps * w + cap * free < total * w AS capped FROM u),
x AS (SELECT sum(CASE WHEN capped THEN 0 ELSE w END) AS shares, sum(source_size) - coalesce(sum(cap) FILTER (capped), 0) AS rest FROM v),
b AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (w * rest)::DOUBLE / greatest(shares, 1)::DOUBLE END AS target,
         CASE WHEN capped THEN cap ELSE (w * rest) // greatest(shares, 1) END AS budget
  FROM v, x),
p AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM b),
q0 AS (SELECT d.*, p.source_size, target, whole, budget - whole * source_size AS rest, '' AS low, 0 AS more FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)"""
    for j in range(FILLS + 1):
        out += f""",
r{j} AS (
  SELECT *, k > low AND size > 0 AND size <= rest AND low IS NOT NULL AS cand,
         sum(CASE WHEN k > low AND size > 0 AND size <= rest AND low IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM q{j}),
t{j} AS (SELECT *, min(CASE WHEN cand AND upto > rest THEN k END) OVER (PARTITION BY source) AS cut FROM r{j}),
q{j + 1} AS (
  SELECT doc_id, source, size, k, source_size, target, whole,
         rest - sum(CASE WHEN cand AND (cut IS NULL OR k < cut) THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest,
         cut AS low, more + CASE WHEN cand AND (cut IS NULL OR k < cut) THEN 1 ELSE 0 END AS more
  FROM t{j})"""
    return out + f""",
n AS (SELECT source, k, sum(size) AS words, any_value(rest) AS rest FROM q{FILLS + 1} WHERE more = 0 AND size > 0 AND size < 2 * rest GROUP BY source, k HAVING sum(size) < 2 * any_value(rest)),
e AS (SELECT source, k FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY words, k) = 1),
z AS (SELECT q.*, more + CASE WHEN e.k IS NULL THEN 0 ELSE 1 END AS all_more FROM q{FILLS + 1} q LEFT JOIN e ON e.source IS NOT DISTINCT FROM q.source AND e.k = q.k)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (whole + all_more))::BIGINT AS taken, source, (whole + all_more)::INT AS copies FROM z
"""


ORACLE = _oracle()
