"""Queries on bake-offs, metrics and promotion gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.expr import seeded_number
from trialframe.operators import bakeoff, gates, judging, lifecycle, metrics
from trialframe.plans.base import ORACLES, QUERIES, query, table


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """Three arms that predict quality: by length, by language and by a coin; `safe` is absent for some of the coin's."""
    items = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    coin = (seeded_number(F.col("doc_id")) % 2 == 0).cast("int")
    arms = {"len": (0, (F.col("n_chars") >= 500).cast("int")), "lang": (1, (F.col("lang") == "en").cast("int")), "src": (2, coin)}
    rows = []
    for arm, (idx, pred) in arms.items():
        hit = (pred == F.col("quality")).cast("double")
        cell = lambda f, num, text: F.struct(F.lit(arm).alias("arm"), F.lit(idx).alias("arm_idx"), F.lit(f).alias("field"), num.cast("double").alias("vnum"), text.cast("string").alias("vstr"))  # noqa: B023, E731
        none = F.lit(None)
        safe = cell("safe", 1 - F.col("toxic"), none)
        tag = F.when(F.col("lang") == "fr", "de").otherwise(F.col("lang")) if arm == "src" else F.col("lang")
        rows += [cell("exact", hit, none), F.when(F.col("doc_id") % 7 != 0, safe) if arm == "src" else safe, cell("tag", none, tag)]
    return items.select(F.col("doc_id").alias("item"), F.explode(F.array(*rows)).alias("c")).where("c is not null").select("item", "c.*")


#: Permutations and resamples of the gates.
DRAWS = 10_000

_OUT = """
items AS (SELECT l.doc_id, quality, toxic, lang, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
preds AS (
  SELECT 'len' AS arm, 0 AS arm_idx, *, (n_chars >= 500)::INT AS pred FROM items
  UNION ALL SELECT 'lang', 1, *, (lang = 'en')::INT FROM items
  UNION ALL SELECT 'src', 2, *, ((('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 2) = 0)::INT FROM items),
outp AS (
  SELECT arm, arm_idx, doc_id AS item, 'exact' AS field, (pred = quality)::INT::DOUBLE AS vnum, NULL AS vstr FROM preds
  UNION ALL SELECT arm, arm_idx, doc_id, 'safe', (1 - toxic)::DOUBLE, NULL FROM preds WHERE arm <> 'src' OR doc_id % 7 <> 0
  UNION ALL SELECT arm, arm_idx, doc_id, 'tag', NULL, CASE WHEN arm = 'src' AND lang = 'fr' THEN 'de' ELSE lang END FROM preds),
n AS (SELECT count(DISTINCT item) AS n_items FROM outp),
arms AS (SELECT DISTINCT arm, arm_idx FROM outp),
pairs AS (
  SELECT coalesce(a.arm_, p.x) AS arm, p.y AS other, coalesce(a.item, b.item) AS item, coalesce(a.field, b.field) AS field, a.item IS NOT NULL AND b.item IS NOT NULL AS joint,
         coalesce(a.vnum = b.vnum AND NOT isnan(a.vnum), false) OR coalesce(a.vstr = b.vstr, false) AS same
  FROM (SELECT s.arm AS x, t.arm AS y FROM arms s, arms t WHERE s.arm <> t.arm) p
  JOIN (SELECT DISTINCT item, field FROM outp) k ON true
  LEFT JOIN (SELECT arm AS arm_, item, field, vnum, vstr FROM outp) a ON a.arm_ = p.x AND a.item = k.item AND a.field = k.field
  LEFT JOIN outp b ON b.arm = p.y AND b.item = k.item AND b.field = k.field
  WHERE a.item IS NOT NULL OR b.item IS NOT NULL)"""

_AGREE = """
agree AS (SELECT arm, avg(m) AS agreement FROM (SELECT arm, other, avg((joint AND same)::INT) AS m FROM pairs GROUP BY arm, other) GROUP BY arm)"""


@query(f"""
WITH {_OUT}, {_AGREE},
means AS (SELECT arm, arm_idx, field, sum(vnum) / max(n_items) AS mean FROM outp, n WHERE vnum IS NOT NULL GROUP BY ALL),
wide AS (SELECT arm, arm_idx, max(CASE WHEN field = 'exact' THEN mean END) AS exact, max(CASE WHEN field = 'safe' THEN mean END) AS safe FROM means GROUP BY ALL)
SELECT w.arm, round(exact, 6) AS exact, round(safe, 6) AS safe, round(agreement, 6) AS agreement,
       row_number() OVER (ORDER BY exact DESC, safe DESC, arm_idx)::INT AS rank,
       row_number() OVER (ORDER BY exact DESC, safe DESC, arm_idx) = 1 AS winner
FROM wide w JOIN agree a ON w.arm = a.arm""")
def bakeoff_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    board = bakeoff.leaderboard(outputs(spark, d), "exact", "safe")
    return board.select("arm", F.round("primary", 6).alias("exact"), F.round("tie", 6).alias("safe"), F.round("agreement", 6).alias("agreement"), "rank", "winner")


@query(f"""
WITH {_OUT}
SELECT arm, field, round(sum((NOT (joint AND same))::INT) / max(n_items), 6) AS disagreement
FROM pairs, n WHERE other = 'len' GROUP BY arm, field""")
def bakeoff_field_disagreement(spark: SparkSession, d: str) -> DataFrame:
    out = outputs(spark, d)
    return bakeoff.field_disagreement(out, "len", bakeoff.item_count(out)).select("arm", "field", F.round("disagreement", 6).alias("disagreement"))


@query(f"WITH {_OUT}, {_AGREE} SELECT arm, round(agreement, 6) AS agreement FROM agree")
def bakeoff_agreement(spark: SparkSession, d: str) -> DataFrame:
    return bakeoff.agreement(outputs(spark, d)).select("arm", F.round("agreement", 6).alias("agreement"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").drop("text"), "doc_id")


@query("""
WITH x AS (SELECT lang, quality = 1 AS t, n_chars >= 500 AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT lang, count(*) FILTER (t AND p) AS tp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn FROM x GROUP BY lang)
SELECT *, round((tp + tn) / (tp + fn + fp + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""")
def confusion_by_lang(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.confusion(labelled(spark, d), F.col("quality") == 1, F.col("n_chars") >= 500, ["lang"])
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query("""
WITH e AS (SELECT label, embedding[1]::DOUBLE AS s FROM embeddings),
g AS (SELECT l.label, e.label = l.label AS y, s FROM e, (SELECT DISTINCT label FROM embeddings) l),
r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0::DOUBLE AS r FROM g)
SELECT label, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg,
       round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc
FROM r GROUP BY label""")
def auc_by_label(spark: SparkSession, d: str) -> DataFrame:
    """One label against the rest, by the first coordinate."""
    out = metrics.one_against_rest_auc(table(spark, d, "embeddings"), "label", F.col("embedding")[0].cast("double"))
    return out.withColumn("auc", F.round("auc", 6))


_SCORES = "SELECT event_type, round(value)::DOUBLE AS s FROM events WHERE value IS NOT NULL"


@query(f"""
WITH x AS ({_SCORES}), c AS (SELECT event_type, s, count(*) AS n FROM x GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY s DESC) AS reached FROM c)
SELECT event_type, min(s) FILTER (reached <= 25) AS threshold, coalesce(max(reached) FILTER (reached <= 25), 0)::BIGINT AS fires FROM w GROUP BY event_type""")
def threshold_for_budget(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").where("value is not null").select("event_type", F.round("value").alias("s"))
    return metrics.budget_threshold(x, "s", 25, ["event_type"])


@query("""
WITH g AS (SELECT vec_id, round(embedding[1]::DOUBLE, 4) + CASE WHEN label < 5 THEN 0.15 ELSE 0 END AS c, round(embedding[2]::DOUBLE, 4) AS i, label < 5 AS y, vec_id % 3 <> 0 AS w FROM embeddings),
f AS (SELECT count(*) FILTER (i > 0.1) AS budget FROM g),
k AS (SELECT c, count(*) AS n FROM g GROUP BY c), t AS (SELECT c, sum(n) OVER (ORDER BY c DESC) AS reached FROM k),
th AS (SELECT min(c) AS thr FROM t, f WHERE reached <= budget),
m AS (SELECT g.*, coalesce(c >= thr, false) AS cf, i > 0.1 AS inf, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS rc, rank() OVER (ORDER BY i) + (count(*) OVER (PARTITION BY i) - 1) / 2 AS ri FROM g, th),
s AS (SELECT (SELECT budget FROM f) AS budget, count(*) FILTER (cf) AS fires, count(*) FILTER (w AND cf AND NOT inf) AS wins, count(*) FILTER (w AND inf AND NOT cf) AS losses,
             (sum(rc) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS ca,
             (sum(ri) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS ia FROM m),
p AS (SELECT *, CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda q: exp(lgamma(wins + losses + 1) - lgamma(q + 1) - lgamma(wins + losses - q + 1) - (wins + losses) * ln(2.0))))) END AS p FROM s)
SELECT budget::BIGINT AS budget, fires, wins, losses, round(p, 6) AS p, round(ca, 6) AS cell_auc, round(ia, 6) AS incumbent_auc, p < 0.05 AND wins > losses AS coverage_sig, fires <= budget AS budget_held, ca >= ia AS auc_not_regressed,
       p < 0.05 AND wins > losses AND fires <= budget AND ca >= ia AS promote FROM p""")
def corrected_gate(spark: SparkSession, d: str) -> DataFrame:
    """The candidate fires as often as the incumbent; coverage, budget and AUC decide."""
    e = table(spark, d, "embeddings")
    y = F.col("label") < 5
    g = e.select("vec_id", (F.round(F.col("embedding")[0].cast("double"), 4) + F.when(y, 0.15).otherwise(0.0)).alias("candidate"), F.round(F.col("embedding")[1].cast("double"), 4).alias("incumbent"), y.alias("y"), (F.col("vec_id") % 3 != 0).alias("warranted"))
    out = gates.corrected_gate(g, "candidate", "incumbent", F.col("y"), F.col("warranted"), 0.1, harmful_favors_incumbent=False)
    return out.select("budget", "fires", "wins", "losses", *[F.round(c, 6).alias(c) for c in ("p", "cell_auc", "incumbent_auc")], "coverage_sig", "budget_held", "auc_not_regressed", "promote")


def arm_diffs(spark: SparkSession, d: str) -> DataFrame:
    """(arm, item, diff): the exact field against the baseline's, as an integer."""
    out = outputs(spark, d).where("field = 'exact'")
    base = out.where("arm = 'len'").select("item", F.col("vnum").alias("base"))
    return out.where("arm <> 'len'").join(base, "item").select("arm", "item", (F.col("vnum") - F.col("base")).cast("int").alias("diff"))


@query(f"""
WITH {_OUT},
dif AS (SELECT a.arm, a.item, (a.vnum - b.vnum)::INT AS diff FROM outp a JOIN outp b ON a.item = b.item AND a.field = 'exact' AND b.field = 'exact' AND b.arm = 'len' WHERE a.arm <> 'len'),
o AS (SELECT arm, sum(diff) AS observed, count(*) AS n, avg(diff) AS mean_diff FROM dif GROUP BY arm),
c AS (SELECT item, block * 64 + k AS digit, ('0x' || substr(sha256(block || '|' || item), k + 1, 1))::INT AS bits FROM (SELECT DISTINCT item FROM dif), range(0, {-(-DRAWS // 256)}) t(block), range(0, 64) u(k)),
s AS (SELECT arm, digit, bits, sum(diff) AS diff FROM dif JOIN c USING (item) GROUP BY ALL),
f AS (SELECT arm, 4 * digit + j AS perm, sum(CASE WHEN (bits >> (3 - j)) & 1 = 0 THEN diff ELSE -diff END) AS total FROM s, range(0, 4) v(j) WHERE 4 * digit + j < {DRAWS} GROUP BY ALL),
p AS (SELECT f.arm, (count(*) FILTER (total >= observed) + 1) / {DRAWS + 1} AS p FROM f JOIN o ON f.arm = o.arm GROUP BY f.arm)
SELECT o.arm, n, round(mean_diff, 6) AS mean_diff, round(p, 6) AS p, mean_diff >= 0.01 AND p < 0.025 AS passed FROM o JOIN p ON o.arm = p.arm""")
def permutation_pvalue(spark: SparkSession, d: str) -> DataFrame:
    out = gates.permutation_gate(arm_diffs(spark, d), "item", "diff", DRAWS, ["arm"], F.lit(0.05 / 2), 0.01)
    return out.select("arm", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("p", 6).alias("p"), "passed")


@query(f"""
WITH {_OUT},
s AS (SELECT arm, item, vnum FROM outp WHERE field = 'exact'),
c AS (SELECT item, block * 16 + k AS boot, ('0x' || substr(sha256(block || '|' || item), 4 * k + 1, 4))::INT AS number FROM (SELECT DISTINCT item FROM s), range(0, {-(-DRAWS // 16)}) t(block), range(0, 16) u(k)),
w AS (SELECT item, boot, {" + ".join(f"(number >= {p})::INT" for p in gates.POISSON)} AS n FROM c WHERE boot < {DRAWS}),
m AS (SELECT arm, boot, sum(n * vnum) / sum(n) AS mean FROM w JOIN s USING (item) WHERE n > 0 GROUP BY ALL),
q AS (SELECT arm, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY arm),
a AS (SELECT arm, avg(mean) AS mean FROM m GROUP BY arm)
SELECT q.arm, round(q.low, 6) AS low, round(q.high, 6) AS high, q.low > i.high AND a.mean - ia.mean > 0.01 AS promote
FROM q JOIN a ON q.arm = a.arm, (SELECT * FROM q WHERE arm = 'len') i, (SELECT * FROM a WHERE arm = 'len') ia""")
def bootstrap_gate(spark: SparkSession, d: str) -> DataFrame:
    out = outputs(spark, d).where("field = 'exact'")
    q = gates.intervals(gates.bootstrap_means(out, "item", "vnum", DRAWS, ["arm"]), ["arm"])
    return gates.bootstrap_verdicts(q, "arm", "len", "max", 0.01).select("arm", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "promote")


@query("""
WITH c AS (SELECT lang, avg(n_chars) FILTER (quality = 1) AS ceiling, avg(n_chars) FILTER (quality = 0) AS floor FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang),
x AS (SELECT l.doc_id, d.lang, (n_chars - floor) / nullif(ceiling - floor, 0) AS v FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN c ON d.lang = c.lang)
SELECT doc_id, lang, round(CASE WHEN v IS NOT NULL THEN least(1.0, greatest(0.0, v)) END, 6) AS normalized FROM x""")
def calibration_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = labelled(spark, d)
    c = metrics.calibration(x, F.col("n_chars").cast("double"), F.col("quality") == 1, F.col("quality") == 0, ["lang"])
    v = metrics.normalized(F.col("n_chars").cast("double"), F.col("ceiling"), F.col("floor"))
    return x.join(c, "lang").select("doc_id", "lang", F.round(v, 6).alias("normalized"))


@query("""
WITH x AS (SELECT source, n_chars, CASE WHEN source <> 'web' OR d.doc_id % 2 = 0 THEN CASE quality * 2 + toxic WHEN 2 THEN 'author' WHEN 0 THEN 'foreign' WHEN 3 THEN 'style_swapped' ELSE 'topic_matched' END ELSE 'foreign' END AS arm FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
m AS (SELECT source, avg(n_chars) FILTER (arm = 'author') AS a, avg(n_chars) FILTER (arm = 'foreign') AS f, avg(n_chars) FILTER (arm = 'style_swapped') AS s, avg(n_chars) FILTER (arm = 'topic_matched') AS t FROM x GROUP BY source),
r AS (SELECT source, coalesce(a - f = 0 OR a - f IS NULL, true) AS refused, (a - s) / nullif(a - f, 0) AS drop_, (t - f) / nullif(a - f, 0) AS rise FROM m)
SELECT source, refused, round(drop_, 6) AS style_swap_drop, round(rise, 6) AS topic_match_inflation, round(greatest(drop_, rise), 6) AS leakage, coalesce(greatest(drop_, rise) > 0.5, false) AS violation FROM r""")
def topic_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Length as a score: does it follow the topic (toxicity) of texts of either style (quality)?"""
    names = F.create_map(*[F.lit(x) for x in (2, "author", 0, "foreign", 3, "style_swapped", 1, "topic_matched")])
    arm = F.when((F.col("source") != "web") | (F.col("doc_id") % 2 == 0), names[(F.col("quality") * 2 + F.col("toxic")).cast("int")]).otherwise("foreign")
    out = metrics.topic_leakage(labelled(spark, d), F.col("n_chars"), arm, ["source"])
    return out.select("source", "refused", *[F.round(c, 6).alias(c) for c in ("style_swap_drop", "topic_match_inflation", "leakage")], F.coalesce(F.col("leakage") > metrics.LEAKAGE_TOLERANCE, F.lit(False)).alias("violation"))


@query("""
WITH v AS (SELECT lang, ('0x' || right(sha256(doc_id || '|' || '11'), 1))::INT % 2 = 0 AS first, doc_id % 3 = 0 AS a, doc_id % 3 = 1 AS b FROM documents),
o AS (SELECT lang, CASE WHEN NOT a AND NOT b THEN 'tie' WHEN a = first THEN 'win' ELSE 'loss' END AS vote FROM v)
SELECT lang, count(*) FILTER (vote = 'win') AS wins, count(*) FILTER (vote = 'loss') AS losses, count(*) FILTER (vote = 'tie') AS ties,
       round(count(*) FILTER (vote = 'win') / count(*), 6) AS win_rate FROM o GROUP BY lang""")
def judge_coin_votes(spark: SparkSession, d: str) -> DataFrame:
    """A hash coin says which slot holds the candidate; votes for slots become wins, losses and ties."""
    x = table(spark, d, "documents")
    first = F.conv(F.right(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("11")).cast("binary"), 256), F.lit(1)), 16, 10).cast("int") % 2 == 0
    a, b = F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1
    vote = F.when(~a & ~b, "tie").when(a == first, "win").otherwise("loss")
    o = x.select("lang", vote.alias("vote"))
    n = {k: F.count_if(F.col("vote") == v) for k, v in (("wins", "win"), ("losses", "loss"), ("ties", "tie"))}
    return o.groupBy("lang").agg(*[c.alias(k) for k, c in n.items()], F.round(n["wins"] / F.count("*"), 6).alias("win_rate"))


_STUB = "CASE WHEN {0} = 'j3' OR length({1}) > length({2}) THEN 'a' WHEN length({1}) < length({2}) THEN 'b' ELSE 'tie' END"


@query(f"""
WITH x AS (SELECT doc_id, 'j' || doc_id % 7 AS judge, text AS candidate, substr(text, 1, 400) AS reference, ('0x' || right(sha256(doc_id || '|11'), 1))::INT % 2 = 0 AS first, doc_id % 3 AS cached FROM documents),
v AS (SELECT *, {_STUB.format("judge", "CASE WHEN first THEN candidate ELSE reference END", "CASE WHEN first THEN reference ELSE candidate END")} AS preferred FROM x),
w AS (SELECT *, CASE WHEN preferred = 'tie' THEN 'tie' WHEN (preferred = 'a') = first THEN 'win' ELSE 'loss' END AS vote FROM v),
n AS (SELECT judge, count(*) * 0.25 > 10 AS over FROM w WHERE cached <> 0 AND judge = 'j5' GROUP BY judge),
r AS (SELECT w.*, CASE judge WHEN 'j1' THEN 'same family' WHEN 'j2' THEN 'golden gate' WHEN 'j3' THEN 'garbage' WHEN 'j4' THEN 'no controls' WHEN 'j6' THEN 'unknown judge' END AS why, coalesce(over, false) AND cached <> 0 AS unpaid FROM w LEFT JOIN n USING (judge))
SELECT doc_id AS row_id, judge, CASE WHEN why IS NOT NULL OR unpaid THEN NULL WHEN cached = 0 THEN 'tie' ELSE vote END AS vote,
       CASE WHEN why IS NOT NULL OR unpaid THEN NULL WHEN cached = 0 THEN 'cache' ELSE 'bought' END AS origin, coalesce(why, CASE WHEN unpaid THEN 'spend' END) AS refusal FROM r""")
def judged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Texts against their beginnings before seven judges: one clears, the others fail at one stage each.

    The judge's model is a stub that prefers what is longer; that of j3 has gone wrong and always names slot a.
    """
    x = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.concat(F.lit("j"), (F.col("doc_id") % 7).cast("string")).alias("judge"), F.col("text").alias("candidate"), F.substring("text", 1, 400).alias("reference"))
    families = {"j0": "a", "j1": "g", "j2": "a", "j3": "a", "j4": "a", "j5": "a"}
    judges = spark.createDataFrame([(j, f, "p", f"m{j}", "s", 10.0 if j == "j5" else None) for j, f in families.items()], "judge string, family string, provider string, model string, verdict_schema string, max_usd double")
    golden = spark.createDataFrame([(j, j != "j2") for j in families], "judge string, green boolean")
    told = x.where(F.col("judge") != "j4").select("judge", F.col("row_id").cast("string").alias("row_id"), "candidate")
    controls = told.select("judge", "row_id", F.lit("paraphrase").alias("kind"), F.reverse("candidate").alias("candidate"), F.col("candidate").alias("reference"))
    controls = controls.unionByName(told.select("judge", "row_id", F.lit("garbage").alias("kind"), F.lit("").alias("candidate"), F.concat("candidate", F.lit(".")).alias("reference")))

    def ask(q: DataFrame) -> DataFrame:
        longer = F.length("slot_a") - F.length("slot_b")
        return q.withColumn("preferred", F.when((F.col("judge") == "j3") | (longer > 0), "a").when(longer < 0, "b").otherwise("tie"))

    key = lambda digest: lifecycle.vote_key(F.lit("p"), F.concat(F.lit("m"), "judge"), F.lit("s"), F.lit("v1"), F.lit(digest), F.col("row_id"), F.col("candidate"), F.col("reference"), F.lit(11))
    cache = x.where("row_id % 3 = 0").select(key("d1").alias("key"), F.lit("tie").alias("vote")).unionByName(x.where("row_id % 3 = 1").select(key("d0").alias("key"), F.lit("win").alias("vote")))
    cleared = judging.clearances(judges, controls, golden, ask, "g", 11)
    return judging.judged(x, cleared, cache, ask, ("v1", "d1"), 11, 0.25).select("row_id", "judge", "vote", "origin", "refusal")


@query(f"SELECT b.arm, b.rank, b.winner, b.winner AND b.arm <> 'len' AND coalesce(p.passed, false) AS passed_gate FROM ({ORACLES['bakeoff_leaderboard']}) b LEFT JOIN ({ORACLES['permutation_pvalue']}) p ON b.arm = p.arm")
def bakeoff_gated(spark: SparkSession, d: str) -> DataFrame:
    """The board, and whether the winner may be promoted."""
    g = gates.permutation_gate(arm_diffs(spark, d), "item", "diff", DRAWS, ["arm"], F.lit(0.05 / 2), 0.01)
    return bakeoff.gated(QUERIES["bakeoff_leaderboard"](spark, d), g, "len").select("arm", "rank", "winner", "passed_gate")
