"""Queries on texts: agreement, Markdown, sanitised lines, families, log markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import text as T
from trialframe.functions.expr import jaccard, word_hashes
from trialframe.plans.base import query, table

FAMILIES = {"brand": "brand", "part": "part", "steel": "metal", "copper": "metal", "brass": "metal", "tin": "metal", "nickel": "metal"}
MARKERS = ("the and", "apache license", "disgusting")


@query("""
WITH e AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '\\s+'), lambda w: w <> '')) AS w FROM documents)
SELECT a.doc_id, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(a.w || b.w)), 0), 1), 6) AS similarity,
       coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(a.w || b.w)), 0), 1) >= 0.6 AS agree FROM e a JOIN e b ON b.doc_id = a.doc_id + 1""")
def jaccard_agreement(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", word_hashes(F.col("text")).alias("w"))
    nxt = e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    s = jaccard(F.col("w"), F.col("v"))
    return e.join(nxt, "doc_id").select("doc_id", F.round(s, 6).alias("similarity"), (s >= 0.6).alias("agree"))


_MD = (
    "chr(9) || '# ' || url || chr(13) || chr(10) || '**page** `' || page_id || '`' || chr(13) || '| **a | b** |' || chr(10) || '|---|:-:|' || chr(10) || '| _x_ |' || chr(9) || page_id || ' |' || chr(10)"
    " || '  ~~~ sql' || chr(10) || ' **raw** | ' || page_id || chr(10) || '   ' || chr(10) || '```' || chr(10) || CASE WHEN page_id % 2 = 0 THEN '  ### *even*  ' || chr(10) || '~~~' || chr(10) || '#open' ELSE '####### odd' END"
)


@query(f"""
WITH m AS (SELECT page_id, string_split(regexp_replace({_MD}, '\\r\\n|[\\n\\r]', chr(10), 'g'), chr(10)) AS ls FROM pages),
l AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM m),
n AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM l),
o AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM n),
c AS (SELECT page_id, k, line, bare, inside, list_filter(list_transform(string_split(bare, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS cells FROM o WHERE NOT fence),
r AS (SELECT page_id, k, line, bare, inside, CASE WHEN contains(bare, '|') THEN CASE WHEN len(list_filter(cells, lambda x: NOT regexp_full_match(x, ':?-+:?'))) = 0 THEN '' ELSE array_to_string(cells, ' ') END
                               ELSE regexp_replace(bare, '^#{{1,6}}\\s+', '') END AS t FROM c),
s AS (SELECT page_id, k, inside, line, bare, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '__(.+?)__', '\\1', 'g'), '\\*(.+?)\\*', '\\1', 'g'), '_(.+?)_', '\\1', 'g'), '`(.+?)`', '\\1', 'g') AS t FROM r)
SELECT page_id, string_agg(CASE WHEN inside THEN line ELSE t END, chr(10) ORDER BY k) AS plain FROM s WHERE CASE WHEN inside THEN bare ELSE t END <> '' GROUP BY page_id""")
def markdown_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages wrapped as Markdown, and back to plain text."""
    md = F.expr(_MD)
    return table(spark, d, "pages").select("page_id", T.strip_markdown(md).alias("plain"))


@query("""
WITH x AS (SELECT doc_id, regexp_replace(text, '[\\r\\n\\x{2028}\\x{2029}]', '⏎', 'g') AS t FROM documents),
y AS (SELECT doc_id, replace(regexp_replace(t, '[\\p{Cc}\\p{Cf}]', ' ', 'g'), '`', '''') AS t FROM x)
SELECT doc_id, CASE WHEN length(t) > 240 THEN substr(t, 1, 239) || '…' ELSE t END AS line FROM y""")
def sanitize_history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.sanitize_history(F.col("text")).alias("line"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items())


@query(f"""
WITH x AS (SELECT p_partkey, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z]+'), lambda w: CASE w {_CASES} END), lambda f: f IS NOT NULL)) AS f FROM part)
SELECT p_partkey, CASE WHEN len(f) = 1 THEN f[1] END AS family FROM x""")
def family_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.family_of(F.concat_ws(" ", "p_name", "p_type"), FAMILIES).alias("family"))


@query("SELECT lang, count(*) AS logs, count(*) FILTER (" + " OR ".join(f"contains(lower(text), '{m}')" for m in MARKERS) + ") AS infra FROM documents GROUP BY lang")
def infra_log_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("logs"), F.count_if(T.infrastructure_failure(F.col("text"), MARKERS)).alias("infra"))
