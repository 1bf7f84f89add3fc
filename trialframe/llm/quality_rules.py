"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every statistic of a text is an expression over its words and lines, so a table of thresholds becomes a single
Spark projection: no user function runs and nothing is shuffled.

Defined results: a null or empty text has no words, fails the word count and is not kept. Very long texts are handled
whole. Repeated rows and ties are independent, as a row depends on its own text only. Of an empty table the result is
empty. Other columns of the input pass through `with_quality` untouched, except those whose names it writes, which it
replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import SPACE_RE, WORD_SPACE, table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they "
    "this to was were which with you "
    "als am auch auf aus bei das dem den der des die ein eine einen er es für ich im ist mit nicht sich sie sind und "
    "von war werden wie zu zum "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas pour que "
    "qui sa se ses son sur un une "
    "al como con del el ella entre era es esta este fue ha la las lo los más me mi muy no o para pero por que se sin "
    "sobre su sus un una y"
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Reject where the statistic lies below low or above high."""

    statistic: str
    low: float | None = None
    high: float | None = None


#: Documents below ten words, or with over a fifth of their words in repeated five-word windows, fail at once.
BASE = (Rule("n_words", low=10), Rule("repeat_percent_of_words", high=20))
RULES = (
    Rule("mean_word_length", low=2.0, high=14.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.01),
    Rule("alphabetic_word_ratio", low=0.7),
    Rule("exclaimed_word_ratio", high=0.3),
    Rule("adjacent_repeat_ratio", high=0.4),
    Rule("upper_letter_ratio", high=0.4),
    Rule("duplicate_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more, each counted once."""
    n = F.size(words)

    def marked(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            same = lambda k, j: F.get(p, k)["h"] == F.get(p, j)["h"]
            hit = F.filter(
                F.sequence(F.lit(0), F.size(p) - 1),
                lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
            )
            starts = F.sort_array(F.transform(hit, lambda k: F.get(p, k)["i"]))
            return _let(
                starts,
                lambda s: F.aggregate(
                    F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(_let(pairs, covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    hashed = F.transform(words, lambda x: F.xxhash64(x))  # each word once, not once per window
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(_let(hashed, lambda h: _let(windows(h), marked)))


def statistics(text: Column) -> Column:
    """A struct of the counts of one text; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    bare = F.btrim(body, F.lit(WORD_SPACE))
    words = F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, SPACE_RE))
    stops = sorted(set(STOP_WORDS.split()))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    count = lambda items, test: F.size(F.filter(items, test)).cast("long")
    chars = lambda found: (F.length(body) - F.length(F.regexp_replace(body, found, ""))).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            count(w, lambda x: F.lower(x).isin(stops)).alias("n_stop_words"),
            count(w, lambda x: x.rlike("\\p{L}")).alias("n_alphabetic_words"),
            count(w, lambda x: F.endswith(x, F.lit("!"))).alias("n_exclaimed_words"),
            F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("long").alias("n_adjacent_repeats"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            count(x, lambda y: y.rlike("^[\\x20\\x09-\\x0D]*[-*•]")).alias("n_bullet_lines"),
            count(x, lambda y: y.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$")).alias("n_ellipsis_lines"),
        )

    return F.struct(
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(body, SPACE_RE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        chars("\\p{Lu}+").alias("n_upper"),
        chars("\\p{L}+").alias("n_letters"),
    )


def compiled(s: Column) -> dict[str, Column]:
    """The statistics that rules can name; a ratio with nothing to divide by is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    w, l = s["w"], s["l"]  # noqa: E741
    return {
        "n_words": w["n_words"],
        "repeat_percent_of_words": F.coalesce(F.try_divide(w["n_repeat_words"] * 100, w["n_words"]), F.lit(0.0)),
        "mean_word_length": ratio(s["word_chars"], w["n_words"]),
        "symbols_per_word": ratio(s["n_symbols"], w["n_words"]),
        "stop_word_ratio": ratio(w["n_stop_words"], w["n_words"]),
        "alphabetic_word_ratio": ratio(w["n_alphabetic_words"], w["n_words"]),
        "exclaimed_word_ratio": ratio(w["n_exclaimed_words"], w["n_words"]),
        "adjacent_repeat_ratio": ratio(w["n_adjacent_repeats"], w["n_words"]),
        "upper_letter_ratio": ratio(s["n_upper"], s["n_letters"]),
        "duplicate_line_ratio": ratio(l["n_dup_lines"], l["n_lines"]),
        "bullet_line_ratio": ratio(l["n_bullet_lines"], l["n_lines"]),
        "ellipsis_line_ratio": ratio(l["n_ellipsis_lines"], l["n_lines"]),
    }


def rejects(rules, stats: dict[str, Column]) -> Column:
    """True where any rule of the table rejects."""
    out = F.lit(False)
    for r in rules:
        if r.low is not None:
            out = out | (stats[r.statistic] < F.lit(r.low))
        if r.high is not None:
            out = out | (stats[r.statistic] > F.lit(r.high))
    return out


def with_quality(df: DataFrame, text: str = "text", rules=RULES, base=BASE, into: str = "quality_verdict") -> DataFrame:
    """df with a struct column of all counts, base_failed and kept."""
    held = df.withColumn(into, statistics(F.col(f"`{text}`")))
    s = F.col(f"`{into}`")
    stats = compiled(s)
    failed = rejects(base, stats)
    return held.withColumn(
        into,
        F.struct(
            s["w"]["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"),
            *[c.alias(k) for k, c in stats.items() if k != "n_words"],
            failed.alias("base_failed"), (~failed & ~rejects(rules, stats)).alias("kept"),
        ),
    )


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that all rules accept, with the columns of df."""
    into = "__quality_rules"
    return with_quality(df, text, rules, into=into).where(F.col(into)["kept"]).drop(into)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("quality_verdict")
    return with_quality(docs).select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM s WHERE len(w) > 5),
h AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS win FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM h) WHERE n > 1),
c AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n_repeat
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
m AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS alpha,
         len(list_filter(w, lambda x: suffix(x, '!'))) AS excl, len(list_filter(w, lambda x, i: x = w[i - 1])) AS adjacent,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS up, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters,
         len(l) AS lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ell
  FROM s LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 14, false) AND n_symbols / n_words <= 0.1
       AND stops / n_words >= 0.01 AND alpha / n_words >= 0.7 AND excl / n_words <= 0.3 AND adjacent / n_words <= 0.4
       AND coalesce(up / nullif(letters, 0), 0) <= 0.4 AND coalesce(n_dup_lines / nullif(lines, 0), 0) <= 0.5
       AND coalesce(bullets / nullif(lines, 0), 0) <= 0.9 AND coalesce(ell / nullif(lines, 0), 0) <= 0.3 AS kept
FROM b
"""
