"""Line dedup: overlapping windows of three consecutive lines, found globally; later occurrences are removed.

Lines of more than `SHORT_LINE` words are folded first, so that a passage inside a paragraph is found as well. Where a
fold ends depends on the words around it only: after each word whose value (a number from its bytes) is the least among
the `REACH` words before and after it in its line, the first of equals. Two copies of a passage thus fold alike from
`REACH` words after their beginnings on, wherever they stand. Where no word ends a fold, as in runs of one word, every
`LONG_FOLD` words are one.

A window is a 64-bit hash of three consecutive folded lines, and of as many more as it takes to reach `LEAST_WORDS` words
(a word of 24 bytes or more counts as one per 12 bytes, so that scripts without spaces are covered): passages of very
short lines have windows too. Its first occurrence is the one in the document with the smallest id, and there the first.
All others are later ones; the lines that any later window covers are removed. A line that loses all its parts goes with
its line feed; of others the remaining words are joined by a space; untouched lines stay as they are, byte for byte.

Spark sees (window, document) once per pair, counted with partial sums, so that a window in a third of the documents
is no large group; which windows repeat is written to the shared folder and joined back as a plain join, whose skewed
side Spark can split. The windows to remove come back to their documents by a plain join on the id.

Defined results: null and empty texts, and texts of fewer than three folded lines or of fewer than ten words, stay. Rows with a null id stay and
nothing is removed for their sake. Rows that share an id count as one document: nothing of one is removed for the
other, unless it repeats within itself. Very long texts are handled whole. Columns other than the text stay, whatever
their names, but for n_lines and n_removed, which are set. Windows are told apart up to collisions of their hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import durable, mix, powers, slices, small_batches, span_hashes, table, word_spans

WINDOW = 3
LEAST_WORDS = 10
SHORT_LINE, REACH, LONG_FOLD = 8, 3, 16
#: Bytes of which each counts a word, for words of twice as many or more.
WORD_BYTES = 12


def run_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run of hashes, from first to last inclusive."""
    up, down = powers(len(h) + 1)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=c[1:])
    return mix((c[last + 1] - c[first]) * down[first])


@dataclass
class Folded:
    """A run of texts: words by fold, folds by text, and the windows that count (key, first and last fold)."""

    buf: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    line: np.ndarray
    fold: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    first: np.ndarray
    last: np.ndarray


def folded(buf: np.ndarray, offs: np.ndarray, hashed: bool = True) -> Folded:
    """The folds of texts, and their windows if these are asked for."""
    starts, ends, doc = word_spans(buf, offs)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Folded(buf, offs, starts, ends, none, none, none, np.zeros(0, np.uint64), none, none)
    feeds = np.r_[0, np.cumsum(buf == 10)]
    line = feeds[starts]
    head = np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]
    own = np.cumsum(head) - 1
    total = np.r_[0, np.cumsum(buf, dtype=np.int64)]
    size = ends - starts
    value = ((total[ends] - total[starts]) * 7919 + size * 104729) % 10007
    stop = np.bincount(own)[own] > SHORT_LINE
    for j in range(1, REACH + 1):
        near = own[j:] == own[:-j]
        stop[j:] &= ~near | (value[j:] < value[:-j])
        stop[:-j] &= ~near | (value[:-j] <= value[j:])
    index = np.arange(len(starts))
    began = np.maximum.accumulate(np.where(head | np.r_[True, stop[:-1]], index, 0))
    stop |= (index - began) % LONG_FOLD == LONG_FOLD - 1
    stop |= np.r_[head[1:], True]
    fold = np.cumsum(np.r_[False, stop[:-1]])
    last_word = np.flatnonzero(stop)
    first_word = np.r_[0, last_word[:-1] + 1]
    if not hashed:
        return Folded(buf, offs, starts, ends, line, fold, doc[first_word], np.zeros(0, np.uint64), none, none)
    h = run_hashes(span_hashes(buf, starts, ends), first_word, last_word)
    units = np.cumsum(np.maximum(size // WORD_BYTES, 1))
    reached = units[last_word]
    before = np.r_[0, reached[:-1]]
    n = len(h)
    first = np.arange(n)
    last = np.maximum(first + WINDOW - 1, np.searchsorted(reached, before + LEAST_WORDS))
    fold_doc = doc[first_word]
    use = last < n
    use[use] = fold_doc[last[use]] == fold_doc[first[use]]
    first, last = first[use], last[use]
    return Folded(buf, offs, starts, ends, line, fold, fold_doc, run_hashes(h, first, last), first, last)


def runs(texts, hashed: bool = True) -> Iterator[tuple[int, int, Folded]]:
    for lo, hi, buf, offs in slices(texts):
        yield lo, hi, folded(buf, offs, hashed)


def window_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(window, id, again) once for each pair; again: it occurs twice or more in that text."""

    def rows(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, x in runs(b.column(1)):
                d = x.doc[x.first]
                order = np.lexsort((x.key, d))
                k, d = x.key[order], d[order]
                start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else d
                again = np.diff(np.r_[start, len(k)]) > 1
                yield pa.RecordBatch.from_arrays([pa.array(k[start].view(np.int64)), pa.array(ids[lo + d[start]]), pa.array(again)], names=["w", "i", "again"])

    known = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    return known.mapInArrow(rows, "w long, i long, again boolean")


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(i, later, again): windows of document i that occurred in an earlier one, and those that repeat in it first."""
    small_batches(docs.sparkSession)
    rows = durable(window_rows(docs, id_col, text))
    repeated = rows.groupBy("w").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.max("again").alias("any")).where("n > 1 or any")
    repeated = durable(repeated.select("w", "first"))
    hits = rows.join(repeated, "w").where("i <> first or again")
    mine = F.col("i") == F.col("first")
    return hits.groupBy("i").agg(F.collect_list(F.when(~mine, F.col("w"))).alias("later"), F.collect_list(F.when(mine, F.col("w"))).alias("again"))


def rebuilt(x: Folded, d: int, text: str, later: np.ndarray, again: np.ndarray) -> tuple[str, int]:
    """Text d of a run without the covered lines, and their number."""
    lo, hi = np.searchsorted(x.doc[x.first], [d, d + 1])
    key = x.key[lo:hi].view(np.int64)
    gone = np.isin(key, later)
    for w in again:
        gone[np.flatnonzero(key == w)[1:]] = True
    if not gone.any():
        return text, 0
    base, end = np.searchsorted(x.doc, [d, d + 1])
    step = np.zeros(end - base + 1, np.int64)
    np.add.at(step, x.first[lo:hi][gone] - base, 1)
    np.add.at(step, x.last[lo:hi][gone] - base + 1, -1)
    cover = np.cumsum(step[:-1]) > 0
    w0, w1 = np.searchsorted(x.fold, [base, end])
    out = cover[x.fold[w0:w1] - base]
    line = x.line[w0:w1] - int((x.buf[: x.offs[d]] == 10).sum())
    raw: list[str | None] = list(text.split("\n"))
    for k in np.unique(line[out]).tolist():
        kept = w0 + np.flatnonzero((line == k) & ~out)
        raw[k] = " ".join(bytes(x.buf[x.starts[j] : x.ends[j]]).decode() for j in kept.tolist()) if len(kept) else None
    return "\n".join(r for r in raw if r is not None), int(cover.sum())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later occurrences removed from the text, and n_lines (folded lines before) and n_removed."""
    own = "d" + uuid.uuid4().hex  # no column of docs has such a name
    i, later_, again_, cut_ = (f"{own}_{c}" for c in ("i", "later", "again", "cut"))
    gone = removals(docs, id_col, text).toDF(i, later_, again_)

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(t: pd.Series, later: pd.Series, again: pd.Series) -> pd.DataFrame:
        texts = [v if isinstance(v, str) else None for v in t]
        n_lines, n_removed = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        hit = later.notna().to_numpy()
        for hashed in (False, True):  # texts that keep all their lines need no windows
            own = np.flatnonzero(hit == hashed)
            for lo, hi, x in runs(pa.array([texts[j] for j in own], pa.large_string()), hashed):
                n_lines[own[lo:hi]] = np.bincount(x.doc, minlength=hi - lo)
                for k in range(lo, hi) if hashed else ():
                    j = own[k]
                    if n_lines[j]:
                        texts[j], n_removed[j] = rebuilt(x, k - lo, texts[j], np.asarray(later.iloc[j], np.int64), np.asarray(again.iloc[j], np.int64))
        return pd.DataFrame({"text": texts, "n_lines": n_lines, "n_removed": n_removed})

    cut = cut.asNondeterministic()  # else a filter on its result would run it a second time
    held = docs.drop("n_lines", "n_removed")
    joined = held.join(gone, F.col(f"`{id_col}`") == F.col(i), "left").withColumn(cut_, cut(F.col(f"`{text}`"), later_, again_))
    return joined.withColumns({c: F.col(cut_)[k] for c, k in ((text, "text"), ("n_lines", "n_lines"), ("n_removed", "n_removed"))}).drop(i, later_, again_, cut_)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
  FROM documents),
a AS (SELECT doc_id, ln, unnest(x) AS word, generate_subscripts(x, 1) AS k, len(x) AS n FROM (SELECT doc_id, ln, regexp_extract_all(line, '[^ 	-
]+') AS x FROM l)),
sums AS (
  SELECT word, (list_sum(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)) * 7919 + strlen(word) * 104729) % 10007 AS v,
         greatest(1, strlen(word) // {WORD_BYTES}) AS u
  FROM (SELECT DISTINCT word FROM a)),
b AS (
  SELECT doc_id, ln, k, n, word, u,
         n > {SHORT_LINE} AND v < coalesce(min(v) OVER (o ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING), 10007)
                AND v <= coalesce(min(v) OVER (o ROWS BETWEEN 1 FOLLOWING AND {REACH} FOLLOWING), 10007) AS stop
  FROM a JOIN sums USING (word) WINDOW o AS (PARTITION BY doc_id, ln ORDER BY k)),
s AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id, ln ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM b),
f AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, ln, seg ORDER BY k) - 1) // {LONG_FOLD} AS sub FROM s),
q AS (
  SELECT doc_id, ln, part, u, row_number() OVER d AS pos, sum(u) OVER d AS upto
  FROM (SELECT doc_id, ln, seg, sub, string_agg(word, ' ' ORDER BY k) AS part, sum(u) AS u FROM f GROUP BY ALL)
  WINDOW d AS (PARTITION BY doc_id ORDER BY ln, seg, sub)),
e AS (
  SELECT x.doc_id, x.pos, min(y.pos) AS last
  FROM q x JOIN q y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.pos + {WINDOW - 1} AND x.pos + {LEAST_WORDS - 1} AND y.upto >= x.upto - x.u + {LEAST_WORDS} GROUP BY ALL),
parts AS (SELECT doc_id, list(part ORDER BY pos) AS parts FROM q GROUP BY doc_id),
u AS (SELECT e.doc_id, pos, last, array_to_string(parts[pos:last], chr(10)) AS win FROM e JOIN parts ON e.doc_id = parts.doc_id),
g AS (SELECT doc_id, pos, last FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM u) WHERE rn > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM g),
k AS (
  SELECT q.doc_id, ln, bool_or(c.pos IS NOT NULL) AS touched, string_agg(part, ' ' ORDER BY q.pos) FILTER (c.pos IS NULL) AS rest
  FROM q LEFT JOIN c ON q.doc_id = c.doc_id AND q.pos = c.pos GROUP BY q.doc_id, ln),
t AS (
  SELECT l.doc_id, string_agg(CASE WHEN coalesce(touched, false) THEN rest ELSE line END, chr(10) ORDER BY l.ln) AS text
  FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.ln = k.ln GROUP BY l.doc_id),
n AS (SELECT q.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed FROM q LEFT JOIN c ON q.doc_id = c.doc_id AND q.pos = c.pos GROUP BY q.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
