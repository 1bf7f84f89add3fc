"""Source divergence audit: how far the sources of a language differ in their words, by a frequent-pattern tree.

Of each kept term, a language has a row of nonzero counts in the order of its sources. The value of a pair of sources is
a sum over all kept terms, and most counts are zero. So all pairs start from the sum that they would have if one of the
two had no term, which follows from each source's histogram of counts; what is to be corrected are the pairs of nonzero
counts in one row. Rows are inserted into a prefix tree, equal beginnings once with their multiplicity, and each node
adds the correction of itself with each of its ancestors once, times its multiplicity. All numbers are integers.

Trees are built from ranges of the rows by their beginnings, so rows that begin alike meet, and a hot beginning is dealt
over several; a node that two ranges share is corrected in both with its part of the multiplicity. Rows of more than
`SLICE` sources are corrected in several parts. Work and memory of a task follow from its share of rows; the result
itself has every pair of sources of a language.

Defined results: null text, lang and source are empty strings, so they form groups like others. A group without terms
is reported in the pairs. A language without kept terms has pairs of the value 0 and no terms. Repeated rows are
documents of their own. Very long texts are counted whole. Equal values are ranked by their items in the order of UTF-8.
An empty table gives an empty result. Only the named columns are read, so others don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.llm.common import LOWER, durable, slices, small_batches, table

#: A language keeps the terms that at least so many of its documents have.
LEAST_DOCS = 3
#: Shares are given in parts of so many.
PARTS = 1_000_000_000
#: Ranks of terms that are reported for a group.
TOP_TERMS = 200
#: Counts held in one task before they are given to Spark, nodes of one row that one task corrects, sources of a block.
HELD_COUNTS, SLICE, BLOCK = 120_000, 512, 1024
#: Entries of rows in one tree, and pairs of nodes held before they are added up.
TREE_ENTRIES, HELD_PAIRS = 400_000, 2_000_000
#: Items of a row that choose its range.
HEAD = 4
#: Parts of a group whose first terms are found apart.
SALTS = 16

TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[0x41:0x5B] = TERM_BYTES[0x61:0x7B] = TERM_BYTES[0x80:] = True


def terms_of(texts: pa.Array):
    """(text index, code, terms) of slices of the texts; a code is a position in the slice's array of terms."""
    for lo, _, buf, offs in slices(texts):
        term = TERM_BYTES[buf]
        before = np.r_[False, term[:-1]] if len(term) else term
        before[offs[:-1][offs[:-1] < len(buf)]] = False
        starts = np.flatnonzero(term & ~before)
        if not len(starts):
            continue
        # The bytes of terms end to end; a term ends where the next one starts.
        data = LOWER[buf[term]]
        at = (np.cumsum(term) - 1)[starts]
        cuts = np.r_[at, len(data)].astype(np.int64)
        held = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        yield lo + np.searchsorted(offs, starts, "right") - 1, held.indices.to_numpy(), held.dictionary


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, and for each group one row with a null term."""
    given = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches):
        groups: dict[tuple, int] = {}
        held: list[pa.Table] = []
        rows = 0

        def merged():
            t = pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select(["g", "term", "n", "docs"])

        def sent(t: pa.Table):
            names = list(groups)
            langs, sources = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
            out = pa.table([langs.take(t.column("g")), sources.take(t.column("g")), t.column("term"), t.column("n"), t.column("docs")], schema=schema)
            yield from out.to_batches(max_chunksize=50_000)

        for batch in batches:
            of = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            for doc, code, terms in terms_of(batch.column(2)):
                width = len(terms)
                once, n = np.unique(doc * width + code, return_counts=True)
                key = of[once // width] * width + once % width
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                held.append(pa.table({
                    "g": key[first] // width, "term": terms.cast(pa.string()).take(pa.array(key[first] % width)),
                    "n": np.add.reduceat(n, first), "docs": np.diff(np.r_[first, len(key)]),
                }))
                rows += len(first)
                if rows > 2 * HELD_COUNTS:
                    held = [merged()]
                    rows = held[0].num_rows
                    if rows > HELD_COUNTS:
                        yield from sent(held[0])
                        held, rows = [], 0
        if held:
            yield from sent(merged())
        if groups:
            n = len(groups)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in groups]), pa.array([x for _, x in groups]), pa.nulls(n, pa.string()), pa.array([0] * n), pa.array([0] * n)], schema=schema)

    counts = given.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, all_: Column, v: Column) -> Column:
    """1 + floor(PARTS * (n + 1) / (all + v)), exact for any counts; 1 where a language keeps no term."""
    held = F.when(v > 0, all_ + v).otherwise(F.lit(1))
    parts = F.lit(PARTS).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)")
    return F.when(v > 0, F.call_function("div", parts, held.cast("decimal(20,0)")) + 1).otherwise(F.lit(1)).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same, in tasks: below 2**63, as p and q are at most PARTS + 1."""
    return (p - q) ** 2 // q


def kept_counts(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts of the terms that a language keeps, with its total; rows of groups (null term) stay."""
    w = Window.partitionBy("lang", "term")
    held = counts.withColumns({"total": F.sum("n").over(w), "in_docs": F.sum("docs").over(w), "first": F.col("source") == F.min("source").over(w)})
    return held.where((F.col("in_docs") >= least_docs) | F.col("term").isNull()).drop("in_docs", "docs")


def group_table(kept: DataFrame) -> DataFrame:
    """(lang, source, i, n_all, v, lang_all, p0): a row per group; i is its place among the sources of its language."""
    each = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.sum((F.col("first") & F.col("term").isNotNull()).cast("long")).alias("firsts"))
    of = each.groupBy("lang").agg(F.sum("firsts").alias("v"), F.sum("n_all").alias("lang_all"))
    held = each.join(of, "lang").withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    return held.select("lang", "source", "i", "n_all", "v", "lang_all", share(F.lit(0), F.col("n_all"), F.col("v")).alias("p0"))


PAIRS_DDL = "lang string, a int, b int, value long"
PAIRS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def added(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(first) else value


def tree_pairs(offs: np.ndarray, i: np.ndarray, n: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray, part: np.ndarray):
    """(a << 32 | b, correction) of the tree of sorted rows, once for each node and ancestor.

    Rows lie end to end between offs; part says which SLICE of a row's nodes is asked for.
    """
    lens = np.diff(offs)
    rows = len(lens)
    # How many items a row has in common with the one before: those nodes are there already.
    common = np.zeros(rows, np.int64)
    live = np.flatnonzero(np.r_[False, part[1:] == part[:-1]])
    for j in range(int(lens.max(initial=0))):
        live = live[(lens[live] > j) & (lens[live - 1] > j)]
        x, y = offs[live] + j, offs[live - 1] + j
        live = live[(i[x] == i[y]) & (n[x] == n[y])]
        if not len(live):
            break
        common[live] = j + 1
    keys, values, held = [], [], 0
    for j in range(1, int(lens.max(initial=0))):
        sub = np.flatnonzero(lens > j)
        first = np.flatnonzero(common[sub] <= j)
        weight = np.add.reduceat(times[sub], first)
        node = sub[first]
        mine = part[node] == j // SLICE
        node, weight = node[mine], weight[mine]
        step = max(1, HELD_PAIRS // j)
        for lo in range(0, len(node), step):
            at, w = offs[node[lo : lo + step]], weight[lo : lo + step, None]
            up, me = (at[:, None] + np.arange(j)), (at + j)[:, None]
            a, b, a0, b0 = p[up], p[me], p0[up], p0[me]
            forth = squares(a, b) - squares(a, b0) - squares(a0, b) + squares(a0, b0)
            back = squares(b, a) - squares(b, a0) - squares(b0, a) + squares(b0, a0)
            keys += [((i[up] << 32) | i[me]).ravel(), ((i[me] << 32) | i[up]).ravel()]
            values += [(forth * w).ravel(), (back * w).ravel()]
            held += 2 * forth.size
            if held > HELD_PAIRS:
                k, v = added(np.concatenate(keys), np.concatenate(values))
                keys, values, held = [k], [v], 0
    return added(np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) of rows (lang, path of (i, n, p, p0), times), from one tree after the other of sorted ranges."""
    parts = F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(path) - 1) div {SLICE} as int)")))
    dealt = rows.where("size(path) > 1").select("lang", parts.alias("part"), "path", "times")
    # Ranges by short keys, as Spark samples them on the driver: the first items, then a hash that splits a hot beginning.
    head = F.transform(F.slice("path", 1, HEAD), lambda x: F.shiftleft(x["i"].cast("long"), 40) + x["n"])
    dealt = dealt.repartitionByRange("lang", "part", head, F.xxhash64("path")).sortWithinPartitions("lang", "part", "path")

    def correct(batches):
        def sent(lang, batch_rows):
            path = pa.concat_arrays([b.column(2) for b in batch_rows])
            items = path.flatten()
            offs = np.r_[0, np.cumsum(path.value_lengths().to_numpy(zero_copy_only=False))]
            i, n, p, p0 = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            times, part = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batch_rows]).astype(np.int64) for k in (3, 1))
            key, value = tree_pairs(offs, i, n, p, p0, times, part)
            for lo in range(0, len(key), 50_000):
                k = key[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(value[lo : lo + 50_000])], schema=PAIRS)

        held, entries, now = [], 0, None
        for batch in batches:
            langs = batch.column(0).to_pylist()
            cuts = [0, *[k for k in range(1, len(langs)) if langs[k] != langs[k - 1]], len(langs)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if held and (langs[lo] != now or entries > TREE_ENTRIES):
                    yield from sent(now, held)
                    held, entries = [], 0
                now = langs[lo]
                held.append(batch.slice(lo, hi - lo))
                entries += len(held[-1].column(2).flatten())
        if held:
            yield from sent(now, held)

    return dealt.mapInArrow(correct, PAIRS_DDL)


def starts(hist: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the sums that pairs would have if no term had a nonzero count in both.

    Each source with its histogram meets the others of its language in blocks, as their number of results asks for.
    """
    own = hist.groupBy("lang", "i").agg(F.collect_list(F.struct("p", "times")).alias("counts"))
    held = groups.select("lang", "i", "p0", "v").join(own, ["lang", "i"], "left")
    block = groups.groupBy("lang", F.expr(f"i div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("i", "p0")).alias("others")).drop("block")

    def pairs(batches):
        for batch in batches:
            for lang, i, p0, v, counts, others in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5), strict=True):
                with_ = others.values.flatten()
                j, q0 = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in with_)
                forth = v * squares(np.int64(p0), q0)
                back = np.zeros(len(j), np.int64)
                if counts.is_valid:
                    p, times = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in counts.values.flatten())
                    for lo in range(0, len(p), 1000):
                        a, w, b = p[None, lo : lo + 1000], times[None, lo : lo + 1000], q0[:, None]
                        forth += ((squares(a, b) - squares(np.int64(p0), b)) * w).sum(axis=1)
                        back += ((squares(b, a) - squares(b, np.int64(p0))) * w).sum(axis=1)
                one = j != i
                here, there = np.full(one.sum(), i, np.int32), j[one].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (2 * len(here)), pa.string()), pa.array(np.r_[here, there]), pa.array(np.r_[there, here]), pa.array(np.r_[forth[one], back[one]])], schema=PAIRS)

    return held.join(block, "lang").select("lang", "i", "p0", "v", "counts", "others").mapInArrow(pairs, PAIRS_DDL)


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and the terms that a source has more of than its language."""
    small_batches(df.sparkSession)
    kept = durable(kept_counts(term_counts(df, text, lang, source), least_docs))
    groups = durable(group_table(kept))
    p = share(F.col("n"), F.col("n_all"), F.col("v"))
    held = durable(kept.where("term is not null").join(groups, ["lang", "source"]).select("lang", "source", "term", "i", "n", "p0", p.alias("p"), share(F.col("total"), F.col("lang_all"), F.col("v")).alias("q")))
    # Equal rows of terms are one, with their number: what the tree would find at its leaves.
    rows = held.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("i", "n", "p", "p0"))).alias("path"))
    rows = durable(rows.groupBy("lang", "path").agg(F.count("*").alias("times")))
    hist = held.groupBy("lang", "i", "p").agg(F.count("*").alias("times"))
    sums = starts(hist, groups).union(corrections(rows)).groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    name = lambda k, n: groups.select("lang", F.col("i").alias(k), F.col("source").alias(n))
    pairs = sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    order = [F.desc("value"), F.asc("item")]
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    # The first terms of each part of a group, then of the group: a hot group is split.
    more = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(*order)
    more = more.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    more = more.withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.union(more)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and characteristic terms of every language and source."""
    return divergence(table(spark, sf_dir, "documents"))


_UPPER = "".join(map(chr, range(65, 91)))
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM d GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
l AS (SELECT lang, sum(n) AS n_all, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, sum(c.n) AS n_all FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT g.*, coalesce(n.n_all, 0) AS n_all FROM g LEFT JOIN n USING (lang, source)),
p AS (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n,
         1 + ({PARTS}::HUGEINT * (coalesce(c.n, 0) + 1)) // (m.n_all + l.v) AS p, 1 + ({PARTS}::HUGEINT * (k.n + 1)) // (l.n_all + l.v) AS q
  FROM m JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
