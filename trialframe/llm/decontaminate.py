"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are lower-cased runs of letters and digits. An item of L words is represented by SimHashes (64 bits over word
pairs) of its first, middle and last C words, where C is the largest window size of a fixed ladder below L (so that an
edit at one edge leaves a window without it); longer items get windows along their length. Of every text, all windows
of each size in use are hashed. Fingerprints are cut into four blocks of 16 bits: two that differ in at most `RADIUS` =
11 bits differ in at most two bits in some block, so tables of all 16-bit values within two bits of an item's block find
every pair within the radius. Each such pair is verified: the text's window of L words at that place and the item must
have a weighted Jaccard similarity of their five-word shingles (with multiplicity) of at least `SIMILARITY`. A shingle
of the item weighs the logarithm of its rarity among all items, any other shingle as much as the rarest.

Spark counts the shingles over the whole benchmark and joins each item with the weights of its own. The index of at most
about `BLOCK_WINDOWS` fingerprints is broadcast at a time, whatever the benchmark's size. One block scores texts in
place, without a shuffle. Of several blocks each is scanned and its hits written before the next is made; a hit's
similarity is the same in any division into blocks.

Defined results: null and empty texts, and null or short items (below `LEAST_WORDS` words), match nothing. Equal items
are all reported, repeated rows of an item once. Of several places in a text that with the largest similarity, then the
first, is reported. Repeated rows and very long texts are scanned alike; extra columns stay, whatever their names, but
for the one that is written. An empty benchmark or table gives no match.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import _SLOT, durable, mix, shingle_hashes, slices, small_batches, span_hashes, table
from trialframe.llm.toxicity import _WORD, lowered

SIZES = (8, 10, 12, 14, 17, 20, 24, 29, 35, 42, 50, 60, 72, 86, 103, 124)
LEAST_WORDS = SIZES[0]
RADIUS = 11
BLOCK_BITS, BLOCK_TOLERANCE = 16, 2
SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints in one block of the benchmark, of about 5 KB each in a worker.
BLOCK_WINDOWS = 12_000
#: Windows whose counts are held at once, so that they stay in a core's cache.
STEP = 2048
_BYTES, _GATHER = np.uint64(0x0101010101010101), np.uint64(0x8040201008040201)
HITS = "array<struct<item_id:long,similarity:double,start_word:int,words:int>>"


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _WORD[buf]
    after = np.r_[False, word[:-1]]
    after[offs[:-1][offs[:-1] < n]] = False
    before = np.r_[word[1:], False]
    last = offs[1:] - 1
    before[last[last >= 0]] = False
    starts = np.flatnonzero(word & ~after)
    return span_hashes(buf, starts, np.flatnonzero(word & ~before) + 1), np.searchsorted(offs, starts, "right") - 1


def pair_bits(words: np.ndarray) -> np.ndarray:
    """Running counts [n, 8] of each bit of the hashes of adjacent words, eight in one number, a byte each.

    Sums over all words carry from byte to byte; the difference of two, of fewer than 256 words, has its bytes apart."""
    pair = mix(words[:-1] * _SLOT[0] + words[1:] * _SLOT[1])
    bits = np.unpackbits(pair.view(np.uint8)).view(np.uint64).reshape(-1, 8)
    out = np.zeros((len(bits) + 1, 8), np.uint64)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def fingerprints(running: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of size words."""
    pairs = size - 1
    if len(running) <= pairs:
        return np.zeros(0, np.uint64)
    # A count above half reaches its byte's top bit; a product gathers the eight top bits in one byte, the first highest.
    out = np.empty((len(running) - pairs, 8), np.uint8)
    for lo in range(0, len(out), STEP):
        hi = min(lo + STEP, len(out))
        counts = running[lo + pairs : hi + pairs] - running[lo:hi]
        counts += _BYTES * np.uint64(127 - pairs // 2)
        counts >>= np.uint64(7)
        counts &= _BYTES
        counts *= _GATHER
        counts >>= np.uint64(56)
        out[lo:hi] = counts
    return out.view(np.uint64).ravel()


def near_blocks() -> np.ndarray:
    """All 16-bit masks of at most BLOCK_TOLERANCE bits."""
    v = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
    return v[np.bitwise_count(v) <= BLOCK_TOLERANCE]


@dataclass
class SizeIndex:
    """The fingerprints of one window size and, for each block and value, which of them come near."""

    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    starts: list[np.ndarray] = field(default_factory=list)
    some: list[np.ndarray] = field(default_factory=list)
    lists: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        masks = near_blocks()
        for b in range(64 // BLOCK_BITS):
            own = (self.prints >> np.uint64(b * BLOCK_BITS)).astype(np.uint16)
            value = (own[:, None] ^ masks[None, :]).ravel()
            who = np.repeat(np.arange(len(own), dtype=np.int32), len(masks))
            order = np.argsort(value, kind="stable")
            self.lists.append(who[order])
            self.starts.append(np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)))
            self.some.append(np.diff(self.starts[-1]) > 0)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, entry) within RADIUS."""
        found = []
        for b in range(64 // BLOCK_BITS):
            value = (prints >> np.uint64(b * BLOCK_BITS)).astype(np.uint16)
            hit = np.flatnonzero(self.some[b][value])
            value = value[hit].astype(np.int64)
            first = self.starts[b][value]
            n = self.starts[b][value + 1] - first
            win = np.repeat(hit, n)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who = self.lists[b][at]
            close = np.bitwise_count(prints[win] ^ self.prints[who]) <= RADIUS
            found.append(win[close] * len(self.prints) + who[close])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.prints), pair % len(self.prints)


def shingles(words: np.ndarray) -> Counter:
    return Counter(shingle_hashes(words, np.zeros(len(words), np.int64), SHINGLE)[0].tolist())


def places(n: int) -> tuple[int, list[int]]:
    """Size of the windows of an item of n words and where they begin."""
    size = max(s for s in SIZES if s < n or s == LEAST_WORDS)
    along = range(0, n - size, max(1, size // 2)) if n > SIZES[-1] * 1.2 else ()
    return size, sorted({0, (n - size) // 2, n - size, *along})


class Benchmark:
    """The index of some items, as a task uses it: their ids, word hashes, and weights by shingle."""

    def __init__(self, ids: list, words: list[np.ndarray], weights: list[dict[int, float]], rare: float):
        self.ids, self.words, self.weights, self.rare = ids, words, weights, rare
        self.shingles = [shingles(w) for w in words]
        rows: dict[int, list] = {}
        for k, w in enumerate(self.words):
            size, at = places(len(w))
            prints = fingerprints(pair_bits(w), size)
            rows.setdefault(size, []).extend((prints[p], k, p) for p in at)
        self.sizes = {s: SizeIndex(np.array([r[0] for r in v], np.uint64), np.array([r[1] for r in v]), np.array([r[2] for r in v])) for s, v in sorted(rows.items())}

    def similarity(self, item: int, window: np.ndarray) -> float:
        a, b = self.shingles[item], shingles(window)
        both = either = 0.0
        own = self.weights[item]
        for s in a.keys() | b.keys():
            w = own.get(s, self.rare)
            both += w * min(a[s], b[s])
            either += w * max(a[s], b[s])
        return both / either if either else 0.0

    def scan(self, texts) -> list[list[tuple]]:
        """Per text its (item_id, similarity, start_word, words)."""
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        if not self.ids:
            return out
        for lo, _, buf, offs in slices(lowered(texts), 1_000_000):
            words, doc = words_of(buf, offs)
            if len(words) < LEAST_WORDS:
                continue
            first = np.searchsorted(doc, np.arange(len(offs) - 1))
            last = np.searchsorted(doc, np.arange(len(offs) - 1), "right")
            running = pair_bits(words)
            tried: set[tuple[int, int, int]] = set()
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for size, index in self.sizes.items():
                inside = np.flatnonzero(doc[: max(0, len(doc) - size + 1)] == doc[size - 1 :])
                if not len(inside):
                    continue
                win, who = index.search(fingerprints(running, size)[inside])
                for w, e in zip(inside[win].tolist(), who.tolist(), strict=True):
                    d, item = int(doc[w]), int(index.item[e])
                    length = len(self.words[item])
                    at = max(int(first[d]), w - int(index.offset[e]))
                    if (d, item, at) in tried:
                        continue
                    tried.add((d, item, at))
                    s = self.similarity(item, words[at : min(at + length, int(last[d]))])
                    start = at - int(first[d])
                    if s >= SIMILARITY and (s, -start) > (best.get((d, item), (0.0, 0))[0], -best.get((d, item), (0.0, 0))[1]):
                        best[d, item] = (s, start)
            for (d, item), (s, start) in sorted(best.items()):
                out[lo + d].append((self.ids[item], s, start, len(self.words[item])))
        return out


def weighted_items(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, float]:
    """(i, words, shingles, weights) of every different item, and the weight of a shingle of no item."""

    def rows(batches):
        for b in batches:
            for k, (i, text) in enumerate(zip(b.column(0).to_pylist(), lowered(b.column(1)).to_pylist(), strict=True)):
                buf = np.frombuffer(text.encode(), np.uint8)
                w, _ = words_of(buf, np.array([0, len(buf)]))
                if len(w) >= LEAST_WORDS:
                    held = pa.array([np.array(list(shingles(w)), np.uint64).view(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([b.column(2).slice(k, 1), pa.array([i]), pa.array([w.tobytes()], pa.binary()), held], names=["r", "i", "words", "shingles"])

    known = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null").distinct()
    known = durable(known.withColumn("r", F.monotonically_increasing_id()))
    items = durable(known.mapInArrow(rows, "r long, i long, words binary, shingles array<long>"))
    n = max(1, items.count())
    each = items.select("r", F.explode("shingles").alias("s"))
    rarity = each.groupBy("s").agg(F.log(1 + n / F.count("*")).alias("weight"))
    own = each.join(rarity, "s").groupBy("r").agg(F.collect_list("s").alias("shingles"), F.collect_list("weight").alias("weights"))
    return durable(items.select("r", "i", "words").join(own, "r").drop("r")), math.log(1 + n)


def with_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "matches", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """docs with the items that a text contains: an array of item_id, similarity, start_word and words by item."""
    spark = docs.sparkSession
    small_batches(spark)
    items, rare = weighted_items(benchmark, item_id, item_text)
    length = F.length("words") / 8
    total = items.agg(F.sum(3 + F.floor(2 * length / SIZES[-1]))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_windows))
    name = f"__row_{uuid.uuid4().hex}"
    held = docs if blocks == 1 else durable(docs.withColumn(name, F.monotonically_increasing_id()))
    found: DataFrame | None = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "words"), F.lit(blocks)) == k).orderBy("i", "words").collect()
        sent = spark.sparkContext.broadcast([(r.i, bytes(r.words), r.shingles, r.weights) for r in rows])

        @F.pandas_udf(HITS)
        def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            items = sent.value  # noqa: B023
            weights = [dict(zip(np.array(x[2], np.int64).view(np.uint64).tolist(), x[3], strict=True)) for x in items]
            index = Benchmark([x[0] for x in items], [np.frombuffer(x[1], np.uint64) for x in items], weights, rare)
            for t in parts:
                hits = index.scan(pa.array(t, pa.string(), from_pandas=True))
                yield pd.Series([[dict(zip(("item_id", "similarity", "start_word", "words"), h, strict=True)) for h in x] for x in hits])

        if blocks == 1:
            return held.withColumn(into, scan(F.col(f"`{text}`")))
        hits = durable(held.select(name, scan(F.col(f"`{text}`")).alias("h")).where(F.size("h") > 0))
        found = hits if found is None else found.unionByName(hits)
        sent.destroy()
    every = found.groupBy(name).agg(F.array_sort(F.flatten(F.collect_list("h"))).alias("h"))
    none = F.array().cast(HITS)
    joined = held.drop(into).join(every.withColumnRenamed("h", into), name, "left")
    return joined.withColumn(into, F.coalesce(F.col(f"`{into}`"), none)).drop(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", F.round("m.similarity", 6).alias("similarity"), "m.start_word", "m.words")


_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: All windows that share a shingle with an item, by the definition of the similarity.
ORACLE = rf"""
WITH i AS (
  SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '{_RUN}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
  WHERE len(w) >= {LEAST_WORDS}),
ish AS (SELECT item_id, k, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
total AS (SELECT count(*) AS items FROM i),
rarity AS (SELECT s, ln(1 + max(items) / count(DISTINCT item_id)) AS wt FROM ish, total GROUP BY s),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_RUN}') AS w FROM documents WHERE text IS NOT NULL),
dsh AS (SELECT doc_id, k, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
c AS (SELECT DISTINCT doc_id, item_id, greatest(1, dsh.k - ish.k + 1) AS place FROM dsh JOIN ish ON dsh.s = ish.s),
own AS (SELECT item_id, ish.s, count(*) AS m, max(wt) AS wt FROM ish JOIN rarity ON ish.s = rarity.s GROUP BY ALL),
win AS (
  SELECT c.doc_id, c.item_id, place, dsh.s, count(*) AS m
  FROM c JOIN i ON i.item_id = c.item_id JOIN dsh ON dsh.doc_id = c.doc_id AND dsh.k BETWEEN place AND place + n - 5 GROUP BY ALL),
sums AS (
  SELECT win.doc_id, win.item_id, place, sum(coalesce(own.wt, ln(1 + items)) * win.m) AS theirs, coalesce(sum(own.wt * least(own.m, win.m)), 0) AS both_
  FROM win LEFT JOIN own ON own.item_id = win.item_id AND own.s = win.s, total GROUP BY ALL),
mine AS (SELECT item_id, sum(wt * m) AS mine FROM own GROUP BY item_id),
sim AS (SELECT doc_id, sums.item_id, place, both_ / (theirs + mine - both_) AS sim FROM sums JOIN mine ON mine.item_id = sums.item_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(sim, 9) DESC, place) AS r FROM sim WHERE sim >= {SIMILARITY} - 1e-12)
SELECT doc_id, best.item_id, round(sim, 6) AS similarity, (place - 1)::INT AS start_word, n::INT AS words FROM best JOIN i ON i.item_id = best.item_id WHERE r = 1
"""
