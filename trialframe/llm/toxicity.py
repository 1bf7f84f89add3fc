"""Toxicity by multiple-instance learning: a text is a bag of sentences, of which only the bag has a label.

A sentence's probability is a logistic function of its features (hashed words and word beginnings); a text's is the
noisy-or of its sentences. Fitting takes a sample of at most `MAX_LABELLED` labelled texts: Spark counts each feature's
texts by label, the `SELECTED` most telling features are kept, and the weights are fitted on the driver from these
few features a text. Scoring is one vectorised pass without a shuffle and also gives the offending sentences.

Defined results: null or empty text, or one without a telling feature, scores 0 and has no offending sentence. A score
equal to a threshold counts as reaching it. Rows with a null id are scored, but not learned from; a column that has the
name of the result is replaced. Of equally telling features those with the smaller hash are selected.
Several labels of one id count as toxic if any does; null labels are ignored. Repeated rows are scored alike. Without
labelled rows of both kinds every text scores 0. Extra columns are kept by `score_texts`. Very long texts are handled
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import durable, sized_broadcast, slices, small_batches, span_hashes, table

BITS = 22
PREFIXES = (4, 5, 6)  # bytes
#: Labelled texts that the classifier is fitted on at most.
MAX_LABELLED = 40_000
SELECTED = 4096
#: Least log odds ratio and toxic texts of a selected feature.
LEAST_ODDS, LEAST_TEXTS = 2.0, 3
#: Features that chance alone may bring among the selected ones: sets how telling a feature must be among so many.
FALSE_FEATURES = 2.0
#: Of the fit: pull of each weight towards 0, and what a toxic text counts against a clean one.
RIDGE, POSITIVE_WEIGHT = 2e-4, 4.0
THRESHOLD = 0.7

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and text of every sentence: up to and with a run of . ! ? or line feeds."""
    n = len(buf)
    end = _END[buf]
    cut = np.zeros(n + 1, bool)
    if n:
        cut[1:n] = end[:-1] & ~end[1:]
        cut[offs] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and start byte of each word's features."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORD[buf]
    after = np.r_[False, word[:-1]]
    after[offs[:-1][offs[:-1] < n]] = False
    before = np.r_[word[1:], False]
    last = offs[1:] - 1
    before[last[last >= 0]] = False
    starts, ends = np.flatnonzero(word & ~after), np.flatnonzero(word & ~before) + 1
    bucket = [(span_hashes(buf, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)]
    at = [starts]
    for k in PREFIXES:
        long = ends - starts > k
        s = starts[long]
        h = span_hashes(buf, s, s + k) + np.uint64(k)
        bucket.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64))
        at.append(s)
    return np.concatenate(bucket), np.concatenate(at)


def lowered(texts):
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        """Index of a selected bucket plus one, else 0."""
        out = np.zeros(1 << BITS, np.int16)
        out[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return out

    def score(self, texts, lookup: np.ndarray | None = None, keep: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
        """Probability of each text and its sentences at or above keep (code point offsets)."""
        lookup = self.lookup() if lookup is None else lookup
        score, found = np.zeros(len(texts)), [[] for _ in range(len(texts))]
        low = lowered(texts)
        for lo, hi, buf, offs in slices(low):
            bucket, at = features(buf, offs)
            k = lookup[bucket]
            hit = k > 0
            if not hit.any():
                continue
            s0, s1, doc = sentences(buf, offs)
            own = np.searchsorted(s0, at[hit], "right") - 1
            z = np.bincount(own, self.weights[k[hit] - 1], minlength=len(s0))
            seen = np.unique(own)
            p = 1 / (1 + np.exp(-(z[seen] + self.bias)))
            score[lo:hi] = 1 - np.exp(np.bincount(doc[seen], np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=hi - lo))
            for s, ps in zip(seen[p >= keep], p[p >= keep], strict=True):
                d = doc[s]
                head = buf[offs[d] : s1[s]]
                chars = np.cumsum((head & 0xC0) != 0x80)
                first = s0[s] - offs[d]
                found[lo + d].append({"start": int(chars[first - 1]) if first else 0, "end": int(chars[-1]), "score": float(ps)})
        return np.clip(score, 0, 1), found


def learnable(id_col: Column, folds: int = 3, held: int = 1) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds != held


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """(i, t, y) of the bounded sample; the labels that take part are few enough to broadcast."""
    y = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("i")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("y"))
    n = max(1, y.count())
    rank = F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / float(1 << 40)
    y = y.where(rank < min(1.0, 0.95 * MAX_LABELLED / n))
    y = durable(y)
    return docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("t")).join(sized_broadcast(y, y.count(), MAX_LABELLED), "i")


def select_features(rows: DataFrame) -> np.ndarray:
    """The buckets whose presence tells most about a label, by the z of their log odds ratio."""

    def count(batches):
        pos, neg, n = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32), [0, 0]
        for b in batches:
            y = np.array(b.column(1).to_pylist(), np.int64)
            n[0] += int((y == 0).sum())
            n[1] += int((y > 0).sum())
            for lo, hi, buf, offs in slices(lowered(b.column(0))):
                bucket, at = features(buf, offs)
                doc = np.searchsorted(offs, at, "right") - 1
                pair = np.unique(doc * (1 << BITS) + bucket)
                d, f = pair >> BITS, pair & ((1 << BITS) - 1)
                toxic = y[lo:hi][d] > 0
                np.add.at(pos, f[toxic], 1)
                np.add.at(neg, f[~toxic], 1)
        k = np.flatnonzero(pos + neg)  # all of them: how many texts have a feature is known only once Spark has summed the tasks
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[k, -1]), pa.array(np.r_[pos[k], n[1]].astype(np.int64)), pa.array(np.r_[neg[k], n[0]].astype(np.int64))], names=["f", "p", "n"])

    sums = rows.select("t", "y").mapInArrow(count, "f long, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = durable(sums.where((F.col("f") < 0) | (F.col("p") >= LEAST_TEXTS)))
    totals, tried = sums.where("f = -1").collect(), sums.where("f >= 0").count()
    if not totals or not totals[0].p or not totals[0].n:
        return np.zeros(0, np.int64)
    a, b = float(totals[0].p), float(totals[0].n)
    odds = F.log((F.col("p") + 0.5) / (a - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (b - F.col("n") + 0.5))
    spread = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    least_z = max(2.0, NormalDist().inv_cdf(1 - min(0.5, FALSE_FEATURES / max(1, tried))))
    # Only what speaks for toxicity: a sentence without such a feature has probability 0, so others would never count alone.
    best = sums.where("f >= 0").withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS).withColumn("z", F.col("odds") / spread)
    return np.array(sorted(r.f for r in best.where(F.col("z") > least_z).orderBy(F.desc("z"), "f").limit(SELECTED).collect()), np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """labels: only rows that may be learned from."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text, label)
    chosen = select_features(rows)
    if not len(chosen):
        return ToxicityModel(chosen, np.zeros(0), -20.0)
    empty = ToxicityModel(chosen, np.zeros(len(chosen)), 0.0)

    def bags(batches):
        lookup = empty.lookup()
        for b in batches:
            y = b.column(1).to_pylist()
            ys, ss, fs = [], [], []
            for lo, hi, buf, offs in slices(lowered(b.column(0))):
                bucket, at = features(buf, offs)
                k = lookup[bucket]
                at, k = at[k > 0], k[k > 0].astype(np.int64)
                s0, _, _ = sentences(buf, offs)
                own = np.searchsorted(s0, at, "right") - 1 if len(at) else at
                doc = np.searchsorted(offs, at, "right") - 1
                order = np.argsort(doc, kind="stable")
                own, k = own[order], k[order]
                ends = np.searchsorted(doc[order], np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    mine = slice(ends[d], ends[d + 1])
                    ys.append(int(y[lo + d]))
                    ss.append((own[mine] - own[mine].min()).tolist() if len(own[mine]) else [])
                    fs.append((k[mine] - 1).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ss, pa.list_(pa.int32())), pa.array(fs, pa.list_(pa.int32()))], names=["y", "s", "f"])

    got = rows.select("t", "y").mapInArrow(bags, "y int, s array<int>, f array<int>").toPandas()
    return train(chosen, got["y"].to_numpy(), got["s"].to_list(), got["f"].to_list())


def train(buckets: np.ndarray, y: np.ndarray, sentence: list, feature: list, steps: int = 300, rate: float = 0.1, ridge: float = RIDGE, weight: float = POSITIVE_WEIGHT) -> ToxicityModel:
    """Adam on the noisy-or likelihood; a sentence without a selected feature has probability 0."""
    sizes = np.array([len(x) for x in feature])
    f = np.concatenate([np.asarray(x, np.int64) for x in feature]) if sizes.sum() else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(y)), sizes)
    s = np.concatenate([np.asarray(x, np.int64) for x in sentence]) if sizes.sum() else f
    pair, sent = np.unique(doc * (1 << 32) + s, return_inverse=True)
    bag = pair >> 32
    w, bias, t = np.zeros(len(buckets)), -1.0, y > 0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = np.clip(1 / (1 + np.exp(-(np.bincount(sent, w[f], minlength=len(pair)) + bias))), 1e-9, 1 - 1e-9)
        clean = np.exp(np.bincount(bag, np.log1p(-p), minlength=len(y)))
        out = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        # d(-log likelihood)/dz of a sentence: p for a clean text, -p (1 - out) / out for a toxic one
        g = np.where(t[bag], -weight * p * (1 - out[bag]) / out[bag], p)
        grad = np.r_[np.bincount(f, g[sent], minlength=len(w)) + ridge * len(y) * w, g.sum()] / max(1, len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel(buckets, w, float(bias))


def score_texts(df: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """df with a struct of score and offending sentences (start, end in code points, score)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup = held.value.lookup()
        for t in parts:
            p, found = held.value.score(pa.array(t, pa.string(), from_pandas=True), lookup)
            yield pd.DataFrame({"score": p, "offending": found})

    small_batches(df.sparkSession)
    return df.withColumn(into, score(F.col(f"`{text}`")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(learnable(F.col("doc_id"))))
    t = F.col("toxicity")
    return score_texts(docs, model).select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), t["score"].alias("score"),
        F.when(t["score"] >= THRESHOLD, 1).otherwise(0).alias("predicted"), t["offending"].alias("offending"),
    )
