"""Language identification: nearest centroid over normalised TF-IDF vectors of hashed character n-grams.

Training: document frequencies of all learnable texts give the IDF (a count per bucket, summed by Spark); a sample of
at most `PER_LANG` texts a language is clustered into `CLUSTERS` spherical centroids, each language as one bounded
group. Scoring compares a text's vector with every centroid by cosine in one vectorised pass without a shuffle. A text
whose best cosine lies below what its centroid's own training texts reach is marked as rejected.

Defined results: null text, or text without a letter, is `und` with score 0. Case is ignored. Equal cosines take the
language first in order. Repeated rows are judged alike; extra columns are kept by `identify`, but for one that has the
name of the result, which is replaced. Without any learnable
row every text is `und`. Null ids are learned from and judged like others (as the empty text's CRC). Very long texts
are handled whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import _SLOT, mix, slices, small_batches, table

BUCKETS = 4096
GRAMS = (1, 2, 3)
#: Texts of one language that are clustered: the bound of the fitted sample.
PER_LANG = 600
CLUSTERS = 4
#: Share of a centroid's training texts that would be rejected.
REJECT_QUANTILE = 0.002
UNKNOWN = "und"


def plain(texts) -> pa.Array:
    """Lower-cased words of letters between single spaces."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    return pc.utf8_trim(pc.replace_substring_regex(a, r"[^\p{L}]+", " "), " ")


def vectors(texts):
    """(first row, raw counts [rows, BUCKETS]) of runs of the texts."""
    for lo, hi, buf, offs in slices(plain(texts), 1_000_000):
        lead = np.flatnonzero((buf & 0xC0) != 0x80)  # one per code point
        code = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        doc = np.searchsorted(offs, lead, "right") - 1
        counts = np.zeros((hi - lo) * BUCKETS)
        for n in GRAMS:
            m = len(code) - n + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            for j in range(n):
                h += code[j : j + m] * _SLOT[j + 8 * n]
            whole = doc[:m] == doc[n - 1 :]
            at = doc[:m][whole] * BUCKETS + (mix(h[whole]) % np.uint64(BUCKETS)).astype(np.int64)
            counts += np.bincount(at, minlength=len(counts))
        yield lo, counts.reshape(hi - lo, BUCKETS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def learnable(df: DataFrame, id_col: str = "doc_id", lang: str = "lang", folds: int = 5) -> DataFrame:
    return df.where(~held_out(F.col(f"`{id_col}`"), folds) & F.col(f"`{lang}`").isNotNull())


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, score, rejected = [], [], []
        for _, counts in vectors(texts):
            if not self.langs:
                best, top, out = [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
            else:
                cos = weighted(counts, self.idf) @ self.centroids.T
                k = cos.argmax(1)
                top = np.clip(cos[np.arange(len(k)), k], 0, 1)
                none = counts.sum(1) == 0
                top[none] = 0
                out = none | (top < self.floors[k])
                best = [UNKNOWN if e else self.langs[i] for i, e in zip(k, none, strict=True)]
            names += best
            score.append(top)
            rejected.append(out)
        empty = np.zeros(0)
        return names, np.concatenate(score) if score else empty, np.concatenate(rejected) if rejected else empty.astype(bool)


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Texts with each bucket, and all texts."""

    def count(batches):
        total, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for _, c in vectors(b.column(0)):
                total[:BUCKETS] += (c > 0).sum(0)
            n += b.num_rows
        total[BUCKETS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], names=["bucket", "n"])

    rows = df.select(F.col(f"`{text}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out[:BUCKETS], int(out[BUCKETS])


def cluster(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means from the mean and the farthest points; deterministic."""
    seeds = [x.mean(0)]
    for _ in range(1, min(k, len(x))):
        seeds.append(x[(x @ np.array(seeds).T).max(1).argmin()])
    c = np.array(seeds)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """df: the learnable rows."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    df_counts, n = document_frequencies(rows, "t")
    idf = np.log((1 + n) / (1 + df_counts)) + 1
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel(idf, [], np.zeros((0, BUCKETS)), np.zeros(0))
    # A share by hash that gives a little more than the bound; the group is then cut to the bound by that hash.
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, 1.3 * PER_LANG / size + 30 / size))).otherwise(share)
    rank = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.lit("")), "t"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.withColumn("rank", rank).where(F.col("rank") <= share)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "t"], kind="stable").head(PER_LANG)
        x = np.concatenate([weighted(c, idf) for _, c in vectors(pa.array(pdf["t"], pa.string()))])
        x = x[(x != 0).any(1)]
        if not len(x):
            return pd.DataFrame({"l": [], "k": [], "c": [], "floor": []})
        c = cluster(x, CLUSTERS)
        cos = x @ c.T
        own, top = cos.argmax(1), cos.max(1)
        floor = [float(np.quantile(top[own == j], REJECT_QUANTILE)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"l": pdf["l"].iloc[0], "k": range(len(c)), "c": [v.astype(np.float64).tolist() for v in c], "floor": floor})

    found = sample.groupBy("l").applyInPandas(centroids, "l string, k int, c array<double>, floor double").orderBy("l", "k").collect()
    c = np.array([r.c for r in found]).reshape(len(found), BUCKETS)
    return LanguageModel(idf, [r.l for r in found], c, np.array([r.floor for r in found]))


def identify(df: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """df with a struct of lang, score and rejected."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(t: pd.Series) -> pd.DataFrame:
        names, score, rejected = model.predict(pa.array(t, pa.string(), from_pandas=True))
        return pd.DataFrame({"lang": names, "score": score, "rejected": rejected})

    small_batches(df.sparkSession)
    return df.withColumn(into, predict(F.col(f"`{text}`")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(learnable(docs))
    out = F.col("language")
    return identify(docs.drop("lang"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), out["lang"].alias("lang_pred"), out["score"].alias("score"), out["rejected"].alias("rejected")
    )
