"""From raw documents to training windows: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents. `run` writes every stage's rows to the shared folder and reads them for the next, so a lost
executor costs at most the stage that runs.

Defined results: documents with a null or empty text end at the quality rules. Line dedup drops a document whose text
is removed as a whole, sets n_chars, where there is such a column, to the length of what is left, and leaves others
alone. Rows that share an id are separate rows for every stage, except that near-duplicate and line decisions count
them as one document. Very long texts go whole through every stage. Of equal documents, and of equal lines, those with
the smallest id stay. Columns beside those of documents are carried along, also where they have names that an operator
writes (`n_lines`, `n_removed`). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import WORD_SPACE, durable, table
from trialframe.llm.decontaminate import with_matches
from trialframe.llm.jaccard_join import keep_one
from trialframe.llm.line_dedup import dedup_lines
from trialframe.llm.packing import pack
from trialframe.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated windows of lines, as far as anything is left of them."""
    own = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(own)).where((F.col("n_removed") == 0) | (F.btrim(F.col("text"), F.lit(WORD_SPACE)) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(*own).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group at a similarity of 0.8 on five-word shingles."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    hits = "__benchmark_hits"
    return with_matches(docs, table(spark, sf_dir, "benchmark"), into=hits).where(F.size(hits) == 0).drop(hits)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows with their tokens."""
    return pack(docs).withColumn("ids_crc32", F.crc32("tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
