"""A corpus from raw documents: bad text out, near copies out, repeated passages cut, benchmark leaks out, then encoded.

Every stage takes (spark, docs, sf_dir) and returns a frame; run() writes each as Parquet in the shared folder and
reads it back as the next one's documents. All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm.decontaminate import drop_contaminated
from lociq.llm.jaccard import keep_one_of_each
from lociq.llm.pieces import encode_pieces
from lociq.llm.quality import keep_quality
from lociq.llm.storage import settle
from lociq.llm.suffixes import dedup_passages


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(stage):
    """The stage with batches of at most 500 rows between Spark and Python: documents are long, and both
    sides hold whole batches of them. The setting has to last until the frame is written, so run() puts it back, not the stage."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, "500")
        return stage(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by ``labels``, doesn't reject; null and empty texts are judged like any other."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: sets of five-word shingles with a Jaccard similarity of 0.8 or more. Documents without
    words all stay; of equal rows one stays."""
    return keep_one_of_each(docs, k=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand earlier in the corpus; all rows stay, null and short texts as they are."""
    return dedup_passages(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item; null and empty texts hold none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of each text; a null text counts as empty."""
    got = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [(stage.__name__, _small_batches(stage)) for stage in (quality, near_copies, passages, leaks, pieces)]

#: The quality classifier and the piece encoder can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(BATCH, before)
    return docs
