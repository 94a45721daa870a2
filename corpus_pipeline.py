"""From raw documents to shuffled token sequences: the stages of a training corpus, each one operator over all that the
stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, line_runs, mixing, quality_cnn, simhash, similar
from nearfield.sources.scratch import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 1/2)."""
    net = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_cnn.accepted(docs.select(*COLUMNS), net)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; a document of which nothing is left goes."""
    left = line_runs.remove_repeats(docs.select(*COLUMNS)).where("n_removed < n_lines")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the smallest doc_id."""
    return simhash.keep_first(docs.select(*COLUMNS))


def one_of_each_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same at five-word shingles and a Jaccard similarity of 0.8 or more, in place of op4's 3 bits. Not in STAGES."""
    return similar.keep_first(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, copies shuffled globally."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, ("doc_id", "lang", "source"), ids=True)


STAGES = [("quality classifier", good_quality), ("line dedup", without_repeated_lines), ("SimHash near-dedup", one_of_each), ("mixing", mixed), ("byte-level BPE", tokens)]

#: What a Python worker holds at once, and the JVM's copy of it: rows and bytes of an Arrow batch. Whole texts of any length
#: pass; a longer one is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

#: A network's scores are out of SQL's reach; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again by the next. Sets the
    session's Arrow batches to ``BATCH``, since one session's executors hold the workers of all stages."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
