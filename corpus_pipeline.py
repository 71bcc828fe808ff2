"""A corpus pipeline of the operators in ``pagewright.llm``: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from pagewright.llm.common import small_batches, written

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: word shingles and hundredths of similarity.
SHINGLE, SHARE = 5, 80
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; it is fitted on labelled rows that aren't held out."""
    small_batches(spark)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).filter("predicted = 0").select(COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur on many sites go; every document stays, with its new length."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links reach, the one with the smallest id stays; documents without words and without ids all stay."""
    small_batches(spark)
    linked = written(jaccard_join.link(docs, SHINGLE, SHARE), "linked")
    gone = linked.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti").select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, question and answer, go."""
    small_batches(spark)
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of each document, the last two of the ids and of their decoded bytes."""
    small_batches(spark)
    return byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: The classifier, the tokenizer and the retrieval aren't SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each result written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
