"""The registered queries of these operators and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, cover_tree, decontaminate, divergence, html_extract, jaccard_join, line_dedup, mix_sources, secret_scan, substring_dedup, token_ids, toxicity, whiten
from .common import shared_folder, small_batches

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_ids.write_token_files(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_ids.read_token_files(spark, path)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, with_ids=False)


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return cover_tree.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), n=3, share=90)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digests(secret_scan.scan(docs, secret_scan.train(docs)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mix_sources.plan(table(spark, sf_dir, "documents"), mix_sources.labelled_quality(table(spark, sf_dir, "labels")))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten.whiten(vectors, whiten.fit(vectors))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_files": op2_token_files,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_cover_tree": op4_cover_tree,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secret_scan": op8_secret_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_extract": op10_html_extract,
    "op11_mix_sources": op11_mix_sources,
    "op12_whiten": op12_whiten,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_cover_tree": cover_tree.SQL,
    "op11_mix_sources": mix_sources.SQL,
    "op13_divergence": divergence.SQL,
}
