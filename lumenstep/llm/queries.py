"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bytebpe, crossparse, decontaminate, lattice, linkrank, prefixcount, repetition, simhash, substrings, surrogates
from .common import read, ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@_query
def op1_link_rank_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linkrank.judge(read(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


@_query
def op2_suffix_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(read(spark, sf_dir, "documents"))


@_query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query
def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, surrogates.key_of(spark), count_col="n_entities")


@_query
def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query
def op7_deep_shallow_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"), with_text=True)
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")  # a removed span may begin or end within a character
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text)


@_query
def op8_cross_parsing_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.identify(read(spark, sf_dir, "documents"))


@_query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op10_subword_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
