"""Queries of the corpus operators over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulens.llm import bpe, decontam, hilbert, licenses, lm_mix, minhash, ogg, pii, toxicity, warc
from tabulens.llm.common import documents


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mix.document_scores(documents(spark, sf_dir))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.document_shards(documents(spark, sf_dir), 40)


def op3_byte_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), path)


def op4_pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.document_spans(documents(spark, sf_dir))


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("matches")


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(ogg.load(ogg.store(documents(spark, sf_dir))))


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), minhash.QUERY)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_context_mixing, op2_hilbert_shards, op3_byte_bpe, op4_pigeonhole_edit, op5_boosted_pii, op6_license_join, op7_ogg, op8_circulant_minhash, op9_toxicity, op10_warc)}
ORACLE: dict[str, str] = {}
