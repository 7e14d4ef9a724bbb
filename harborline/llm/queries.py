"""The queries of the text operators, over the whole tables of a folder."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from harborline.llm.decontaminate import contaminated
from harborline.llm.divergence import SQL as DIVERGENCE_SQL
from harborline.llm.divergence import divergence
from harborline.llm.katz import lm_scores
from harborline.llm.merkle import manifest, manifest_sql
from harborline.llm.packing import best_fit_packing
from harborline.llm.pieces import sampled
from harborline.llm.pii import pii
from harborline.llm.quality import quality
from harborline.llm.rules import quality_rules
from harborline.llm.simhash import near_duplicates
from harborline.llm.substrings import substring_dedup
from harborline.llm.toxicity import toxicity
from harborline.llm.urls import url_filter
from harborline.settings import logger

#: The session setting that holds the secret key of pseudonyms.
KEY_SETTING = "spark.harborline.pii.key"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL of the queries that it can express; tests/llm holds the others against brute force, a round trip or held-out labels.
ORACLES: dict[str, str] = {"op11_merkle_manifest": manifest_sql(), "op12_source_divergence": DIVERGENCE_SQL}


def query(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def own_key() -> str:
    """A key that nobody knows, the same for all calls of this process: values stay linked, but only in what it writes."""
    logger("pii").warning("%s is unset: pseudonyms are made under a random key", KEY_SETTING)
    return secrets.token_hex(32)


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or own_key()


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "n_matched")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


@query("op8_pii_pseudonyms")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"), pii_key(spark))


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


@query("op10_sentencepiece_sampling")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


@query("op12_source_divergence")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
