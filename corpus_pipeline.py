"""From raw documents to encoded ones: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.llm.decontaminate import decontaminate
from harborline.llm.pieces import sampled
from harborline.llm.pii import pseudonymised
from harborline.llm.quality import keep_good
from harborline.llm.queries import pii_key
from harborline.llm.scratch import Scratch, fresh
from harborline.llm.wide import one_of_each

#: Words that a benchmark item must have to remove a document; shorter ones stand in many clean texts. The query over the
#: benchmark (op5) has no such bound.
LEAST_ITEM = 5
#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; a text without words is judged by its statistics, all zero.

    An error if no label can be learned from. Repeated rows are judged alike; extra columns stay."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingle sets of Jaccard similarity 0.8 or more.

    Of a group the least doc_id stays (null first), of its repeated rows one; texts without words are one group."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item of LEAST_ITEM words or more; null and empty texts hold none, an empty benchmark has none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LEAST_ITEM)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced under the session's key, or one of this process; null and empty texts as they are."""
    (count,) = fresh(docs, "_n_pii")
    return pseudonymised(docs, pii_key(spark), count).drop(count)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with ids that decode to its text; extra columns go."""
    return sampled(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii pseudonyms", pii_pseudonyms),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder.

    Texts of any length are one row of each stage; empty tables pass through as empty ones."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{i}")
            if i:
                scratch.drop(f"stage-{i - 1}")
    return docs
