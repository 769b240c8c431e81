"""The corpus pipeline: documents to token files, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.llm.decontaminate import decontaminate
from meridia.llm.mixing import repeat_mixed
from meridia.llm.ngram_join import keep_one
from meridia.llm.quality_gam import fit_quality, keep_good
from meridia.llm.registry import tokenizer_path
from meridia.llm.textops import Scratch, table
from meridia.llm.token_output import token_report


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3.

    A null or empty text is scored like any other, by features that are all 0. Without labels every
    score is 0.5 and all documents stay. Rows alike stay or go together.
    """
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more.

    That is one with the group's smallest doc_id. Texts without words link with nothing and all stay; of
    rows alike in doc_id and text with words, one stays.
    """
    return keep_one(docs, width=5, num=80, den=100)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of the benchmark occurs; null and empty texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents left out, taken once or repeated.

    Texts without words are not taken; a null source is a source of its own.
    """
    return repeat_mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files written and read back: doc_id, start, n_tokens and ids_crc32 of each document, a repeated one as often as it comes."""
    return token_report(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mix),
    ("token-ID output", tokens),
]

#: SQL can express neither the classifier nor the draws; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again by the next, which then takes its place.

    Extra columns go through all stages but the last, whatever their names; an empty table gives an
    empty result.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
