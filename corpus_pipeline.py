"""The corpus pipeline: quality, exact and near duplicates, source mixing and packing, each on all that is left.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents; the last returns the packed pieces.

Defined cases are those of the operators: null and empty texts pass as empty ones, repeated rows are copies, extra
columns are kept, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrain.llm.common import load, table
from lexigrain.llm.exact_dedup import keep_first
from lexigrain.llm.jaccard import keep_one
from lexigrain.llm.mixing import repeat_rows
from lexigrain.llm.packing import pack
from lexigrain.llm.quality import good_documents
from lexigrain.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier finds good; it learns from ``labels`` and these documents."""
    return good_documents(docs, load(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every text."""
    return keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingle sets are linked at 0.8."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them."""
    return repeat_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

#: The classifier, the tokenizer and the packing program have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
        spark.sparkContext._jvm.System.gc()  # what only that stage read is then seen to be unread, and goes
    return STAGES[-1][1](spark, docs, sf_dir)
