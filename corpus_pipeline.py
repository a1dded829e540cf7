"""Corpus preparation as a chain of stages over ``documents``.

Each stage takes the documents that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlens.llm.common import documents, written
from tutorlens.llm.encoding import tokenizer_path
from tutorlens.llm.langid import keep_identified
from tutorlens.llm.mixing import mixed
from tutorlens.llm.packing import pack_documents
from tutorlens.llm.simhash import one_of_each
from tutorlens.llm.suffix_dedup import without_passages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no letters), or whose score stays below ``langid.MIN_SCORE`` because a model
    of single characters explains them far better than any learned language does, go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of 50 words (``suffix_dedup.PASSAGE_WORDS``) that also begins anywhere else is cut out, so every repeated
    passage of over 50 words goes, however short its words are; documents that are empty then go."""
    return without_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or sampled to their target weights; a document stands there as often as it is taken."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document packed into context windows: one row per piece."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: the stages rest on a fitted model and on suffix arrays: not expressible in SQL
ORACLE_SQL = None
