"""A corpus pipeline of five stages. Each takes the rows that the stage before it kept, as a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm import exact_dedup, shingle_join
from weftlink.llm.packing import pack
from weftlink.llm.quality import fit_quality, keep_good
from weftlink.llm.queries import table, tokenizer_path
from weftlink.llm.secret_scan import redact_rows
from weftlink.llm.shared import stored


# Stages take tables with the columns of ``documents`` and others of any name; all but the last return the same columns.
# An empty table gives an empty table.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on labelled rows of ``docs``, scores below 0.3 go.

    Null texts are scored as empty ones and stay null; repeated rows and rows without an id are judged each by its text, so
    equal texts fare alike. Without labels every score is 0.5 and all rows stay.
    """
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest id stays.

    Null and empty texts are equal. Rows without an id go unless all of their group have none; one row stays of rows that
    repeat id and text.
    """
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a five-word Jaccard similarity of 0.8 or more the row with the least id stays.

    Texts of fewer than five words are alike only when all words agree; texts without words, null ones too, and rows
    without an id all stay. Rows that repeat the least id of a group all stay.
    """
    return shingle_join.keep_one(docs, n=5, threshold=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets, and n_chars is counted anew where a text changed.

    All rows stay; null and empty texts, repeated rows and rows without an id pass through like any other.
    """
    return redact_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens: one row per piece, with its ids.

    A null or empty text is its end id alone. Repeated rows and rows without an id are packed as rows of their own.
    """
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]
#: Tokenised windows of texts that a trained classifier chose can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
