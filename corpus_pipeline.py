"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, extra ones included, whatever their names.

Defined results of every stage: an empty table gives an empty one; repeated rows are rows of their own; nothing depends on
the order of rows. What a stage does with nulls and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import mixing, packing, partenum, quality_model, secret_scan
from lodegraph.llm.common import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, unchanged; a null text or one without words goes, a null doc_id is no matter."""
    return quality_model.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest doc_id, null last, of ties and repeated rows one; documents without words all stay."""
    return partenum.drop_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a marker in place of each secret and n_chars as it then is; null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, the last time maybe in part; a null source is a source, texts without words are not taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null text is the end token alone, a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: Fitted models, exact hashing and tokens are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
