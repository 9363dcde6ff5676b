"""A corpus from raw documents to packed sequences: five stages, each one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import mixing, packing, parity, resampling, secrets, tokens
from tessella.llm.common import WorkFolder


# Every stage takes tables with further columns of any name and gives them back as they were; a null text is an empty
# one to it and stays null; an empty table gives an empty table with the same columns.


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents whose key, importance weight and Gumbel draw, is not among the k largest go.

    k is the share of documents that held-out labelled ones tell. Rows of one id share a draw, so repeated rows
    stay or go together; without labels of both kinds all stay.
    """
    return resampling.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each component of links (five words, 0.8) the document of the smallest id stays.

    Of rows with one id one stays. Documents without words, and rows without an id, all stay.
    """
    return parity.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every row stays, its secrets masked, n_chars with them."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as its source's target and its draw say, in whole copies, none at times.

    Rows of one id and text share a draw; a null source is a source of its own; documents without words weigh nothing, and
    come as often as their draw says.
    """
    return mixing.remix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of all documents in sequences of at most 2048 tokens; a document without text has its end alone.

    Copies are packed each by itself, and carry their document's id, null if it has none.
    """
    return packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", packed),
]
#: Tokens of a public vocabulary and their packing have no SQL; the stages' rows are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again as the next one's input."""
    work, docs = WorkFolder(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.cut(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            work.drop(f"stage{i - 1}")
    return docs
