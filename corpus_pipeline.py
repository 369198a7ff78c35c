"""Documents to training tokens: filter, deduplicate, redact, mix, encode.

Every stage takes all rows its predecessor kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import mixing, pieces, pii, quality, simhash
from tallyworks.llm.common import materialise, table

#: Quality is learned from labels and pieces are no rows of SQL.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it learns from the labels of the documents given."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model, out="__score")
    return scored.where(F.col("__score") >= quality.CUT).select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.deduplicated(docs)


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data and the terms that disclose it; clean ones as they are."""
    return pii.redact(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids and the score of their best segmentation."""
    encoded = pieces.with_pieces(docs, out="__nbest")
    best = F.col("__nbest")[0]
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "piece_score")]
    return encoded.select(*names, best["ids"].alias("ids"), best["score"].alias("piece_score"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("personal_data", redacted_documents),
    ("mixing", mixed_documents),
    ("pieces", encoded_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
