"""From raw documents to packed training windows: quality, exact and near duplicates, personal data,
packing. Each stage reads what the one before has written, and works on all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import chosen_path, dedup_names, pii_anchors, quality_qda, queries
from pagequarry.llm.common import few_rows, row_key, stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# Rows to drop (a number each) that may be sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 300_000


def _only(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents that ``decided`` keeps. Rows that repeat both id and text are one."""
    decided = stash(decided.select("key", "kept"), "decided")
    keys = decided.groupBy("key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    dropped = keys.where("NOT kept").select("key")
    if few_rows(dropped, BROADCAST_ROWS):
        dropped = F.broadcast(dropped)
    left = docs.withColumn("key", row_key()).join(dropped, "key", "left_anti").select(COLUMNS)
    return left if keys.where("kept AND rows > 1").isEmpty() else left.dropDuplicates(["doc_id", "text"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_qda.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return _only(docs, dedup_names.exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return _only(docs, chosen_path.jaccard_join(docs))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    masked = pii_anchors.redact(docs.select(COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows, mixed by source."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("PII", personal),
    ("packing", packing),
]

# The quality stage learns a model, which SQL does not express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stash(docs, f"stage-{at}") if at + 1 < len(STAGES) else docs
    return docs
