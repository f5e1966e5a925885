"""Filters, search and paging on a result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def display(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """text, Cluster and, where the table has it, Sentiment."""
    columns = [*by, "text", F.col("cluster").alias("Cluster")]
    if "sentiment" in results.columns:
        columns.append(F.col("sentiment").alias("Sentiment"))
    return results.select(*columns)


def has_words(query: Column, *columns: str) -> Column:
    """Every word of the query occurs in some column, whatever the case."""
    row = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(row, w))


def search(results: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows that hold every word of the query in some column, whatever the case."""
    row = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    for word in query.lower().split():
        results = results.where(F.contains(row, F.lit(word)))
    return results


def of_topic(results: DataFrame, label: str) -> DataFrame:
    """Rows of the cluster a label such as ``2: Name`` stands for."""
    return results.where(F.col("cluster").cast("string") == label.split(":", 1)[0].strip())


def of_sentiment(results: DataFrame, label: str) -> DataFrame:
    return results.where(F.contains(F.lower("sentiment"), F.lit(label.lower())))


def takeaway_query(text: Column) -> Column:
    """First five words of a takeaway without punctuation (ASCII word characters, as a browser does)."""
    head = F.array_join(F.slice(F.split(text, " "), 1, 5), " ")
    return F.trim(F.regexp_replace(head, r"[^A-Za-z0-9_\s]", ""))


def page(results: DataFrame, order: Sequence[Column], size: int | None, number: int = 0) -> DataFrame:
    """One page of the sorted table; ``size`` None is all of it."""
    ordered = results.orderBy(*order)
    return ordered if size is None else ordered.offset(size * number).limit(size)
