"""Pages to text segments, and the gates on segment counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as X
from pagequarry.operators.keys import Keys


def split_lines(pages: DataFrame, by: Keys, body: str = "text") -> DataFrame:
    """One row per line with its position; ``n_lines`` is the page's line count.

    The count is read off the array before it is exploded, so later steps can tell small pages
    from large ones without a shuffle.
    """
    lines = F.split(F.coalesce(F.col(body), F.lit("")), "\n")
    return (
        pages.select(*by, lines.alias("_lines"))
        .select(*by, F.size("_lines").cast("bigint").alias("n_lines"), F.posexplode("_lines").alias("_p", "text"))
        .select(*by, F.col("_p").cast("bigint").alias("pos"), "text", "n_lines")
    )


def content_lines(pages: DataFrame, by: Keys, body: str = "text", longer_than: int = 15) -> DataFrame:
    """Lines stripped of white space that pass the content test."""
    lines = split_lines(pages, by, body).withColumn("text", X.strip_ws(F.col("text")))
    return lines.where((F.length("text") > longer_than) & X.is_content(F.col("text")))


def status_of(n_segments: Column, n_clean: Column) -> Column:
    """Why a page is rejected, or ``ok``."""
    return (
        F.when(F.coalesce(n_segments, F.lit(0)) == 0, "no_content")
        .when(F.coalesce(n_clean, F.lit(0)) < 2, "too_little_text")
        .otherwise("ok")
    )


def page_status(pages: DataFrame, segments: DataFrame, cleaned: DataFrame, by: Keys) -> DataFrame:
    """Gate table: one row per page with both counts and the status."""
    keys = list(by)
    n_segments = segments.groupBy(*keys).agg(F.count("*").alias("n_segments"))
    n_clean = cleaned.groupBy(*keys).agg(F.count("*").alias("n_clean"))
    joined = pages.select(*keys).join(n_segments, keys, "left").join(n_clean, keys, "left")
    return joined.select(
        *keys,
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        F.coalesce("n_clean", F.lit(0)).alias("n_clean"),
        status_of(F.col("n_segments"), F.col("n_clean")).alias("status"),
    )


def error_records(status: DataFrame, url: str) -> DataFrame:
    """Rejected pages as (error, url)."""
    message = F.when(
        F.col("status") == "no_content", "The page has no text to work on."
    ).otherwise("Fewer than two different texts are left after cleaning.")
    return status.where(F.col("status") != "ok").select(
        message.alias("error"), F.col(url).cast("string").alias("url")
    )
