"""Stored results: Parquet, CSV and JSON forms of reports and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import schemas

CSV = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true", "lineSep": "\n"}


def write_records(results: DataFrame, path: str, partition: str | None = None) -> None:
    """Result records (text, cluster, sentiment, cleaned and keys) as Parquet."""
    writer = results.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_csv(results: DataFrame, path: str) -> None:
    """CSV with a header and without row numbers."""
    results.write.mode("errorifexists").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV back into typed columns; texts may hold quotes and line breaks."""
    return spark.read.options(**CSV, multiLine="true").schema(schema).csv(path)


def write_workbook(takeaways: DataFrame, clustered: DataFrame, path: str) -> None:
    """Two tables under one folder: ``summary`` (only with takeaways) and ``clustered``."""
    if not takeaways.isEmpty():
        write_csv(takeaways.select(F.col("text").alias("executive_summary")), f"{path}/summary")
    write_csv(clustered, f"{path}/clustered")


def pack(*columns: str | Column) -> Column:
    """A report's nested part as one JSON text."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def unpack(rows: DataFrame, schema: T.StructType | str, blob: str = "results") -> DataFrame:
    """JSON text back to columns, under the row's own url, total_items and avg_subjectivity.

    Keys that the text lacks come back NULL.
    """
    kept = [c for c in rows.columns if c != blob]
    opened = rows.withColumn("_blob", F.from_json(blob, schema))
    inner = [f.name for f in opened.schema["_blob"].dataType.fields if f.name not in kept]
    return opened.select(*kept, *[F.col(f"_blob.{name}") for name in inner])


def append_history(reports: DataFrame, path: str) -> None:
    """Insert-only history, by day; rows without an owner are left out."""
    rows = reports.where(F.col("user_id").isNotNull()).withColumn("dt", F.to_date("ts"))
    rows.write.mode("append").partitionBy("dt").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HISTORY_FILE).parquet(path)


def api_record(reports: DataFrame, *keys: str) -> DataFrame:
    """The compact record as JSON, eight named fields, beside the url and ``keys``."""
    return reports.select(*keys, "url", pack(*schemas.API_FIELDS).alias("record"))
