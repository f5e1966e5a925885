"""Registered queries that run a stream over a whole driver table, and the full report."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import history as H
from pagequarry.operators import html as E
from pagequarry.plans import report as RP
from pagequarry.plans.catalog import DOC, docs, gazetteer, register
from pagequarry.session import cut, fresh_path
from pagequarry.sources import store
from pagequarry.sources.tables import read_table
from pagequarry.streaming import streams as ST


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table as a stream of files: one file, or a folder of them. The pattern stands for either;
    a plain path would have to be a folder."""
    schema = read_table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(os.path.join(folder, f"{name}.parque[t]"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return table_stream(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("url"), "ts",
        (F.col("value") / 500).alias("avg_subjectivity"),
    )


@register(
    "stream_latest", "ST2",
    "SELECT user_id, arg_max(event_type, {'t': ts, 'v': event_type}) AS url, max(ts) AS ts FROM events GROUP BY 1",
)
def _(spark, folder):
    base = fresh_path(spark, "latest")
    ST.latest_by_key(event_stream(spark, folder), ["user_id"], "url", base).awaitTermination()
    return ST.read_latest(spark, base, ["user_id"])


@register(
    "stream_toggles", "ST3",
    "SELECT user_id, event_type AS url, count(*) AS n, max(ts) AS created_at, count(*) % 2 = 1 AS subscribed FROM events GROUP BY ALL",
)
def _(spark, folder):
    base = fresh_path(spark, "toggles")
    ST.toggle_state(event_stream(spark, folder), base).awaitTermination()
    return ST.read_latest(spark, base, ["user_id", "url"])


@register(
    "stream_series", "ST4",
    "SELECT event_id AS id, user_id, event_type AS url, ts, round(value / 500, 6) AS avg_subjectivity FROM events",
)
def _(spark, folder):
    base = fresh_path(spark, "series")
    ST.append_series(event_stream(spark, folder), base).awaitTermination()
    points = ST.read_series(spark, base)
    return points.withColumn("avg_subjectivity", F.round("avg_subjectivity", 6))


def page_subscribers(spark: SparkSession, folder: str) -> DataFrame:
    """(url, user_id): every event of every user toggles a page, by its number, all of one type the same
    page, which so has many followers. Pages without an odd number of some user's toggles have none."""
    events, pages = read_table(spark, folder, "events"), read_table(spark, folder, "pages")
    n = F.lit(pages.count())
    popular = F.col("event_type") == F.lit(events.agg(F.min("event_type")).first()[0])
    toggles = events.select("user_id", "ts", F.when(popular, 0).otherwise(F.pmod("event_id", n)).alias("place"))
    # Some page numbers may not occur; what toggles them is lost to nobody.
    numbered = pages.select(F.pmod("page_id", n).alias("place"), "url")
    return H.subscriptions(toggles.join(numbered, "place").select("user_id", "url", "ts")).select("url", "user_id")


@register("stream_reports", "ST1")
def _(spark, folder):
    """Page snapshots as they arrive: the whole report of every subscribed url, copied to its users."""
    snapshots = table_stream(spark, folder, "pages").withColumn("ts", F.col("page_id"))
    base = fresh_path(spark, "reports")
    names = gazetteer(spark, folder)

    def make(pages: DataFrame) -> DataFrame:
        pages = cut(pages)
        found = RP.stages(pages, E.segments(pages, ["url"]), names, ["url"], capitals=False)
        packed = store.pack("sentiment_counts", "cluster_counts", "takeaways", "metrics", "entities", "graph")
        return RP.report(found, ["url"]).select("url", "status", "total_items", "avg_subjectivity", packed.alias("results"))

    ST.report_snapshots(snapshots, lambda: page_subscribers(spark, folder), make, base).awaitTermination()
    copies = spark.read.parquet(os.path.join(base, "copies")).drop("batch")
    failed = spark.read.parquet(os.path.join(base, "reports")).drop("batch").where("status <> 'ok'")
    return copies.unionByName(failed.withColumn("user_id", F.lit(None).cast("bigint")))


@register("page_report", "S6 C6 T4 N12 K10 K11")
def _(spark, folder):
    """The whole report of every document, packed as the stored JSON form."""
    full = RP.report_of(docs(spark, folder), gazetteer(spark, folder), DOC, capitals=False)
    packed = store.pack(
        "sentiment_counts", "cluster_counts", "takeaways", "metrics", "entities", "graph", "human_time_mins"
    )
    return full.select("doc_id", "status", "total_items", "avg_subjectivity", packed.alias("results"))
