"""Streams: scheduled page reports, latest-by-key state, toggle state, growing time series.

Every stream appends or upserts into Parquet folders below a base path and keeps its own progress
there, so a lost executor or a restart resumes from the last finished micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators import history
from pagequarry.operators.keys import Keys


def arrivals(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of new Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _start(writer, every: str | None) -> StreamingQuery:
    """Run on a schedule, or once over everything that is there."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def report_snapshots(
    snapshots: DataFrame,
    subscriptions: Callable[[], DataFrame],
    make_report: Callable[[DataFrame], DataFrame],
    base: str,
    every: str | None = None,
) -> StreamingQuery:
    """Per micro-batch: every subscribed url once (its newest snapshot), reported, and a copy of the
    report for each subscriber.

    ``subscriptions`` is asked anew for each batch: (url, user_id), as they are then. A snapshot that
    comes late, after a newer one of its url was taken in an earlier batch, is no news and is left
    out; the newest (ts, page_id) of every url is keyed state below ``base``. A batch writes its own
    folders, ``reports`` with the status of every url and ``copies`` with those that went well, and
    overwrites them when it is run again, so a repeated batch adds nothing twice. Pages that fail
    carry their status and do not stop the others.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, subs = rows.sparkSession, subscriptions()
        others = [c for c in rows.columns if c != "url"]
        newest = rows.groupBy("url").agg(F.max_by(F.struct(*others), F.struct("ts", "page_id")).alias("_row"))
        newest = newest.select("url", "_row.*")
        seen = _state(spark, f"{base}/newest", ["url"], before=number)
        if seen is not None:
            known = seen.select("url", F.struct("ts", "page_id").alias("_seen"))
            newest = newest.join(known, "url", "left").where(
                F.col("_seen").isNull() | (F.struct("ts", "page_id") > F.col("_seen"))
            ).drop("_seen")
        due = newest.join(history.due_urls(subs).select("url"), "url", "left_semi")
        make_report(due).write.mode("overwrite").parquet(f"{base}/reports/batch={number}")
        report = spark.read.parquet(f"{base}/reports/batch={number}")
        history.fan_in(report, subs).write.mode("overwrite").parquet(f"{base}/copies/batch={number}")
        _merge(newest.select("url", "ts", "page_id"), f"{base}/newest", ["url"], number)

    writer = snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/progress")
    return _start(writer, every)


def latest_by_key(
    rows: DataFrame, by: Keys, value: str, base: str, ts: str = "ts", every: str | None = None
) -> StreamingQuery:
    """Last value per key, of equal times the greater one: each micro-batch writes its changed keys;
    read with ``read_latest``."""
    last = F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value")))
    state = rows.groupBy(*by).agg(last.alias("_last"))
    return _upserts(state.select(*by, F.col("_last.value").alias(value), F.col("_last.ts").alias(ts)), base, every, by)


def toggle_state(rows: DataFrame, base: str, every: str | None = None) -> StreamingQuery:
    """Toggles per (user, url) with their parity; read with ``read_latest``."""
    state = rows.groupBy("user_id", "url").agg(F.count("*").alias("n"), F.max("ts").alias("created_at"))
    return _upserts(state.withColumn("subscribed", F.col("n") % 2 == 1), base, every, ["user_id", "url"])


# Batches of changes that are merged into one table of the newest state.
MERGED = 16


def _upserts(state: DataFrame, base: str, every: str | None, by: Keys) -> StreamingQuery:
    def batch(changed: DataFrame, number: int) -> None:
        _merge(changed, base, by, number)

    writer = state.writeStream.outputMode("update").foreachBatch(batch)
    return _start(writer.option("checkpointLocation", f"{base}/progress"), every)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished batch folders below ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _state(spark: SparkSession, base: str, by: Keys, before: int | None = None, own: bool = False) -> DataFrame | None:
    """The newest state per key: the last merged table, and the changes since. ``before``: as it was
    before that batch, whatever a broken run of it has left; with its ``own`` changes if asked for."""
    able = lambda folder: [n for n in _batches(spark, f"{base}/{folder}") if before is None or n < before]
    merged = max(able("merged"), default=-1)
    paths = [f"{base}/changes/batch={n}" for n in (*able("changes"), *([before] if own else [])) if n > merged]
    parts = [spark.read.parquet(p).withColumn("_batch", F.lit(int(p.split("=")[-1]))) for p in paths]
    if merged >= 0:
        parts.append(spark.read.parquet(f"{base}/merged/batch={merged}").withColumn("_batch", F.lit(merged)))
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    others = [c for c in rows.columns if c not in (*by, "_batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*others), "_batch").alias("_row")).select(*by, "_row.*")


def _merge(changed: DataFrame, base: str, by: Keys, number: int) -> None:
    """Write a batch's changed keys; after ``MERGED`` batches also the whole state, as a new folder that
    counts once it is finished. What the table before that has replaced is removed, so a reader of it
    is not disturbed, and a batch that runs again finds what it started from."""
    spark = changed.sparkSession
    changed.write.mode("overwrite").parquet(f"{base}/changes/batch={number}")
    if (number + 1) % MERGED == 0:
        _state(spark, base, by, number, own=True).write.mode("overwrite").parquet(f"{base}/merged/batch={number}")
        spent = number - MERGED
        for folder, last in (("changes", spent), ("merged", spent - MERGED)):
            for n in _batches(spark, f"{base}/{folder}"):
                if n <= last:
                    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}/batch={n}")
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_latest(spark: SparkSession, base: str, by: Keys) -> DataFrame:
    """The newest state per key over all micro-batches; reads the live keys and at most the changes of
    the last ``MERGED`` batches."""
    return _state(spark, base, by)


def append_series(points: DataFrame, base: str, every: str | None = None) -> StreamingQuery:
    """Points of (user, url) as they come, by day; order is made when they are read."""
    rows = points.withColumn("dt", F.to_date("ts"))
    writer = rows.writeStream.outputMode("append").format("parquet").partitionBy("dt")
    return _start(writer.option("path", f"{base}/points").option("checkpointLocation", f"{base}/progress"), every)


def read_series(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/points").drop("dt")
