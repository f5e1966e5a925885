"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings (no restart needed). Broadcast joins are chosen by measured size only: the static
# estimate knows nothing of what an explode makes of a row. The window-group-limit threshold is the largest
# top-n that Spark still cuts on the map side; the 1,000,000-character document cap needs
# up to that many rows per page.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Coalescing stops at an even share per core; this only lowers the floor below that share.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Join by hash instead of by sort where every build partition is measured to be this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000001",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # A worker holds a batch as it comes and as Python has it; rows of packed blocks are a few hundred kilobytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", name: str = "pagequarry") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    threads = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * threads))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and stream state.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    fresh folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    fresh = tempfile.mkdtemp(prefix="pagequarry-")
    context.setCheckpointDir(fresh)
    return fresh


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(work_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage and drop its lineage."""
    spark = df.sparkSession
    folder = work_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
