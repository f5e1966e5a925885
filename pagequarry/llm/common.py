"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import fresh_path

BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(text: str = "text", id_col: str = "doc_id") -> Column:
    """Stands for a row where another scan must find it again: hash of id and text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit("")))


def few_rows(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; the size check in front of every broadcast."""
    return df.limit(most + 1).count() <= most


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice hold about ``most`` bytes, one row at least.

    Bounds the Python objects of a task whatever the length of the texts.
    """
    for batch in batches:
        rows = batch.num_rows
        size = batch.column(column).nbytes
        if size <= most or rows <= 1:
            if rows:
                yield batch
            continue
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i in range(rows):
            held += int(lengths[i])
            if held >= most:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < rows:
            yield batch.slice(start)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker process, so that compiled tables are
    shared by the tasks that the process runs one after the other. A worker keeps one operator's
    tables only: asking for another name lets the former go."""
    home = sys.modules.setdefault("_pagequarry_llm_cache", types.ModuleType("_pagequarry_llm_cache")).__dict__
    if "held" not in home or name not in home["held"]:
        home["held"] = {name: {}}
    return home["held"][name]


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` for tables of texts: small Arrow batches, and memory given back after a task.

    Lowers the session's rows per Arrow batch if they are more than ``rows``; nothing else of the
    session is changed.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= rows:
        conf.set(ARROW_ROWS, str(rows))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)
