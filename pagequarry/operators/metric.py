"""Exact distances under a key, with what cannot matter left out by the triangle inequality.

Texts of a key go to the nearest of a few pivots, which are texts themselves, drawn by hash. A cell
knows its radius, the farthest text from its pivot. The k-th nearest of the drawn texts bounds the
distance a question has to look at, and a cell whose pivot is farther than that bound and the
radius together cannot hold one of its k nearest. What is left out is exact: bounds are widened by
more than rounding can take away.

A vector is shuffled to be placed, to its cell's block and to the join, whatever the size of the
key; a question once to each cell it has to visit, so to at most ``pivots`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import vectors
from pagequarry.operators.keys import Keys, block_sizes, in_blocks, top_n

# Texts drawn per key, and how many of them are pivots at most; rows placed together.
DRAWN, PIVOTS, PLACED = 256, 64, 1024


def packed_rows(rows: DataFrame, keys: Keys, row_id: str, more: Keys = ()) -> DataFrame:
    """Rows of a key packed into arrays: ids, rows and ``more``, each in the same order."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(row_id).alias("id"), "embedding", *more)).alias("_p"))
    return packed.select(*keys, F.col("_p.id").alias("ids"), F.col("_p.embedding").alias("rows"), *[F.col(f"_p.{c}").alias(c) for c in more])


def in_key_blocks(rows: DataFrame, by: Keys, row_id: str, block: int) -> DataFrame:
    """Rows with the number ``part`` of their block inside ``by``."""
    return in_blocks(rows, by, row_id, block_sizes(rows, by, block)).drop("parts")


def drawn(texts: DataFrame, by: Keys, text_id: str, block: int, pivots: int, size: int = DRAWN) -> DataFrame:
    """(key, sample, cells): ``size`` texts of every key that has more than a block; the first
    ``cells`` are pivots."""
    wanted = F.least(F.lit(pivots), F.ceil(F.col("n") / block)).cast("int")
    large = texts.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*by, wanted.alias("cells"))
    head = top_n(texts, by, [F.xxhash64(text_id), F.col(text_id)], size, "_r")
    listed = head.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", "embedding"))).alias("_s"))
    return listed.join(large, list(by)).select(*by, F.col("_s.embedding").alias("sample"), "cells")


def in_cells(texts: DataFrame, by: Keys, text_id: str, samples: DataFrame) -> DataFrame:
    """(key, id, embedding, cell, away): the nearest pivot and the distance to it."""

    @F.pandas_udf("cell array<int>, away array<double>")
    def place(rows: pd.Series, sample: pd.Series, cells: pd.Series) -> pd.DataFrame:
        cell, away = [], []
        for own, pivots, n in zip(rows, sample, cells):
            dist = vectors.distances(np.stack(own).astype(float), np.stack(pivots[:n]).astype(float))
            cell.append(dist.argmin(axis=1).astype(np.int32))
            away.append(dist.min(axis=1))
        return pd.DataFrame({"cell": cell, "away": away})

    blocks = packed_rows(in_key_blocks(texts, by, text_id, PLACED), [*by, "part"], text_id)
    found = blocks.join(samples, list(by)).withColumn("_p", place("rows", "sample", "cells"))
    zipped = F.arrays_zip(F.col("ids").alias(text_id), F.col("rows").alias("embedding"), F.col("_p.cell").alias("cell"), F.col("_p.away").alias("away"))
    return found.select(*by, F.inline(zipped))


def visits(questions: DataFrame, by: Keys, question_id: str, samples: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(key, id, embedding, cell): the cells that may hold one of the k nearest texts of a question.

    ``cells``: (key, cell, n, radius).
    """
    radii = cells.groupBy(*by).agg(F.collect_list(F.struct("cell", "radius")).alias("radii"))

    @F.pandas_udf("array<array<int>>")
    def choose(rows: pd.Series, sample: pd.Series, numbers: pd.Series, reach: pd.Series) -> pd.Series:
        out = []
        for own, near, cell, radius in zip(rows, sample, numbers, reach):
            cell, radius = np.asarray(cell), np.asarray(radius, float)
            dist = vectors.distances(np.stack(own).astype(float), np.stack(near).astype(float))
            bound = np.full(len(dist), np.inf)
            if dist.shape[1] >= k:
                bound = np.partition(dist, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * (1 + bound + dist.max(axis=1, initial=0))
            able = dist[:, cell] - radius <= (bound + slack)[:, None]
            out.append([cell[row].tolist() for row in able])
        return pd.Series(out, dtype=object)

    blocks = packed_rows(in_key_blocks(questions, by, question_id, PLACED), [*by, "part"], question_id)
    told = blocks.join(samples.join(radii, list(by)), list(by))
    told = told.withColumn("_v", choose("rows", "sample", F.col("radii.cell"), F.col("radii.radius")))
    zipped = F.arrays_zip(F.col("ids").alias(question_id), F.col("rows").alias("embedding"), F.col("_v").alias("_c"))
    return told.select(*by, F.inline(zipped)).select(*by, question_id, "embedding", F.explode("_c").alias("cell"))


def cell_sizes(placed: DataFrame, by: Keys) -> DataFrame:
    return placed.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))


# Rows of asking blocks that a task holds before it lets results go.
FOLDED = 200_000


TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def numbers(column: pa.ListArray, i: int) -> np.ndarray:
    """One row's numbers, or its vectors as a matrix, without a Python object for each."""
    held = column.slice(i, 1).flatten()
    if not pa.types.is_list(held.type):
        return held.to_numpy(zero_copy_only=False)
    lengths = held.value_lengths()
    if lengths.null_count or len(set(lengths.to_pylist())) > 1:
        raise ValueError("vectors must be given, and of one length")
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def fold_pairs(pairs: DataFrame, keys: Keys, step: Callable, result: Callable, shape: str) -> DataFrame:
    """Fold the pairs of blocks of each asking block where they are.

    ``pairs`` has ``keys`` (they name the asking block) and then the arrays that ``step(state, *columns)``
    takes as NumPy arrays, a pair at a time; ``result(state)`` is a dictionary of columns, put out with
    the keys. A task puts out an asking block once, however many blocks it has met there, but for a flush
    when it holds many.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    n = len(keys)
    types = {name: TYPES[kind] for name, kind in (c.split(" ") for c in shape.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, object] = {}
        size = 0
        key_types: list[pa.DataType] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            for key, state in held.items():
                columns = result(state)
                told = [pa.array(columns[c], kind) for c, kind in types.items()]
                named = [pa.array([v] * len(told[0]), kind) for v, kind in zip(key, key_types)]
                yield pa.RecordBatch.from_arrays([*named, *told], [*keys, *types])

        for batch in batches:
            key_types = [f.type for f in batch.schema][:n]
            columns = batch.columns
            for i in range(batch.num_rows):
                key = tuple(c[i].as_py() for c in columns[:n])
                values = [numbers(c, i) for c in columns[n:]]
                size += 0 if key in held else len(values[0])
                held[key] = step(held.get(key), *values)
                if size > FOLDED:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    return pairs.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [shape]))
