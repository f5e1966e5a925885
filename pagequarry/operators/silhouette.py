"""Exact Euclidean silhouette and centroids for given labels over dense vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import vectors
from pagequarry.operators import metric
from pagequarry.operators.keys import Keys, small_side

# A key's packed centres are a few kilobytes; up to this many keys are broadcast.
PACKED_KEYS = 2000


def centroids(rows: DataFrame, by: Keys, cluster: str = "cluster") -> DataFrame:
    """(key, cluster, size, centre): mean vector per cluster, summed per dimension."""
    spread = rows.select(*by, cluster, F.posexplode("embedding").alias("dim", "x"))
    means = spread.groupBy(*by, cluster, "dim").agg(
        F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("size")
    )
    return means.groupBy(*by, cluster).agg(
        F.max("size").alias("size"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("centre"),
    )


def assign(rows: DataFrame, centres: DataFrame, by: Keys, cluster: str = "cluster") -> DataFrame:
    """Add the nearest centre and its distance; the centres of a key travel as one short array."""
    packed = centres.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("centre")))).alias("_centres")
    )
    d2 = lambda centre: F.aggregate(
        F.zip_with("embedding", centre, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    near = F.array_min(F.transform("_centres", lambda s: F.struct(d2(s["centre"]).alias("d2"), s["c"].alias("c"))))
    return (
        rows.join(small_side(packed, PACKED_KEYS), list(by))
        .withColumn("_near", near)
        .withColumn("nearest", F.col("_near.c"))
        .withColumn("dist", F.sqrt("_near.d2"))
        .drop("_near", "_centres")
    )


def wanted_clusters(rows: DataFrame, by: Keys, row_id: str, block: int) -> DataFrame:
    """(key, id, own, embedding, cluster): a row with its own cluster, and with every other one that
    may be nearest on average.

    A row's mean distance to a cluster lies between its distance to the centre and the root of that
    squared and the cluster's mean squared distance from its centre, so a cluster whose centre is
    farther than another one's upper bound is left out. Bounds are widened by more than rounding takes.
    """
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norms = rows.groupBy(*by, "cluster").agg(F.avg(norm2).alias("norm2"))
    packed = centroids(rows, by).join(norms, [*by, "cluster"]).groupBy(*by).agg(
        F.collect_list(F.struct("cluster", "centre", "norm2")).alias("centres")
    )
    placed = metric.in_key_blocks(rows.select(*by, row_id, "embedding", "cluster"), by, row_id, block)
    blocks = metric.packed_rows(placed, [*by, "part"], row_id, ["cluster"]).join(packed, list(by))

    @F.pandas_udf("array<array<int>>")
    def choose(own: pd.Series, rows: pd.Series, names: pd.Series, centres: pd.Series, norms: pd.Series) -> pd.Series:
        out = []
        for o, x, c, m, s in zip(own, rows, names, centres, norms):
            o, c, m, s = np.asarray(o), np.asarray(c), np.stack(m).astype(float), np.asarray(s, float)
            dist = vectors.distances(np.stack(x).astype(float), m)
            slack = 1e-6 * (1 + np.sqrt(s.max()) + dist.max())
            spread = np.maximum(s - (m**2).sum(axis=1), 0)
            other = o[:, None] != c
            upper = np.where(other, np.sqrt(dist**2 + spread), np.inf).min(axis=1)
            able = ~other | (dist <= (upper + slack)[:, None])
            out.append([c[row].tolist() for row in able])
        return pd.Series(out, dtype=object)

    told = blocks.withColumn(
        "_w", choose("cluster", "rows", F.col("centres.cluster"), F.col("centres.centre"), F.col("centres.norm2"))
    )
    zipped = F.arrays_zip(F.col("ids").alias("id"), F.col("rows").alias("embedding"), F.col("cluster").alias("own"), F.col("_w").alias("_c"))
    return told.select(*by, F.inline(zipped)).select(*by, "id", "own", "embedding", F.explode("_c").alias("cluster"))


def cluster_distances(rows: DataFrame, by: Keys, row_id: str, block: int = 512) -> DataFrame:
    """(key, id, own, cluster, total): distance sums of a row to its own cluster and to those of its
    key that may be the nearest other one.

    A row goes once to each such cluster, where it meets the members block by block; a pair of
    blocks is one array operation, and a task leaves one sum per row and cluster.
    """
    place = [*by, "cluster"]
    asking = metric.in_key_blocks(wanted_clusters(rows, by, row_id, block), place, "id", block)
    left = metric.packed_rows(asking, [*place, "part"], "id", ["own"])
    members = metric.in_key_blocks(rows.select(*place, row_id, "embedding"), place, row_id, block)
    right = metric.packed_rows(members, [*place, "part"], row_id).select(*place, F.col("rows").alias("other_rows"))

    def step(state, ids, own, left, right):
        total = vectors.distance_sums(left.astype(float), right.astype(float))
        return (ids.copy(), own.copy(), total) if state is None else (*state[:2], state[2] + total)

    def result(state):
        return {"id": state[0], "own": state[1], "total": state[2]}

    pairs = left.join(right, place).select(*place, "part", "ids", "own", "rows", "other_rows")
    found = metric.fold_pairs(pairs, [*place, "part"], step, result, "id bigint, own int, total double")
    return found.groupBy(*by, "id", "own", "cluster").agg(F.sum("total").alias("total"))


def silhouette(rows: DataFrame, by: Keys, row_id: str, block: int = 512) -> DataFrame:
    """(key, own, n, silhouette): mean silhouette of every cluster's members, 0 for singletons."""
    sizes = rows.groupBy(*by, "cluster").agg(F.count("*").alias("size"))
    means = cluster_distances(rows, by, row_id, block).join(sizes, [*by, "cluster"])
    own = F.col("own") == F.col("cluster")
    per_row = means.groupBy(*by, "id", "own").agg(
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.max(F.when(own, F.col("total"))).alias("inside"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    a = F.col("inside") / F.greatest(F.col("size") - 1, F.lit(1))
    top = F.greatest(a, F.col("b"))
    value = F.when((F.col("size") > 1) & (top > 0), (F.col("b") - a) / top).otherwise(0.0)
    return per_row.groupBy(*by, "own").agg(F.count("*").alias("n"), F.avg(value).alias("silhouette"))
