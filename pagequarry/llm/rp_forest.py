"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: a node splits its points at the median of their projection
on the line through two of them. Every vector of the table is then led to its leaf in each tree. A
query searches all trees through one priority queue, always going on where the boundaries crossed so
far are nearest, until it has its leaves; the vectors in those are ranked exactly. How many leaves
that takes for the wanted recall is measured on the sample, against brute force.

Largest inner product becomes nearest direction by one more component, which gives all indexed
vectors the same length and is zero for queries.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import stash

NEIGHBOURS, EVERY, RECALL = 20, 20, 0.96
TREES, LEAVES = 4, 256
# The sample that the trees are fitted on: rows, and bytes of their vectors as doubles.
SAMPLE_ROWS, SAMPLE_BYTES, PROBES = 20_000, 64 << 20, 200
# Vectors and queries of one block of a leaf.
VECTORS, QUERIES = 8192, 4096


@dataclass
class Tree:
    """Inner nodes in arrays; a child below zero is the leaf ``-1 - child``."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), 0 if len(self.cuts) else -1, np.int64)
        while (moving := np.flatnonzero(at >= 0)).size:
            nodes = at[moving]
            places = np.einsum("ij,ij->i", points[moving], self.normals[nodes])
            at[moving] = self.children[nodes, (places >= self.cuts[nodes]).astype(np.int64)]
        return -1 - at


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split until a node has at most ``leaf`` points, or points that no line tells apart."""
    normals, cuts, children, leaves = [], [], [], 0
    waiting = [(np.arange(len(points)), -1, 0)]
    while waiting:
        own, parent, side = waiting.pop()
        here = None
        for _ in range(4 if len(own) > leaf else 0):
            a, b = points[rng.choice(own, 2, replace=False)]
            size = np.linalg.norm(a - b)
            if not size:
                continue
            normal = (a - b) / size
            places = points[own] @ normal
            cut = float(np.median(places))
            left = places < cut
            if left.any():
                here = len(cuts)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                waiting += [(own[left], here, 0), (own[~left], here, 1)]
                break
        if here is None:
            here = -1 - leaves
            leaves += 1
        if parent >= 0:
            children[parent][side] = here
    d = points.shape[1]
    return Tree(np.array(normals).reshape(-1, d), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves)


class Forest:
    def __init__(
        self, sample: np.ndarray, longest: float, k: int, recall: float = RECALL, trees: int = TREES, leaves: int = LEAVES
    ):
        """``sample``: some of the vectors, their number bounded by the caller; ``longest``: the
        greatest length of all of them."""
        rng = np.random.default_rng(11)
        self.longest = longest
        points = self.lifted(sample)
        self.trees = [grow(points, max(8, len(sample) // leaves), rng) for _ in range(trees)]
        self.sample = sample
        self.k = k
        self.homes = [t.leaf_of(points) for t in self.trees]
        probes = rng.choice(len(sample), min(len(sample), PROBES), replace=False) if len(sample) else []
        self.visits = self._enough(probes, recall) if len(probes) else 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0.0))
        return np.hstack([x, rest[:, None]])

    def orders(self, queries: np.ndarray, most: int) -> Iterator[list[tuple[int, int]]]:
        """For each query the first ``most`` leaves (tree, leaf) out of the shared queue."""
        flat = np.hstack([queries, np.zeros((len(queries), 1))])
        margins = [(flat @ t.normals.T - t.cuts).tolist() if len(t.cuts) else None for t in self.trees]
        children = [t.children.tolist() for t in self.trees]
        for q in range(len(queries)):
            queue = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(self.trees)]
            found: list[tuple[int, int]] = []
            while queue and len(found) < most:
                far, t, node = heapq.heappop(queue)
                while node >= 0:
                    margin = margins[t][q][node]
                    pair = children[t][node]
                    near = margin >= 0
                    heapq.heappush(queue, (far + margin * margin, t, pair[not near]))
                    node = pair[near]
                found.append((t, -1 - node))
            yield found

    def _enough(self, probes: np.ndarray, recall: float) -> int:
        """Leaves to visit so that the sample's true neighbours of its probes are found."""
        queries = self.sample[probes]
        scores = queries @ self.sample.T
        scores[np.arange(len(probes)), probes] = -np.inf
        k = min(self.k, len(self.sample) - 1)
        if k < 1:
            return 1
        true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        ranks = []
        for i, order in enumerate(self.orders(queries, sum(t.leaves for t in self.trees))):
            rank = {leaf: n for n, leaf in enumerate(order)}
            ranks += [min(rank[t, int(home[j])] for t, home in enumerate(self.homes)) for j in true[i]]
        return int(np.quantile(ranks, recall, method="higher")) + 1

    def floors(self, queries: np.ndarray, orders: list[list[tuple[int, int]]]) -> np.ndarray:
        """A score that at least k + 1 vectors of a query's own leaves reach: the sample's in those
        leaves are among them. What is below need not be passed on."""
        out = np.full(len(queries), -np.inf)
        scores = queries @ self.sample.T
        for i, order in enumerate(orders):
            seen = np.zeros(len(self.sample), bool)
            for t, homes in enumerate(self.homes):
                wanted = np.zeros(self.trees[t].leaves, bool)
                wanted[[leaf for tree, leaf in order if tree == t]] = True
                seen |= wanted[homes]
            own = scores[i, seen]
            if len(own) > self.k + 1:
                floor = np.partition(own, len(own) - self.k - 2)[len(own) - self.k - 2]
                out[i] = floor - 1e-9 * (1 + abs(floor))
        return out


def usable(vectors: DataFrame, vector: str, id_col: str) -> DataFrame:
    """(vec_id, vec) without vectors that take no part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    return rows.where(fine).where(F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def nearest(
    vectors: DataFrame,
    vector: str = "embedding",
    id_col: str = "vec_id",
    k: int = NEIGHBOURS,
    every: int = EVERY,
    recall: float = RECALL,
    block: tuple[int, int] = (VECTORS, QUERIES),
) -> DataFrame:
    """The ``k`` nearest rows by inner product for every row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (in double precision), nearest first, ties to the
    smaller id; all candidates if there are fewer than ``k``. Rows with a null id, and vectors that
    are null, empty, zero or hold a null or non-finite component take no part, nor do vectors of
    another dimension than the most frequent one (the larger of equals). Rows that repeat id and
    vector are one. Equal vectors are indexed once, with their smallest ids, of which no more than
    ``k`` + 1 can be asked for. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vector, id_col)
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    d = sizes[0]["d"]
    rows = rows.where(F.size("vec") == d)
    asks = F.max((F.col("vec_id") % every == 0).cast("int"))
    first = Window.partitionBy("vec").orderBy("vec_id")
    alike = rows.groupBy("vec").agg(asks.alias("asks"))
    few = rows.distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    few = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stash(
        few.join(alike, "vec").select(F.monotonically_increasing_id().alias("class"), "vec", "ids", "asks"), "vectors"
    )
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    drawn = classes.select("class", "vec").orderBy(F.xxhash64("class"), "class").limit(most).collect()
    longest = classes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    points = np.array([r["vec"] for r in sorted(drawn, key=lambda r: r["class"])], np.float64)
    forest = Forest(points, float(np.sqrt(longest)), k, recall)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(forest))

    def opened() -> Forest:
        return pickle.loads(shared.value)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened()
        for batch in batches:
            lifted = own.lifted(_matrix(batch.column("vec"), d))
            homes = np.stack([t.leaf_of(lifted) for t in own.trees], 1).astype(np.int32)
            offsets = pa.array(np.arange(len(homes) + 1, dtype=np.int32) * homes.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("vec"), batch.column("first"),
                 pa.ListArray.from_arrays(offsets, pa.array(homes.ravel()))],
                ["class", "vec", "first", "homes"],
            )

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                queries = _matrix(part.column("vec"), d)
                orders = list(own.orders(queries, own.visits))
                floors = own.floors(queries, orders)
                which, tree, leaf = [], [], []
                for i, order in enumerate(orders):
                    which += [i] * len(order)
                    tree += [t for t, _ in order]
                    leaf += [n for _, n in order]
                at = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [part.column("class").take(at), part.column("vec").take(at), pa.array(floors[which]),
                     pa.array(tree, pa.int32()), pa.array(leaf, pa.int32())],
                    ["query", "qvec", "floor", "tree", "leaf"],
                )

    source = classes.select("class", "vec", F.col("ids")[0].alias("first"), "asks")
    indexed = source.mapInArrow(led, "class bigint, vec array<double>, first bigint, homes array<int>")
    indexed = indexed.select("class", "vec", "first", F.posexplode("homes").alias("tree", "leaf"))
    visits = source.where("asks = 1").mapInArrow(
        walked, "query bigint, qvec array<double>, floor double, tree int, leaf int"
    )
    # Per leaf, of which there are a fixed number: in how many blocks its vectors and its queries go.
    here = indexed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / block[0]).cast("int").alias("vector_blocks"))
    there = visits.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / block[1]).cast("int").alias("query_blocks"))
    blocks = F.broadcast(stash(here.join(there, ["tree", "leaf"]), "leaf-blocks"))
    place = ["tree", "leaf", "vector_block", "query_block"]
    left = (
        indexed.join(blocks, ["tree", "leaf"])
        .withColumn("vector_block", F.pmod(F.xxhash64("class"), "vector_blocks").cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    ).select(*place, "class", "vec", "first")
    right = (
        visits.join(blocks, ["tree", "leaf"])
        .withColumn("query_block", F.pmod(F.xxhash64("query"), "query_blocks").cast("int"))
        .withColumn("vector_block", F.explode(F.sequence(F.lit(0), F.col("vector_blocks") - 1)))
    ).select(*place, "query", "qvec", "floor")

    def ranked(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query": [], "class": [], "score": []}
        if own.num_rows and asked.num_rows:
            own = own.sort_by("first").combine_chunks()
            asked = asked.combine_chunks()
            x = _matrix(own.column("vec").combine_chunks(), d)
            names, queries = own.column("class").to_numpy(), asked.column("query").to_numpy()
            floors = asked.column("floor").to_numpy()
            q = _matrix(asked.column("qvec").combine_chunks(), d)
            for low in range(0, len(q), 512):
                scores = q[low : low + 512] @ x.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                top = np.take_along_axis(scores, best, 1)
                i, j = np.nonzero(top >= floors[low : low + 512, None])
                out["query"].append(queries[low + i])
                out["class"].append(names[best[i, j]])
                out["score"].append(top[i, j])
        kinds = {"query": np.int64, "class": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in out.items()})

    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(
        ranked, "query bigint, class bigint, score double"
    )
    # One more than asked for, since a query may find itself.
    found = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    names = classes.select("class", "ids")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = found.join(names, "class").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = stash(listed.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1), "neighbours")
    asking = rows.where(F.col("vec_id") % every == 0).distinct().join(classes.select("vec", F.col("class").alias("query")), "vec")
    pairs = asking.select(F.col("vec_id").alias("query_id"), "query").join(
        listed.select("query", "vec_id", "score"), "query"
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
