"""N-gram Jaccard self-join by chosen paths.

A text is its set of word shingles; min-hash coordinates turn sets of all sizes into equally many
tokens. A run splits the sets on a sampled coordinate, so that similar sets, which share most tokens,
tend to stay together: a bucket of sets with the same token is a path. Small buckets are compared by
brute force, larger ones split again on further tokens, on average 1/similarity of them per set, and
those that do not fall apart are taken as they are. Runs with other tokens repeat this until a pair
at the threshold is missed by none of them but with the probability that the target recall leaves.

What comes out are candidate groups. Inside each, all sets are then compared exactly, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import few_rows, map_batches, row_key, slices, stash, worker_cache
from pagequarry.llm.components import components
from pagequarry.llm.sp_model import Memo

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
COORDINATES, LEVELS, SMALL, BLOCK = 64, 4, 32, 512
BROADCAST_ROWS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SCALES = np.random.default_rng(5).integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- sets and signatures

def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shingles(text: str, word_hash, width: int = SHINGLE) -> np.ndarray:
    """The set of hashed shingles of ``width`` words (a shorter text is one shingle), sorted."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
    n = max(1, len(hashes) - width + 1)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for i in range(min(width, len(hashes))):
            mixed = (mixed ^ hashes[i : i + n]) * _MIX
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(sets: np.ndarray) -> np.ndarray:
    """The least of each coordinate's 32-bit hashes over the set."""
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(sets), 2048):
            best = np.minimum(best, ((sets[i : i + 2048, None] * _SCALES) >> np.uint64(32)).min(0))
    return best.astype("<u4")


def _hasher():
    cache = worker_cache("shingles")
    if "words" not in cache:
        cache["words"] = Memo(_word_hash, most=150_000)
    return cache["words"].__getitem__


def signatures(source: DataFrame, width: int) -> DataFrame:
    """Per row of ``source`` (doc_id, key, text): digest of its shingle set, its size, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = _hasher()
        for batch in slices(batches, "text"):
            sets = [shingles(t, word_hash, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "key", "digest", "n", "sig"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, run, f"doc_id {kind}, key bigint, digest binary, n bigint, sig binary")


# ---------------------------------------------------------------- paths

def runs_for(similarity: float, recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold is found with probability ``recall``, even if it
    lies in large buckets at every level."""
    more = 1 / similarity - 1
    stays = 1.0
    for _ in range(levels):
        # A token always, another in the share of buckets that makes 1/similarity on average.
        one, two = similarity * stays, more * similarity * stays
        stays = 1 - (1 - one) * (1 - two)
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - stays))))


def _token(sig: Column, coordinate: Column) -> Column:
    return F.substring(sig, coordinate * 4 + 1, F.lit(4))


def _children(rows: DataFrame, level: int, similarity: float) -> DataFrame:
    """Paths one token longer: (run, path, node). ``rows`` have run, path, node, sig."""
    first = F.pmod(F.col("run") * LEVELS + level, F.lit(COORDINATES))
    second = F.pmod(first + COORDINATES // 2 + LEVELS, F.lit(COORDINATES))
    more = int(round((1 / similarity - 1) * 1000))
    also = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(1000)) < more
    paths = F.array_compact(F.array(
        F.xxhash64("path", first, _token(F.col("sig"), first)),
        F.when(also, F.xxhash64("path", second, _token(F.col("sig"), second))),
    ))
    return rows.select("run", F.explode(paths).alias("path"), "node")


def _near(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket whose signatures agree in ``least`` coordinates or more. Rows come
    sorted by bucket, none of more than ``SMALL`` rows: neighbours at each distance are compared."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        path = held.column("path").to_numpy()
        ready = len(path) if batch is None else int(np.searchsorted(path == path[-1], True))
        if not ready:
            continue
        now, held = held.slice(0, ready), held.slice(ready)
        path, node = now.column("path").to_numpy(), now.column("node").to_numpy()
        sig = np.frombuffer(b"".join(now.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
        for k in range(1, SMALL):
            same = np.flatnonzero(path[k:] == path[:-k])
            if not len(same):
                break
            close = same[(sig[same] == sig[same + k]).sum(1) >= least]
            if len(close):
                yield pa.RecordBatch.from_arrays([pa.array(node[close]), pa.array(node[close + k])], ["u", "v"])


def _with_end(batches):
    yield from batches
    yield None


def candidate_edges(nodes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(u, v): edges that join all nodes which some run finds similar. ``nodes`` have node, sig."""
    runs = runs_for(similarity, recall)
    # A true pair agrees in fewer coordinates than five deviations below the mean once in millions.
    least = int(np.floor(COORDINATES * similarity - 5 * np.sqrt(COORDINATES * similarity * (1 - similarity))))
    rows = nodes.select(
        F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "node", "sig"
    ).withColumn("path", F.col("run").cast("bigint"))
    found = []
    for level in range(LEVELS):
        paths = _children(rows, level, similarity)
        paths = stash(paths, f"paths-{level}")
        sizes = stash(paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes-{level}")
        small = paths.join(sizes.where(F.col("size") <= SMALL), "path").select("path", "node").join(nodes, "node")
        small = small.select("path", "node", "sig").repartition("path").sortWithinPartitions("path", "node")
        found.append(stash(small.mapInArrow(lambda b: _near(b, least), "u bigint, v bigint").distinct(), f"near-{level}"))
        large = paths.join(sizes.where(F.col("size") > SMALL), "path").select("run", "path", "node")
        if level + 1 < LEVELS:
            large = stash(large, f"large-{level}")
            if large.isEmpty():
                break
            rows = large.join(nodes, "node")
        else:
            # Sets that agree in all sampled tokens belong to one group; who is similar in it is
            # settled exactly afterwards. One row per set, none per pair.
            hubs = large.groupBy("path").agg(F.min("node").alias("u"))
            found.append(stash(large.join(hubs, "path").select("u", F.col("node").alias("v")), "left-over"))
    edges = found[0]
    for part in found[1:]:
        edges = edges.unionByName(part)
    return edges


# ---------------------------------------------------------------- exact comparison

def _links(sets: list[np.ndarray], split: int, similarity: float) -> np.ndarray:
    """Which sets are similar, as a matrix: of the first ``split`` against the others, or of all
    against all if ``split`` is 0."""
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    rows, code = rows[shared], np.unique(code[shared], return_inverse=True)[1]
    a, b = (split, len(sets) - split) if split else (len(sets), len(sets))
    both = np.zeros((a, b), np.float32)
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    step = max(256, (8 << 20) // (4 * len(sets)))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        i, j = np.searchsorted(code, [low, low + step])
        part = np.zeros((len(sets), step), np.float32)
        part[rows[i:j], code[i:j] - low] = 1
        both += (part[:split] @ part[split:].T) if split else (part @ part.T)
    left, right = (sizes[:split], sizes[split:]) if split else (sizes, sizes)
    union = left[:, None] + right[None, :] - both
    return both >= similarity * union - 1e-6


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> set[tuple[int, int]]:
    """Edges that connect what ``near`` connects, about one per node."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    x, y = np.nonzero(near)
    x, y = np.searchsorted(nodes, left[x]), np.searchsorted(nodes, right[y])
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return set(zip(nodes[label[moved]].tolist(), nodes[moved].tolist()))


def _compare(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: the copies that each set is linked to (u = node, v null, links), and
    edges (u, v) that span the links. Rows come sorted by group and pair of blocks."""

    def settle(rows: list) -> pa.RecordBatch | None:
        first, second = rows[0][1], rows[0][2]
        rows = sorted(rows, key=lambda r: (r[3] != first, r[4]))
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        nodes, weights = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        split = 0 if first == second else sum(r[3] == first for r in rows)
        if len(rows) < 2 or split == len(rows) or (first != second and split == 0):
            return None
        near = _links(sets, split, similarity)
        if split:
            left, right = nodes[:split], nodes[split:]
            links = np.concatenate([near @ weights[split:], near.T @ weights[:split]])
        else:
            left = right = nodes
            near = near & ~np.eye(len(nodes), dtype=bool)
            links = near @ weights
        edges = sorted(_forest(near, left, right))
        has = links > 0
        u = nodes[has].tolist() + [e[0] for e in edges]
        v = [None] * int(has.sum()) + [e[1] for e in edges]
        n = links[has].tolist() + [0] * len(edges)
        if not u:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "links"]
        )

    held, at = [], None
    for batch in batches:
        columns = [batch.column(c) for c in ("group", "first", "second", "block", "node", "weight", "set")]
        for row in zip(*(c.to_pylist() for c in columns)):
            if row[:3] != at:
                if held and (out := settle(held)) is not None:
                    yield out
                held, at = [], row[:3]
            held.append(row)
    if held and (out := settle(held)) is not None:
        yield out


def jaccard_join(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    width: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    block: int = BLOCK,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Near-duplicate classes: row, key, doc_id, class_id, n_links, kept; one row per input row.

    ``class_id`` is the smallest id of the documents that chains of links (shingle sets of
    similarity ``similarity`` or more) connect, ``n_links`` the number of other rows that the row
    itself is linked to, ``kept`` marks one row per class: that of the smallest id, the first read
    of equal ones, null ids last. Texts of fewer than ``width`` words are one shingle; those without
    a word (null, empty, blank) have no links and are a class each. Rows with equal sets are joined
    once and counted with their number. Other columns are ignored, an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("key", row_key())
    signed = signatures(source.select("doc_id", "key", "text"), width)
    signed = stash(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    sets = stash(
        signed.where("n > 0").groupBy("digest").agg(
            F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min(order).alias("first")
        ),
        "sets",
    )
    nodes = stash(
        signed.where("n > 0").select(F.col("row").alias("node"), "sig", "key").join(sets, "node"), "nodes"
    )
    groups = stash(components(candidate_edges(nodes.select("node", "sig"), similarity, recall)), "groups")
    sizes = stash(
        groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "group-sizes"
    )
    members = nodes.select("node", "key", "digest", "weight").join(groups, "node").join(sizes, "component")
    members = stash(
        members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members"
    )
    wanted = members.select("key", "digest").distinct()
    few = few_rows(wanted, broadcast_rows)
    needed = source.join(F.broadcast(wanted) if few else wanted, "key", "inner").select("digest", "text")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = _hasher()
        for batch in slices(batches, "text"):
            found = [shingles(t, word_hash, width).tobytes() for t in batch.column("text").to_pylist()]
            right = [hashlib.blake2b(s, digest_size=16).digest() for s in found]
            out = pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(found, pa.binary())], ["digest", "set"]
            )
            # Another text with the same key is no member.
            yield out.filter(pa.array([a == b for a, b in zip(right, batch.column("digest").to_pylist())]))

    spelled_sets = map_batches(needed, spelled, "digest binary, set binary").dropDuplicates(["digest"])
    placed = members.select("component", "blocks", "block", "digest", "node", "weight").join(spelled_sets, "digest")
    others = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = others.select(
        F.col("component").alias("group"),
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "block", "node", "weight", "set",
    ).repartition("group", "first", "second").sortWithinPartitions("group", "first", "second")
    compared = stash(
        map_batches(paired, lambda b: _compare(b, similarity), "u bigint, v bigint, links bigint"), "compared"
    )
    classes = components(compared.where("v IS NOT NULL").select("u", "v"))
    links = compared.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    joined = stash(
        sets.join(classes, "node", "left").join(links, "node", "left").select(
            "digest", "weight", "first", F.coalesce("component", "node").alias("class"),
            F.coalesce("links", F.lit(0)).alias("links"),
        ),
        "classes",
    )
    heads = stash(joined.groupBy("class").agg(F.min("first").alias("head")), "heads")
    told = stash(joined.join(heads, "class").select("digest", "head", (F.col("links") + F.col("weight") - 1).alias("links")), "told")
    rows = signed.select("row", "key", "doc_id", "n", "digest")
    with_words = rows.where("n > 0").join(told, "digest").select(
        "row", "key", "doc_id", F.col("head.doc_id").alias("class_id"), F.col("links").alias("n_links"),
        (F.col("head.row") == F.col("row")).alias("kept"),
    )
    without = rows.where("n = 0").select(
        "row", "key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept")
    )
    return with_words.unionByName(without)
