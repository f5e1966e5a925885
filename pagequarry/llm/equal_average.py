"""Compression of vectors to short codes, with equal-average nearest-entry search.

A vector of integers is cut into equal parts, and each part is named by the nearest entry of the
part's codebook. Entries are sorted by the sum of their components. By the inequality of Cauchy and
Schwarz two vectors of ``d`` components whose sums differ by ``g`` are at least ``g * g / d`` apart
(squared), so the search for a part starts at its own sum and goes outward, on either side until the
next entry's squared sum gap over ``d`` strictly exceeds the best distance. Entries at exactly that
bound are still compared, since ties go to the lower index.

Parts are searched in blocks of neighbouring sums: the block's window of entries grows outward, and
a part leaves the block when both of its sides are closed. All arithmetic is exact: on doubles while
every term is below 2**53, else on 64-bit integers; beyond those the table is refused.

Spark assigns the parts where the rows are; a task sends on one sum per codebook entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import map_batches, stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Parts of one block, and entries by which a side of its window grows first; then twice as many, and so on.
BLOCK, STEP = 128, 8
# Components of one slice of a batch.
SLICE = 1 << 20


@dataclass
class Codebook:
    """The entries of one part, in the order of their component sums."""

    entries: np.ndarray  # (entries, d) integers, in index order

    def __post_init__(self) -> None:
        sums = self.entries.sum(1)
        self.order = np.lexsort((np.arange(len(sums)), sums))
        self.sums = sums[self.order]
        self.largest = int(np.abs(self.entries).max(initial=0))

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of every point's nearest entry, and how many entries were compared."""
        n, d = points.shape
        kind = number_kind(max(self.largest, int(np.abs(points).max(initial=0))), d)
        index, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        entries = self.entries[self.order].astype(kind)
        squares = (entries * entries).sum(1)
        sums = points.sum(1)
        compared = 0
        by_sum = np.argsort(sums, kind="stable")
        for low in range(0, n, BLOCK):
            rows = by_sum[low : low + BLOCK]
            index[rows], best[rows], count = self._block(points[rows].astype(kind), sums[rows], entries, squares)
            compared += count
        return index, best, compared

    def _block(
        self, points: np.ndarray, sums: np.ndarray, entries: np.ndarray, squares: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, int]:
        count, d = len(self.sums), points.shape[1]
        own = (points * points).sum(1)
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), count, np.int64)
        # The window starts where the sums of the block are; one entry at least.
        left = min(int(np.searchsorted(self.sums, sums[0])), count - 1)
        right = max(int(np.searchsorted(self.sums, sums[-1], "right")), left + 1)
        compared, open_rows, step = 0, np.arange(len(points)), STEP

        def compare(start: int, stop: int, rows: np.ndarray) -> None:
            gaps = own[rows, None] - 2 * (points[rows] @ entries[start:stop].T) + squares[start:stop]
            nearest = gaps.min(1)
            named = np.where(gaps == nearest[:, None], self.order[start:stop], count).min(1)
            nearest = nearest.astype(np.int64)
            wins = (nearest < best[rows]) | ((nearest == best[rows]) & (named < index[rows]))
            best[rows[wins]], index[rows[wins]] = nearest[wins], named[wins]

        compare(left, right, open_rows)
        compared += (right - left) * len(open_rows)
        while open_rows.size:
            below = np.zeros(len(open_rows), bool)
            above = np.zeros(len(open_rows), bool)
            if left:
                below = reaches(sums[open_rows] - self.sums[left - 1], best[open_rows], d)
            if right < count:
                above = reaches(self.sums[right] - sums[open_rows], best[open_rows], d)
            if below.any():
                start = max(0, left - step)
                compare(start, left, open_rows[below])
                compared += (left - start) * int(below.sum())
                left = start
            if above.any():
                stop = min(count, right + step)
                compare(right, stop, open_rows[above])
                compared += (stop - right) * int(above.sum())
                right = stop
            # Sums go on growing apart and the best only falls, so a closed side stays closed.
            open_rows = open_rows[below | above]
            step *= 2
        return index, best, compared


def reaches(gaps: np.ndarray, best: np.ndarray, d: int) -> np.ndarray:
    """Whether the squared sum gap over ``d`` is at most the best distance (in whole numbers)."""
    return gaps * gaps <= best * d


def number_kind(largest: int, d: int) -> type:
    """The numbers that hold every term of a distance between vectors of ``d`` components exactly."""
    # Squared distances, and sum gaps squared against distances times d.
    term = 4 * d * d * largest * largest
    if term < 1 << 53:
        return np.float64
    if term < 1 << 63:
        return np.int64
    raise ValueError(f"components up to {largest} are beyond exact 64-bit distances in {d} dimensions")


def whole_vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists take part, and their components as integers ``floor(scale * x)``."""
    starts = column.offsets.to_numpy()
    first = int(starts[0])
    flat = column.values.slice(first, int(starts[-1]) - first).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = starts - first
    sizes = np.diff(starts)
    bad = ~np.isfinite(flat)  # a null component is read as not a number
    upto = np.concatenate([[0], np.cumsum(bad)])
    fine = (upto[starts[1:]] == upto[starts[:-1]]) & (sizes > 0)
    fine &= column.is_valid().to_numpy(zero_copy_only=False)
    widths = np.unique(sizes[fine])
    if not widths.size:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    if len(widths) > 1:
        raise ValueError(f"vectors have unequal numbers of components: {widths.tolist()[:5]}")
    rows = np.flatnonzero(fine)
    d = int(widths[0])
    scaled = np.floor(flat[(starts[rows][:, None] + np.arange(d)).ravel()] * scale)
    if np.abs(scaled).max(initial=0) >= 1 << 53:
        raise ValueError("components times the scale are beyond 2**53")
    return rows, scaled.astype(np.int64).reshape(len(rows), d)


def _slices(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[pa.RecordBatch]:
    """Batches with a bounded number of components, one row at least."""
    for batch in batches:
        if batch.num_rows:
            wide = max(1, len(batch.column(vector).flatten()) // batch.num_rows)
            rows = max(1, SLICE // wide)
            for low in range(0, batch.num_rows, rows):
                yield batch.slice(low, rows)


@dataclass
class Codebooks:
    """One codebook a part. ``entries`` is (parts, entries, components of a part)."""

    entries: np.ndarray
    scale: int = SCALE

    def __post_init__(self) -> None:
        self.books = [Codebook(part) for part in self.entries]

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) of indices and of squared distances."""
        if vectors.shape[1] != self.width:
            raise ValueError(f"vectors of {vectors.shape[1]} components, codebooks for {self.width}")
        parts = np.split(vectors, len(self.books), axis=1)
        found = [book.search(part) for book, part in zip(self.books, parts)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def listed(self) -> str:
        """All components by part, entry and position."""
        return ",".join(str(x) for x in self.entries.ravel().tolist())

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([part[code] for part, code in zip(self.entries, codes.T)], axis=1)


def first_entries(vectors: DataFrame, vector: str, id_col: str, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The vectors of the smallest ids (nulls last, ties by vector) as starting codebooks."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "vec"):
            rows, whole = whole_vectors(batch.column("vec"), scale)
            if len(rows):
                starts = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * whole.shape[1])
                lists = pa.ListArray.from_arrays(starts, pa.array(whole.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), lists], ["vec_id", "vec"])

    source = _source(vectors, vector, id_col)
    kind = source.schema["vec_id"].dataType.simpleString()
    rows = map_batches(source, seeds, f"vec_id {kind}, vec array<bigint>")
    # At most ``entries`` rows come to the driver.
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    if not first:
        return None
    if len({len(r["vec"]) for r in first}) > 1:
        raise ValueError("vectors have unequal numbers of components")
    if len(first[0]["vec"]) % parts:
        raise ValueError(f"{len(first[0]['vec'])} components cannot be cut into {parts} equal parts")
    whole = np.array([r["vec"] for r in first], np.int64)
    return np.stack(np.split(whole, parts, axis=1))


def _source(vectors: DataFrame, vector: str, id_col: str, *more: str) -> DataFrame:
    return vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), *[F.col(c) for c in more]
    )


def refine(vectors: DataFrame, books: Codebooks, vector: str = "embedding", id_col: str = "vec_id") -> Codebooks:
    """One round: parts are assigned, entries become the floor of their parts' means."""
    parts, entries, d = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, d + 1), np.int64)
        for batch in _slices(batches, "vec"):
            rows, whole = whole_vectors(batch.column("vec"), books.scale)
            if not len(rows):
                continue
            codes, _ = books.assign(whole)
            for p, part in enumerate(np.split(whole, parts, axis=1)):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                total[p, used, :d] += np.add.reduceat(part[order], first, axis=0)
                total[p, used, d] += np.diff(np.append(first, len(order)))
        part, entry = np.nonzero(total[:, :, d])
        if len(part):
            starts = pa.array(np.arange(len(part) + 1, dtype=np.int32) * (d + 1))
            lists = pa.ListArray.from_arrays(starts, pa.array(total[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), lists], ["part", "entry", "sums"]
            )

    partial = map_batches(_source(vectors, vector, id_col), sums, "part int, entry int, sums array<bigint>")
    merged = (
        partial.select("part", "entry", F.posexplode("sums").alias("place", "value"))
        .groupBy("part", "entry", "place")
        .agg(F.sum("value").alias("value"))
    )
    fresh = np.zeros((parts, entries, d + 1), np.int64)
    # As many rows as the codebooks have components.
    for row in merged.collect():
        fresh[row["part"], row["entry"], row["place"]] = row["value"]
    used = fresh[:, :, d] > 0
    out = books.entries.copy()
    out[used] = fresh[used][:, :d] // fresh[used][:, d:]
    return Codebooks(out, books.scale)


def train(
    vectors: DataFrame,
    vector: str = "embedding",
    id_col: str = "vec_id",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks learned from all vectors that take part; None if there are none. The driver holds
    the codebooks, ``entries`` times the components of a vector, and nothing that grows with rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    first = first_entries(vectors, vector, id_col, parts, entries, scale)
    if first is None:
        return None
    books = Codebooks(first, scale)
    for _ in range(rounds):
        books = refine(vectors, books, vector, id_col)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, label, code (a byte a part) and error (squared distance) of every vector that takes part."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "vec"):
            rows, whole = whole_vectors(batch.column("vec"), books.scale)
            if not len(rows):
                continue
            codes, errors = books.assign(whole)
            taken = pa.array(rows)
            raw = codes.astype(np.uint8).tobytes()
            ends = np.arange(len(rows) + 1, dtype=np.int32) * codes.shape[1]
            code = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(taken), batch.column("label").take(taken), code, pa.array(errors.sum(1))],
                ["vec_id", "label", "code", "error"],
            )

    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    return map_batches(named, coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error bigint")


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """Add ``decoded``, the vector that a code stands for, on the scale of the input."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = b"".join(batch.column(code).to_pylist())
                indices = np.frombuffer(raw, np.uint8).reshape(batch.num_rows, -1)
                values = books.decoded(indices) / books.scale
                starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * values.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(starts, pa.array(values.ravel()))],
                    [*batch.schema.names, "decoded"],
                )

    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return map_batches(codes, opened, f"{listed}, decoded array<double>")


def compress(
    vectors: DataFrame,
    vector: str = "embedding",
    id_col: str = "vec_id",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors that take part, and the codebooks.

    Returns vec_id, label, code (binary, a byte a part), error (squared distance on the integer
    scale) and label_error (error summed over equal labels, nulls together). Rows whose vector is
    null, empty, or holds a null or non-finite component are dropped. Repeated rows stay, and each
    may start a codebook entry; rows with a null id come last there. Of equally near entries the
    lower index is taken. Vectors of unequal numbers of components, a number that the parts do not
    divide, and components beyond exact 64-bit distances raise ValueError. Other columns are ignored;
    an empty table gives no rows and no codebooks. A label that holds a third of all rows costs a
    task one row of the sum; the sums are joined as a written table, so that Spark broadcasts them
    if they are small and splits a hot label if not.
    """
    books = train(vectors, vector, id_col, parts, entries, rounds, scale)
    if books is None:
        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
        shape = f"vec_id {kinds[id_col]}, label {kinds[label]}, code binary, error bigint, label_error bigint"
        return vectors.sparkSession.createDataFrame([], shape), None
    codes = stash(encode(vectors, books, vector, id_col, label), "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = stash(sums.withColumnRenamed("label", "of"), "label-errors")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return joined.select("vec_id", "label", "code", "error", "label_error"), books
