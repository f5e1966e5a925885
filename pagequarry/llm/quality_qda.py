"""Document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics. Per class, mean and covariance come from sums
that Spark adds up over all labelled rows; the covariance is shrunk towards the pooled one and
towards a sphere. The score is the logistic of the difference of two log densities, whose Mahalanobis
distances use Cholesky factors inverted once, on fitting.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import held_out, map_batches, slices, stash

# Classes of UTF-8 bytes that are counted.
LOWER, UPPER, DIGIT, BLANK, BREAK, STOP, SYMBOL, HIGH = range(8)
FEATURES = (
    "length", "capitals", "digits", "symbols", "stops", "breaks", "word length", "word spread", "distinct",
    "repeats", "top word", "marked words", "short words", "line copies",
)
POOL, SPHERE = 0.05, 0.02
THRESHOLD = 0.3


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, SYMBOL, np.uint8)
    kinds[128:] = HIGH
    for first, last, kind in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
        kinds[ord(first) : ord(last) + 1] = kind
    kinds[[ord(c) for c in "\t \r"]] = BLANK
    kinds[ord("\n")] = BREAK
    kinds[[ord(c) for c in ".,;:?'\"()-"]] = STOP
    return kinds


BYTE_CLASSES = _byte_classes()


# Ordinary prose that is added to every text before shares are taken, so that a short one tells little:
# bytes and words, and the shares that they have.
PRIOR_BYTES, PRIOR_WORDS = 150, 25


def _odds(part: float, whole: float, usual: float, weight: float) -> float:
    """Log odds of a share, after ``weight`` cases of the ``usual`` share."""
    return float(np.log((part + weight * usual) / (max(whole - part, 0) + weight * (1 - usual))))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text; finite for any text, the empty one included."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(BYTE_CLASSES[raw], minlength=8).tolist()
    words = text.split()
    n = len(words)
    letters = counts[LOWER] + counts[UPPER]
    lengths = list(map(len, words))
    mean = sum(lengths) / max(n, 1)
    spread = sum(x * x for x in lengths) / max(n, 1) - mean * mean
    kinds = Counter(words)
    lines = text.split("\n")
    marked = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,;:?'\")"))
    b, w = PRIOR_BYTES, PRIOR_WORDS
    return [
        float(np.log(len(text) + 2 * b)),
        _odds(counts[UPPER], letters, 0.03, b),
        _odds(counts[DIGIT], len(raw), 0.003, b),
        _odds(counts[SYMBOL], len(raw), 0.002, b),
        _odds(counts[STOP], len(raw), 0.025, b),
        _odds(counts[BREAK], len(raw), 0.004, b),
        float(np.log((sum(lengths) + 5.0 * w) / (n + w))),
        float(np.log((spread * n + 10.0 * w) / (n + w))),
        float(np.log((len(kinds) + 0.9 * w) / (n + w) ** 0.85)),
        _odds(sum(map(eq, words, words[1:])), n, 0.005, w),
        _odds(max(kinds.values(), default=0), n, 0.05, w),
        _odds(marked, n, 0.002, w),
        _odds(sum(1 for x in lengths if x <= 3), n, 0.4, w),
        _odds(len(lines) - len(set(lines)), len(lines), 0.05, 3),
    ]


class Discriminant:
    """Class 1 against class 0 from (count, sum, sum of products) of each."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, sphere: float = SPHERE):
        d = len(FEATURES)
        known = {k: m for k, m in moments.items() if m[0] > 0}
        self.constant = None
        if len(known) < 2:
            # One class or none to learn from.
            self.constant = float(next(iter(known), 0.5))
            return
        means = {k: s / n for k, (n, s, _) in known.items()}
        scatter = {k: q - n * np.outer(means[k], means[k]) for k, (n, _, q) in known.items()}
        total = sum(n for n, _, _ in known.values())
        pooled = sum(scatter.values()) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.parts = []
        for k in (0, 1):
            n = known[k][0]
            own = scatter[k] / n / np.outer(scale, scale)
            mixed = (1 - pool - sphere) * own + pool * pooled / np.outer(scale, scale)
            mixed += np.eye(d) * (sphere * max(np.trace(own) / d, 1e-3) + 1e-6)
            factor = np.linalg.cholesky(mixed)
            bias = np.log(n / total) - np.log(np.diag(factor)).sum()
            self.parts.append((means[k] / scale, np.linalg.inv(factor).T, bias))
        self.scale = scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        x = x / self.scale
        density = [bias - 0.5 * (((x - mean) @ whiten) ** 2).sum(1) for mean, whiten, bias in self.parts]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def features(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and its statistics (array of double), one row per input row; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([statistics(t or "") for t in batch.column("text").to_pylist()])
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            listed = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed], ["doc_id", "features"])

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("features", T.ArrayType(T.DoubleType()))]
    )
    return map_batches(docs.selectExpr(f"`{id_col}` AS id", f"`{text}` AS text"), run, schema)


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Learn from every labelled row that isn't held out. Only the sums come to the driver: their
    number depends on the number of statistics alone."""
    d = len(FEATURES)
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    rows = measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("label", "features")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column("label").to_numpy()
            x = batch.column("features").flatten().to_numpy().reshape(len(of), d)
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in np.unique(of).tolist():
                held[k] = held.get(k, 0) + x[of == k].T @ x[of == k]
        for k, m in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())],
                ["label", "cell", "value"],
            )

    partial = rows.mapInArrow(sums, "label int, cell int, value double")
    moments = {k: np.zeros((d + 1) ** 2) for k in (0, 1)}
    for r in partial.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():
        moments[r["label"]][r["cell"]] = r["value"]
    square = {k: m.reshape(d + 1, d + 1) for k, m in moments.items()}
    return Discriminant({k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in square.items()})


def score(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Quality of every document: doc_id, held_out, score (0 to 1, higher is better), predicted.

    One row per input row. Null and empty texts have statistics and so a score; rows that repeat are
    scored each, columns other than id and text are never read. Without labels of both classes the
    score is the known class, or 0.5. The texts are read once; the statistics are kept in the
    shared folder, and only they are joined to the labels.
    """
    measured = stash(features(docs, text, id_col), "statistics")
    model = fit(measured, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return measured.mapInArrow(run, schema).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all their columns, that the classifier does not reject. The decision is
    made where the row is read, so no text is shuffled."""
    model = fit(stash(features(docs, text, id_col), "statistics"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = np.array([statistics(t or "") for t in batch.column(text).to_pylist()])
            yield batch.filter(pa.array(model.scores(x) >= THRESHOLD))

    return map_batches(docs, run, docs.schema)
