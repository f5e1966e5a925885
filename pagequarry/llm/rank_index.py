"""Fill-in-middle transformation, with cuts found by a learned rank index.

A text is cut into units, runs of ASCII letters or single other characters. The offsets of all unit
boundaries, in code points, grow with their rank almost along a line, so they are kept as segments
of a piecewise-linear function, each fitted so that no boundary is off by more than ``ERROR``, and
one signed byte a boundary: the residual between the boundary and the rounded prediction. Looking
up a rank is one search among few segments, one multiplication, and one residual, and is exact.

A segment grows from its first boundary while the cone of slopes that keep all its boundaries
within the error is not empty. The cone is narrowed for many boundaries at once, by running maxima
and minima over a window that doubles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import map_batches, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Out of a hundred texts: so many are transformed, and so many of those have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
# Residuals fit a signed byte: the error and half a step of rounding.
ERROR, WINDOW = 126, 1024


def boundaries(text: str) -> np.ndarray:
    """Offsets of the unit boundaries of a text, 0 and its length included."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = codes | 32
    letters = (low >= 97) & (low <= 122)
    # A unit ends after every character, unless that one and the next are letters.
    ends = np.flatnonzero(~(letters[:-1] & letters[1:])) + 1
    return np.concatenate([[0], ends, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)


@dataclass
class RankIndex:
    """Segments by first rank, with base offset and slope; and the residual of every rank."""

    starts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        starts, slopes, at, n = [], [], 0, len(offsets)
        while at < n:
            least, most, upto, window = -np.inf, np.inf, at + 1, WINDOW
            while upto < n:
                stop = min(n, upto + window)
                run = np.arange(upto - at, stop - at, dtype=np.float64)
                rise = (offsets[upto:stop] - offsets[at]).astype(np.float64)
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), least)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), most)
                shut = lows > highs
                if shut.any():
                    last = int(shut.argmax())
                    if last:
                        least, most = lows[last - 1], highs[last - 1]
                    upto += last
                    break
                least, most, upto, window = lows[-1], highs[-1], stop, 2 * window
            starts.append(at)
            slopes.append((least + most) / 2 if upto > at + 1 else 0.0)
            at = upto
        firsts = np.array(starts, np.int64)
        index = cls(firsts, offsets[firsts], np.array(slopes), np.zeros(0, np.int8))
        index.residuals = (offsets - index.predicted(np.arange(n))).astype(np.int8)
        return index

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        which = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[which] + np.rint(self.slopes[which] * (ranks - self.starts[which])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries with these ranks."""
        return self.predicted(ranks) + self.residuals[ranks]

    @property
    def units(self) -> int:
        return len(self.residuals) - 1


def draws(doc_id, seed: int = 1) -> list[int]:
    """Four numbers below 2**32 that follow from the document's id; a null id counts as empty."""
    shown = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(shown[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id, text: str, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    index = RankIndex.fit(boundaries(text))
    n = index.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    start, stop = index.offsets(np.array([one, two])).tolist()
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", start, stop - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", start, stop - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 1) -> DataFrame:
    """Texts with their middle moved to the end.

    Returns doc_id, n (units), form (``plain``, ``psm`` or ``spm``), prefix_chars, middle_chars (code
    points, null if plain) and output, one row per input row; other columns are ignored. Null counts
    as empty, and an empty text is plain; a null id draws as an empty one. Rows that repeat an id draw
    alike. A prefix, middle or suffix may be empty, also where both cuts fall together. Texts are
    whole at any length: a task holds about 8 MB of texts at a time, one text at least, and for it
    four bytes a character and nine a unit. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            n, form, prefix, middle, output = zip(*(transformed(i, t, seed) for i, t in rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, batch.schema.field("text").type)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return map_batches(
        source, run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of. Markers occur once each: texts with one are plain,
    and no text can complete a marker at the seam, since its first character occurs in it once."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
