"""Near-duplicate removal inside a page: first wins, dropped rows suppress nobody.

Small pages (line count known from the split) are decided whole in one task over a group of at
most ``limit`` rows. Larger pages are cut into ranges of positions, which are settled one after the
other, the same range of all pages at once. When a range is settled, what it and the ranges before
it have kept meets the ranges that follow: range r + 1 is a multiple of some largest power of two,
and so many ranges back meet so many ranges ahead. Each pair of ranges meets in exactly one of these
steps, so a range costs two jobs, a row takes part in a logarithm of the ranges, chains of copies of
any length settle, and copies that are gone take no further part.

Rows that meet are packed into blocks of similar length and bounded bytes. A pair of blocks is one
task's work, which returns the rows to drop and no pairs: a page of near copies stays linear in output.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import similar
from pagequarry.operators import clean as C
from pagequarry.operators.keys import Keys
from pagequarry.session import fresh_path

# Characters of a block; it has as many rows as that gives, within ``limit`` times eight.
BLOCK_CHARS = 1 << 20


def drop_near_duplicates(
    cleaned: DataFrame,
    by: Keys,
    threshold: float = 0.85,
    measure: str = "ratio",
    autojunk: bool = True,
    limit: int = 512,
) -> DataFrame:
    """Rows of ``cleaned`` (distinct ``cleaned`` texts of a page) that survive.

    Needs ``pos`` and ``n_lines`` (no ``pos`` of a page reaches its ``n_lines``).
    """
    columns = cleaned.columns
    small = _small_pages(
        cleaned.where(F.col("n_lines") <= limit), by, threshold, measure, autojunk
    ).select(*columns)
    large = cleaned.where(F.col("n_lines") > limit)
    if large.isEmpty():
        return small
    kept = _large_pages(large, by, threshold, measure, autojunk, limit)
    return small.unionByName(large.join(kept, [*by, "pos"], "left_semi").select(*columns))


def drop_in_pages(
    lines: C.Lines,
    by: Keys,
    text: Callable[[Column], Column] = lambda cleaned: cleaned,
    threshold: float = 0.85,
    measure: str = "ratio",
    autojunk: bool = True,
) -> DataFrame:
    """(page, pos, cleaned) that survive, of pages as :func:`clean.lines_of` gives them, by ``text`` of what
    is cleaned. Small pages are decided in their row, and nothing of them is shuffled."""
    which = _keep(threshold, measure, autojunk)(F.transform("_rows", lambda r: text(r["cleaned"])))
    some = lines.small.where(F.size("_rows") > 0).select(*by, "_rows")
    small = some.withColumn("_keep", which).select(*by, F.inline(F.transform("_keep", lambda i: F.get("_rows", i))))
    small = small.select(*by, "pos", "cleaned")
    return small if lines.others is None else small.unionByName(_of_lines(lines, by, text, threshold, measure, autojunk))


def kept_rows(lines: C.Lines, by: Keys, threshold: float = 0.85, measure: str = "ratio", autojunk: bool = True) -> DataFrame:
    """(page, n_lines, _rows): the small pages of ``lines`` with the segments that survive, in their row."""
    which = _keep(threshold, measure, autojunk)(F.transform("_rows", lambda r: r["cleaned"]))
    told = lines.small.select(*by, "n_lines", "_rows").withColumn("_keep", which)
    return told.select(*by, "n_lines", F.transform("_keep", lambda i: F.get("_rows", i)).alias("_rows"))


def accounting(
    lines: C.Lines,
    by: Keys,
    text: Callable[[Column], Column] = lambda cleaned: cleaned,
    threshold: float = 0.85,
    measure: str = "ratio",
    autojunk: bool = True,
) -> DataFrame:
    """:func:`clean.accounting` of what :func:`drop_in_pages` leaves; a small page is counted in its row."""
    which = _keep(threshold, measure, autojunk)(F.transform("_rows", lambda r: text(r["cleaned"])))
    small = C.counted(lines.small, by, F.size(which).cast("bigint"))
    if lines.others is None:
        return small
    return small.unionByName(C.accounting(lines.others, _of_lines(lines, by, text, threshold, measure, autojunk), by))


def _of_lines(lines: C.Lines, by: Keys, text: Callable, threshold: float, measure: str, autojunk: bool) -> DataFrame:
    rows = C.distinct_cleaned(lines.others, by).withColumn("cleaned", text(F.col("cleaned")))
    return drop_near_duplicates(rows, by, threshold, measure, autojunk).select(*by, "pos", "cleaned")


def _keep(threshold: float, measure: str, autojunk: bool) -> Callable:
    """Places of the texts of a page that stay. Equal texts are one, the first of them."""

    @F.pandas_udf("array<int>")
    def keep(texts: pd.Series) -> pd.Series:
        firsts = [{t: n for n, t in reversed(list(enumerate(page)))} for page in texts]
        pages = [sorted(f, key=f.get) for f in firsts]
        kept = similar.first_wins_of(pages, measure, threshold, autojunk)
        return pd.Series([[f[p[n]] for n in k] for f, p, k in zip(firsts, pages, kept)], dtype=object)

    return keep


def _small_pages(rows: DataFrame, by: Keys, threshold: float, measure: str, autojunk: bool) -> DataFrame:
    others = [c for c in rows.columns if c not in (*by, "pos")]

    keep = _keep(threshold, measure, autojunk)
    pages = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("pos", *others))).alias("_rows")
    )
    single = pages.where(F.size("_rows") == 1).select(*by, F.inline("_rows"))
    several = (
        pages.where(F.size("_rows") > 1)
        .withColumn("_keep", keep(F.transform("_rows", lambda r: r["cleaned"])))
        .select(*by, F.inline(F.transform("_keep", lambda i: F.get("_rows", i))))
    )
    return several.unionByName(single)


def _large_pages(
    rows: DataFrame, by: Keys, threshold: float, measure: str, autojunk: bool, limit: int
) -> DataFrame:
    spark, keys = rows.sparkSession, list(by)
    width = limit * 8
    step = -math.log(similar.length_floor(measure, threshold))
    # Texts of one cell differ in length by that quotient at most, so a block's rows follow from its bytes.
    fits = F.greatest(F.lit(1), F.least(F.lit(width), F.floor(F.lit(BLOCK_CHARS) * F.exp(-step * F.col("cell")))))
    placed = rows.select(
        *by,
        "pos",
        "cleaned",
        F.floor(F.col("pos") / width).cast("int").alias("range"),
        F.floor(F.log(F.greatest(F.length("cleaned"), F.lit(1)).cast("double")) / step).cast("int").alias("cell"),
    ).withColumn("part", F.floor(F.col("pos") / fits).cast("bigint"))
    # In range order on storage, so that a step reads its own ranges.
    path = fresh_path(spark, "ranges")
    placed.repartitionByRange("range", *by, "pos").sortWithinPartitions("range").write.parquet(path)
    placed = spark.read.parquet(path)
    ranges = placed.agg(F.max("range")).first()[0] + 1

    kept: list[str] = []
    gone: list[tuple[int, int, str]] = []  # first range, range after the last, where the dropped rows are

    def left(first: int, end: int) -> DataFrame:
        out = placed.where(F.col("range").between(first, end - 1))
        found = [where for a, b, where in gone if a < end and first < b]
        return out.join(spark.read.parquet(*found), [*keys, "pos"], "left_anti") if found else out

    for at in range(ranges):
        own = left(at, at + 1)
        survivors = _small_pages(own, by, threshold, measure, autojunk)
        kept.append(fresh_path(spark, f"kept-{at}"))
        survivors.select(*own.columns).write.parquet(kept[-1])
        reach = (at + 1) & -(at + 1)
        if at + 1 < ranges:
            earlier = spark.read.parquet(*kept[at + 1 - reach :])
            end = min(at + 1 + reach, ranges)
            dropped = _similar_to_any(earlier, left(at + 1, end), by, threshold, measure, autojunk)
            where = fresh_path(spark, f"gone-{at}")
            dropped.write.parquet(where)
            gone.append((at + 1, end, where))
    return spark.read.parquet(*kept).select(*keys, "pos")


def _similar_to_any(
    earlier: DataFrame, later: DataFrame, by: Keys, threshold: float, measure: str, autojunk: bool
) -> DataFrame:
    """(page, pos) of the later rows that some earlier row is similar to."""
    keys = list(by)
    left = earlier.groupBy(*by, "cell", "part").agg(F.collect_list("cleaned").alias("left_rows"))
    right = later.groupBy(*by, "cell", "part").agg(F.collect_list(F.struct("pos", "cleaned")).alias("right_rows"))

    # Which blocks meet: same or next length cell. Only block keys take part here; the rows join
    # afterwards on the full block key, which spreads a hot page.
    near = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")
    left_keys = left.select(*by, F.col("cell").alias("left_cell"), F.col("part").alias("left_part"), near)
    meet = left_keys.join(right.select(*by, "cell", "part"), [*keys, "cell"])
    pairs = meet.join(right, [*keys, "cell", "part"]).join(
        left.withColumnsRenamed({"cell": "left_cell", "part": "left_part"}),
        [*keys, "left_cell", "left_part"],
    )

    @F.pandas_udf("array<bigint>")
    def judge(a: pd.Series, texts: pd.Series, pos: pd.Series) -> pd.Series:
        return pd.Series(
            [[int(p[n]) for n in similar.any_similar(list(x), list(y), measure, threshold, autojunk)]
             for x, y, p in zip(a, texts, pos)],
            dtype=object,
        )

    verdicts: Column = judge(F.col("left_rows"), F.col("right_rows.cleaned"), F.col("right_rows.pos"))
    return pairs.select(*by, F.explode(verdicts).alias("pos")).distinct()
