"""Small helpers for keyed top-n, bounded concatenation and grouped joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a look-up table for broadcast when it has at most ``most`` rows; else leave the choice
    to the optimiser, which then shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is computed once per row.

    They come out of a generator, which keeps the optimiser from copying their expressions into the
    filters and projections above.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def top_n(df: DataFrame, by: Keys, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. Spark cuts to ``n`` on the map side before the shuffle, so a
    hot key ships at most ``n`` rows per task."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_rows(df: DataFrame, by: Keys, same: Keys, pos: str = "pos") -> DataFrame:
    """Keep the first row (by ``pos``) of every distinct ``same`` value inside a key.

    An aggregate instead of a window: repeats collapse on the map side, so a text that holds a
    third of all rows costs one row per task. ``n_lines`` is the same all over a page, so it groups
    along; filters on it still reach the scan.
    """
    if "n_lines" in df.columns and "n_lines" not in by:
        same = [*same, "n_lines"]
    columns = [c for c in df.columns if c not in (*by, *same, pos)]
    aggregates = [F.min(pos).alias(pos)]
    aggregates += [F.min_by(c, pos).alias(c) for c in columns]
    return df.groupBy(*by, *same).agg(*aggregates).select(*df.columns)


def joined_text(
    df: DataFrame, by: Keys, text: str, sep: str, max_chars: int | None = None, pos: str = "pos"
) -> DataFrame:
    """Texts of a key in ``pos`` order, joined by ``sep``, whole or cut at ``max_chars``.

    With a cut, only rows that start before it are gathered, so a group never exceeds ``max_chars``
    characters plus one row, whatever the key holds.
    """
    head = df.select(*by, pos, text)
    if max_chars is not None:
        step = len(sep)
        # A row takes up its separator at least, whatever its text.
        head = top_n(head, by, [F.col(pos)], max_chars // max(step, 1) + 1, rank="_rank") if step else head
        before = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        head = head.withColumn(
            "_start", F.coalesce(F.sum(F.length(text) + step).over(before), F.lit(0))
        ).where(F.col("_start") < max_chars)
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    whole = F.array_join(F.transform("_parts", lambda p: p[text]), sep)
    return head.groupBy(*by).agg(parts.alias("_parts")).select(
        *by, (whole if max_chars is None else F.substring(whole, 1, max_chars)).alias("doc")
    )


def array_parts(df: DataFrame, by: Keys, value: str, pos: str = "pos", width: int = 1000) -> DataFrame:
    """Column to arrays: values of a key in ``pos`` order, in parts of at most ``width``.

    A normal page has part 0 only; concatenating the parts in order gives the whole list.
    """
    part = F.floor(F.col(pos) / width).cast("bigint")
    items = F.array_sort(F.collect_list(F.struct(pos, value)))
    return (
        df.groupBy(*by, part.alias("part"))
        .agg(items.alias("_items"))
        .select(*by, "part", F.transform("_items", lambda x: x[value]).alias("items"))
    )


def running_before(
    df: DataFrame, by: Keys, pos: str, values: Sequence[str], heads: Sequence[str] = (), width: int = 4096
) -> DataFrame:
    """Add ``before_<value>``, sums over the rows of a key with a smaller ``pos``, and ``first_<head>``, the
    value in the key's first row.

    Windows run inside stretches of ``width`` positions, and over the sums of stretches, so a key
    with a third of all rows is spread over its stretches. Where ``n_lines`` says that a key has one
    stretch only (no ``pos`` reaches it), that is all.
    """
    placed = df.withColumn("_part", F.floor(F.col(pos) / width))
    wide = placed.where(F.col("n_lines") > width) if "n_lines" in df.columns else placed
    sums = wide.groupBy(*by, "_part").agg(
        *[F.sum(v).alias(f"_s_{v}") for v in values], *[F.min_by(h, pos).alias(f"_h_{h}") for h in heads]
    )
    over = Window.partitionBy(*by).orderBy("_part")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *by, "_part", *[F.sum(f"_s_{v}").over(earlier).alias(f"_b_{v}") for v in values],
        *[F.first(f"_h_{h}").over(over).alias(f"_h_{h}") for h in heads], F.row_number().over(over).alias("_r"),
    ).where("_r > 1").drop("_r")
    stretch = Window.partitionBy(*by, "_part").orderBy(pos)
    inside = stretch.rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{v}") for v in values],
        *[F.first(h).over(stretch).alias(f"_f_{h}") for h in heads],
    )
    return summed.join(starts, [*by, "_part"], "left").select(
        *df.columns, *[(F.col(f"_i_{v}") + F.coalesce(f"_b_{v}", F.lit(0))).alias(f"before_{v}") for v in values],
        *[F.coalesce(f"_h_{h}", f"_f_{h}").alias(f"first_{h}") for h in heads],
    )


def block_sizes(df: DataFrame, by: Keys, block: int) -> DataFrame:
    """(key, parts): in how many blocks of about ``block`` rows a key goes."""
    return df.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))


def in_blocks(df: DataFrame, by: Keys, row_id: str, sizes: DataFrame) -> DataFrame:
    """Add ``parts`` and the row's block ``part``, 0 .. parts - 1, by hash of its id: blocks are even
    whatever the ids look like."""
    return df.join(sizes, list(by)).withColumn("part", F.pmod(F.xxhash64(row_id), F.col("parts")).cast("int"))


def every_part(parts: str = "parts") -> Column:
    """One row per block of the other side; each block lists its partners itself, so no task makes
    all pairs of a key."""
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
