"""Mixing sources to target weights, by DataFrame operations alone.

Every document has a hash-random key. Documents are range-partitioned by source and key, the sizes
before each document are a prefix sum over the ranges (totals of the ranges first, then inside each
range), and a source is cut at its exact budget: whole epochs as often as they fit, then the
documents in key order up to the rest, the last of them in part.

A target is ``weight * level``, but no more than ``most`` times the source's size; the level at which
the targets add up to the whole follows from the prefix sums of the sources in the order in which
they fill up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import stash

WEIGHTS, MOST_EPOCHS = (1, 2, 3), 3
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def hash_key(doc_id: Column, seed: str = "") -> Column:
    """A key that is random to the sources and the same in every run. Null ids share one."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


class PrefixSums:
    """Sums of the rows before a row, inside a group, whatever share of all rows the group has.

    Rows are range-partitioned by group and order, and written with the number of their range: a
    group spans ranges, and a lost executor changes nothing. Only the window over ``ranges``, one row
    per range and group in it, spans ranges.
    """

    def __init__(self, rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], label: str):
        self.by, self.order, self.values = list(by), list(order), list(values)
        ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*by, *order)])
        self.rows = stash(ranged.withColumn("range", F.spark_partition_id()), label)
        totals = self.rows.groupBy(*by, "range").agg(*[F.sum(v).alias(v) for v in values])
        earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        self.ranges = totals.select(
            *[F.col(c).alias(f"of_{c}") for c in (*by, "range")],
            *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"range_{v}") for v in values],
        )

    def before(self, ranges: DataFrame | None = None) -> DataFrame:
        """Rows with ``before_<value>``, and with the columns that ``ranges`` adds to those of a range."""
        ranges = self.ranges if ranges is None else ranges
        keys = [*self.by, "range"]
        inside = Window.partitionBy(*keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        summed = self.rows.select(
            "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"inside_{v}") for v in self.values]
        )
        met = F.lit(True)
        for key in keys:
            met = met & F.col(key).eqNullSafe(F.col(f"of_{key}"))
        spent = [f"{part}_{v}" for v in self.values for part in ("range", "inside")]
        return summed.join(ranges, met).select(
            "*", *[(F.col(f"range_{v}") + F.col(f"inside_{v}")).alias(f"before_{v}") for v in self.values]
        ).drop("range", *[f"of_{key}" for key in keys], *spent)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size).

    ``weights`` go round over the sources by code point, null last. The targets add up to all sizes;
    none is above ``most`` times its source's size, what is above is shared by the others by weight.
    """
    listed = sizes.select("*", F.col("source").isNull().alias("none"), F.lit(1).cast("bigint").alias("one"))
    ranked = PrefixSums(listed, [], ["none", "source"], ["one"], "mix-ranks").before()
    turn = (F.col("before_one") % len(weights)).cast("int") + 1
    shares = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("bigint"))
    shares = shares.select(
        "source",
        "none",
        "source_size",
        "weight",
        (F.col("source_size") * F.lit(most)).alias("cap"),
        (F.col("source_size").cast("double") * F.lit(most) / F.col("weight")).alias("full_at"),
    )
    # In the order in which sources fill up: what is left, by the weight left, is the level if all
    # before are full. It rises until the sources that are full are those, and never after.
    filling = PrefixSums(shares, [], ["full_at", "none", "source"], ["cap", "weight"], "mix-levels")
    whole = filling.rows.agg(F.sum("source_size").alias("sizes"), F.sum("weight").alias("weights")).first()
    left = (F.lit(whole["sizes"]) - F.col("before_cap")).cast("double")
    level = filling.before().agg(F.max(left / (F.lit(whole["weights"]) - F.col("before_weight")))).first()[0]
    target = F.least(F.col("weight") * F.lit(level).cast("double"), F.col("cap").cast("double"))
    return filling.rows.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = "",
) -> DataFrame:
    """How much of every document a mix of the sources takes.

    Returns doc_id, source, size (words of the whole text, null: 0), source_size, weight, target (of
    the source, in words), start (words of the source before the document, in key order), epochs
    (how often all of it is taken), rest (words of it that the last, partial epoch takes) and taken
    (words in all), one row per input row. A source's taken words are its target, rounded to a whole
    word. Runs agree: keys follow from ids, ties go by id and size, and rows that agree in source, id
    and size are counted as one row before anything is sorted, so repeats, and null ids, load no task.
    Texts are read once and never shuffled, whatever their length. A null source is a source; empty
    texts are of size 0 and take nothing; an empty table gives no rows; other columns are ignored.
    """
    if any(int(w) <= 0 for w in weights) or most < 1:
        raise ValueError("weights and the number of epochs must be positive")
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    rows = stash(read.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    shares = stash(targets(sizes, weights, most).withColumnRenamed("source", "named"), "mix-targets")

    keyed = rows.withColumn("key", hash_key(F.col("doc_id"), seed)).withColumn("all", F.col("size") * F.col("copies"))
    sums = PrefixSums(keyed, ["source"], ["key", "doc_id", "size"], ["all"], "mix-ranges")
    # A source's target goes to its ranges, so no join of documents meets a whole source.
    ranges = sums.ranges.join(shares, F.col("of_source").eqNullSafe(F.col("named"))).drop("named")
    placed = sums.before(ranges).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    placed = placed.select(
        "*",
        (F.col("before_all") + (F.col("copy") - 1) * F.col("size")).alias("start"),
        F.floor(F.col("target") + 0.5).alias("budget"),
    )
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("bigint"))
    placed = placed.withColumn("epochs", epochs)
    reach = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start")
    placed = placed.withColumn("rest", F.least(F.col("size"), F.greatest(F.lit(0).cast("bigint"), reach)))
    return placed.select(
        "doc_id", "source", "size", "source_size", "weight", "target", "start", "epochs", "rest",
        (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"),
    )


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word."""
    shown = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORDS), F.lit(0))
    return F.array_join(F.slice(shown, 1, F.greatest(count.cast("int"), F.lit(0))), "")


def mixed_texts(docs: DataFrame, mixed: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, epoch, text): the mix itself, a row per document and epoch.

    ``mixed`` is what :func:`mix` returned for ``docs``. Texts of the last epoch end where the budget
    does; documents that it does not reach have no row there, nor have texts without words. Rows that
    agree in id, source and size are taken for repeats of one document: the least of their texts
    stands for all, as often as they are. Texts are shuffled once, by that identity.
    """
    keys = ["doc_id", "source", "size"]
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.col(text).alias("text")
    ).where("size > 0").groupBy(*keys).agg(F.min("text").alias("text"))
    # Of equal rows at most one is cut, so a repeat's part is three numbers.
    parts = mixed.where("taken > 0").groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(
        F.sum("epochs").alias("whole"), F.max("epochs").alias("epochs"),
        F.count(F.when(F.col("rest") == F.col("size"), 1)).alias("full"),
        F.max(F.when(F.col("rest") < F.col("size"), F.col("rest")).otherwise(0)).alias("cut"),
    )
    met = F.lit(True)
    for key in keys:
        met = met & F.col(key).eqNullSafe(F.col(f"of_{key}"))
    joined = texts.join(parts, met)
    last = F.col("epochs") + 1
    many = lambda n, epoch: F.transform(F.sequence(F.lit(0).cast("bigint"), n), lambda i: F.struct(i.alias("i"), epoch(i).alias("epoch")))
    rows = joined.select(
        "doc_id", "source", "size", "text", "cut", "whole", "full",
        F.explode(many(F.col("whole") + F.col("full"), lambda i: F.when(i < F.col("whole"), i % F.greatest("epochs", F.lit(1)) + 1).otherwise(last))).alias("n"),
    )
    cut = F.col("n.i") == F.col("whole") + F.col("full")
    return rows.where(~cut | (F.col("cut") > 0)).select(
        "doc_id", "source", F.col("n.epoch").alias("epoch"),
        F.when(cut, first_words(F.col("text"), F.col("cut"))).otherwise(F.col("text")).alias("text"),
    )
