"""Two-site comparison: similarity, shared entities, side-by-side metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.fixed import STOP_WORDS
from pagequarry.operators.keys import top_n
from pagequarry.operators.terms import term_counts

MAX_TERMS = 1000


def site_terms(cleaned: DataFrame, site: str, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """(site, term, tf): joining a site's texts by a space adds up their word counts."""
    counts = term_counts(cleaned, [site], pairs=False, stop_words=stop_words)
    return counts.groupBy(site, "term").agg(F.sum("tf").alias("tf"))


def similarity(pairs: DataFrame, terms: DataFrame, site: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """(pair_id, score): cosine of the two sites' TF-IDF fitted on the pair, times 100, half-even.

    A pair without terms on one side scores 0. The vocabulary is capped per pair by total count.
    """
    sides = F.inline(
        F.array(
            F.struct(F.lit("a").alias("side"), F.col("site_a").alias(site)),
            F.struct(F.lit("b").alias("side"), F.col("site_b").alias(site)),
        )
    )
    tf = F.col("tf")
    both = (
        pairs.select("pair_id", sides)
        .join(terms, site)
        .groupBy("pair_id", "term")
        .agg(
            F.sum(F.when(F.col("side") == "a", tf).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("side") == "b", tf).otherwise(0)).alias("b"),
        )
    )
    kept = top_n(both, ["pair_id"], [(F.col("a") + F.col("b")).desc(), F.col("term")], max_terms, "_r")
    df = (F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int")
    idf = F.log(F.lit(3.0) / (df + 1.0)) + 1.0
    scaled = kept.select("pair_id", (F.col("a") * idf).alias("wa"), (F.col("b") * idf).alias("wb"))
    summed = scaled.groupBy("pair_id").agg(
        F.sum(F.col("wa") * F.col("wb")).alias("dot"),
        F.sum(F.col("wa") * F.col("wa")).alias("aa"),
        F.sum(F.col("wb") * F.col("wb")).alias("bb"),
    )
    cosine = F.try_divide(F.col("dot"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb")))
    score = F.coalesce(F.bround(100 * F.round(cosine, 9), 0), F.lit(0.0)).cast("int")
    return pairs.join(summed, "pair_id", "left").select("pair_id", "site_a", "site_b", score.alias("score"))


def shared_entities(pairs: DataFrame, top: DataFrame, site: str) -> DataFrame:
    """(pair_id, name): names of site A's top entities that site B's hold too, whatever the case."""
    a = pairs.join(top.withColumnRenamed(site, "site_a"), "site_a").select(
        "pair_id", "name", F.lower("name").alias("low")
    )
    b = pairs.join(top.withColumnRenamed(site, "site_b"), "site_b").select(
        "pair_id", F.lower("name").alias("low")
    )
    return a.join(b, ["pair_id", "low"], "left_semi").select("pair_id", "name").distinct()


def sentiment_sides(scored: DataFrame, site: str) -> DataFrame:
    """(site, positive, neutral, negative), zero-filled, in display order."""
    label = F.col("sentiment_label")
    return scored.groupBy(site).agg(
        F.count_if(label == "Positive").alias("positive"),
        F.count_if(label == "Neutral").alias("neutral"),
        F.count_if(label == "Negative").alias("negative"),
    )


def radar(positive: Column, negative: Column, total: Column, subjectivity: Column, topics: Column) -> dict[str, Column]:
    """Five metrics clamped to 0..1; a total of 0 counts as 1."""
    base = F.when(F.coalesce(total, F.lit(0)) == 0, 1).otherwise(total)
    raw = {
        "positivity": positive / base,
        "negativity": negative / base,
        "subjectivity": subjectivity,
        "objectivity": 1 - subjectivity,
        "diversity": topics / 10,
    }
    return {name: F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double"))) for name, value in raw.items()}


def compact_entities(top: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` entities of a category; ``top`` carries the rank."""
    return top.where(F.col("rank") <= n)


def compact_takeaways(takeaways: DataFrame, n: int = 4) -> DataFrame:
    return takeaways.where(F.col("rank") <= n)


def pair_errors(pairs: DataFrame, status: DataFrame, site: str) -> DataFrame:
    """(pair_id, error): a blank address first, then side A's error, then side B's."""
    a = status.select(F.col(site).alias("site_a"), F.col("status").alias("status_a"))
    b = status.select(F.col(site).alias("site_b"), F.col("status").alias("status_b"))
    joined = pairs.join(a, "site_a", "left").join(b, "site_b", "left")

    def blank(name: str) -> Column:
        return F.length(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))) == 0

    def failed(side: str, number: int) -> Column:
        state = F.coalesce(F.col(f"status_{side}"), F.lit("no_content"))
        message = F.format_string(f"Page {number}, %s: %s", F.col(f"site_{side}").cast("string"), state)
        return F.when(state != "ok", message)

    error = F.when(blank("site_a") | blank("site_b"), "Two valid addresses are needed.").otherwise(
        F.coalesce(failed("a", 1), failed("b", 2))
    )
    return joined.select("pair_id", "site_a", "site_b", error.alias("error"))
