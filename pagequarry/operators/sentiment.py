"""Sentiment: lexicon scores, labels, badges and their page aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as X
from pagequarry.functions.fixed import LEXICON, NEGATIONS
from pagequarry.operators.keys import Keys, computed, small_side


def score_by_table(
    segments: DataFrame, lexicon: DataFrame, by: Keys, negations: Sequence[str] = tuple(NEGATIONS)
) -> DataFrame:
    """As ``score``, with a lexicon table of any size (word, polarity, subjectivity, intensity).

    Words are joined to the lexicon, each with the two words before it; only hits are summed up per
    segment. The lexicon goes to every executor if it is counted to be small, else both sides meet
    by word.
    """
    known = lexicon.groupBy("word").agg(
        F.max("polarity").alias("p"), F.max("subjectivity").alias("s"), F.max("intensity").alias("i")
    )
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"[{X.WORD}']+"), F.lit(0))
    placed = segments.select(*by, "pos", words.alias("_w")).select(*by, "pos", "_w", F.posexplode("_w").alias("at", "word"))
    spoken = placed.select(
        *by, "pos", "word", F.coalesce(F.get("_w", F.col("at") - 1), F.lit("")).alias("b1"),
        F.coalesce(F.get("_w", F.col("at") - 2), F.lit("")).alias("b2"),
    )
    strong = known.where("i <> 1").select(F.col("word").alias("b1"), F.col("i").alias("k"))
    hits = spoken.join(small_side(known.drop("i")), "word").join(small_side(strong), "b1", "left")
    factor = F.coalesce("k", F.lit(1.0))
    turned = F.col("b1").isin(*negations) | (F.col("k").isNotNull() & F.col("b2").isin(*negations))
    polarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("p") * factor)) * F.when(turned, -0.5).otherwise(1.0)
    subjectivity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") * factor))
    means = hits.groupBy(*by, "pos").agg(F.avg(polarity).alias("polarity"), F.avg(subjectivity).alias("subjectivity"))
    scored = segments.join(means, [*by, "pos"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("polarity", "subjectivity")}
    )
    return scored.withColumn("sentiment_label", X.sentiment_label(F.col("polarity"))).withColumn(
        "sentiment", X.sentiment_badge(F.col("sentiment_label"))
    )


def score(
    segments: DataFrame,
    lexicon: Sequence[tuple] = tuple(LEXICON),
    negations: Sequence[str] = tuple(NEGATIONS),
) -> DataFrame:
    """Add polarity, subjectivity, label and badge. Map-only: no join, no shuffle."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"[a-z'[{X.WORD}]]+"), F.lit(0))
    scored = segments.withColumn("_words", words).withColumn(
        "_scores", X.score_tokens("_words", lexicon, negations)
    )
    scored = computed(
        scored,
        polarity=X.mean_of(F.col("_scores"), "polarity"),
        subjectivity=X.mean_of(F.col("_scores"), "subjectivity"),
    ).drop("_words", "_scores")
    return scored.withColumn("sentiment_label", X.sentiment_label(F.col("polarity"))).withColumn(
        "sentiment", X.sentiment_badge(F.col("sentiment_label"))
    )


def label_counts(scored: DataFrame, by: Keys) -> DataFrame:
    """Rows per label; labels that do not occur have no row."""
    return scored.groupBy(*by, "sentiment_label").agg(F.count("*").alias("n"))


def mean_subjectivity(scored: DataFrame, by: Keys) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg("subjectivity").alias("avg_subjectivity"))
