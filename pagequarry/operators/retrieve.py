"""Retrieval: vectors, exact nearest rows under a key, context assembly and prompt tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as X
from pagequarry.functions import vectors
from pagequarry.functions.fixed import CHAT_PROMPT, COMPARE_PROMPT, FACT_CHECK_PROMPT, STOP_WORDS
from pagequarry.operators import metric
from pagequarry.operators.keys import Keys, computed, joined_text, top_n
from pagequarry.session import cut

TOP_K = 7
# Blocks that are packed into one: a block of texts goes to every block of questions of its cell, and back.
TEXTS, QUESTIONS = 4, 8
# Ids of texts up to which every task is told which ones were found.
TOLD = 1_000_000


def encode(
    texts: DataFrame,
    text: str = "text",
    size: int = 256,
    stop_words: Sequence[str] = tuple(STOP_WORDS),
    portable: bool = False,
) -> DataFrame:
    """Add ``embedding``: hashed word counts of unit length. A model's own column serves as well.

    ``portable`` takes the buckets from MD5, which other engines have too, instead of Spark's own hash.
    """
    words = texts.withColumn("_w", X.without(X.tokens(F.col(text)), stop_words))
    if portable:
        bucket = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % size
        # Each step is worked out once per row.
        slots = computed(words, _b=F.array_sort(F.transform("_w", bucket)))
        slots = computed(slots, _d=F.array_distinct("_b"))
        slots = computed(slots, _c=F.transform("_d", lambda d: F.size(F.filter("_b", lambda x: x == d)).cast("double")))
        slots = computed(slots, _l=F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, c: s + c * c)))
        held = lambda b: F.try_element_at("_c", F.array_position("_d", b).cast("int"))
        dense = F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda b: F.when(F.array_contains("_d", b.cast("bigint")), held(b.cast("bigint")) / F.col("_l")).otherwise(0.0),
        )
        return slots.withColumn("embedding", dense).drop("_w", "_b", "_d", "_c", "_l")
    hashed = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=size).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(hashed)
    return unit.withColumn("embedding", vector_to_array("_unit")).drop("_w", "_tf", "_unit")


def nearest(
    questions: DataFrame,
    texts: DataFrame,
    by: Keys,
    question_id: str = "question_id",
    text_id: str = "text_id",
    k: int = TOP_K,
    block: int = 256,
    pivots: int = metric.PIVOTS,
) -> DataFrame:
    """(key, question, rank, text, dist): the k nearest texts of the question's own key, by L2.

    The texts of a key with more than ``block`` of them lie in cells around pivots, and a question
    goes only to the cells that may hold one of its k nearest (see :mod:`metric`). A cell's texts and
    its questions are packed into blocks; a pair of blocks is one product of matrices, which leaves few
    distances to work out, and a task emits k rows per question and cell, so a key with a third of all rows
    is spread over its cells, and top-k is cut again on the map side before the final shuffle.
    """
    placed, asked = _cells(questions, texts, by, question_id, text_id, k, block, pivots)
    place = [*by, "cell"]
    right = metric.packed_rows(metric.in_key_blocks(placed, place, text_id, TEXTS * block), [*place, "part"], text_id)
    left = metric.packed_rows(metric.in_key_blocks(asked, place, question_id, QUESTIONS * block), [*place, "part"], question_id)
    pairs = left.withColumnsRenamed({"ids": "question_ids", "rows": "question_rows"}).join(right.drop("part"), place)

    def step(state, q_ids, q_rows, ids, rows):
        before = None if state is None else state[1:]
        return q_ids.copy(), *vectors.nearest(q_rows.astype(float), rows.astype(float), ids, k, before)

    def result(state):
        ids, found, dist = state
        return {"question": np.repeat(ids, found.shape[1]), "text": found.ravel(), "dist": dist.ravel()}

    asking = [*place, "part"]
    pairs = pairs.select(*asking, "question_ids", "question_rows", "ids", "rows")
    hits = metric.fold_pairs(pairs, asking, step, result, "question bigint, text bigint, dist double").drop("cell", "part")
    ranked = top_n(hits, [*by, "question"], [F.col("dist"), F.col("text")], k)
    return ranked.withColumnsRenamed({"question": question_id, "text": text_id})


def _cells(
    questions: DataFrame, texts: DataFrame, by: Keys, question_id: str, text_id: str, k: int, block: int, pivots: int
) -> tuple[DataFrame, DataFrame]:
    """Texts with their cell, and questions with each cell they visit; keys of one block are one cell."""
    texts, asked = texts.select(*by, text_id, "embedding"), questions.select(*by, question_id, "embedding")
    samples = cut(metric.drawn(texts, by, text_id, block, pivots))
    one = F.lit(0).alias("cell")
    if samples.isEmpty():
        return texts.select("*", one), asked.select("*", one)
    large = samples.select(*by)
    placed = cut(metric.in_cells(texts.join(large, list(by), "left_semi"), by, text_id, samples))
    visits = metric.visits(
        asked.join(large, list(by), "left_semi"), by, question_id, samples, metric.cell_sizes(placed, by), k
    )
    return (
        placed.drop("away").unionByName(texts.join(large, list(by), "left_anti").select("*", one)),
        visits.unionByName(asked.join(large, list(by), "left_anti").select("*", one)),
    )


def nearest_work(
    questions: DataFrame,
    texts: DataFrame,
    by: Keys,
    question_id: str = "question_id",
    text_id: str = "text_id",
    k: int = TOP_K,
    block: int = 256,
    pivots: int = metric.PIVOTS,
) -> DataFrame:
    """(key, questions, texts, pairs, compared): how many pairs of a key :func:`nearest` computes."""
    placed, asked = _cells(questions, texts, by, question_id, text_id, k, block, pivots)
    held = placed.groupBy(*by, "cell").agg(F.count("*").alias("held"))
    compared = asked.join(held, [*by, "cell"]).groupBy(*by).agg(
        F.count_distinct(question_id).alias("questions"), F.sum("held").alias("compared")
    )
    sizes = held.groupBy(*by).agg(F.sum("held").alias("texts"))
    return compared.join(sizes, list(by)).select(
        *by, "questions", "texts", (F.col("questions") * F.col("texts")).alias("pairs"), "compared"
    )


def contexts(
    questions: DataFrame, hits: DataFrame, texts: DataFrame, question: Keys, text_id: str = "text_id"
) -> DataFrame:
    """Texts of the hits in rank order, joined by a blank line; questions without hits keep ''. Where the texts
    that were found are few (counted), the others are left out before anything is shuffled."""
    hits, bodies = cut(hits), texts.select(text_id, "text")
    ids = hits.select(text_id).distinct()
    if ids.limit(TOLD + 1).count() <= TOLD:
        bodies = bodies.join(F.broadcast(ids), text_id, "left_semi")
    found = hits.join(bodies, text_id)
    joined = found.groupBy(*question).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n"
        ).alias("context")
    )
    return questions.join(joined, list(question), "left").withColumn("context", F.coalesce("context", F.lit("")))


def question_status(question: Column, context: Column) -> Column:
    return (
        F.when(F.length(X.strip_ws(F.coalesce(question, F.lit("")))) == 0, "empty_question")
        .when(F.length(F.coalesce(context, F.lit(""))) == 0, "no_context")
        .otherwise("ok")
    )


def chat_prompts(asked: DataFrame, fact_check: Column | None = None) -> DataFrame:
    """Add ``prompt`` by one of two templates; ``fact_check`` defaults to false."""
    flag = F.lit(False) if fact_check is None else F.coalesce(fact_check, F.lit(False))
    question = X.strip_ws(F.col("question"))
    return asked.withColumn(
        "prompt",
        F.when(flag, F.format_string(FACT_CHECK_PROMPT, F.col("context"), question)).otherwise(
            F.format_string(CHAT_PROMPT, F.col("context"), question)
        ),
    )


def comparison_prompts(pairs: DataFrame, cleaned: DataFrame, site: str, max_chars: int = 12_000) -> DataFrame:
    """(pair_id, prompt): each side's cleaned text, cut to ``max_chars``, in one template."""
    docs = joined_text(cleaned, [site], "cleaned", " ", max_chars)
    one = docs.withColumnsRenamed({site: "site_a", "doc": "doc_a"})
    two = docs.withColumnsRenamed({site: "site_b", "doc": "doc_b"})
    sides = pairs.join(one, "site_a", "left").join(two, "site_b", "left")
    blank = F.lit("")
    prompt = F.format_string(
        COMPARE_PROMPT, F.col("site_a").cast("string"), F.coalesce("doc_a", blank),
        F.col("site_b").cast("string"), F.coalesce("doc_b", blank),
    )
    return sides.select("pair_id", "site_a", "site_b", prompt.alias("prompt"))
