"""Entities by gazetteer and pattern, and the co-occurrence graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import tokens
from pagequarry.functions.fixed import LABEL_CATEGORY
from pagequarry.operators.clean import Pages
from pagequarry.operators.keys import Keys, computed, joined_text, running_before, top_n

DOC_CHARS = 1_000_000
TOKEN = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?]+[.!?]*"
PATTERNS = {
    "DATE": r"\b(?:19|20)[0-9]{2}(?:-[0-9]{2}-[0-9]{2})?\b",
    "MONEY": r"[$€£₹] ?[0-9][0-9,]*(?:\.[0-9]+)?",
}


def documents(segments: DataFrame, by: Keys, text: str = "text", max_chars: int | None = None) -> DataFrame:
    """Non-null texts of a page joined by a space, whole unless a cut is asked for."""
    return joined_text(segments.where(F.col(text).isNotNull()), by, text, " ", max_chars)


def sentences(docs: DataFrame, by: Keys) -> DataFrame:
    """(page, sentence, text): split after terminal punctuation, blanks dropped."""
    pieces = F.regexp_extract_all("doc", F.lit(SENTENCE), F.lit(0))
    return (
        docs.select(*by, F.posexplode(pieces).alias("sentence", "text"))
        .select(*by, F.col("sentence").cast("bigint").alias("sentence"), F.trim("text").alias("text"))
        .where(F.length("text") > 0)
    )


def page_sentences(segments: DataFrame | Pages, by: Keys, text: str = "text") -> DataFrame:
    """(page, sentence, text): what :func:`sentences` gives for the page's :func:`documents`, without
    gathering a page. Pages that come packed are split where they are.

    A segment yields an open head, whole sentences and an open tail. How many sentences are closed
    before a segment numbers its pieces, so a tail and the heads that go on with it have one number,
    and only those meet. A sentence without an end in its page is one row, as long as it is.
    """
    if isinstance(segments, Pages):
        held = F.filter(F.transform("_rows", lambda r: r[text]), lambda t: t.isNotNull())
        small = sentences(segments.small.select(*by, F.array_join(held, " ").alias("doc")), by)
        return small if segments.large is None else small.unionByName(page_sentences(segments.large, by, text))
    sized = ["n_lines"] if "n_lines" in segments.columns and "n_lines" not in by else []
    pieces_of = lambda t: F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0))
    held = segments.where(F.col(text).isNotNull()).select(
        *by, *sized, "pos", pieces_of(F.concat(F.lit(" "), F.col(text))).alias("_p"), F.col(text).rlike("^[.!?]").cast("int").alias("_lead")
    )
    open_end = F.coalesce((~F.try_element_at("_p", F.lit(-1)).rlike("[.!?]$")).cast("int"), F.lit(0))
    counted = running_before(
        held.select("*", (F.size("_p") - open_end).alias("_n"), F.lit(1).alias("_one")), by, "pos", ["_n", "_one"], ["_lead"]
    )
    # All but the first segment follow a blank, which is no part of a sentence's end. Ends that open
    # the page belong to no sentence: the first piece is not one then, and no number is spent on it.
    first = F.col("before__one") == 0
    lead = F.when(F.col("first__lead") == 1, 1).otherwise(0)
    counted = counted.select(
        *by, "pos", F.when(first & (lead == 1), F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1)))).otherwise(F.col("_p")).alias("_q"),
        (F.col("before__n") - F.when(first, 0).otherwise(lead)).alias("_at"),
    )
    pieces = counted.select(*by, "pos", "_at", F.posexplode("_q").alias("_i", "_x"))
    whole = (F.col("_i") > 0) & F.col("_x").rlike(r"[.!?]$")
    named = pieces.select(*by, (F.col("_at") + F.col("_i")).cast("bigint").alias("sentence"), "pos", "_x", whole.alias("_w"))
    parts = named.where("NOT _w").groupBy(*by, "sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "_x"))).alias("_l"))
    joined = parts.select(*by, "sentence", F.array_join(F.transform("_l", lambda x: x["_x"]), "").alias("_x"))
    return (
        named.where("_w").select(*by, "sentence", "_x").unionByName(joined)
        .select(*by, "sentence", F.trim("_x").alias("text")).where(F.length("text") > 0)
    )


def _clean_name(name: Column) -> Column:
    return F.trim(F.replace(F.trim(name), F.lit("\n"), F.lit(" ")))


def category_of(label: Column) -> Column:
    """Label to category; NULL for labels that are not shown."""
    category = F.lit(None).cast("string")
    for name, shown in LABEL_CATEGORY.items():
        category = F.when(label == name, shown).otherwise(category)
    return category


def _one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def known_names(gazetteer: DataFrame) -> DataFrame:
    """(key, size, name, label): names by the sequence of their tokens; blanks are one space, and
    what stands before the first and after the last token is left out."""
    inner = F.regexp_replace(_one_space(F.col("term")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    tokens = F.regexp_extract_all("name", F.lit(TOKEN), F.lit(0))
    return (
        gazetteer.select(inner.alias("name"), "label")
        .where("name <> ''")
        .groupBy("name").agg(F.min("label").alias("label"))
        .select(F.array_join(tokens, " ").alias("key"), F.size(tokens).alias("size"), "name", "label")
    )


HIT = "name string, label string, at bigint"
# Bytes of names up to which every worker walks the whole gazetteer as a trie.
TRIE_BYTES = 4 << 20
# Tokens that names begin with, up to which they are looked for before a sentence is sent to a worker.
FIRST_TOKENS = 20_000


def tagged(split: DataFrame, gazetteer: DataFrame, by: Keys, capitals: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(page, sentence, name, label, at): gazetteer names of any number of words, plus patterns.

    A name matches where the text has its tokens with the same signs between them; any blanks,
    line ends too, count as one space. ``at`` is the place of the first token. With ``capitals`` a
    name must start with a capital letter in the text. Names inside a longer name at the same place
    are dropped. A sentence is cut into tokens once, and offsets come from running sums over them, so
    the work is linear in its length. Names of up to ``trie_bytes`` (measured) are walked as a trie of
    tokens in the workers; of a larger gazetteer, the spellings that stand in the text meet the names
    in a join, without the text.
    """
    known = known_names(gazetteer)
    total, sizes = known.agg(F.sum(F.octet_length("name")), F.collect_set("size")).first()
    sizes = sorted(sizes) or [1]  # distinct numbers of words in a name: a handful, whatever the gazetteer holds
    starts = F.lit(None).cast("array<boolean>")
    # The most frequent characters come first.
    words = F.regexp_extract_all("text", F.lit(r"[a-zA-Z0-9[\p{L}\p{N}]]+"), F.lit(0))
    if capitals:
        starts = F.transform(words, lambda w: w.rlike(r"^\p{Lu}"))
    # Most sentences have no match, and send nothing of the patterns to the workers.
    cut_up = split.select(
        *by, "sentence", "text", words.alias("words"), starts.alias("starts"),
        F.array_compact(F.array(*[
            F.when(F.col("text").rlike(p), F.struct(
                F.lit(label).alias("label"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("found"), F.split("text", p, -1).alias("between")
            ))
            for label, p in PATTERNS.items()
        ])).alias("patterns"),
    )
    if (total or 0) <= trie_bytes:
        listed = split.sparkSession.sparkContext.broadcast([tuple(r) for r in known.select("key", "name", "label").collect()])

        @F.pandas_udf(f"array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
        def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            trie = tokens.trie(listed.value)
            for batch in batches:
                yield pd.Series([tokens.hits(*row, trie) for row in zip(*batch)], dtype=object)

        # Where names begin with few different tokens, only sentences that have one of them, or a pattern, are sent.
        first = {key.split(" ")[0] for key, _name, _label in listed.value}
        if 0 < len(first) <= FIRST_TOKENS:
            named = F.exists("words", lambda w: w.isin(sorted(first)))
            cut_up = computed(cut_up, _able=named | (F.size("patterns") > 0)).where("_able")
        return cut_up.select(*by, "sentence", F.inline(walk("words", "text", "starts", "patterns")))
    return _joined_hits(cut_up.withColumn("gaps", F.split("text", TOKEN, -1)), known, by, sizes)


def _joined_hits(cut_up: DataFrame, known: DataFrame, by: Keys, sizes: list[int]) -> DataFrame:
    """The same for a gazetteer of any size: every spelling of fitting length meets the names."""

    @F.pandas_udf("array<struct<i:int,n:int,at:bigint,spelled:string>>")
    def spellings(words: pd.Series, gaps: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([tokens.spellings(*row, sizes) for row in zip(words, gaps, starts)], dtype=object)

    @F.pandas_udf(f"array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    def patterned(patterns: pd.Series) -> pd.Series:
        return pd.Series([tokens.pattern_hits(row) for row in patterns], dtype=object)

    spelled = cut_up.select(*by, "sentence", F.inline(spellings("words", "gaps", "starts")))
    hits = spelled.join(known.select(F.col("name").alias("spelled"), "label"), "spelled")
    # Inside a longer name: an earlier start, or the same and a longer one, that ends no sooner.
    order = [F.col("i"), F.col("n").desc()]
    before = Window.partitionBy(*by, "sentence").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    free = hits.withColumn("_end", F.max(F.col("i") + F.col("n")).over(before))
    names = free.where(F.coalesce(F.col("i") + F.col("n") > F.col("_end"), F.lit(True)))
    return names.select(*by, "sentence", F.col("spelled").alias("name"), "label", "at").unionByName(
        cut_up.select(*by, "sentence", F.inline(patterned("patterns")))
    )


def mentions(tags: DataFrame, by: Keys) -> DataFrame:
    """(page, sentence, pos, name, category) for labels that are shown and names over one character."""
    return (
        tags.withColumn("category", category_of(F.col("label")))
        .withColumn("name", _clean_name(F.col("name")))
        .where(F.col("category").isNotNull() & (F.length("name") > 1))
        .select(*by, "sentence", F.col("at").alias("pos"), "name", "category")
    )


def top_entities(found: DataFrame, by: Keys, n: int = 5) -> DataFrame:
    """The ``n`` most frequent names per category; ties go to the earlier first mention."""
    counted = found.groupBy(*by, "category", "name").agg(
        F.count("*").alias("n"), F.min(F.struct("sentence", "pos")).alias("first")
    )
    order = [F.col("n").desc(), F.col("first"), F.col("name")]
    return top_n(counted, [*by, "category"], order, n).drop("first")


def nodes(found: DataFrame, by: Keys) -> DataFrame:
    """Name, category of its first mention, mention count and tooltip."""
    place = F.struct("sentence", "pos", "category")
    counted = found.groupBy(*by, "name").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # The wording of both tooltips (this one and that of the edges) is part of the format.
    title = F.format_string(
        "<b>%s</b><br>Type: %s<br>Mentions: %d", F.col("name"), F.col("first.category"), F.col("n")
    )
    return counted.select(*by, "name", F.col("first.category").alias("category"), "n", title.alias("title"), "first")


def top_nodes(all_nodes: DataFrame, by: Keys, n: int = 20) -> DataFrame:
    order = [F.col("n").desc(), F.col("first"), F.col("name")]
    return top_n(all_nodes, by, order, n).drop("first")


def edges(found: DataFrame, chosen: DataFrame, by: Keys) -> DataFrame:
    """Sentences two chosen names share, per unordered pair.

    Only names of the final graph (at most 20 a page) reach the pairing, so a sentence yields at
    most 190 pairs however long it is. Pairs are built from the sentence's own array.
    """
    kept = found.join(chosen.select(*by, "name"), [*by, "name"], "left_semi")
    packed = kept.groupBy(*by, "sentence").agg(F.sort_array(F.collect_set("name")).alias("_names"))
    pairs = F.expr(
        "flatten(transform(_names, (a, i) -> transform(slice(_names, i + 2, size(_names)), "
        "b -> named_struct('src', a, 'dst', b))))"
    )
    return (
        packed.where(F.size("_names") > 1)
        .select(*by, F.inline(pairs))
        .groupBy(*by, "src", "dst")
        .agg(F.count("*").alias("n"))
        .withColumn("title", F.format_string("Co-occurred %d times in same sentences", F.col("n")))
    )


def top_edges(all_edges: DataFrame, by: Keys, n: int = 30) -> DataFrame:
    return top_n(all_edges, by, [F.col("n").desc(), F.col("src"), F.col("dst")], n)


def neighbours(all_edges: DataFrame, by: Keys) -> DataFrame:
    """Every node with each node it is linked to, both directions of every edge."""
    both = F.array(
        F.struct(F.col("src").alias("name"), F.col("dst").alias("neighbour")),
        F.struct(F.col("dst").alias("name"), F.col("src").alias("neighbour")),
    )
    return all_edges.select(*by, "n", F.inline(both)).select(*by, "name", "neighbour", "n")


def packed_graph(pages: DataFrame, chosen: DataFrame, linked: DataFrame, by: Keys) -> DataFrame:
    """One row per page: arrays of nodes and edges, empty where a page has none."""
    keys = list(by)
    node_rows = chosen.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "category", "n", "title"))).alias("nodes")
    )
    edge_rows = linked.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("rank", "src", "dst", "n", "title"))).alias("edges")
    )
    node_type, edge_type = node_rows.schema["nodes"].dataType, edge_rows.schema["edges"].dataType
    return (
        pages.select(*by)
        .join(node_rows, keys, "left")
        .join(edge_rows, keys, "left")
        .select(
            *by,
            F.struct(
                F.coalesce("nodes", F.array().cast(node_type)).alias("nodes"),
                F.coalesce("edges", F.array().cast(edge_type)).alias("edges"),
            ).alias("graph"),
        )
    )
