"""HTML pages to segments: an elements table, then every extraction rule as DataFrame logic.

The page is parsed once. One aggregate over the elements serves all passes and the gates between
them, so the parse is never repeated for a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions import markup
from pagequarry.functions import text as X
from pagequarry.functions.fixed import HEADING_TAGS, JUNK_CONTAINERS, JUNK_FRAGMENTS, TITLE_WORDS
from pagequarry.operators.keys import Keys

# Pass numbers in extraction order; 8 is the main-body fallback of sparse pages.
PASSES = {"heading": 1, "link": 2, "raw_link": 3, "container": 4, "titled": 5, "paragraph": 6, "list_item": 7, "main": 8}

BATCH = 5000


def elements(pages: DataFrame, by: Keys, html: str = "html", closed: bool = False) -> DataFrame:
    """One row per heading, link, span, div, p, li, article and section in document order. ``closed``:
    character references count only with their semicolon."""
    keys = [T.StructField(k, pages.schema[k].dataType) for k in by]
    found = T.StructType(
        [
            *keys,
            T.StructField("ord", T.LongType()),
            T.StructField("tag", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("own_attrs", T.StringType()),
            T.StructField("has_href", T.BooleanType()),
            T.StructField("main_line", T.BooleanType()),
            T.StructField(
                "ancestors",
                T.ArrayType(
                    T.StructType([T.StructField("tag", T.StringType()), T.StructField("attrs", T.StringType())])
                ),
            ),
        ]
    )
    names = list(by)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records: list[dict] = []
            for row in batch.itertuples(index=False):
                key = dict(zip(names, row))
                records += [{**key, **e} for e in markup.elements(row[-1], closed)]
                if len(records) >= BATCH:
                    yield pd.DataFrame(records)[found.names]
                    records = []
            if records:
                yield pd.DataFrame(records)[found.names]

    return pages.select(*by, html).mapInPandas(walk, found)


def is_junk(own_attrs: Column, ancestors: Column) -> Column:
    """Own class or id holds a junk fragment, or one of the nearest three ancestors is junk."""
    pattern = X.any_phrase(JUNK_FRAGMENTS)
    near = F.slice(ancestors, 1, 3)
    return own_attrs.rlike(pattern) | F.exists(
        near, lambda a: a["tag"].isin(JUNK_CONTAINERS) | a["attrs"].rlike(pattern)
    )


def _rules(text: Column, tag: Column, attrs: Column, href: Column, main: Column, junk: Column) -> dict[str, Column]:
    """Which pass an element feeds, gates aside."""
    size = F.length(text)
    content = X.is_content(text)
    plain = ~text.startswith("http")
    fair = ~junk & content
    titled = attrs.rlike("(?i)(" + "|".join(TITLE_WORDS) + ")")
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return {
        "heading": tag.isin(HEADING_TAGS) & fair,
        "link": (tag == "a") & fair & (size > 20) & plain,
        "raw_link": (tag == "a") & href & content & (size > 15) & (size < 200) & plain & (spaces >= 2),
        "container": tag.isin("article", "section") & fair,
        "titled": tag.isin("span", "div") & titled & fair & (size > 15) & (size < 300),
        "paragraph": (tag == "p") & fair & (size > 30),
        "list_item": (tag == "li") & fair & (size > 20) & (size < 200),
        "main": main & content & (size > 15),
    }


def classified(found: DataFrame) -> DataFrame:
    """Elements with a junk flag and one flag per pass."""
    c = F.col
    flagged = found.where(c("text").isNotNull()).withColumn("junk", is_junk(c("own_attrs"), c("ancestors")))
    rules = _rules(c("text"), c("tag"), c("own_attrs"), c("has_href"), c("main_line"), c("junk"))
    return flagged.withColumns(rules)


def gated_segments(flagged: DataFrame, by: Keys, few: int = 5, sparse: int = 10) -> DataFrame:
    """Ordered union of the passes with exact first-occurrence dedup.

    A gate looks at the number of distinct texts kept by the passes before it. Per distinct text we
    keep the first place each pass would take it from; per page we count what each pass adds, for
    both outcomes of the gates before it; then every text gets the first open pass that takes it.
    """
    keys = list(by)
    texts = flagged.groupBy(*by, "text").agg(
        *[F.min(F.when(F.col(p), F.col("ord"))).alias(p) for p in PASSES]
    )
    has = {p: F.col(p).isNotNull() for p in PASSES}
    start = has["heading"] | has["link"]
    titles = has["container"] | has["titled"]
    wide = start | has["raw_link"] | titles
    narrow = start | titles
    gates = texts.groupBy(*by).agg(
        F.count_if(start).alias("n_start"),
        F.count_if(wide).alias("n_wide"),
        F.count_if(narrow).alias("n_narrow"),
        F.count_if(wide | has["paragraph"]).alias("n_wide_p"),
        F.count_if(narrow | has["paragraph"]).alias("n_narrow_p"),
        *[
            F.count_if(base | extra).alias(name)
            for name, base, extra in (
                ("n_wide_l", wide, has["list_item"]),
                ("n_narrow_l", narrow, has["list_item"]),
                ("n_wide_pl", wide | has["paragraph"], has["list_item"]),
                ("n_narrow_pl", narrow | has["paragraph"], has["list_item"]),
            )
        ],
    )
    open_raw = F.col("n_start") < few
    before_p = F.when(open_raw, F.col("n_wide")).otherwise(F.col("n_narrow"))
    with_p = F.when(open_raw, F.col("n_wide_p")).otherwise(F.col("n_narrow_p"))
    open_p = before_p < few
    before_l = F.when(open_p, with_p).otherwise(before_p)
    open_l = before_l < few
    with_l = F.when(open_p, F.when(open_raw, F.col("n_wide_pl")).otherwise(F.col("n_narrow_pl"))).otherwise(
        F.when(open_raw, F.col("n_wide_l")).otherwise(F.col("n_narrow_l"))
    )
    total = F.when(open_l, with_l).otherwise(before_l)
    gates = gates.select(
        *by,
        open_raw.alias("open_raw_link"),
        open_p.alias("open_paragraph"),
        open_l.alias("open_list_item"),
        (total < sparse).alias("open_main"),
    )
    place = F.lit(None).cast("struct<pass:int,ord:bigint>")
    for name, number in reversed(PASSES.items()):
        taken = has[name]
        if name in ("raw_link", "paragraph", "list_item", "main"):
            taken = taken & F.col(f"open_{name}")
        place = F.when(taken, F.struct(F.lit(number).alias("pass"), F.col(name).alias("ord"))).otherwise(place)
    placed = texts.join(gates, keys).select(*by, "text", place.alias("place")).where("place IS NOT NULL")
    in_page = Window.partitionBy(*by)
    return placed.select(
        *by,
        (F.row_number().over(in_page.orderBy("place")) - 1).cast("bigint").alias("pos"),
        "text",
        F.col("place.pass").alias("pass"),
        F.count("*").over(in_page).alias("n_lines"),
    )


def segments(pages: DataFrame, by: Keys) -> DataFrame:
    """Pages to ordered, distinct segments."""
    return gated_segments(classified(elements(pages, by)), by)


def script_heavy(pages: DataFrame, by: Keys, html: str = "html") -> DataFrame:
    """Flag pages with more than ten script tags and under 500 characters of body text."""
    scripts = F.regexp_count(F.col(html), F.lit("(?i)<script")).cast("bigint")
    body = F.regexp_replace(F.col(html), r"(?is)^.*<body[^>]*>|</body>.*$", "")
    body = F.regexp_replace(body, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))
    return pages.select(*by, scripts.alias("n_scripts"), F.length(body).cast("bigint").alias("n_body")).withColumn(
        "script_heavy", (F.col("n_scripts") > 10) & (F.col("n_body") < 500)
    )
