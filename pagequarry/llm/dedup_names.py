"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of fixed size. The distinct blocks are sorted and numbered;
the number is the block's name. Adjacent names are paired, the distinct pairs sorted and numbered
in turn, until every document has one name. Equal names mean equal texts, with no room for a hash
collision: names are given to distinct contents, and the short keys by which names travel back to
the documents are checked to be unique over all distinct blocks (else drawn again).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import row_key, stash

BLOCK_BYTES = 4096
# Maximal runs of blanks that are not one plain space already; those stay as they are.
BLANK_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null is empty; each run of ASCII blanks becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUNS, " ")


def _blocks(content: Column, size: Column, width: int) -> Column:
    last = F.greatest(F.lit(0), F.floor((size - 1) / width)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(content, i * width + 1, F.lit(width)))


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("h1"), F.xxhash64(block, F.lit(~seed)).alias("h2"))


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Sort the distinct rows of each partition and number them; the numbers are unique over all."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(content: DataFrame, width: int, seed: int) -> DataFrame | None:
    """(h1, h2, name) of every distinct block, or None if two blocks share their key.

    The blocks themselves are shuffled once, copies already collapsed on the map side.
    """
    distinct = content.select(F.explode(_blocks(F.col("content"), F.col("size"), width)).alias("block")).distinct()
    named = stash(
        _numbered(distinct, ["block"]).select(_key(F.col("block"), seed).alias("key"), "name").select("key.*", "name"),
        "block-names",
    )
    clashes = named.groupBy("h1", "h2").count().where("count > 1")
    return None if clashes.limit(1).count() else named


def identities(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``row`` (a number of its own), ``key`` (of id and text), the id, ``depth``
    and ``name``.

    Rows have equal (depth, name) exactly if their normalised texts are equal. ``text_sha256`` is
    the digest of the normalised text.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), row_key(text, id_col).alias("key"), normalised(F.col(text)).alias("content")
    ).select(
        "doc_id", "key", F.col("content").cast("binary").alias("content"), F.octet_length("content").alias("size")
    )
    seed = 0
    while (names := block_names(source, width, seed)) is None:
        seed += 1
    keyed = stash(
        source.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "key",
            F.sha2("content", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("content"), F.col("size"), width), lambda b: _key(b, seed)).alias("keys"),
        ),
        "block-keys",
    )
    rows = (
        keyed.select("row", F.size("keys").alias("blocks"), F.posexplode("keys").alias("pos", "key"))
        .select("row", "blocks", F.col("pos").cast("bigint").alias("pos"), "key.*")
        .join(names, ["h1", "h2"])
        .select("row", "pos", "name", "blocks")
    )
    # How many foldings a document needs follows from its number of blocks, so equal texts end together.
    most = keyed.agg(F.max(F.size("keys"))).first()[0] or 0
    rows = stash(rows, "names-0") if most > 1 else rows
    depth, done = 0, []
    while most > 1:
        done.append(rows.where("blocks = 1").select("row", F.lit(depth).alias("depth"), "name"))
        pairs = (
            rows.where("blocks > 1")
            .groupBy("row", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.shiftright(F.max("blocks") + 1, 1).alias("blocks"),
            )
        )
        pairs = stash(pairs, f"pairs-{depth}")
        folded = stash(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]), f"pair-names-{depth}")
        rows = stash(pairs.join(folded, ["a", "b"]).select("row", "pos", "name", "blocks"), f"names-{depth + 1}")
        most, depth = (most + 1) // 2, depth + 1
    done.append(rows.where("blocks = 1").select("row", F.lit(depth).alias("depth"), "name"))
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    return keyed.select("row", "key", "doc_id", "text_sha256").join(named, "row")


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = BLOCK_BYTES) -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when identical after each run of ASCII blanks is made one space; null counts as
    empty, so null and empty texts form one group. The row with the smallest id stays, null ids
    last; of rows that repeat an id, the first read stays. Returns row, key, doc_id, keep_id,
    group_size, kept, text_sha256, one row per input row; an empty table gives no rows, other
    columns of the input are ignored. Memory per task does not grow with the size of a group:
    groups are counted by aggregates with map-side combine, and joins on hot names are left to the
    adaptive skew split.
    """
    named = stash(identities(docs, text, id_col, width), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    groups = named.groupBy("depth", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["depth", "name"]).select(
        "row",
        "key",
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
