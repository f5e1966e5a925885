"""Secret scanning over a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean trigram query is derived: an OR of alternatives, each an AND of
trigrams that every match must hold. The index has, per trigram that some query names, the postings
of the texts that hold it. Postings are intersected per alternative; what is left are candidates,
which the regex itself then verifies. A rule with an alternative that needs no trigram scans all
texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import few_rows, row_key, stash

# Alternatives that a derived query may hold before it is given up as "any text".
MOST_ALTERNATIVES = 64
# Candidate rows (two numbers each) that may be sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the least length of ``group``; shorter matches are dropped
    after matching, without another try inside them."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = True


RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("hosting", r"gh[opsur]_[A-Za-z0-9]+", 40, base=False),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+", 24, base=False),
    Rule("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


# ---------------------------------------------------------------- trigram queries

def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3].lower() for i in range(len(text) - 2))


@dataclass(frozen=True)
class _Path:
    """One alternative: trigrams gathered so far, and the literal text that the match ends with now."""

    grams: frozenset[str]
    tail: str

    def add(self, text: str) -> "_Path":
        return _Path(self.grams, self.tail + text)

    def broken(self) -> "_Path":
        return _Path(self.grams | _grams(self.tail), "")


def _walk(tokens, paths: list[_Path]) -> list[_Path]:
    for op, arg in tokens:
        if op is C.LITERAL:
            paths = [p.add(chr(arg)) for p in paths]
        elif op is C.SUBPATTERN:
            paths = _walk(arg[-1], paths)
        elif op is C.BRANCH:
            paths = [q for branch in arg[1] for q in _walk(branch, paths)]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            paths = [p.add(chr(c)) for p in paths for _, c in arg]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
            paths = paths + _walk(arg[2], paths)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            paths = [p.broken() for p in _walk(arg[2], paths)]
        else:
            paths = [p.broken() for p in paths]
        paths = list(dict.fromkeys(paths))
        if len(paths) > MOST_ALTERNATIVES:
            paths = [_Path(frozenset(), "")]
    return paths


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives of trigrams (in lower case) that a match needs, or None if any text may match."""
    needs = {p.broken().grams for p in _walk(parser.parse(pattern), [_Path(frozenset(), "")])}
    if frozenset() in needs:
        return None
    kept = [n for n in needs if not any(other < n for other in needs)]
    return sorted(sorted(n) for n in kept)


# ---------------------------------------------------------------- index and candidates

def build_index(docs: DataFrame, trigrams: list[str], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Postings (trigram, key): which texts hold which of ``trigrams``, in lower case. Rows that share
    a key only share candidates."""
    held = F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams])
    return (
        docs.select(row_key(text, id_col).alias("key"), F.lower(F.col(text)).alias("low"))
        .select("key", F.explode(F.array_compact(held)).alias("trigram"))
    )


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(key, kinds): the rules of which some alternative has all its trigrams in the text."""
    spark = index.sparkSession
    rows = [
        (kind, n, len(needs), gram)
        for kind, alternatives in queries.items()
        for n, needs in enumerate(alternatives)
        for gram in needs
    ]
    # A few dozen rows, bounded by the rules.
    wanted = F.broadcast(spark.createDataFrame(rows, "kind string, alternative int, size int, trigram string"))
    return (
        index.join(wanted, "trigram")
        .groupBy("key", "kind", "alternative", "size")
        .agg(F.count_distinct("trigram").alias("found"))
        .where("found = size")
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _found(rule: Rule, ask: Column) -> Column:
    """What a rule's regex cuts the text into: per match the code points before it (since the match
    before), its own code points, and whether it is long enough. Null if the rule isn't asked."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    zipped = F.zip_with(
        F.zip_with(gaps, whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"))),
        part,
        lambda s, p: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (F.length(p) >= rule.least).alias("ok")),
    )
    matches = F.filter(zipped, lambda m: m["size"].isNotNull())
    return F.when(ask & F.col("text").rlike(rule.pattern), matches)


def scan(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    id_col: str = "doc_id",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every secret of every text: row, doc_id, spans (array of kind, start, end, order, base).

    One row per input row, in whatever number; a text without secrets has an empty array, null
    counts as empty, repeated rows each get their result, other columns are ignored. Offsets are in
    code points, end exclusive; spans are sorted by start, then by the order of the rules. The
    texts are read once for the index and once to verify; only numbers are shuffled unless there
    are more than ``broadcast_rows`` candidates, when candidates join by shuffle.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q is not None}
    asked = source.withColumn("key", row_key())
    if indexed:
        grams = sorted({g for q in indexed.values() for needs in q for g in needs})
        index = stash(build_index(source, grams), "trigram-index")
        wanted = stash(candidates(index, indexed), "trigram-candidates")
        if few_rows(wanted, broadcast_rows):
            wanted = F.broadcast(wanted)
        asked = asked.join(wanted, "key", "left")
    else:
        asked = asked.withColumn("kinds", F.lit(None).cast("array<string>"))
    ask = {
        r.kind: F.lit(True) if queries[r.kind] is None else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
        for r in rules
    }
    found = stash(
        asked.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.array(*[_found(r, ask[r.kind]) for r in rules]).alias("found"),
        ),
        "secret-matches",
    )
    upto = Window.partitionBy("row", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        found.where(F.exists("found", lambda m: m.isNotNull()))
        .select("row", F.posexplode("found").alias("order", "matches"))
        .select("row", "order", F.posexplode("matches").alias("at", "m"))
        .select("row", "order", "m.size", "m.ok", F.sum(F.col("m.gap") + F.col("m.size")).over(upto).alias("end"))
        .where("ok")
    )
    kinds, base = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.base) for r in rules])
    # A row's spans are no more than its text, so this group is as bounded as the row itself.
    grouped = spans.groupBy("row").agg(
        F.array_sort(
            F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "order", "end"))
        ).alias("spans")
    )
    named = F.transform(
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")),
        lambda s: F.struct(
            F.get(kinds, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.get(base, s["order"]).alias("base"),
        ),
    )
    return found.select("row", "doc_id").join(grouped, "row", "left").select("row", "doc_id", named.alias("spans"))
