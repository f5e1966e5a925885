"""The registered queries: each one over a whole driver table, with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import text as X
from pagequarry.functions.fixed import HEADING_TAGS, IGNORED_PHRASES, LABEL_CATEGORY, LEXICON, NEGATIONS, STOP_WORDS
from pagequarry.operators import clean as C
from pagequarry.operators import compare as P
from pagequarry.operators import entities as N
from pagequarry.operators import segments as G
from pagequarry.operators import sentiment as S
from pagequarry.operators import terms as W
from pagequarry.session import cut, tune
from pagequarry.sources.tables import read_table, spread

DOC = ["doc_id"]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def register(name: str, covers: str, sql: str | None = None):
    """Decorator: enter a query under ``name``; ``covers`` lists the survey's operator ids."""

    def enter(run: Callable[[SparkSession, str], DataFrame]):
        def tuned(spark: SparkSession, folder: str) -> DataFrame:
            return run(tune(spark), folder)

        CATALOG[name] = Query(tuned, tuple(covers.split()), sql)
        return run

    return enter


# ---------------------------------------------------------------- shared inputs

def docs(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents").select("doc_id", *extra, "text"))


def lines(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Lines of every document; ``extra`` columns of it come along in the key."""
    return G.split_lines(docs(spark, folder, *extra), [*DOC, *extra])


def cleaned(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return C.clean(lines(spark, folder, *extra), [*DOC, *extra])


def pages(spark: SparkSession, folder: str, *extra: str) -> C.Pages:
    """:func:`cleaned`, with the segments of a document of usual size in its own row."""
    return C.clean_pages(docs(spark, folder, *extra), [*DOC, *extra])


def weighted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned segments, and their packed weights."""
    rows = cleaned(spark, folder)
    return rows, W.weigh(rows, DOC, keep=["n_lines", "text"])


# ---------------------------------------------------------------- shared SQL

SQL_LINES = (
    "seg AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS text, len(l)::BIGINT AS n_lines "
    "FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
)


def sql_normalise(text: str) -> str:
    return (
        f"trim(lower(regexp_replace(regexp_replace({text}, '[^{X.WORD}{X.WS}]', '', 'g'), '[{X.WS}]+', ' ', 'g')))"
    )


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{X.WS}]+|[{X.WS}]+$', '', 'g')"


def sql_content(text: str) -> str:
    return (
        f"(length({sql_strip(text)}) >= 10 AND NOT regexp_matches(lower({text}), '{X.any_phrase(IGNORED_PHRASES)}') "
        f"AND len(regexp_extract_all({text}, '\\p{{L}}')) / greatest(length({text}), 1) >= 0.4)"
    )


SQL_CLEAN = (
    SQL_LINES
    + f", cl AS (SELECT * FROM (SELECT doc_id, min(pos) AS pos, text, {sql_normalise('text')} AS cleaned "
    "FROM seg GROUP BY doc_id, text) WHERE length(cleaned) > 5)"
)
_STOP = X.quoted(STOP_WORDS)
SQL_TERMS = (
    SQL_CLEAN
    + f""", wl AS (SELECT doc_id, pos, list_filter(regexp_extract_all(cleaned, '[{X.WORD}]{{2,}}'),
        lambda t: t NOT IN ({_STOP})) AS w FROM cl),
    tk AS (SELECT doc_id, pos, unnest(w) AS term FROM wl UNION ALL
        SELECT doc_id, pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM wl),
    tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM tk GROUP BY ALL),
    nn AS (SELECT doc_id, count(*) AS n FROM cl GROUP BY doc_id),
    st AS (SELECT doc_id, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY ALL),
    vocab AS (SELECT doc_id, term, df, cf, n FROM st JOIN nn USING (doc_id) WHERE df <= 0.95::DOUBLE * n
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cf DESC, term) <= 5000)"""
)
SQL_WEIGHTS = (
    SQL_TERMS
    + """, raw AS (SELECT doc_id, pos, term, tf, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf
        FROM tf JOIN vocab USING (doc_id, term)),
    wt AS (SELECT *, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY doc_id, pos)) AS w FROM raw)"""
)


# ---------------------------------------------------------------- segments and cleaning

@register(
    "split_lines", "S1 E15",
    f"WITH {SQL_LINES}, s AS (SELECT doc_id, pos, {sql_strip('text')} AS text FROM seg) "
    f"SELECT doc_id, pos, text FROM s WHERE length(text) > 15 AND {sql_content('text')}",
)
def _(spark, folder):
    return G.content_lines(docs(spark, folder), DOC).select("doc_id", "pos", "text")


@register(
    "content_flags", "E3",
    f"WITH {SQL_LINES} SELECT doc_id, pos, {sql_content('text')} AS is_content FROM seg",
)
def _(spark, folder):
    return lines(spark, folder).select("doc_id", "pos", X.is_content(F.col("text")).alias("is_content"))


@register(
    "page_status", "E16 E17",
    f"""WITH {SQL_LINES}, s AS (SELECT doc_id, {sql_strip('text')} AS text FROM seg),
    c AS (SELECT doc_id, count(*) AS n_segments FROM s WHERE length(text) > 15 AND {sql_content('text')} GROUP BY 1),
    k AS (SELECT doc_id, count(*) AS n_clean FROM (SELECT doc_id, text FROM s
        WHERE length(text) > 15 AND {sql_content('text')} AND length({sql_normalise('text')}) > 5 GROUP BY ALL) GROUP BY 1)
    SELECT doc_id, coalesce(n_segments, 0) AS n_segments, coalesce(n_clean, 0) AS n_clean,
      CASE WHEN coalesce(n_segments, 0) = 0 THEN 'no_content' WHEN coalesce(n_clean, 0) < 2 THEN 'too_little_text'
      ELSE 'ok' END AS status,
      CASE WHEN coalesce(n_segments, 0) = 0 THEN 'The page has no text to work on.'
      WHEN coalesce(n_clean, 0) < 2 THEN 'Fewer than two different texts are left after cleaning.' END AS error
    FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def _(spark, folder):
    pages = docs(spark, folder)
    found = G.content_lines(pages, DOC)
    status = G.page_status(pages, found, C.clean(found, DOC), DOC)
    errors = G.error_records(status, "doc_id").withColumn("doc_id", F.col("url").cast("bigint")).drop("url")
    return status.join(errors, "doc_id", "left")


@register(
    "exact_dedup", "C1", f"WITH {SQL_LINES} SELECT doc_id, min(pos) AS pos, text FROM seg GROUP BY doc_id, text"
)
def _(spark, folder):
    return C.exact_dedup(lines(spark, folder), DOC).select("doc_id", "pos", "text")


@register("clean_text", "C2 C3", f"WITH {SQL_CLEAN} SELECT doc_id, pos, cleaned FROM cl")
def _(spark, folder):
    return cleaned(spark, folder).select("doc_id", "pos", "cleaned")


# ---------------------------------------------------------------- sentiment

_LEX = ", ".join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE, {i}::DOUBLE)" for w, p, s, i in LEXICON)
_NEG = X.quoted([n for n in NEGATIONS])


def sql_sentiment(lexicon: str) -> str:
    return SQL_LINES + f""", {lexicon},
    wd AS (SELECT doc_id, pos, w, unnest(range(1, len(w) + 1)) AS i FROM
        (SELECT doc_id, pos, regexp_extract_all(lower(text), '[{X.WORD}'']+') AS w FROM seg)),
    hit AS (SELECT doc_id, pos, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS b1,
        CASE WHEN i > 2 THEN w[i - 2] ELSE '' END AS b2 FROM wd WHERE w[i] IN (SELECT word FROM lex)),
    sc AS (SELECT doc_id, pos, greatest(-1, least(1, l.p * coalesce(k.f, 1))) *
        CASE WHEN b1 IN ({_NEG}) OR (k.f IS NOT NULL AND b2 IN ({_NEG})) THEN -0.5 ELSE 1 END AS p,
        greatest(0, least(1, l.s * coalesce(k.f, 1))) AS s
        FROM hit JOIN lex l USING (word) LEFT JOIN (SELECT * FROM lex WHERE f <> 1) k ON k.word = b1),
    ag AS (SELECT doc_id, pos, avg(p) AS p, avg(s) AS s FROM sc GROUP BY ALL),
    sent AS (SELECT doc_id, pos, text, coalesce(p, 0) AS polarity, coalesce(s, 0) AS subjectivity,
        CASE WHEN p > 0.1::DOUBLE THEN 'Positive' WHEN p < -0.1::DOUBLE THEN 'Negative' ELSE 'Neutral' END AS sentiment_label
        FROM seg LEFT JOIN ag USING (doc_id, pos)),
    bad AS (SELECT *, CASE sentiment_label WHEN 'Positive' THEN '🟩 Positive' WHEN 'Negative' THEN '🟥 Negative'
        ELSE '⬜ Neutral' END AS sentiment FROM sent)"""


SQL_LEXICON = f"lex(word, p, s, f) AS (VALUES {_LEX})"
SQL_SENTIMENT = sql_sentiment(SQL_LEXICON)
# A lexicon table made of the benchmark's words; lengths give the numbers, so both engines agree.
SQL_BENCH_LEXICON = f"""lex AS (SELECT word, ((length(word) % 7) - 3) / 4 AS p, (length(word) % 5) / 5 AS s,
    CASE WHEN length(word) = 4 THEN 1.3::DOUBLE ELSE 1 END AS f FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[{X.WORD}]+'))) AS word FROM benchmark))"""


def bench_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit(f"[{X.WORD}]+"), F.lit(0)))
    size = F.length("word")
    return read_table(spark, folder, "benchmark").select(words.alias("raw")).select(F.lower("raw").alias("word")).distinct().select(
        "word", ((size % 7 - 3) / 4).alias("polarity"), (size % 5 / 5).alias("subjectivity"),
        F.when(size == 4, 1.3).otherwise(1.0).alias("intensity"),
    )


@register(
    "sentiment_by_table", "T1 T2",
    f"WITH {sql_sentiment(SQL_BENCH_LEXICON)} SELECT doc_id, pos, round(polarity, 6) AS polarity, "
    "round(subjectivity, 6) AS subjectivity, sentiment_label FROM bad",
)
def _(spark, folder):
    return S.score_by_table(lines(spark, folder), bench_lexicon(spark, folder), DOC).select(
        "doc_id", "pos", F.round("polarity", 6).alias("polarity"), F.round("subjectivity", 6).alias("subjectivity"), "sentiment_label"
    )


@register(
    "sentiment_scores", "T1 T2 T3",
    f"WITH {SQL_SENTIMENT} SELECT doc_id, pos, round(polarity, 6) AS polarity, round(subjectivity, 6) AS subjectivity, "
    "sentiment_label, sentiment FROM bad",
)
def _(spark, folder):
    return S.score(lines(spark, folder)).select(
        "doc_id", "pos", F.round("polarity", 6).alias("polarity"), F.round("subjectivity", 6).alias("subjectivity"),
        "sentiment_label", "sentiment",
    )


@register(
    "sentiment_counts", "T4",
    f"WITH {SQL_SENTIMENT} SELECT doc_id, sentiment_label, count(*) AS n FROM sent GROUP BY ALL",
)
def _(spark, folder):
    return S.label_counts(S.score(lines(spark, folder)), DOC)


@register(
    "mean_subjectivity", "T5",
    f"WITH {SQL_SENTIMENT} SELECT doc_id, round(avg(subjectivity), 6) AS avg_subjectivity FROM sent GROUP BY ALL",
)
def _(spark, folder):
    mean = S.mean_subjectivity(S.score(lines(spark, folder)), DOC)
    return mean.withColumn("avg_subjectivity", F.round("avg_subjectivity", 6))


# ---------------------------------------------------------------- entities and graph

ENTITY_LABELS = ["PERSON", "ORG", "GPE", "LOC", "NORP"]


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Names from the benchmark texts: long words, and two and five words at a text's start. The
    label follows from the length, so both engines agree on it."""
    words = read_table(spark, folder, "benchmark").select(
        F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0)).alias("w")
    )
    single = words.select(F.explode("w").alias("term")).where(F.length("term") >= 6)
    double = words.where(F.size("w") > 1).select(F.array_join(F.slice("w", 1, 2), " ").alias("term"))
    # The beginning of a text as it is written, signs and line ends included, as a longer name.
    first = r"^[\p{L}]+(?:[^\p{L}]+[\p{L}]+){4}"
    longer = read_table(spark, folder, "benchmark").select(F.regexp_extract("text", first, 0).alias("term")).where("term <> ''")
    labels = F.array(*[F.lit(x) for x in ENTITY_LABELS])
    return single.union(double).union(longer).distinct().withColumn(
        "label", F.get(labels, F.length("term") % len(ENTITY_LABELS))
    )


def page_mentions(spark: SparkSession, folder: str, *extra: str, capitals: bool = False) -> DataFrame:
    by = [*DOC, *extra]
    split = N.page_sentences(pages(spark, folder, *extra), by)
    return N.mentions(N.tagged(split, gazetteer(spark, folder), by, capitals), by)


_CATEGORY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_CATEGORY.items())
SQL_SENTENCES = (
    SQL_CLEAN
    + f""", dc AS (SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS doc FROM cl GROUP BY 1),
    sn AS (SELECT * FROM (SELECT doc_id, unnest(range(len(l)))::BIGINT AS sentence, trim(unnest(l)) AS text
        FROM (SELECT doc_id, regexp_extract_all(doc, '{N.SENTENCE}') AS l FROM dc)) WHERE length(text) > 0)"""
)


def sql_mentions(capitals: bool = False) -> str:
    """Names by token offsets: a name's span is cut from the text and compared as it is written."""
    token, one = r"[\p{L}\p{N}]+", r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
    upper = r"WHERE regexp_matches(w[i + 1], '^\p{Lu}')" if capitals else ""
    patterns = " UNION ALL ".join(
        f"SELECT doc_id, sentence, m[j] AS name, '{k}' AS label, (1 + length(array_to_string(b[1:j], '')) + "
        f"length(array_to_string(m[1:j - 1], '')))::BIGINT AS spot FROM (SELECT doc_id, sentence, m, b, "
        f"unnest(range(1, len(m) + 1)) AS j FROM (SELECT doc_id, sentence, regexp_extract_all(text, '{v}') AS m, "
        f"string_split_regex(text, '{v}') AS b FROM sn))"
        for k, v in N.PATTERNS.items()
    )
    return (
        SQL_SENTENCES
        + f""", bw AS (SELECT text, regexp_extract_all(text, '[\\p{{L}}]+') AS w FROM benchmark),
    gt AS (SELECT term FROM (SELECT unnest(w) AS term FROM bw) WHERE length(term) >= 6
        UNION SELECT array_to_string(w[1:2], ' ') FROM bw WHERE len(w) > 1
        UNION SELECT regexp_extract(text, '^[\\p{{L}}]+(?:[^\\p{{L}}]+[\\p{{L}}]+){{4}}') FROM bw WHERE len(w) > 4),
    gn AS (SELECT {one.format('term')} AS name, [{X.quoted(ENTITY_LABELS)}][(length(term) % 5) + 1] AS label FROM gt WHERE term <> ''),
    gz AS (SELECT name, min(label) AS label, array_to_string(regexp_extract_all(name, '{token}'), ' ') AS key FROM gn GROUP BY name),
    gs AS (SELECT DISTINCT len(regexp_extract_all(name, '{token}')) AS n FROM gz),
    sw AS (SELECT doc_id, sentence, text, regexp_extract_all(text, '{token}') AS w, string_split_regex(text, '{token}') AS g FROM sn),
    ix AS (SELECT * FROM (SELECT *, unnest(range(len(w))) AS i FROM sw) {upper}),
    ng AS (SELECT *, array_to_string(w[i + 1 : i + n], ' ') AS key FROM ix, gs WHERE i + n <= len(w)),
    hits AS (SELECT * FROM (SELECT doc_id, sentence, i, n, name, label,
        1 + length(array_to_string(g[1 : i + 1], '')) + length(array_to_string(w[1 : i], '')) AS spot,
        length(array_to_string(w[i + 1 : i + n], '')) + length(array_to_string(g[i + 2 : i + n], '')) AS span, text
        FROM ng JOIN gz USING (key)) WHERE {one.format('substr(text, spot, span)')} = name),
    free AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id
        AND o.sentence = h.sentence AND o.n > h.n AND o.i <= h.i AND o.i + o.n >= h.i + h.n)),
    tg AS (SELECT doc_id, sentence, name, label, spot::BIGINT AS spot FROM free UNION ALL {patterns}),
    me AS (SELECT doc_id, sentence, spot AS pos, trim(replace(name, chr(10), ' ')) AS name,
        CASE label {_CATEGORY} END AS category FROM tg WHERE CASE label {_CATEGORY} END IS NOT NULL AND length(trim(name)) > 1)"""
    )


SQL_MENTIONS = sql_mentions()
SQL_NODES = (
    SQL_MENTIONS
    + """, na AS (SELECT doc_id, name, count(*) AS n, min({'s': sentence, 'p': pos, 'c': category}) AS f FROM me GROUP BY ALL),
    nd AS (SELECT doc_id, name, f.c AS category, n, '<b>' || name || '</b><br>Type: ' || f.c || '<br>Mentions: ' || n AS title,
        row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, name)::INTEGER AS rank FROM na),
    tn AS (SELECT * FROM nd WHERE rank <= 20)"""
)
SQL_EDGES = (
    SQL_NODES
    + """, ps AS (SELECT DISTINCT doc_id, sentence, name FROM me SEMI JOIN tn USING (doc_id, name)),
    ed AS (SELECT a.doc_id, a.name AS src, b.name AS dst, count(*) AS n FROM ps a JOIN ps b
        ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.name < b.name GROUP BY ALL),
    te AS (SELECT *, 'Co-occurred ' || n || ' times in same sentences' AS title,
        row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, src, dst)::INTEGER AS rank FROM ed)"""
)


@register("page_documents", "N1", f"WITH {SQL_SENTENCES} SELECT doc_id, substring(doc, 1, {N.DOC_CHARS}) AS doc FROM dc")
def _(spark, folder):
    return N.documents(cleaned(spark, folder), DOC, max_chars=N.DOC_CHARS)


@register("sentences", "N2", f"WITH {SQL_SENTENCES} SELECT doc_id, sentence, text FROM sn")
def _(spark, folder):
    return N.page_sentences(cleaned(spark, folder), DOC)


@register("entity_mentions", "N3 N4 N5", f"WITH {SQL_MENTIONS} SELECT doc_id, sentence, pos, name, category FROM me")
def _(spark, folder):
    return page_mentions(spark, folder)


@register(
    "entity_mentions_capitals", "N3 N4 N5",
    f"WITH {sql_mentions(capitals=True)} SELECT doc_id, sentence, pos, name, category FROM me",
)
def _(spark, folder):
    return page_mentions(spark, folder, capitals=True)


SQL_TOP_ENTITIES = (
    SQL_MENTIONS
    + """, e AS (SELECT doc_id, category, name, count(*) AS n, min({'s': sentence, 'p': pos}) AS f FROM me GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY n DESC, f, name)::INTEGER AS rank FROM e)"""
)


@register("top_entities", "N6", f"WITH {SQL_TOP_ENTITIES} SELECT doc_id, category, name, n, rank FROM r WHERE rank <= 5")
def _(spark, folder):
    return N.top_entities(page_mentions(spark, folder), DOC)


@register("compact_entities", "P5", f"WITH {SQL_TOP_ENTITIES} SELECT doc_id, category, name, n, rank FROM r WHERE rank <= 2")
def _(spark, folder):
    return P.compact_entities(N.top_entities(page_mentions(spark, folder), DOC))


@register("entity_nodes", "N7 N9", f"WITH {SQL_NODES} SELECT doc_id, name, category, n, title, rank FROM tn")
def _(spark, folder):
    return N.top_nodes(N.nodes(page_mentions(spark, folder), DOC), DOC)


def _graph(spark, folder):
    found = cut(page_mentions(spark, folder))
    chosen = N.top_nodes(N.nodes(found, DOC), DOC)
    return chosen, N.edges(found, chosen, DOC)


@register("entity_edges", "N8 N10 N11", f"WITH {SQL_EDGES} SELECT doc_id, src, dst, n, title, rank FROM te WHERE rank <= 30")
def _(spark, folder):
    return N.top_edges(_graph(spark, folder)[1], DOC)


@register(
    "graph_sizes", "N12",
    f"""WITH {SQL_EDGES}, a AS (SELECT doc_id, count(*) AS k FROM tn GROUP BY 1),
    b AS (SELECT doc_id, count(*) AS k FROM te WHERE rank <= 30 GROUP BY 1)
    SELECT doc_id, coalesce(a.k, 0) AS n_nodes, coalesce(b.k, 0) AS n_edges FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
)
def _(spark, folder):
    chosen, linked = _graph(spark, folder)
    graph = N.packed_graph(docs(spark, folder), chosen, N.top_edges(linked, DOC), DOC)
    return graph.select(
        "doc_id", F.size("graph.nodes").cast("bigint").alias("n_nodes"), F.size("graph.edges").cast("bigint").alias("n_edges")
    )


@register(
    "graph_neighbours", "D8",
    f"""WITH {SQL_EDGES} SELECT doc_id, src AS name, dst AS neighbour, n FROM ed
    UNION ALL SELECT doc_id, dst, src, n FROM ed""",
)
def _(spark, folder):
    return N.neighbours(_graph(spark, folder)[1], DOC)


# ---------------------------------------------------------------- terms

@register(
    "term_counts", "F1 F2 F3",
    f"WITH {SQL_TERMS} SELECT doc_id, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY ALL",
)
def _(spark, folder):
    return W.page_counts(pages(spark, folder), DOC)


@register("vocabulary", "F4 F5", f"WITH {SQL_TERMS} SELECT doc_id, term, df, cf, n FROM vocab")
def _(spark, folder):
    return W.vocabulary(cleaned(spark, folder), DOC).select("doc_id", "term", "df", "cf", "n")


@register(
    "vocabulary_size", "F7 F11",
    f"""WITH {SQL_TERMS}, v AS (SELECT doc_id, count(*) AS k FROM vocab WHERE n >= 3 GROUP BY 1)
    SELECT doc_id, coalesce(k, 0) AS vocab_size FROM documents LEFT JOIN v USING (doc_id)""",
)
def _(spark, folder):
    return W.vocab_size(W.vocabulary(cleaned(spark, folder), DOC), docs(spark, folder), DOC)


@register(
    "term_weights", "F6",
    f"WITH {SQL_WEIGHTS} SELECT doc_id, pos, term, tf, df, round(idf, 6) AS idf, round(w, 6) AS w FROM wt",
)
def _(spark, folder):
    rows = W.by_term(weighted(spark, folder)[1], DOC)
    return rows.withColumn("idf", F.round("idf", 6)).withColumn("w", F.round("w", 6))


@register(
    "segment_density", "F8",
    f"""WITH {SQL_WEIGHTS}, d AS (SELECT doc_id, pos, sum(w) AS s FROM wt GROUP BY ALL)
    SELECT doc_id, pos, round(coalesce(s, 0), 6) AS tfidf_score FROM cl LEFT JOIN d USING (doc_id, pos)""",
)
def _(spark, folder):
    dense = W.segment_density(weighted(spark, folder)[1])
    return dense.select("doc_id", "pos", F.round("tfidf_score", 6).alias("tfidf_score"))


SQL_CLOUD = (
    SQL_WEIGHTS
    + """, ts AS (SELECT doc_id, term, sum(w) AS score FROM wt JOIN nn USING (doc_id) WHERE n >= 3 GROUP BY ALL HAVING sum(w) > 0),
    cloud AS (SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term)::INTEGER AS rank FROM ts)"""
)


@register(
    "cloud_terms", "F9 F10",
    f"WITH {SQL_CLOUD} SELECT doc_id, term, round(score, 6) AS score, rank FROM cloud WHERE rank <= 80",
)
def top_terms(spark, folder):
    top = W.best_terms(cleaned(spark, folder), DOC)
    return top.withColumn("score", F.round("score", 6))


__all__ = ["CATALOG", "Query", "register", "HEADING_TAGS"]
