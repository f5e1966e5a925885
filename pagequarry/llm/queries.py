"""The registered queries of this subpackage: each operator over its whole table, in the form that
its contract fixes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import chosen_path, dedup_names, equal_average, lang_crf, mix_packing, pii_anchors, quality_qda, rank_index, rp_forest, secrets_index, source_mix, sp_encode, token_counts
from pagequarry.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def enter(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return enter


def joined_spans(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256,
                  regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""


@register("op7_exact_dedup", DEDUP_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_names.exact_dedup(table(spark, folder, "documents")).drop("row", "key")


def spans_sql(rules, order: str) -> str:
    """SQL that finds every rule's matches by splitting the text at them and adding up lengths."""
    parts = []
    for n, (kind, pattern, keep, base) in enumerate(rules):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {n} AS o, '{kind}' AS kind, {base} AS base, i, m, "
            f"sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ("
            f"SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM ("
            f"SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS gs FROM d"
            f")) QUALIFY {keep}"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
        + " UNION ALL ".join(f"({p})" for p in parts)
        + "), f AS (SELECT *, kind || ':' || (e - length(m))::BIGINT || ':' || e::BIGINT AS shown, e - length(m) AS b FROM s), "
        f"a AS (SELECT doc_id, string_agg(shown, ',' ORDER BY {order}) AS spans, "
        f"string_agg(shown, ',' ORDER BY {order}) FILTER (WHERE base) AS bases, "
        + ", ".join(f"count(*) FILTER (WHERE kind = '{r[0]}') AS n_{r[0]}" for r in rules if r[3])
        + " FROM f GROUP BY doc_id) SELECT doc_id, "
        + ", ".join(f"coalesce(n_{r[0]}, 0) AS n_{r[0]}" for r in rules if r[3])
        + ", sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"
    )


def _secret_keep(rule: secrets_index.Rule) -> str:
    part = "regexp_extract(m, '{}', {})".format(rule.pattern.replace("'", "''"), rule.group) if rule.group else "m"
    return f"length({part}) >= {rule.least}"


SECRETS_SQL = spans_sql([(r.kind, r.pattern, _secret_keep(r), r.base) for r in secrets_index.RULES], "b, o")


@register("op9_secrets", SECRETS_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets_index.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", count_of("assign"), count_of("access"), count_of("hex"),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


# ---------------------------------------------------------------- tokenizers

def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the operators take the file's content."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> bytes:
    with open(vocabulary("piece_bpe_32k.model"), "rb") as file:
        return file.read()


TOKEN_LIMIT = 4096


@register("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), piece_model())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@register("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    encoded = sp_encode.encode(table(spark, folder, "documents"), piece_model())
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint").alias("end_byte"),
    )


def byte_tokenizer() -> bytes:
    with open(vocabulary("byte_bpe_50k.json"), "rb") as file:
        return file.read()


def packed(docs: DataFrame) -> DataFrame:
    """The packing contract's columns; the pieces' ids as their checksum."""
    pieces = mix_packing.pack(docs, byte_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@register("op2_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


# ---------------------------------------------------------------- personal data

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
# Doubled digits count from the right, the second, fourth and so on.
_LUHN = (
    f"list_sum(list_transform(range(length({_DIGITS})), lambda j: CASE WHEN j % 2 = 0 THEN "
    f"substr({_DIGITS}, length({_DIGITS}) - j, 1)::INT ELSE (substr({_DIGITS}, length({_DIGITS}) - j, 1)::INT * 2) // 10 "
    f"+ (substr({_DIGITS}, length({_DIGITS}) - j, 1)::INT * 2) % 10 END)) % 10 = 0"
)
PII_SQL = spans_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", True),
        (
            "ip",
            r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
            "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR "
            "coalesce(try_cast(right(p, 3) AS INT), 0) > 255)) = 0",
            True,
        ),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", True),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", True),
        ("url", r"(?:https?|ftp)://[A-Za-z0-9][A-Za-z0-9./?=&%_#:+~-]*", "true", False),
        (
            "account",
            r"(?:account|acct|iban)[\x20:#.]{1,3}[A-Z0-9]*[0-9][A-Z0-9]*",
            "length(regexp_extract(m, '[A-Z0-9]+$')) BETWEEN 6 AND 34",
            False,
        ),
    ],
    "o, b",
)


@register("op10_pii", PII_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_anchors.find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii_anchors.BASE_KINDS))
    return found.select(
        "doc_id", *[count_of(k) for k in pii_anchors.BASE_KINDS],
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


# ---------------------------------------------------------------- models

@register("op1_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality_qda.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op6_language")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = lang_crf.identify(table(spark, folder, "documents"))
    return found.withColumn("held_out", held_out(F.col("doc_id")))


# ---------------------------------------------------------------- near duplicates

JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS l FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i+4], ' '))
      WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared * 5 >= 4 * (x.size + y.size - shared)),
r AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.t),
c AS (SELECT doc_id, min(t) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM c LEFT JOIN k USING (doc_id)
"""


@register("op5_jaccard_join", JOIN_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


# ---------------------------------------------------------------- vectors

@register("op8_neighbours")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return rp_forest.nearest(table(spark, folder, "embeddings"))


def codes_sql(parts: int = equal_average.PARTS, entries: int = equal_average.ENTRIES, rounds: int = equal_average.ROUNDS) -> str:
    """The rounds unrolled; every part against every entry, by inner products of whole numbers."""
    ctes = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, "
        f"list_transform(embedding, lambda x: floor({equal_average.SCALE} * x::DOUBLE)) AS w FROM embeddings "
        "WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, k, w[k * (len(w) // {parts}) + 1:(k + 1) * (len(w) // {parts})] AS x "
        f"FROM v, range({parts}) AS t(k))",
        f"c0 AS MATERIALIZED (SELECT k, r AS e, x FROM p WHERE r < {entries})",
    ]
    for n in range(rounds + 1):
        ctes.append(
            f"a{n} AS MATERIALIZED (SELECT r, k, m // {entries} AS d, m % {entries} AS e FROM (SELECT p.r, p.k, "
            "min((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x))::BIGINT "
            f"* {entries} + c.e) AS m FROM p JOIN c{n} c ON c.k = p.k GROUP BY ALL))"
        )
        if n < rounds:
            ctes.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c.k, c.e, coalesce(f.x, c.x) AS x FROM c{n} c LEFT JOIN ("
                "SELECT k, e, list(floor(s / n) ORDER BY i) AS x FROM (SELECT a.k, a.e, i, sum(p.x[i]) AS s, count(*) AS n "
                f"FROM a{n} a JOIN p ON p.r = a.r AND p.k = a.k, range(1, len(p.x) + 1) AS t(i) GROUP BY ALL) "
                "GROUP BY k, e) f ON f.k = c.k AND f.e = c.e)"
            )
    return (
        "WITH " + ", ".join(ctes) + ", o AS (SELECT r, string_agg(format('{:02x}', e), '' ORDER BY k) AS code, "
        f"sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r), "
        f"h AS (SELECT sha256(string_agg(x[i]::BIGINT::VARCHAR, ',' ORDER BY k, e, i)) AS codebooks_sha256 "
        f"FROM c{rounds}, range(1, len(x) + 1) AS t(i)) "
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 "
        "FROM v JOIN o USING (r), h"
    )


@register("op11_vector_codes", codes_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    codes, books = equal_average.compress(table(spark, folder, "embeddings"))
    listed = hashlib.sha256((books.listed() if books else "").encode()).hexdigest()
    return codes.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(listed).alias("codebooks_sha256")
    )


# ---------------------------------------------------------------- mixing

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, source IS NULL AS none FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY none, source) - 1) % 3 + 1] AS weight FROM s),
c AS (SELECT *, source_size * 3 AS cap, source_size::DOUBLE * 3 / weight AS full_at FROM w),
l AS (SELECT max(((SELECT sum(source_size) FROM c) - coalesce(filled, 0))::DOUBLE
                 / ((SELECT sum(weight) FROM c) - coalesce(gone, 0))::DOUBLE) AS level
      FROM (SELECT sum(cap) OVER f AS filled, sum(weight) OVER f AS gone FROM c
            WINDOW f AS (ORDER BY full_at, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
t AS (SELECT source, source_size, least(weight * level, cap::DOUBLE) AS target FROM c, l),
k AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM k)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - epochs * source_size - start)))::BIGINT AS taken
FROM e
"""


@register("op12_source_mix", MIX_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


# ---------------------------------------------------------------- fill in the middle

FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1,
             ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, len(units) AS n, units, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
             array_to_string(units[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""


@register("op13_fill_in_middle", FIM_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    cut = rank_index.fill_in_middle(table(spark, folder, "documents"))
    text = rank_index.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )
