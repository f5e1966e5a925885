"""Column expressions on text. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.fixed import IGNORED_PHRASES, NEGATIONS, SENTIMENT_BADGES

# White space as Unicode has it, spelled out: the engines' own \s is ASCII only.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"


def quoted(words: Sequence[str]) -> str:
    """A SQL list body: 'a', 'b', ..."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def strip_ws(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def normalise(text: Column) -> Column:
    """Delete everything but word characters and space, collapse space, lower-case, trim.

    The pattern names the most frequent characters first, and space is replaced only in texts where it is
    not single blanks already.
    """
    kept = F.regexp_replace(text, rf"[^a-z[ A-Z0-9][{WORD}{WS}]]", "")
    single = F.transform(
        F.array(kept),
        lambda t: F.when(t.rlike(rf"[{WS}&&[^ ]]"), F.regexp_replace(t, rf"[{WS}]+", " "))
        .when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t),
    )
    return F.trim(F.lower(F.get(single, F.lit(0))))


def any_phrase(phrases: Sequence[str]) -> str:
    """A pattern that finds any of the phrases literally."""
    special = ".+*?()[]{}|^$\\"
    return "|".join("".join("\\" + c if c in special else c for c in p) for p in phrases)


def is_content(text: Column) -> Column:
    """Ten characters or more, no furniture phrase, letters at least two fifths."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (
        (F.length(strip_ws(text)) >= 10)
        & ~F.lower(text).rlike(any_phrase(IGNORED_PHRASES))
        & (letters / F.greatest(F.length(text), F.lit(1)) >= 0.4)
    )


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0))


def without(words: Column, stop_words: Sequence[str]) -> Column:
    """Remove stop words, keep order and repeats."""
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a space. ``words`` must be a plain column, not an expression:
    the function looks into it once per word."""
    joined = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.filter(joined, lambda w: w.isNotNull())


def sentiment_label(polarity: Column) -> Column:
    return (
        F.when(polarity > 0.1, "Positive").when(polarity < -0.1, "Negative").otherwise("Neutral")
    )


def sentiment_badge(label: Column) -> Column:
    badge = F.lit(None).cast("string")
    for name, shown in SENTIMENT_BADGES.items():
        badge = F.when(label == name, shown).otherwise(badge)
    return badge


def score_tokens(words: str, lexicon: Sequence[tuple], negations: Sequence[str] = NEGATIONS) -> Column:
    """Array column of words -> struct(polarity, subjectivity), averaged over lexicon hits.

    A word counts when the lexicon holds it. The word before it scales it by its intensity; a
    negation before it (or before that intensifier) flips the sign and halves it. The lexicon is
    compiled into the expression: a hash-set test per word, map look-ups on the few hits only.
    """
    pol = ", ".join(f"'{w}', {float(p)}D" for w, p, _s, _i in lexicon)
    sub = ", ".join(f"'{w}', {float(s)}D" for w, _p, s, _i in lexicon)
    strong = [(w, i) for w, _p, _s, i in lexicon if i != 1.0] or [("", 1.0)]
    scale = ", ".join(f"'{w}', {float(i)}D" for w, i in strong)
    hit_words = quoted([w for w, *_ in lexicon])
    negs = quoted(negations)
    before = f"coalesce(get({words}, i - 1), '')"
    before2 = f"coalesce(get({words}, i - 2), '')"
    factor = f"(CASE WHEN {before} IN ({quoted([w for w, _ in strong])}) THEN try_element_at(map({scale}), {before}) ELSE 1.0D END)"
    negated = (
        f"({before} IN ({negs}) OR ({before} IN ({quoted([w for w, _ in strong])}) AND {before2} IN ({negs})))"
    )
    word = f"get({words}, i)"
    polarity = (
        f"greatest(-1.0D, least(1.0D, try_element_at(map({pol}), {word}) * {factor}))"
        f" * (CASE WHEN {negated} THEN -0.5D ELSE 1.0D END)"
    )
    subjectivity = f"greatest(0.0D, least(1.0D, try_element_at(map({sub}), {word}) * {factor}))"
    hits = f"filter(transform({words}, (w, i) -> i), i -> get({words}, i) IN ({hit_words}))"
    return F.expr(
        f"transform({hits}, i -> named_struct('polarity', {polarity}, 'subjectivity', {subjectivity}))"
    )


def mean_of(scores: Column, field: str) -> Column:
    """Mean of a field over an array of structs, 0 for an empty array."""
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s[field])
    return F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(F.lit(0.0))


# Small letters whose capital in full case mapping is several letters, but which have a single one.
_SMALL = "ß" + "".join(chr(c) for b in range(0x1F80, 0x1FB0, 16) for c in range(b, b + 8)) + "ᾳῃῳ"
_CAPITAL = "ẞ" + "".join(chr(c) for b in range(0x1F88, 0x1FB0, 16) for c in range(b, b + 8)) + "ᾼῌῼ"


def capital(letter: Column) -> Column:
    """The upper case of one letter as one letter; it stays as it is where there is none."""
    one = F.translate(letter, _SMALL, _CAPITAL)
    return F.when((F.length(F.upper(one)) > 1) | F.lit(_CAPITAL).contains(one), one).otherwise(F.upper(one))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others; letter by letter, so
    no text grows."""
    spaced = F.split(F.lower(text), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(spaced, lambda p: F.concat(capital(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))),
        "",
    )
