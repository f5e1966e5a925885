"""Term weighting: n-grams, document frequency, vocabulary cap, TF-IDF and its sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text as X
from pagequarry.functions.fixed import STOP_WORDS
from pagequarry.operators.clean import Pages
from pagequarry.operators.keys import Keys, top_n

SALTS = 16
# Positions of a block of segments.
BLOCK = 512
MAX_DF, MAX_FEATURES = 0.95, 5000
# Rows and bytes of segments that a task works on together where pages come packed.
TOGETHER, GATHERED = 4096, 8 << 20


def _runs(cleaned: DataFrame, by: Keys, pairs: bool, stop_words: Sequence[str], text: str, keep: Sequence[str]) -> tuple[DataFrame, Column]:
    """Segments with their sorted terms, and the expression that counts them: where the runs of equal
    terms start, and how long they are."""
    words = cleaned.select(*by, "pos", *keep, X.without(X.tokens(F.col(text)), stop_words).alias("_w"))
    both = F.concat("_w", X.bigrams(F.col("_w"))) if pairs else F.col("_w")
    terms = words.select(*by, "pos", *keep, F.sort_array(both).alias("_t"))
    starts = terms.withColumn(
        "_s",
        F.expr("filter(transform(_t, (t, i) -> i), i -> i = 0 OR get(_t, i) <> get(_t, i - 1))"),
    )
    return starts, F.expr(
        "transform(_s, (s, j) -> named_struct('term', get(_t, s), "
        "'tf', CAST(coalesce(get(_s, j + 1), size(_t)) - s AS BIGINT)))"
    )


def packed_counts(
    cleaned: DataFrame,
    by: Keys,
    pairs: bool = True,
    stop_words: Sequence[str] = tuple(STOP_WORDS),
    text: str = "cleaned",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(page, pos, *keep, terms): a segment's words and, with ``pairs``, word pairs, with how often each
    occurs, sorted, in its own row. Nothing is shuffled. A segment without terms has an empty list."""
    starts, runs = _runs(cleaned, by, pairs, stop_words, text, keep)
    return starts.select(*by, "pos", *keep, runs.alias("terms"))


def term_counts(
    cleaned: DataFrame,
    by: Keys,
    pairs: bool = True,
    stop_words: Sequence[str] = tuple(STOP_WORDS),
    text: str = "cleaned",
) -> DataFrame:
    """(page, pos, term, tf): the same, a row per term. The generator takes the expression itself: given
    a column, the optimiser would push a filter on its size below, and count everything once more in it."""
    starts, runs = _runs(cleaned, by, pairs, stop_words, text, ())
    return starts.select(*by, "pos", F.inline(runs))


def vocabulary(
    cleaned: DataFrame, by: Keys, max_df: float = MAX_DF, max_features: int = MAX_FEATURES, **options
) -> DataFrame:
    """(page, term, df, cf, n): terms in at most ``max_df`` of the segments, capped by count.

    A page of up to ``BLOCK`` lines (known from the split) is one block, and its vocabulary is made
    where the block is; only larger pages shuffle rows per term.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cleaned.schema}
    shape = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["term string", "df bigint", "cf bigint", "n bigint"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks_of(batches):
            sizes = np.bincount(block)
            terms = batch.column("terms")
            ends = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])[np.concatenate([[0], np.cumsum(sizes)])]
            term, tf = terms.flatten().flatten()
            found = [
                _own_words(term.slice(s, e - s), tf.to_numpy()[s:e], int(n), max_df, max_features)
                for s, e, n in zip(ends, ends[1:], sizes)
            ]
            lengths = [len(f[1]) for f in found]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            place = pa.array(np.repeat(first, lengths))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(place) for c in by], pa.concat_arrays([f[0] for f in found]),
                 pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found])),
                 pa.array(np.repeat(sizes, lengths).astype(np.int64))],
                [*by, "term", "df", "cf", "n"],
            )

    small = _whole_pages(cleaned, by, (), **options).mapInArrow(made, shape)
    large = cleaned.where(F.col("n_lines") > BLOCK)
    if large.isEmpty():
        return small
    return small.unionByName(spread_vocabulary(term_counts(large, by, **options), large, by, max_df, max_features))


def spread_vocabulary(
    counts: DataFrame, cleaned: DataFrame, by: Keys, max_df: float = MAX_DF, max_features: int = MAX_FEATURES
) -> DataFrame:
    """The vocabulary of pages of any size, from a row per term and segment."""
    # Counting pos (never null) instead of rows keeps the column, so that these two branches and the
    # weights can share one shuffle of the segments.
    stats = counts.groupBy(*by, "term").agg(F.count("pos").alias("df"), F.sum("tf").alias("cf"))
    sizes = cleaned.groupBy(*by).agg(F.count("pos").alias("n"))
    # The page size joins under a salted key: a page with a third of all terms is spread over the
    # salts, and the cap below starts from a fresh shuffle that is cut to the cap on the map side.
    salted = stats.withColumn("_salt", F.pmod(F.hash("term"), F.lit(SALTS)))
    copies = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = salted.join(copies, [*by, "_salt"]).drop("_salt").where(F.col("df") <= F.lit(max_df) * F.col("n"))
    return top_n(kept, by, [F.col("cf").desc(), F.col("term")], max_features, "_r").drop("_r")


def _own_words(term: pa.Array, tf: np.ndarray, n: int, max_df: float, max_features: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, df, cf) of a block that is a whole page of ``n`` segments; a segment names a term once."""
    coded = pc.dictionary_encode(term)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    df = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
    cf = np.bincount(codes, tf, len(coded.dictionary)).astype(np.int64)
    kept = np.flatnonzero(df <= max_df * n)
    if len(kept) > max_features:
        names = coded.dictionary.take(pa.array(kept)).to_pylist()
        order = sorted(range(len(kept)), key=lambda i: (-cf[kept[i]], names[i].encode()))
        kept = kept[np.sort(order[:max_features])]
    return coded.dictionary.take(pa.array(kept)), df[kept], cf[kept]


def _whole_pages(cleaned: DataFrame, by: Keys, keep: Sequence[str], text: str = "cleaned", **options) -> DataFrame:
    """Packed counts of the pages of one block, a page's rows next to each other, with their number in
    ``_size``. Pages are gathered as texts, which are a fraction of their terms, and spread out again in
    the same task."""
    held = dict.fromkeys(["pos", *keep, text])
    pages = cleaned.where(F.col("n_lines") <= BLOCK).groupBy(*by).agg(F.collect_list(F.struct(*held)).alias("_rows"))
    rows = pages.select(*by, F.size("_rows").alias("_size"), F.inline("_rows"))
    return packed_counts(rows, [*by, "_size"], keep=keep, text=text, **options)


def _blocks_of(batches: Iterator[pa.RecordBatch], rows: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole pages, and which of the batch's pages a row is of; a page that a batch cuts waits
    for its other rows. Batches are put together to ``rows`` rows or ``GATHERED`` bytes: a step on the terms of
    a few pages costs as much as on many."""
    waiting: list[pa.RecordBatch] = []

    def whole() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        batch = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0] if len(waiting) > 1 else waiting[0]
        sizes, at, starts = batch.column("_size").to_numpy(), 0, []
        while at < batch.num_rows and at + sizes[at] <= batch.num_rows:
            starts.append(at)
            at += int(sizes[at])
        waiting[:] = [batch.slice(at)] if at < batch.num_rows else []
        if starts:
            yield batch.slice(0, at), np.repeat(np.arange(len(starts)), sizes[starts])

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= rows or sum(b.nbytes for b in waiting) >= GATHERED:
                yield from whole()
    if waiting:
        yield from whole()


class PageTerms:
    """The weighed terms of whole pages: entry for entry, by segment, the ``segment`` (row of the batch), the
    ``term`` (a number, the same all over the batch), its ``place`` in the pages' vocabularies, ``tf`` and ``w``;
    of those vocabularies ``of_page``, ``listed`` (the term), ``df`` and ``cf``. Words and pairs are compared as
    numbers; only what leaves the task is spelled."""

    def __init__(
        self, words: pa.ListArray, page: np.ndarray, stop_words: Sequence[str], pairs: bool, max_df: float, max_features: int
    ):
        sizes, self.page = np.diff(words.offsets.to_numpy()), page
        coded = pc.dictionary_encode(words.flatten())
        self.words = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        segment = np.repeat(np.arange(len(sizes)), sizes)
        stopped = pc.or_(pc.is_in(self.words, value_set=pa.array(list(stop_words), pa.string())), pc.less(pc.utf8_length(self.words), 2))
        kept = ~stopped.to_numpy(zero_copy_only=False)[code]
        code, segment, width = code[kept], segment[kept], len(self.words)
        if pairs:
            inside = segment[1:] == segment[:-1]
            pair = width + code[:-1][inside] * width + code[1:][inside]
            code, segment = np.concatenate([code, pair]), np.concatenate([segment, segment[:-1][inside]])
        self.codes, term = np.unique(code, return_inverse=True)
        count = max(len(self.codes), 1)
        spots, tf = np.unique(segment * count + term, return_counts=True)
        segment, term = spots // count, spots % count
        self.held = np.bincount(page)
        own, place, df = np.unique(page[segment] * count + term, return_inverse=True, return_counts=True)
        self.of_page, self.listed = own // count, own % count
        self.df, self.cf = df, np.bincount(place, tf, len(own)).astype(np.int64)
        able = df <= max_df * self.held[self.of_page]
        for n in np.flatnonzero(np.bincount(self.of_page[able], minlength=len(self.held)) > max_features):
            spot = np.flatnonzero(able & (self.of_page == n))
            # Only terms as frequent as the last that stays are told apart by their spelling, by bytes.
            cf = self.cf[spot]
            last = np.partition(cf, len(cf) - max_features)[len(cf) - max_features]
            tied = spot[cf == last]
            order = pc.sort_indices(self.spelled_column(self.listed[tied])).to_numpy()
            able[spot[cf < last]] = False
            able[tied[order[max_features - int((cf > last).sum()) :]]] = False
        kept = able[place]
        self.segment, self.term, self.tf, place = segment[kept], term[kept], tf[kept], place[kept]
        idf = np.log((1.0 + self.held[self.of_page]) / (1.0 + df)) + 1.0
        raw = self.tf * idf[place]
        self.w = raw / np.sqrt(np.bincount(self.segment, raw * raw, len(sizes)))[self.segment]
        self.ends = np.searchsorted(self.segment, np.concatenate([[0], np.cumsum(self.held)]))
        self.place = (np.cumsum(able) - 1)[place]
        self.of_page, self.listed, self.df, self.cf = self.of_page[able], self.listed[able], df[able], self.cf[able]

    def spelled(self, terms: np.ndarray) -> list[str]:
        return self.spelled_column(terms).to_pylist()

    def spelled_column(self, terms: np.ndarray) -> pa.Array:
        code, width = self.codes[terms], len(self.words)
        pair = code >= width
        first = self.words.take(pa.array(np.where(pair, code // max(width, 1) - 1, code)))
        second = self.words.take(pa.array(np.where(pair, code % max(width, 1), 0)))
        return pc.if_else(pa.array(pair), pc.binary_join_element_wise(first, second, " "), first)

    def density(self) -> np.ndarray:
        """Per segment the sum of its weights."""
        return np.bincount(self.segment, self.w, len(self.page)).astype(float)

    def gram(self, n: int) -> np.ndarray:
        """Inner products of a page's segments. Terms of one segment only take part in its own."""
        span = slice(self.ends[n], self.ends[n + 1])
        first = int(self.held[:n].sum())
        row, w = self.segment[span] - first, self.w[span]
        names, code, uses = np.unique(self.term[span], return_inverse=True, return_counts=True)
        shared = uses[code] > 1
        place = np.cumsum(uses > 1) - 1
        dense = np.zeros((self.held[n], int((uses > 1).sum())))
        dense[row[shared], place[code[shared]]] = w[shared]
        inner = dense @ dense.T
        inner[np.diag_indices(len(inner))] += np.bincount(row[~shared], w[~shared] ** 2, self.held[n])
        return inner

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, weights, ends): rows as short as they can be with the inner products they have. Terms
        that several segments of a page have are numbered from 0; what a segment has for itself only is one
        entry more, under the numbers after those, as heavy as its terms together."""
        count, n = max(len(self.codes), 1), len(self.page)
        spots, place, uses = np.unique(self.page[self.segment] * count + self.term, return_inverse=True, return_counts=True)
        shared = uses > 1
        width = np.bincount(spots[shared] // count, minlength=len(self.held))
        code = np.cumsum(shared) - 1 - np.concatenate([[0], np.cumsum(width)[:-1]])[spots // count]
        own = ~shared[place]
        rest = np.bincount(self.segment[own], self.w[own] ** 2, n)
        row = np.flatnonzero(rest)
        first = np.concatenate([[0], np.cumsum(self.held)[:-1]])
        segment = np.concatenate([self.segment[~own], row])
        codes = np.concatenate([code[place[~own]], width[self.page[row]] + row - first[self.page[row]]])
        weights = np.concatenate([self.w[~own], np.sqrt(rest[row])])
        order = np.lexsort((codes, segment))
        return codes[order], weights[order], np.cumsum(np.bincount(segment, minlength=n))

    def best(self, group: np.ndarray, sizes: np.ndarray, n: int, places: int) -> list[list[tuple[str, float]]]:
        """Per group of segments the ``n`` terms of the largest sums of weights over ``sizes``, with these
        quotients; those equal to so many ``places`` go by term. ``group`` is a number per segment."""
        count = max(len(self.codes), 1)
        spots, place = np.unique(group[self.segment] * count + self.term, return_inverse=True)
        owner, term = spots // count, spots % count
        exact = np.bincount(place, self.w, len(spots)) / sizes[owner]
        value = np.round(exact, places)
        ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
        spans = []
        for start, end in zip(ends.tolist(), ends[1:].tolist()):
            own, at = value[start:end], np.arange(start, end)
            if len(own) > n:
                at = at[own >= np.partition(own, len(own) - n)[len(own) - n]]
            spans.append(at)
        # What may be among the best of any group is spelled at once.
        able = np.concatenate(spans) if spans else np.zeros(0, int)
        names, values, exact = self.spelled(term[able]), value[able].tolist(), exact[able].tolist()
        out, first = [], 0
        for at in spans:
            order = sorted(range(first, first + len(at)), key=lambda i: (-values[i], names[i].encode()))[:n]
            out.append([(names[i], exact[i]) for i in order])
            first += len(at)
        return out


def _split(normalised: pa.StringArray) -> pa.ListArray:
    """The words of normalised texts, as :func:`text.tokens` cuts them but for words of one character, which
    the weights leave out. What is left of a text is words and spaces, and the dot that lower case puts
    beside an i."""
    return pc.split_pattern(pc.replace_substring(normalised, "\u0307", " "), " ")


def large_pages(cleaned: DataFrame | Pages) -> DataFrame | None:
    """The segments of pages of more than ``BLOCK`` lines; None without any."""
    if isinstance(cleaned, Pages):
        return cleaned.large
    large = cleaned.where(F.col("n_lines") > BLOCK)
    return None if large.isEmpty() else large


def over_pages(
    cleaned: DataFrame | Pages,
    by: Keys,
    made: Callable[[pa.RecordBatch, PageTerms], pa.RecordBatch],
    shape: str,
    keep: Sequence[str] = (),
    added: Mapping[str, Column] | None = None,
    pairs: bool = True,
    stop_words: Sequence[str] = tuple(STOP_WORDS),
    text: str = "cleaned",
    max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
    through: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """What ``made`` makes of the weighed terms of pages of up to ``BLOCK`` lines, in columns ``by`` and
    ``shape``. A page's segments come in ``pos`` order, with the columns ``keep`` and those ``added``
    in the task; ``through``, which must leave rows where they are, may add columns to keep. Texts are shuffled once, and not at all where pages come packed; terms never are. Packed
    pages' normalised texts go to the task as they are, and are cut into words there."""
    whole = isinstance(cleaned, Pages) and text == "cleaned"
    if isinstance(cleaned, Pages):
        pages = cleaned.small
    else:
        held = dict.fromkeys(["pos", *keep, text])
        pages = cleaned.where(F.col("n_lines") <= BLOCK).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("_rows"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = through(pages.select(*by, F.size("_rows").alias("_size"), F.inline("_rows"))).select(
        *by, "_size", "pos", *keep, *[c.alias(name) for name, c in (added or {}).items()], (F.col(text) if whole else X.tokens(F.col(text))).alias("_words")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, page in _blocks_of(batches, TOGETHER):
            words = _split(batch.column("_words")) if whole else batch.column("_words")
            out = made(batch, PageTerms(words, page, stop_words, pairs, max_df, max_features))
            if out.num_rows:
                yield out

    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in by] + [shape]))


def density(cleaned: DataFrame, by: Keys, keep: Sequence[str] = (), **options) -> DataFrame:
    """(page, pos, *keep, n, tfidf_score) of cleaned segments: how many the page has, and the sum of the
    segment's weights; 0 for a segment without terms."""
    kinds = {f.name: f.dataType.simpleString() for f in cleaned.schema}
    columns = [*by, "pos", *keep]

    def made(batch: pa.RecordBatch, terms: PageTerms) -> pa.RecordBatch:
        told = [pa.array(terms.held[terms.page].astype(np.int64)), pa.array(terms.density())]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *told], [*columns, "n", "tfidf_score"])

    shape = ", ".join([f"`{c}` {kinds[c]}" for c in ("pos", *keep)] + ["n bigint, tfidf_score double"])
    small = over_pages(cleaned, by, made, shape, keep, **options)
    large = cleaned.where(F.col("n_lines") > BLOCK)
    if large.isEmpty():
        return small
    summed = segment_density(weigh(large, by, keep=keep, **options))
    return small.unionByName(summed.join(large.groupBy(*by).agg(F.count("*").alias("n")), list(by)).select(*small.columns))


def page_counts(cleaned: DataFrame | Pages, by: Keys, **options) -> DataFrame:
    """(page, term, df, cf): in how many segments of a page each of its terms occurs, and how often. Pages
    of one block are counted where they are; only larger ones shuffle rows per term."""
    keys = list(by)

    def made(batch: pa.RecordBatch, terms: PageTerms) -> pa.RecordBatch:
        first = np.concatenate([[0], np.cumsum(terms.held)[:-1]])[terms.of_page]
        told = [terms.spelled_column(terms.listed), pa.array(terms.df.astype(np.int64)), pa.array(terms.cf.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(first)) for c in keys], *told], [*keys, "term", "df", "cf"])

    small = over_pages(cleaned, by, made, "term string, df bigint, cf bigint", max_df=np.inf, max_features=1 << 62, **options)
    large = large_pages(cleaned)
    if large is None:
        return small
    counts = term_counts(large, by, **options).groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return small.unionByName(counts)


def vocabulary_sizes(cleaned: DataFrame, by: Keys, **options) -> DataFrame:
    """(page, size): how many terms the vocabulary of a page has; pages without any are left out. Terms of
    pages of one block do not leave the task."""
    keys = list(by)

    def made(batch: pa.RecordBatch, terms: PageTerms) -> pa.RecordBatch:
        sizes = np.bincount(terms.of_page, minlength=len(terms.held))
        first, some = np.concatenate([[0], np.cumsum(terms.held)[:-1]]), sizes > 0
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(first[some])) for c in keys], pa.array(sizes[some].astype(np.int64))], [*keys, "size"]
        )

    small = over_pages(cleaned, by, made, "size bigint", **options)
    large = cleaned.where(F.col("n_lines") > BLOCK)
    if large.isEmpty():
        return small
    return small.unionByName(vocabulary(large, by, **options).groupBy(*by).agg(F.count("*").alias("size")))


def weigh(
    cleaned: DataFrame, by: Keys, keep: Sequence[str] = (), max_df: float = MAX_DF, max_features: int = MAX_FEATURES, **options
) -> DataFrame:
    """Cleaned segments to packed weights: (page, pos, *keep, terms).

    A page of up to ``BLOCK`` lines is weighed whole where its block is: no row per term is shuffled. The
    terms of larger pages are shuffled once, for their document frequencies.
    """
    columns = [*by, "pos", *keep]
    packed = _whole_pages(cleaned, by, keep, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks_of(batches):
            terms = _weighed(batch.column("terms"), block, int(block[-1]) + 1, None, max_df, max_features)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], terms], [*columns, "terms"])

    small = packed.mapInArrow(run, _weight_shape(packed, columns))
    large = cleaned.where(F.col("n_lines") > BLOCK)
    if large.isEmpty():
        return small
    vocab = spread_vocabulary(term_counts(large, by, **options), large, by, max_df, max_features)
    return small.unionByName(packed_weights(packed_counts(large, by, keep=keep, **options), vocab, by))


def _weight_shape(packed: DataFrame, columns: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    term = "array<struct<term:string,tf:bigint,df:bigint,idf:double,w:double>>"
    return ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"terms {term}"])


def packed_weights(packed: DataFrame, vocab: DataFrame, by: Keys) -> DataFrame:
    """(page, pos, ..., terms): term, tf, df, idf and w of a segment's vocabulary terms in its own row.

    w is tf times smoothed idf, L2-normalised per segment. ``packed`` is what :func:`packed_counts` gives,
    with what it kept. The vocabulary of a page (at most its cap of terms) travels as one dictionary to
    each block of the page's segments.
    """
    others = [c for c in packed.columns if c not in (*by, "pos", "terms")]
    names, columns = ["pos", *others, "terms"], [*by, "pos", *others]
    blocks = packed.groupBy(*by, F.floor(F.col("pos") / BLOCK).alias("_part")).agg(
        F.collect_list(F.struct(*names)).alias("_rows")
    )
    words = vocab.groupBy(*by).agg(
        F.collect_list(F.struct("term", F.col("df").cast("bigint").alias("df"), F.col("n").cast("bigint").alias("n"))).alias("_words")
    )
    met = blocks.join(words, list(by), "left").select(*by, "_rows", "_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("_rows")
                fields = dict(zip(names, rows.flatten().flatten()))
                block = np.repeat(np.arange(batch.num_rows), np.diff(rows.offsets.to_numpy()))
                fields["terms"] = _weighed(fields["terms"], block, batch.num_rows, batch.column("_words"), 0.0, 0)
                out = {c: batch.column(c).take(pa.array(block)) for c in by} | fields
                yield pa.RecordBatch.from_arrays([out[c] for c in (*columns, "terms")], [*columns, "terms"])

    return met.mapInArrow(run, _weight_shape(packed, columns))


def _weighed(
    terms: pa.ListArray, block: np.ndarray, blocks: int, words: pa.ListArray | None, max_df: float, max_features: int
) -> pa.ListArray:
    """Counts of segments to weights; ``block`` says whose word list a segment has."""
    sizes = np.diff(terms.offsets.to_numpy())
    term, tf = terms.flatten().flatten()
    segment = np.repeat(np.arange(len(sizes)), sizes)
    # Segments of a block are neighbours, and so are their terms.
    ends = np.cumsum(np.bincount(block[segment], minlength=blocks))
    held = np.bincount(block, minlength=blocks)
    df, idf = np.full(len(term), -1, np.int64), np.ones(len(term))
    for n, (start, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
        if end == start or (words is not None and not words[n].is_valid):
            continue
        own = term.slice(start, end - start)
        if words is None:
            listed, listed_df, _ = _own_words(own, tf.to_numpy()[start:end], int(held[n]), max_df, max_features)
            total = np.full(len(listed_df), held[n])
        else:
            listed, *numbers = words[n].values.flatten()
            listed_df, total = (x.to_numpy() for x in numbers)
        found = pc.fill_null(pc.index_in(own, value_set=listed), -1).to_numpy()
        known = found >= 0
        df[start:end][known] = listed_df[found[known]]
        idf[start:end][known] = (np.log((1.0 + total) / (1.0 + listed_df)) + 1.0)[found[known]]
    kept = df >= 0
    own, raw = segment[kept], tf.to_numpy()[kept] * idf[kept]
    norm = np.sqrt(np.bincount(own, raw * raw, len(sizes)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(sizes)))]).astype(np.int32)
    rows = pa.StructArray.from_arrays(
        [term.filter(pa.array(kept)), tf.filter(pa.array(kept)), pa.array(df[kept]), pa.array(idf[kept]), pa.array(raw / norm[own])],
        ["term", "tf", "df", "idf", "w"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


def by_term(weighted: DataFrame, by: Keys) -> DataFrame:
    """(page, pos, term, tf, df, idf, w): the packed weights, a row per term."""
    return weighted.select(*by, "pos", F.inline("terms"))


def tfidf(cleaned: DataFrame, by: Keys, **options) -> DataFrame:
    """Cleaned segments to term weights, a row per term."""
    return by_term(weigh(cleaned, by, **options), by)


def usable_pages(cleaned: DataFrame, by: Keys, least: int = 3) -> DataFrame:
    """(page): pages of ``least`` segments or more. Others get no term scores, takeaways or
    vocabulary, and one topic."""
    return cleaned.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*by)


def vocab_size(vocab: DataFrame, pages: DataFrame, by: Keys, least: int = 3) -> DataFrame:
    """(page, vocab_size) of all ``pages``; 0 without terms or with fewer than ``least`` segments."""
    sizes = vocab.where(F.col("n") >= least).groupBy(*by).agg(F.count("*").alias("vocab_size"))
    return pages.select(*by).join(sizes, list(by), "left").withColumn("vocab_size", F.coalesce("vocab_size", F.lit(0)))


def segment_density(weighted: DataFrame) -> DataFrame:
    """Packed weights with ``tfidf_score``, the sum of a segment's weights; 0 for a segment without terms."""
    return weighted.withColumn("tfidf_score", F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"])).drop("terms")


def term_scores(weighted: DataFrame, by: Keys, usable: DataFrame | None = None) -> DataFrame:
    """(page, term, score): weights summed up, of the ``usable`` pages only if they are given."""
    rows = weighted if usable is None else weighted.join(usable, list(by), "left_semi")
    return rows.groupBy(*by, "term").agg(F.sum("w").alias("score")).where("score > 0")


def cloud_terms(scores: DataFrame, by: Keys, n: int = 80, digits: int = 9) -> DataFrame:
    """The ``n`` best terms of a page; scores equal to ``digits`` places tie by term."""
    order = [F.round("score", digits).desc(), F.col("term")]
    return top_n(scores, by, order, n)


def best_terms(cleaned: DataFrame, by: Keys, n: int = 80, digits: int = 9, least: int = 3, **options) -> DataFrame:
    """:func:`cloud_terms` of pages of ``least`` cleaned segments or more. Pages of one block are summed up
    where they are; only larger ones shuffle rows per term."""
    keys = list(by)

    def made(batch: pa.RecordBatch, terms: PageTerms) -> pa.RecordBatch:
        best = terms.best(terms.page, np.ones(len(terms.held)), n, digits)
        best = [b if size >= least else [] for b, size in zip(best, terms.held)]
        first = np.repeat(np.concatenate([[0], np.cumsum(terms.held)[:-1]]), [len(b) for b in best])
        flat = [(*t, i + 1) for b in best for i, t in enumerate(b)]
        term, score, rank = zip(*flat) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(first)) for c in keys], pa.array(term, pa.string()), pa.array(score, pa.float64()),
             pa.array(rank, pa.int32())],
            [*keys, "term", "score", "rank"],
        )

    small = over_pages(cleaned, by, made, "term string, score double, rank int", **options)
    large = cleaned.where(F.col("n_lines") > BLOCK)
    if large.isEmpty():
        return small
    scores = term_scores(tfidf(large, by, **options), by, usable_pages(large, by, least))
    return small.unionByName(cloud_terms(scores, by, n, digits))
