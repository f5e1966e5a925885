"""Topics: k-means with k chosen by silhouette, names, counts, metrics and takeaways."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import similar, vectors
from pagequarry.functions import text as X
from pagequarry.operators import spread_kmeans
from pagequarry.operators import terms as W
from pagequarry.operators.clean import Pages
from pagequarry.operators.keys import Keys, top_n
from pagequarry.session import cut

GENERAL = "0: General Topics"
SWEEP = "array<struct<k:int,silhouette:double>>"
# Pages whose inner products a task holds.
SIDE_BY_SIDE = 256


def term_vectors(weighted: DataFrame, by: Keys) -> DataFrame:
    """(page, pos, n_lines, terms, ws): a segment's terms with their weights, from the packed weights."""
    return weighted.select(*by, "pos", "n_lines", F.col("terms.term").alias("terms"), F.col("terms.w").alias("ws"))


def inner_vectors(rows: DataFrame | Pages, by: Keys, **options) -> DataFrame:
    """(page, pos, terms, ws) of cleaned segments for what needs their inner products only: terms are
    numbers, and those that no other segment of the page has are merged. Merged where pages are of one
    block; larger ones keep all their terms, so that a page's numbers stay within its vocabulary."""
    keys = list(by)

    def made(batch: pa.RecordBatch, terms: W.PageTerms) -> pa.RecordBatch:
        codes, weights, ends = terms.merged()
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        columns = [pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(weights))]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "pos")], *columns], [*keys, "pos", "terms", "ws"])

    small = W.over_pages(rows, by, made, "pos bigint, terms array<int>, ws array<double>", **options)
    large = W.large_pages(rows)
    return small if large is None else small.unionByName(_large_vectors(large, by, **options))


def _large_vectors(large: DataFrame, by: Keys, **options) -> DataFrame:
    """:func:`inner_vectors` of the segments of pages larger than a block."""
    coded = spread_kmeans.coded(term_vectors(W.weigh(large, by, keep=["n_lines"], **options), by), by)
    return coded.select(*by, F.inline(F.arrays_zip("pos", F.col("codes").alias("terms"), "ws")))


def topics(
    weighted: DataFrame, by: Keys, restarts: int = 10, seed: int = 42, limit: int = 512
) -> DataFrame:
    """(page, pos, cluster, optimal_k, silhouette, sweep, converged) for every segment of the packed
    weights, which have kept ``n_lines``.

    Pages of fewer than three segments, or without any term, are one cluster with k = 1. Pages up
    to ``limit`` lines are swept whole in a task, larger ones by joins and aggregates: the same
    seeds, assignments, refills, numbering and choice of k, so the limit decides where a page is
    worked on and nothing else.
    """
    rows = term_vectors(weighted, by)
    small = _small(rows.where(F.col("n_lines") <= limit), by, restarts, seed)
    if rows.where(F.col("n_lines") > limit).isEmpty():
        return small
    large = spread_kmeans.sweep(rows.where(F.col("n_lines") > limit), by, restarts, seed)
    return small.unionByName(large)


SWEPT = ["cluster", "optimal_k", "silhouette", "sweep", "converged", "top", "size", "tfidf_score"]


def swept_columns(terms: W.PageTerms, pos: np.ndarray, restarts: int = 10, seed: int = 42, n: int = 5) -> list[pa.Array]:
    """The columns ``SWEPT`` of the segments of whole pages, whose places are ``pos``."""
    double, first = pa.float64(), np.concatenate([[0], np.cumsum(terms.held)])
    draws = vectors.draws_of(pos, restarts * spread_kmeans.DRAWS, seed).reshape(-1, restarts, spread_kmeans.DRAWS)
    swept = [(np.zeros(count, int), 1, None, [], True) for count in terms.held]
    able = [p for p, count in enumerate(terms.held) if count >= 3 and terms.ends[p] < terms.ends[p + 1]]
    # Inner products of some pages at a time.
    for low in range(0, len(able), SIDE_BY_SIDE):
        some = able[low : low + SIDE_BY_SIDE]
        found = vectors.sweep_pages([terms.gram(p) for p in some], [draws[first[p] : first[p + 1]] for p in some])
        for p, told in zip(some, found):
            swept[p] = told
    labels, ks, scores, seen, settled = zip(*swept)
    cluster = np.concatenate(labels)
    _spots, group, sizes = np.unique(np.stack([terms.page, cluster]), axis=1, return_inverse=True, return_counts=True)
    best = [[t for t, _w in b] for b in terms.best(group.ravel(), sizes, n, 9)]
    whole = pa.array(terms.page)
    told = pa.array([[{"k": a, "silhouette": b} for a, b in s] for s in seen], pa.list_(pa.struct([("k", pa.int32()), ("silhouette", double)])))
    return [
        pa.array(cluster.astype(np.int32)), pa.array(ks, pa.int32()).take(whole), pa.array(scores, double).take(whole),
        told.take(whole), pa.array(settled).take(whole), pa.array(best, pa.list_(pa.string())).take(pa.array(group.ravel())),
        pa.array(np.bincount(terms.of_page, minlength=len(terms.held)).astype(np.int64)).take(whole), pa.array(terms.density()),
    ]


def topics_of(rows: DataFrame | Pages, by: Keys, restarts: int = 10, seed: int = 42, n: int = 5, **options) -> DataFrame:
    """:func:`topics` of cleaned segments, and with them ``top`` (the ``n`` best terms of the segment's
    cluster), ``size`` (of the page's vocabulary), ``tfidf_score`` (of the segment) and ``n_rows`` (of the page).

    Pages of one block are weighed and swept where they are, many side by side, and only texts are shuffled
    for them; nothing at all where pages come packed.
    """
    keys, names = list(by), [*SWEPT, "n_rows"]

    def made(batch: pa.RecordBatch, terms: W.PageTerms) -> pa.RecordBatch:
        columns = swept_columns(terms, batch.column("pos").to_numpy(), restarts, seed, n)
        columns.append(pa.array(terms.held.astype(np.int64)).take(pa.array(terms.page)))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "pos")], *columns], [*keys, "pos", *names])

    shape = (
        f"pos bigint, cluster int, optimal_k int, silhouette double, sweep {SWEEP}, converged boolean, top array<string>, "
        "size bigint, tfidf_score double, n_rows bigint"
    )
    small = W.over_pages(rows, by, made, shape, **options)
    if isinstance(rows, Pages):
        return small if rows.large is None else small.unionByName(topics_of(rows.large, by, restarts, seed, n, **options))
    large = rows.where(F.col("n_lines") > W.BLOCK)
    if large.isEmpty():
        return small
    weighed = cut(W.weigh(large, by, keep=["n_lines"], **options))
    found = cut(spread_kmeans.sweep(term_vectors(weighed, by), by, restarts, seed))
    listed = _listed(centroid_terms(W.by_term(weighed, by), found, by, n), by)
    told = found.join(listed.withColumnRenamed("terms", "top"), [*keys, "cluster"], "left")
    told = told.join(W.vocabulary_sizes(large, by, **options), keys, "left")
    told = told.join(found.groupBy(*by).agg(F.count("*").alias("n_rows")), keys)
    told = told.join(W.segment_density(weighed).select(*by, "pos", "tfidf_score"), [*keys, "pos"])
    told = told.withColumn("top", F.coalesce("top", F.array().cast("array<string>"))).withColumn("size", F.coalesce("size", F.lit(0)))
    return small.unionByName(told.select(*small.columns))


def names_of(labelled: DataFrame, by: Keys) -> DataFrame:
    """:func:`topic_names` of segments that carry their cluster's best terms in ``top``."""
    counted = labelled.groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.max("top").alias("top"))
    return counted.select(*by, "cluster", "n", topic_name(F.col("cluster"), F.col("top")).alias("cluster_name"))


def _small(rows: DataFrame, by: Keys, restarts: int, seed: int) -> DataFrame:
    """Pages of bounded size: a page is one row of arrays, and many pages share an Arrow batch."""
    drawn = rows.withColumn("race", spread_kmeans.race(restarts, seed))
    pages = drawn.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "terms", "ws", "race"))).alias("_rows"))

    @F.pandas_udf(f"labels array<int>, optimal_k int, silhouette double, sweep {SWEEP}, converged boolean")
    def sweep_pages(terms: pd.Series, ws: pd.Series, races: pd.Series) -> pd.DataFrame:
        out = []
        for page_terms, page_ws, page_race in zip(terms, ws, races):
            n = len(page_terms)
            if n < 3 or not any(len(t) for t in page_terms):
                out.append(([0] * n, 1, None, [], True))
                continue
            inner = vectors.gram(list(page_terms), list(page_ws))
            draws = np.stack(list(page_race)).reshape(n, restarts, spread_kmeans.DRAWS)
            labels, k, score, seen, settled = vectors.sweep(inner, draws)
            out.append((labels.tolist(), k, score, [{"k": a, "silhouette": b} for a, b in seen], settled))
        frame = pd.DataFrame(out, columns=["labels", "optimal_k", "silhouette", "sweep", "converged"])
        return frame.astype({"silhouette": "float64"})

    swept = pages.withColumn("_s", sweep_pages("_rows.terms", "_rows.ws", "_rows.race"))
    labelled = F.arrays_zip(F.col("_rows.pos").alias("pos"), F.col("_s.labels").alias("cluster"))
    return swept.select(
        *by, "_s.optimal_k", F.nanvl("_s.silhouette", F.lit(None).cast("double")).alias("silhouette"), "_s.sweep",
        "_s.converged", F.inline(labelled),
    ).select(*by, "pos", "cluster", "optimal_k", "silhouette", "sweep", "converged")


def kmeans_in_tasks(points: DataFrame, seeds: DataFrame, by: Keys, rounds: int = 300) -> DataFrame:
    """The counterpart of :func:`spread_kmeans.lloyd` for pages of bounded size: (page, pos, k, cluster,
    converged) of the cheapest restart per k, from the same points and seeds, a page and k in a task."""
    pages = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "terms", "ws"))).alias("_rows"))
    starts = seeds.groupBy(*by, "k").agg(F.array_sort(F.collect_list(F.struct("restart", "cluster", "pos"))).alias("_seeds"))

    @F.pandas_udf("labels array<int>, converged boolean")
    def settle(pos: pd.Series, terms: pd.Series, ws: pd.Series, k: pd.Series, drawn: pd.Series) -> pd.DataFrame:
        out = []
        for p, t, w, n, s in zip(pos, terms, ws, k, drawn):
            chosen = np.searchsorted(np.asarray(p), np.asarray(s)).reshape(-1, n)
            labels, settled = vectors.kmeans(vectors.gram(list(t), list(w)), chosen, rounds)
            out.append((labels.tolist(), settled))
        return pd.DataFrame(out, columns=["labels", "converged"])

    found = pages.join(starts, list(by)).withColumn(
        "_s", settle("_rows.pos", "_rows.terms", "_rows.ws", "k", "_seeds.pos")
    )
    labelled = F.arrays_zip(F.col("_rows.pos").alias("pos"), F.col("_s.labels").alias("cluster"))
    return found.select(*by, "k", "_s.converged", F.inline(labelled)).select(*by, "pos", "k", "cluster", "converged")


def first_seeds(points: DataFrame, by: Keys, k: int) -> DataFrame:
    """(page, k, restart, cluster, pos): the first ``k`` segments of pages of more than ``k``, as seeds."""
    first = points.groupBy(*by).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("pos")), 1, k).alias("p"))
    return first.where(F.col("n") > k).select(
        *by, F.lit(k).alias("k"), F.lit(0).alias("restart"), F.posexplode("p").alias("cluster", "pos")
    )


def kmeans_of_pages(pages: Pages, by: Keys, k: int, rounds: int = 300, limit: int = 2048, **options) -> DataFrame:
    """(page, pos, k, cluster, converged) for pages of more than ``k`` segments, from their first ``k`` as seeds.

    Pages of one block are weighed and clustered in their rows, many at once, and nothing is shuffled. Of
    larger ones those of up to ``limit`` lines are a task each, longer ones go by joins and aggregates.
    """
    keys = list(by)

    def made(batch: pa.RecordBatch, terms: W.PageTerms) -> pa.RecordBatch:
        shared = terms.df[terms.place] > 1
        alone = np.bincount(terms.segment[~shared], terms.w[~shared] ** 2, len(terms.page))
        labels, settled = vectors.kmeans_pages(
            terms.page, terms.segment[shared], terms.place[shared], terms.w[shared], terms.of_page, alone, k, rounds
        )
        told = np.flatnonzero((terms.held > k)[terms.page])
        spot = pa.array(told)
        columns = [pa.array(np.full(len(told), k, np.int32)), pa.array(labels[told].astype(np.int32)), pa.array(settled[terms.page[told]])]
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(spot) for c in (*keys, "pos")], *columns], [*keys, "pos", "k", "cluster", "converged"])

    found = W.over_pages(pages, by, made, "pos bigint, k int, cluster int, converged boolean", **options)
    if pages.large is None:
        return found
    for wide in (False, True):
        chosen = pages.large.where((F.col("n_lines") > limit) == F.lit(wide))
        if not chosen.isEmpty():
            points = cut(_large_vectors(chosen, by, **options))
            seeds = first_seeds(points, by, k)
            points = points.join(seeds.select(*by).distinct(), keys, "left_semi")
            own = spread_kmeans.lloyd(points, seeds, by, rounds) if wide else kmeans_in_tasks(points, seeds, by, rounds)
            found = found.unionByName(own.select(*by, "pos", F.col("k").cast("int").alias("k"), F.col("cluster").cast("int").alias("cluster"), "converged"))
    return found


def sweep_log(labelled: DataFrame, by: Keys) -> DataFrame:
    """(page, k, silhouette) of every k tried."""
    per_page = labelled.groupBy(*by).agg(F.max("sweep").alias("sweep"))
    return per_page.select(*by, F.inline("sweep"))


def centroid_terms(weighted: DataFrame, labels: DataFrame, by: Keys, n: int = 5) -> DataFrame:
    """The ``n`` heaviest terms per cluster: sum of weights over cluster size."""
    sizes = labels.groupBy(*by, "cluster").agg(F.count("*").alias("size"))
    sums = (
        weighted.join(labels.select(*by, "pos", "cluster"), [*by, "pos"])
        .groupBy(*by, "cluster", "term")
        .agg(F.sum("w").alias("total"))
    )
    centres = sums.join(sizes, [*by, "cluster"]).select(
        *by, "cluster", "term", F.round(F.col("total") / F.col("size"), 9).alias("weight")
    )
    return top_n(centres, [*by, "cluster"], [F.col("weight").desc(), F.col("term")], n)


def centroid_terms_of(rows: DataFrame, by: Keys, n: int = 5, **options) -> DataFrame:
    """:func:`centroid_terms` of cleaned segments that carry their ``cluster``. Pages of one block are weighed
    and summed up where they are; only larger ones shuffle rows per term."""
    keys = list(by)

    def made(batch: pa.RecordBatch, terms: W.PageTerms) -> pa.RecordBatch:
        places = np.stack([terms.page, batch.column("cluster").to_numpy(zero_copy_only=False)])
        pairs, group, sizes = np.unique(places, axis=1, return_inverse=True, return_counts=True)
        best = terms.best(group.ravel(), sizes, n, 9)
        first = np.searchsorted(terms.page, np.repeat(pairs[0], [len(b) for b in best]))
        flat = [(int(c), t, round(w, 9), i + 1) for c, b in zip(pairs[1], best) for i, (t, w) in enumerate(b)]
        cluster, term, weight, rank = zip(*flat) if flat else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(first)) for c in keys], pa.array(cluster, pa.int32()), pa.array(term, pa.string()),
             pa.array(weight, pa.float64()), pa.array(rank, pa.int32())],
            [*keys, "cluster", "term", "weight", "rank"],
        )

    small = W.over_pages(rows, by, made, "cluster int, term string, weight double, rank int", ["cluster"], **options)
    large = rows.where(F.col("n_lines") > W.BLOCK)
    if large.isEmpty():
        return small
    return small.unionByName(centroid_terms(W.tfidf(large, by, **options), large.select(*by, "pos", "cluster"), by, n))


def with_best_terms(rows: DataFrame | Pages, by: Keys, cluster: Column, n: int = 5, **options) -> DataFrame:
    """(page, pos, text, cleaned, cluster, top): cleaned segments with their cluster, an expression on
    ``cleaned``, and its ``n`` best terms. Pages of one block are summed up where they are, and no row is
    looked up again."""
    keys, names = list(by), ["pos", "text", "cleaned", "cluster"]

    def made(batch: pa.RecordBatch, terms: W.PageTerms) -> pa.RecordBatch:
        places = np.stack([terms.page, batch.column("cluster").to_numpy(zero_copy_only=False)])
        _pairs, group, sizes = np.unique(places, axis=1, return_inverse=True, return_counts=True)
        best = pa.array([[t for t, _w in b] for b in terms.best(group.ravel(), sizes, n, 9)], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, *names)], best.take(pa.array(group.ravel()))], [*keys, *names, "top"])

    shape = "pos bigint, text string, cleaned string, cluster int, top array<string>"
    small = W.over_pages(rows, by, made, shape, ["text", "cleaned"], {"cluster": cluster}, **options)
    large = W.large_pages(rows)
    if large is None:
        return small
    labelled = large.select(*by, "pos", "text", "cleaned", cluster.alias("cluster"))
    listed = _listed(centroid_terms(W.tfidf(large, by, **options), labelled, by, n), by).withColumnRenamed("terms", "top")
    found = labelled.join(listed, [*keys, "cluster"], "left").withColumn("top", F.coalesce("top", F.array().cast("array<string>")))
    return small.unionByName(found.select(*small.columns))


def scores_of(rows: DataFrame, by: Keys, tags: Column, **options) -> DataFrame:
    """(page, k, silhouette) of given labels of cleaned segments, as :func:`spread_kmeans.scores` gives them.

    ``tags``, an array of (k, cluster), is an expression on a segment's columns pos and cleaned and on the
    number of its page's segments, ``_size``. Pages of one block are worked out where they are.
    """
    keys = list(by)

    def made(batch: pa.RecordBatch, terms: W.PageTerms) -> pa.RecordBatch:
        first, found = np.concatenate([[0], np.cumsum(terms.held)]), []
        k, cluster = batch.column("tags").flatten().flatten()
        ends = np.concatenate([[0], np.cumsum(np.diff(batch.column("tags").offsets.to_numpy()))])
        for n, size in enumerate(terms.held):
            low, high = ends[first[n]], ends[first[n + 1]]
            if low < high:
                ks = k.to_numpy()[low:high].reshape(size, -1)[0]
                labels = cluster.to_numpy()[low:high].reshape(size, -1)
                dist = vectors.apart(terms.gram(n))
                found += [(first[n], int(a), vectors.silhouette(dist, labels[:, i])) for i, a in enumerate(ks)]
        at, k, score = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(at, pa.int64())) for c in keys], pa.array(k, pa.int32()), pa.array(score, pa.float64())],
            [*keys, "k", "silhouette"],
        )

    small = W.over_pages(rows, by, made, "k int, silhouette double", added={"tags": tags}, **options)
    large = rows.where(F.col("n_lines") > W.BLOCK)
    if large.isEmpty():
        return small
    sized = large.join(large.groupBy(*by).agg(F.count("*").cast("int").alias("_size")), keys)
    labels = cut(sized.select(*by, "pos", F.inline(tags)))
    return small.unionByName(spread_kmeans.scores(term_vectors(W.weigh(large, by, keep=["n_lines"], **options), by), labels, by))


def topic_name(cluster: Column, terms: Column) -> Column:
    """Best bigram, else the two best words, else the one word, else General; title-cased."""
    pairs = F.filter(terms, lambda t: t.contains(" "))
    shown = [X.title_case(F.get(terms, F.lit(i))) for i in (0, 1)]
    name = (
        F.when(F.size(pairs) > 0, X.title_case(F.get(pairs, F.lit(0))))
        .when(F.size(terms) >= 2, F.concat_ws(" & ", *shown))
        .when(F.size(terms) == 1, shown[0])
        .otherwise("General")
    )
    return F.concat(cluster.cast("string"), F.lit(": "), name)


def topic_names(labels: DataFrame, top: DataFrame, by: Keys) -> DataFrame:
    """(page, cluster, n, optimal terms, cluster_name), also for clusters without terms."""
    listed = _listed(top, by)
    counted = labels.groupBy(*by, "cluster").agg(F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    return counted.join(listed, [*by, "cluster"], "left").select(
        *by, "cluster", "n", topic_name(F.col("cluster"), F.coalesce("terms", none)).alias("cluster_name")
    )


def _listed(top: DataFrame, by: Keys) -> DataFrame:
    return top.groupBy(*by, "cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms")
    )


def named_topics(labelled: DataFrame, names: DataFrame, by: Keys) -> DataFrame:
    """Segment labels with the topic name; pages with k = 1 carry the general one."""
    shown = F.when(F.col("optimal_k") == 1, GENERAL).otherwise(F.col("cluster_name"))
    return labelled.join(names.select(*by, "cluster", "cluster_name"), [*by, "cluster"]).withColumn(
        "cluster_name", shown
    )


def topic_counts(named: DataFrame, by: Keys) -> DataFrame:
    return named.groupBy(*by, "cluster_name").agg(F.count("*").alias("n"))


def metrics(labelled: DataFrame, vocab: DataFrame, by: Keys) -> DataFrame:
    """(page, silhouette, optimal_k, vocab_size); k = 1 has no silhouette and vocabulary 0."""
    return metrics_of(labelled, vocab.groupBy(*by).agg(F.count("*").alias("size")), by)


def metrics_of(labelled: DataFrame, sizes: DataFrame, by: Keys) -> DataFrame:
    """The same from the vocabularies' sizes (page, size)."""
    pages = labelled.groupBy(*by).agg(
        F.max("optimal_k").alias("optimal_k"), F.max("silhouette").alias("silhouette")
    )
    return pages.join(sizes, list(by), "left").select(*by, *metric_columns())


def metric_columns() -> list[Column]:
    """Of columns silhouette, optimal_k and size."""
    return [
        F.bround("silhouette", 3).alias("silhouette"),
        F.col("optimal_k"),
        F.when(F.col("optimal_k") == 1, 0).otherwise(F.coalesce("size", F.lit(0))).cast("bigint").alias("vocab_size"),
    ]


def topic_id(label: Column) -> tuple[Column, Column]:
    """Id before the first colon, and the name after it."""
    return F.trim(F.substring_index(label, ":", 1)), F.trim(F.regexp_replace(label, r"^[^:]*:?", ""))


def takeaways(
    dense: DataFrame,
    by: Keys,
    most: int = 3,
    longer_than: int = 50,
    threshold: float = 0.6,
    measure: str = "ratio",
    batch: int = 64,
) -> DataFrame:
    """(page, rank, pos, text): segments by density, skipping one similar to an earlier pick.

    ``dense`` has text and tfidf_score. Picks come from the best ``batch`` candidates of a page. Where
    those do not yield enough, every remaining row that is similar to a pick is dropped in place, all
    over the cluster, and the page goes on with the best rows left. The best one left is always a
    pick, so there are at most ``most`` rounds and no page is gathered beyond ``batch`` rows. What the
    open pages have left is written after each round, so ``dense`` is made twice at most.
    """
    able = dense.where(F.length("text") > longer_than).select(
        *by, "pos", "text", F.round("tfidf_score", 9).alias("score")
    )
    done, prior = [], None
    while True:
        picked = cut(_picks(able, prior, by, most, threshold, measure, batch))
        done.append(picked.where("NOT unsettled"))
        prior = picked.where("unsettled").select(*by, "picks")
        if prior.isEmpty():
            break
        able = cut(_unlike(able, prior, by, threshold, measure))
    settled = reduce(DataFrame.unionByName, done)
    return settled.select(*by, F.posexplode("picks").alias("_i", "_pick")).select(
        *by, (F.col("_i") + 1).alias("rank"), "_pick.pos", "_pick.text"
    )


def chosen(
    texts: Sequence[str], scores: np.ndarray, most: int = 3, longer_than: int = 50, threshold: float = 0.6, measure: str = "ratio"
) -> list[int]:
    """:func:`takeaways` of a page whose segments are at hand, in ``pos`` order: their places."""
    picks: list[int] = []
    tests: list[similar.Later] = []
    for i in np.argsort(-np.round(scores, 9), kind="stable").tolist():
        if len(picks) == most:
            break
        if len(texts[i]) > longer_than and not any(test.matches(texts[i]) for test in tests):
            picks.append(i)
            if len(picks) < most:
                tests.append(similar.Later(texts[i], measure, threshold))
    return picks


def _picks(
    able: DataFrame, prior: DataFrame | None, by: Keys, most: int, threshold: float, measure: str, batch: int
) -> DataFrame:
    """(page, picks, unsettled): earlier picks plus those the next ``batch`` candidates yield."""
    row = "array<struct<pos:bigint,text:string>>"
    head = top_n(able, by, [F.col("score").desc(), F.col("pos")], batch + 1, "_rank")
    pages = head.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_rank", "pos", "text"))).alias("_rows"))
    if prior is None:
        pages = pages.withColumn("picks", F.array().cast(row))
    else:
        none = F.array().cast("array<struct<_rank:int,pos:bigint,text:string>>")
        pages = prior.join(pages, list(by), "left").withColumn("_rows", F.coalesce("_rows", none))

    @F.pandas_udf("array<int>")
    def choose(texts: pd.Series, earlier: pd.Series) -> pd.Series:
        def one(page, taken):
            picks: list[int] = []
            tests = [similar.Later(t, measure, threshold) for t in taken]
            for i, text in enumerate(page):
                if len(tests) == most:
                    break
                # The candidate is the first argument of the ratio, the earlier pick the second.
                if not any(test.matches(text) for test in tests):
                    picks.append(i)
                    tests.append(similar.Later(text, measure, threshold))
            return picks

        return pd.Series([one(list(page), list(taken)) for page, taken in zip(texts, earlier)])

    new = choose(F.transform(F.slice("_rows", 1, batch), lambda r: r["text"]), F.col("picks.text"))
    added = F.transform("_new", lambda i: F.struct(F.get("_rows", i)["pos"].alias("pos"), F.get("_rows", i)["text"].alias("text")))
    chosen = pages.withColumn("_new", new).withColumn("picks", F.concat("picks", added.cast(row)))
    return chosen.select(
        *by, "picks", ((F.size("_rows") > batch) & (F.size("picks") < most)).alias("unsettled")
    )


def _unlike(able: DataFrame, prior: DataFrame, by: Keys, threshold: float, measure: str) -> DataFrame:
    """Candidates of the given pages that are similar to none of the page's picks."""

    @F.pandas_udf("boolean")
    def similar_to_pick(texts: pd.Series, picks: pd.Series) -> pd.Series:
        tests: dict[str, similar.Later] = {}
        out = []
        for text, taken in zip(texts, picks):
            for pick in taken:
                if pick not in tests:
                    tests[pick] = similar.Later(pick, measure, threshold)
            out.append(any(tests[pick].matches(text) for pick in taken))
        return pd.Series(out)

    near = able.join(prior, list(by)).withColumn("_near", similar_to_pick("text", "picks.text"))
    return near.where("NOT _near").select(*able.columns)
