"""Sentiment, terms, topics and takeaways."""

import math
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as X
from pagequarry.functions import vectors
from pagequarry.operators import clean as C
from pagequarry.operators import segments as G
from pagequarry.operators import sentiment as S
from pagequarry.operators import spread_kmeans as SK
from pagequarry.operators import terms as W
from pagequarry.operators import topics as K
from pagequarry.plans import registry

URL = ["url"]
TWO = {
    "two": [
        "Rivers carry water down to the wide sea", "The wide sea takes water from rivers", "Water of rivers and sea",
        "Engines burn fuel to turn the wheels", "Wheels turn when engines burn fuel", "Fuel for engines and wheels",
    ],
    "tiny": ["One short line here", "Another short line there"],
}


def prepared(rows):
    cleaned = C.clean(rows, URL)
    return cleaned, W.vocabulary(cleaned, URL), W.weigh(cleaned, URL, keep=["n_lines", "text"])


def test_sentiment_labels(segments):
    rows = segments({"a": ["A wonderful and amazing day", "This was awful and disgusting", "The chair has four legs", "not very good at all"]})
    got = {r.pos: r for r in S.score(rows).collect()}
    assert [got[i].sentiment_label for i in range(4)] == ["Positive", "Negative", "Neutral", "Negative"]
    assert got[0].sentiment == "🟩 Positive"
    counts = {r.sentiment_label: r.n for r in S.label_counts(S.score(rows), URL).collect()}
    assert sum(counts.values()) == 4
    # "very" scales "good", the negation before it flips and halves; averaged with "very" itself.
    assert math.isclose(got[3].polarity, ((-0.5 * min(1, 0.7 * 1.3)) + -0.5 * 0.2) / 2)


def test_sentiment_bounds_are_strict(spark):
    rows = spark.createDataFrame([(0.1,), (0.1000001,), (-0.1,), (-0.2,)], "p double")
    assert [r.l for r in rows.select(X.sentiment_label(F.col("p")).alias("l")).collect()] == ["Neutral", "Positive", "Neutral", "Negative"]


def test_title_case(spark):
    words = ["3d x2y", "o'neil air-bag", "éa ñu"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(X.title_case(F.col("w")).alias("t"))
    assert [r.t for r in rows.collect()] == [w.title() for w in words]


def test_title_case_letter_by_letter(spark):
    words = ["als ßauzu ßß", "ﬁn ŉa", "ᾳα ᾀ ᾗ", "ẞa", "", " a"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(X.title_case(F.col("w")).alias("t"))
    assert [r.t for r in rows.collect()] == ["Als ẞauzu ẞß", "ﬁn ŉa", "ᾼα ᾈ ᾟ", "ẞa", "", " A"]


def test_document_frequency_cut(segments):
    rows = segments({"a": [f"alpha beta{i} gamma{i}" if i else "omega beta0 gamma0" for i in range(20)], "b": [f"alpha beta{i}" for i in range(20)]})
    cleaned = C.clean(rows, URL)
    vocab = W.vocabulary(cleaned, URL)
    assert {r.url for r in vocab.where("term = 'alpha'").collect()} == {"a"}


@pytest.mark.parametrize(("max_df", "max_features"), [(0.95, 5000), (0.4, 7), (0.05, 3)])
def test_blocks_and_shuffles_weigh_alike(segments, monkeypatch, max_df, max_features):
    """Pages weighed whole in their block, and pages whose terms are shuffled: the same, ties of the cap too."""
    rng = random.Random(4)
    pages = {f"p{i}": [" ".join(f"{rng.choice('éabc漢𝔘')}{rng.randint(0, 9)}x" for _ in range(rng.randint(1, 9))) for _ in range(n)] for i, n in enumerate((1, 3, 40, 90))}
    pages["none"] = ["of the and to in it is", "in is it on as the of"]
    cleaned = C.clean(segments(pages), URL)

    def told():
        weights = W.weigh(cleaned, URL, keep=["n_lines"], max_df=max_df, max_features=max_features)
        vocab = W.vocabulary(cleaned, URL, max_df, max_features)
        packed = {(r.url, r.pos, r.n_lines): sorted((t.term, t.tf, t.df, round(t.idf, 12), round(t.w, 12)) for t in r.terms) for r in weights.collect()}
        return packed, sorted(map(tuple, vocab.collect()))

    whole = told()
    conf, rows = cleaned.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows)
    conf.set(rows, "7")  # batches cut pages
    cut_up = told()
    conf.set(rows, before)
    assert cut_up == whole
    monkeypatch.setattr(W, "BLOCK", 16)
    assert told() == whole and len(whole[0]) == cleaned.count()
    counted = {}
    for (url, _pos, _n), terms in whole[0].items():
        for t in terms:
            counted[url, t[0]] = counted.get((url, t[0]), 0) + 1
    assert all(counted[u, t] == df and df <= max_df * n for u, t, df, _cf, n in whole[1]) and len(counted) == len(whole[1])


def many_pages(segments):
    rng = random.Random(3)
    words = ["alpha", "beta", "the", "éa", "ßx", "x1", "y_z", "rivers", "wheels", "engines", "sea", "of"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 9)))
    pages = {f"p{n}": list(dict.fromkeys(line() for _ in range(rng.choice([1, 2, 3, 7, 40])))) for n in range(12)}
    return C.clean(segments(pages | {"none": ["the of the of"]}), URL)


@pytest.mark.parametrize("block, max_features", [(512, 5000), (512, 20), (16, 5000)])
def test_centroid_terms_are_summed_where_pages_are(segments, monkeypatch, block, max_features):
    rows = many_pages(segments).withColumn("cluster", (F.length("cleaned") % 3).cast("int")).cache()
    want = K.centroid_terms(W.by_term(W.weigh(rows, URL, max_features=max_features), URL), rows, URL).collect()
    monkeypatch.setattr(W, "BLOCK", block)
    found = K.centroid_terms_of(rows, URL, max_features=max_features)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want}
    if block == 512:
        # Texts are shuffled, terms are not.
        assert "term#" not in " ".join(re.findall(r"hashpartitioning.*", found._jdf.queryExecution().toString()))


@pytest.mark.parametrize("block", [512, 16])
def test_scores_are_worked_out_where_pages_are(segments, monkeypatch, block):
    rows = many_pages(segments).cache()
    tags = lambda n: F.transform(
        F.filter(F.sequence(F.lit(2), F.lit(9)), lambda k: k < F.col(n)),
        lambda k: F.struct(k.alias("k"), (F.length("cleaned") % k).cast("int").alias("cluster")),
    )
    sized = rows.join(rows.groupBy("url").agg(F.count("*").alias("n")), "url")
    labels = sized.select("url", "pos", F.inline(tags("n")))
    shown = lambda df: {(r.url, r.k): r.silhouette and round(r.silhouette, 9) for r in df.collect()}
    want = shown(SK.scores(K.term_vectors(W.weigh(rows, URL, keep=["n_lines"]), URL), labels, URL))
    sizes = {r.url: r["count"] for r in W.vocabulary(rows, URL).groupBy("url").count().collect()}
    monkeypatch.setattr(W, "BLOCK", block)
    found = K.scores_of(rows, URL, tags("_size"))
    assert shown(found) == want and len(want) > 10
    assert {r.url: r["size"] for r in W.vocabulary_sizes(rows, URL).collect()} == sizes
    if block == 512:
        assert "pos#" not in " ".join(re.findall(r"hashpartitioning.*", found._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("block", [512, 16])
def test_density_is_summed_where_pages_are(segments, monkeypatch, block):
    rows = many_pages(segments).cache()
    shown = lambda df: sorted((r.url, r.pos, r.text, round(r.tfidf_score, 9)) for r in df.collect())
    want = shown(W.segment_density(W.weigh(rows, URL, keep=["n_lines", "text"])).join(W.usable_pages(rows, URL), URL, "left_semi"))
    monkeypatch.setattr(W, "BLOCK", block)
    found = W.density(rows, URL, ["text"])
    assert shown(found.where("n >= 3")) == want
    assert "terms" not in found.columns


@pytest.mark.parametrize("block", [512, 16])
def test_best_terms_are_summed_where_pages_are(segments, monkeypatch, block):
    rows = many_pages(segments).cache()
    shown = lambda df: sorted((r.url, r.rank, r.term, round(r.score, 9)) for r in df.collect())
    want = shown(W.cloud_terms(W.term_scores(W.tfidf(rows, URL), URL, W.usable_pages(rows, URL)), URL, 12))
    monkeypatch.setattr(W, "BLOCK", block)
    found = W.best_terms(rows, URL, 12)
    assert shown(found) == want
    if block == 512:
        assert "term#" not in " ".join(re.findall(r"hashpartitioning.*", found._jdf.queryExecution().toString()))


@pytest.mark.parametrize("block", [512, 16])
def test_topics_are_found_where_pages_are(segments, monkeypatch, block):
    rows = many_pages(segments).cache()
    wt = W.weigh(rows, URL, keep=["n_lines"]).cache()
    want = K.topics(wt, URL, restarts=2).cache()
    dense = {(r.url, r.pos): round(r.tfidf_score, 9) for r in W.segment_density(wt).collect()}
    names = {tuple(r) for r in K.topic_names(want, K.centroid_terms(W.by_term(wt, URL), want, URL), URL).collect()}
    sizes = {r.url: r["count"] for r in W.vocabulary(rows, URL).groupBy("url").count().collect()}
    monkeypatch.setattr(W, "BLOCK", block)
    found = K.topics_of(rows, URL, restarts=2).cache()
    shown = lambda df: sorted(
        (r.url, r.pos, r.cluster, r.optimal_k, r.silhouette and round(r.silhouette, 9), [s.k for s in r.sweep], r.converged) for r in df.collect()
    )
    assert shown(found) == shown(want)
    assert {(r.url, r.pos): round(r.tfidf_score, 9) for r in found.collect()} == dense
    assert {tuple(r) for r in K.names_of(found, URL).collect()} == names
    assert {r.url: r["size"] for r in found.collect() if r["size"]} == sizes


def test_topics(segments):
    cleaned, vocab, wt = prepared(segments(TWO))
    found = K.topics(wt, URL)
    rows = {(r.url, r.pos): r for r in found.collect()}
    assert len(rows) == 8
    sides = [rows[("two", i)].cluster for i in range(6)]
    assert rows[("two", 0)].optimal_k >= 2 and set(sides[:3]).isdisjoint(sides[3:])
    assert rows[("tiny", 0)].optimal_k == 1 and rows[("tiny", 0)].silhouette is None
    names = K.topic_names(found, K.centroid_terms(W.by_term(wt, URL), found, URL), URL)
    named = K.named_topics(found, names, URL)
    assert {r.cluster_name for r in named.where("url = 'tiny'").collect()} == {K.GENERAL}
    metrics = {r.url: r for r in K.metrics(found, vocab, URL).collect()}
    assert metrics["tiny"].vocab_size == 0 and metrics["two"].vocab_size > 0


def silhouette_by_hand(rows, labels):
    dist = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    values = []
    for i, own in enumerate(labels):
        same = [dist[i, j] for j in range(len(rows)) if labels[j] == own and j != i]
        if not same:
            values.append(0.0)
            continue
        b = min(np.mean([dist[i, j] for j in range(len(rows)) if labels[j] == o]) for o in set(labels) - {own})
        a = np.mean(same)
        values.append((b - a) / max(a, b))
    return float(np.mean(values))


def test_sweep_invariants():
    rng = np.random.RandomState(3)
    rows = np.vstack([rng.normal(c, 0.1, (7, 4)) for c in (0, 3, 6)])
    race = rng.exponential(size=(21, 10, SK.DRAWS))
    labels, k, score, seen, settled = vectors.sweep(rows @ rows.T, race)
    assert settled
    assert k == 3 and len(set(labels)) == 3 and [a for a, _s in seen] == list(range(2, 10))
    assert math.isclose(score, silhouette_by_hand(rows, labels.tolist()), abs_tol=1e-6)
    same = np.ones((4, 4))
    assert vectors.sweep(same, race[:4])[1] == 2


def test_empty_clusters_take_the_farthest_rows():
    labels, own = np.array([0, 0, 0, 0, 3, 3]), np.array([0.5, 0.1, 0.9, 0.9, 0.2, 0.7])
    vectors.refill(labels, own, 4)
    assert labels.tolist() == [0, 0, 1, 2, 3, 3] and own.tolist() == [0.5, 0.1, 0.0, 0.0, 0.2, 0.7]


def big_page(rng, n=60):
    topics = [["river", "sea", "water", "wave", "shore"], ["engine", "wheel", "fuel", "gear", "brake"], ["bread", "flour", "oven", "yeast", "crust"]]
    return [" ".join(rng.choice(topics[i % 3]) + str(rng.randint(0, 1)) for _ in range(8)) + f" item{i}" for i in range(n)]


def test_large_pages_by_joins(segments):
    """The distributed sweep finds the planted topics, and its silhouette is exact for its labels."""
    rng = random.Random(5)
    pages = {"big": big_page(rng), "blank": ["the of and to in", "and the of it is", "it is to the of"] * 20}
    cleaned, _vocab, wt = prepared(segments(pages))
    rows = K.term_vectors(wt, URL)
    found = SK.sweep(rows, URL, restarts=2, seed=42, block=16).collect()
    big = sorted((r for r in found if r.url == "big"), key=lambda r: r.pos)
    assert len(big) == 60 and len({r.pos for r in big}) == 60
    assert big[0].optimal_k == max(big[0].sweep, key=lambda s: (s.silhouette, -s.k)).k
    index, dense = {}, np.zeros((60, 5000))
    for r in W.by_term(wt, URL).where("url = 'big'").collect():
        dense[r.pos, index.setdefault(r.term, len(index))] = r.w
    assert math.isclose(big[0].silhouette, silhouette_by_hand(dense[:, : len(index)], [r.cluster for r in big]), abs_tol=1e-6)
    blank = [r for r in found if r.url == "blank"]
    assert blank and all(r.optimal_k == 1 and r.cluster == 0 for r in blank)


def test_the_limit_decides_nothing_but_the_place(segments):
    """Every page by joins, and every page in a task: the same topics."""
    rng = random.Random(8)
    noise = [" ".join(f"w{rng.randint(0, 40)}x" for _ in range(5)) for _ in range(12)]
    equal = ["alpha beta gamma delta"] * 2 + [f"alpha beta gamma {x}" for x in ("delta beta", "one", "two", "three")]
    pages = {"big": big_page(random.Random(1), 20), "noise": noise, "equal": equal, "none": ["of the and to", "in is it on as"] * 3, **TWO}
    cleaned, _vocab, wt = prepared(segments(pages))

    def told(limit):
        return {
            (r.url, r.pos): (r.cluster, r.optimal_k, r.silhouette and round(r.silhouette, 9),
                             tuple((x.k, round(x.silhouette, 9)) for x in r.sweep), r.converged)
            for r in K.topics(wt, URL, restarts=2, limit=limit).collect()
        }

    by_joins, in_tasks = told(0), told(10**9)
    assert by_joins == in_tasks and len(in_tasks) == cleaned.count()
    assert all(v[4] for v in in_tasks.values())


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_blocks_and_tasks_agree_on_given_seeds(segments, block):
    """Several restarts and k, seeds that are equal rows (so clusters are empty), pages of any kind."""
    rng = random.Random(12)
    equal = ["alpha beta gamma delta"] * 3 + [f"alpha beta gamma {x}" for x in ("delta beta", "one", "two", "three", "delta alpha")]
    pages = {"big": big_page(rng, 40), "equal": equal, "none": ["of the and to", "in is it on as", "the of to in"] * 3 + ["alpha beta gamma"]}
    cleaned, _vocab, wt = prepared(segments(pages))
    points = K.term_vectors(wt, URL)
    own = {}
    for r in points.collect():
        own.setdefault(r.url, []).append(r.pos)
    rows = []
    for url, pos in own.items():
        for k in {2, 3, min(6, len(pos) - 1)}:
            for restart in range(3):
                drawn = sorted(pos)[:k] if not restart else rng.sample(sorted(pos), k)
                rows += [(url, k, restart, c, p) for c, p in enumerate(drawn)]
    seeds = points.sparkSession.createDataFrame(sorted(set(rows)), "url string, k int, restart int, cluster int, pos bigint")
    for rounds in (1, 3, 300):
        told = [
            {(r.url, r.k, r.pos): r.cluster for r in found.collect()}
            for found in (SK.lloyd(points, seeds, URL, rounds, block), K.kmeans_in_tasks(points, seeds, URL, rounds))
        ]
        assert told[0] == told[1] and len(told[0]) == sum(len({k for u, k, *_ in rows if u == url}) * len(p) for url, p in own.items())
        if block != 3:
            break


@pytest.mark.parametrize("limit", [2, 512])
def test_pages_are_cleaned_in_their_rows(spark, limit):
    """The same segments as line by line; with pages of one block, nothing is shuffled."""
    texts = ["One line, twice\none line, twice\nOne line, twice\nshort\n\nThe last: line", "", None, "Only line of this page", "a\nb"]
    docs = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "url string, text string")
    found = C.clean_pages(docs, URL, limit=limit)
    want = C.clean(G.split_lines(docs, URL), URL)
    rows = C.segments_of(found, URL)
    assert (found.large is None) == (limit == 512)
    assert sorted(map(tuple, rows.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    if limit == 512:
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


LINES = ["Rivers carry water to the sea, water", "The sea takes water from rivers", "Engines burn fuel", "Rivers carry water to the sea, water", "of the"]


@pytest.mark.parametrize("limit", [2, 512])
def test_segments_carry_the_best_terms_of_their_cluster(spark, limit, monkeypatch):
    """As centroid terms give them; packed pages are not shuffled."""
    monkeypatch.setattr(W, "BLOCK", limit)
    docs = spark.createDataFrame([("a", "\n".join(LINES)), ("b", "The wheel turned\nof the and to"), ("c", "")], "url string, text string")
    cluster = (F.length("cleaned") % 2).cast("int")
    cleaned = C.clean(G.split_lines(docs, URL), URL)
    want = {}
    for r in K.centroid_terms_of(cleaned.withColumn("cluster", cluster), URL).orderBy("rank").collect():
        want.setdefault((r.url, r.cluster), []).append(r.term)
    found = K.with_best_terms(C.clean_pages(docs, URL, limit=limit), URL, cluster)
    assert {(r.url, r.cluster): r.top for r in found.collect()} == {("a", 0): [], ("b", 1): [], **want}
    assert sorted((r.url, r.pos, r.text) for r in found.collect()) == sorted((r.url, r.pos, r.text) for r in cleaned.collect())
    assert limit == 2 or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [2, 512])
def test_terms_are_counted_where_pages_are(spark, limit, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", limit)
    docs = spark.createDataFrame([("a", "\n".join(LINES)), ("b", "Water, water, water"), ("c", None)], "url string, text string")
    counts = W.term_counts(C.clean(G.split_lines(docs, URL), URL), URL)
    want = counts.groupBy("url", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    found = W.page_counts(C.clean_pages(docs, URL, limit=limit), URL)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {(r.term, r.df, r.cf) for r in found.where("url = 'b'").collect()} == {("water", 1, 3), ("water water", 1, 2)}
    assert limit == 2 or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 512])
def test_merged_terms_keep_inner_products(segments, monkeypatch, block):
    """Vectors of merged terms are shorter than those of all terms, and give the same clusters."""
    monkeypatch.setattr(W, "BLOCK", block)
    rng = random.Random(5)
    cleaned, _vocab, wt = prepared(segments({"big": big_page(rng, 30), "none": ["of the and to", "in is it on as"], **TWO}))

    def told(points):
        held = {}
        for r in points.collect():
            held.setdefault(r.url, []).append((r.pos, r.terms, r.ws))
        return {u: sorted(rows) for u, rows in held.items()}

    merged, plain = told(K.inner_vectors(cleaned, URL)), told(K.term_vectors(wt, URL))
    assert merged.keys() == plain.keys()
    for url, rows in plain.items():
        a, b = ([np.array(x[1]) for x in r] for r in (rows, merged[url]))
        v, w = ([np.array(x[2]) for x in r] for r in (rows, merged[url]))
        assert [x[0] for x in rows] == [x[0] for x in merged[url]]
        assert np.allclose(vectors.gram(a, v), vectors.gram(b, w), atol=1e-12)
        assert block == 1 or sum(map(len, b)) <= sum(map(len, a)) and (url != "two" or sum(map(len, b)) < sum(map(len, a)))
    seeds = cleaned.sparkSession.createDataFrame([("big", 3, 0, c, c) for c in range(3)], "url string, k int, restart int, cluster int, pos bigint")
    points = [K.inner_vectors(cleaned, URL), K.term_vectors(wt, URL)]
    ends = [sorted(map(tuple, SK.lloyd(p, seeds, URL, 5, 4).collect())) for p in points]
    ends += [sorted((r.url, r.pos, r.k, r.cluster, r.converged) for r in K.kmeans_in_tasks(p, seeds, URL, 5).collect()) for p in points]
    assert ends[0] == ends[1] == ends[2] == ends[3] and ends[0]


@pytest.mark.parametrize("block,limit", [(512, 2048), (2, 2048), (2, 4)])
def test_pages_are_clustered_in_their_rows(spark, block, limit, monkeypatch):
    """As from all terms and the same seeds, a page in a task; packed pages are not shuffled. Some seeds are equal
    rows, so that clusters are empty, and some pages have no terms, or no more segments than seeds."""
    monkeypatch.setattr(W, "BLOCK", block)
    rng = random.Random(7)
    noise = [[" ".join(f"w{rng.randint(0, 30)}x" for _ in range(6)) for _ in range(n)] for n in (4, 5, 9, 30)]
    equal = ["alpha beta gamma, delta", "alpha beta gamma delta!", "alpha beta: gamma delta", "alpha beta gamma one", "two three four", "İstanbul two three"]
    blank = ["of the and to", "in is it on as", "the of to in", "and of the in", "to the is in"]
    texts = ["\n".join(ls) for ls in [*noise, equal, blank, [*blank, "alpha beta gamma"], noise[0][:3], ["Only one line"]]] + ["", None]
    docs = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "url string, text string")
    cleaned = C.clean(G.split_lines(docs, URL), URL)
    points = K.term_vectors(W.weigh(cleaned, URL, keep=["n_lines"]), URL).cache()
    seeds = K.first_seeds(points, URL, 3)
    pages = C.clean_pages(docs, URL, limit=block)
    for rounds in (1, 3, 300) if block == 512 else (3,):
        found = K.kmeans_of_pages(pages, URL, 3, rounds, limit)
        want = K.kmeans_in_tasks(points, seeds, URL, rounds).select(found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.select("url").distinct().count() == 7
    assert block == 2 or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_query_on_tasks_shuffles_no_points(spark):
    """Rows are dealt out at most, where the table is one file."""
    plan = registry.CATALOG["kmeans_in_tasks"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Scan ExistingRDD" not in plan


def test_pages_are_swept_side_by_side():
    """As one by one, ties and rows without terms included."""
    rng = np.random.default_rng(4)
    inners = []
    for size in [3, 3, 4, 5, 5, 9, 10, 11, 12, 12, 14, 30, 33, 70]:
        rows = rng.random((size, 8)) * (rng.random((size, 8)) < 0.4)
        rows[: size // 3] = rows[0]
        rows[size // 2] = 0
        inners.append(rows @ rows.T)
    draws = [vectors.draws_of(np.arange(len(i)), 36, 42).reshape(-1, 4, 9) for i in inners]
    for own, race, told in zip(inners, draws, vectors.sweep_pages(inners, draws)):
        want = vectors.sweep(own, race)
        assert told[0].tolist() == want[0].tolist() and told[1] == want[1] and told[4] == want[4]
        assert [(k, round(s, 9)) for k, s in told[3]] == [(k, round(s, 9)) for k, s in want[3]]
        assert (told[2] is None and want[2] is None) or math.isclose(told[2], want[2], abs_tol=1e-9)


def test_draws_in_tasks_are_those_of_the_engine(spark):
    places = [0, 1, 7, 2047, 10**12]
    rows = spark.createDataFrame([(p,) for p in places], "pos bigint").select("pos", SK.race(3, 5).alias("race")).collect()
    want = np.array([dict((r.pos, r.race) for r in rows)[p] for p in places])
    assert np.allclose(vectors.draws_of(np.array(places), 27, 5), want, rtol=1e-12, atol=0)


def test_topics_of_pages_in_their_rows(spark):
    """As line by line, for a page that is a row and one whose key several rows have; the query shuffles no segment."""
    lines = [*TWO["two"], *TWO["two"][:2], "short", "Fuel and water and wheels"]
    docs = spark.createDataFrame(
        [("a", "\n".join(lines)), ("b", "of the and to\nin is it on as\nto the of and in"), ("c", "\n".join(lines[:5])), ("c", "\n".join(lines[4:])), ("d", None),
         ("e", "\n".join(lines + ["Wheels turn"]))],
        "url string, text string",
    )
    packed = C.page_rows(docs, URL, limit=10)
    assert {r.url for r in packed.large.collect()} == {"c", "e"}
    shown = lambda df: sorted((r.url, r.pos, r.cluster, r.optimal_k, tuple(r.top), r.size, r.n_rows, round(r.tfidf_score, 9)) for r in df.collect())
    assert shown(K.topics_of(packed, URL)) == shown(K.topics_of(C.clean(G.split_lines(docs, URL), URL), URL))
    plan = registry.CATALOG["topic_guard"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Scan ExistingRDD" not in plan


def test_words_of_normalised_texts_are_what_is_between_blanks(spark):
    """Around every character: the normalised text is that of the plain patterns, and its words are the same
    whether they are matched in Spark or cut at blanks in the task."""
    chars = [chr(c) for c in [*range(0x3100), *range(0xA640, 0xAB70), *range(0xFE00, 0x10400), 0x1D7CE, 0x1F600]]
    rows = [(t,) for c in chars for t in (f"Ab{c}d {c}bcd  ce{c}{c}", f"a {c} B{c}")] + [(None,), ("",), (" \t",)]
    texts = spark.createDataFrame(rows, "t string")
    plain = F.regexp_replace(F.regexp_replace("t", rf"[^{X.WORD}{X.WS}]", ""), rf"[{X.WS}]+", " ")
    found = texts.select("t", X.normalise(F.col("t")).alias("n"), F.trim(F.lower(plain)).alias("want")).withColumn("words", X.tokens(F.col("n"))).toArrow()
    assert found.column("n").equals(found.column("want"))
    cut = W._split(found.column("n").combine_chunks()).to_pylist()
    assert [w and [x for x in w if len(x) > 1] for w in cut] == found.column("words").to_pylist()


def picks_by_hand(texts, scores, measure):
    order = sorted((i for i in range(len(texts)) if len(texts[i]) > 50), key=lambda i: (-round(scores[i], 9), i))
    picks = []
    for i in order:
        if len(picks) == 3:
            break
        if all(SequenceMatcher(None, texts[i], texts[p]).ratio() <= 0.6 for p in picks):
            picks.append(i)
    return picks


@pytest.mark.parametrize("batch", [2, 64])
def test_takeaways(segments, batch):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(70)) for _ in range(4)]
    texts = [base[0][:-i] + "z" * i if i else base[0] for i in range(12)] + base[1:] + ["short"]
    rows = segments({"a": texts})
    dense = rows.withColumn("tfidf_score", F.lit(20.0) - F.col("pos"))
    got = [r.pos for r in K.takeaways(dense, URL, batch=batch).orderBy("rank").collect()]
    assert got == picks_by_hand(texts, [20.0 - i for i in range(len(texts))], "ratio") and len(set(got)) == len(got)
