import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import lang_crf, mix_packing, pii_anchors, quality_qda, queries, rp_forest

FOLDER = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# ---------------------------------------------------------------- quality

def test_quality_on_held_out_rows(spark):
    got = queries.op1(spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and not got.score.isna().any()
    assert (got.held_out == got.doc_id.map(held)).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    mine = got.merge(labels, on="doc_id").query("held_out")
    assert (mine.predicted == mine.quality).mean() >= 0.95


def test_densities_are_those_of_the_normal_distribution():
    draw = np.random.default_rng(1)
    d = len(quality_qda.FEATURES)
    sample = {k: draw.normal(k, 1 + k, (500, d)) @ draw.normal(0, 1, (d, d)) for k in (0, 1)}
    model = quality_qda.Discriminant({k: (float(len(x)), x.sum(0), x.T @ x) for k, x in sample.items()}, pool=0.0, sphere=0.0)
    probe = sample[1][:50]
    logs = []
    for k, x in sample.items():
        mean, cov = x.mean(0), np.cov(x.T, bias=True)
        gap = probe - mean
        logs.append(np.log(0.5) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert np.allclose(model.scores(probe), want, atol=1e-3)


def test_quality_without_both_classes_and_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (8, None, 1)], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality_qda.score(odd, labels).collect()} == {1.0}
    assert {r["score"] for r in quality_qda.score(odd, labels.limit(0)).collect()} == {0.5}
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id bigint, quality int")
    scored = quality_qda.score(odd, both)
    assert scored.count() == odd.count() and scored.where("score IS NULL OR isnan(score)").count() == 0
    assert quality_qda.keep_good(odd, both).schema == odd.schema
    assert quality_qda.score(none, both).count() == 0 and quality_qda.keep_good(none, both).count() == 0


# ---------------------------------------------------------------- languages

def test_language_on_held_out_rows(spark):
    got = queries.op6(spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    mine = got.merge(docs, on="doc_id").query("held_out")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (mine.lang_pred == mine.lang).mean() >= 0.97


def test_messages_are_carried_over_chain_ends(monkeypatch):
    """Texts cut in chains of four words get the probabilities of uncut ones."""
    rng = np.random.default_rng(5)
    languages = ["aa", "bb", "cc"]
    model = lang_crf.Crf(languages, rng.normal(0, 0.7, (lang_crf.BUCKETS, 3)), rng.normal(0, 1, (3, 3)))
    words = ["one", "zwei", "trois", "four", "fünf", "six", "sieben"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 4, 9, 30, 0, 8, 5)]
    whole, counts = lang_crf.Labeller(model).marginals(texts)
    monkeypatch.setattr(lang_crf, "CHAIN", 4)
    cut, same = lang_crf.Labeller(model).marginals(texts)
    assert counts.tolist() == same.tolist() == [1, 4, 9, 30, 0, 8, 5]
    assert np.abs(whole - cut).max() < 1e-5


def test_signs_are_no_words():
    assert lang_crf.words_of("² ½ ① 12 _ \u2167") == []
    assert lang_crf.words_of("Haus² a½b x_y 漢字") == ["haus", "a", "b", "x", "y", "漢字"]


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(n, f"der die das und nicht {n} " * 3, "de") for n in range(40)]
    rows += [(n, "le la les et pas " * 300, "fr") for n in range(40, 80)] + [(99, "²½", "de")]
    got = lang_crf.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_bytes=400).collect()
    assert len(got) == 81
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: lang if i < 99 else "und" for i, _, lang in rows}


def test_forward_backward_against_all_paths():
    draw = np.random.default_rng(4)
    k, n = 3, 5
    moves, emissions = draw.normal(size=(k, k)), draw.normal(size=(2, n, k))
    valid = np.array([[True] * 5, [True] * 3 + [False] * 2])
    potentials = np.exp(emissions)
    potentials[~valid] = 1.0
    got, pairs = lang_crf.forward_backward(potentials, valid, moves, pairs=True)
    expected = np.zeros((k, k))
    for c, length in ((0, 5), (1, 3)):
        paths = np.stack(np.meshgrid(*[range(k)] * length, indexing="ij"), -1).reshape(-1, length)
        weight = np.exp(
            emissions[c, np.arange(length), paths].sum(1) + moves[paths[:, :-1], paths[:, 1:]].sum(1)
        )
        weight /= weight.sum()
        for t in range(length):
            assert np.allclose(np.bincount(paths[:, t], weight, k), got[c, t])
        for t in range(length - 1):
            np.add.at(expected, (paths[:, t], paths[:, t + 1]), weight)
    assert np.allclose(expected, pairs)


def test_switching_text_is_labelled_word_by_word():
    samples = [("the and with from this that have", "en"), ("der und mit von diese dass haben", "de")] * 30
    labeller = lang_crf.Labeller(lang_crf.train(samples))
    got, counts = labeller.marginals(["the and with from der und mit von", "", "1 2 3"])
    assert counts.tolist() == [8, 0, 0]
    assert got.argmax(1).tolist() == [1] * 4 + [0] * 4


def test_languages_of_odd_rows(odd, none, spark):
    got = lang_crf.identify(odd).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (5, 6, 7)} == {"und"}
    assert lang_crf.identify(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lang_crf.identify(unlabelled).collect()} == {"und"}


# ---------------------------------------------------------------- neighbours

def brute_neighbours(rows, k, every):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = sorted((-float(v @ w), j) for j, w in rows if j != i)
            out[i] = scored[:k]
    return out


def test_neighbours_have_the_recall(spark):
    got = queries.op8(spark, FOLDER).toPandas()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    want = brute_neighbours(zip(table.vec_id, table.embedding), 20, 20)
    vectors = {i: np.array(v, float) for i, v in zip(table.vec_id, table.embedding)}
    hits = 0
    for i, scored in want.items():
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert mine.score.is_monotonic_decreasing
        assert np.allclose(mine.score, [vectors[i] @ vectors[j] for j in mine.vec_id])
        hits += len({j for _, j in scored} & set(mine.vec_id))
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("block", [(8192, 4096), (5, 3)])
def test_small_tables_ties_and_bad_vectors(spark, block):
    draw = np.random.default_rng(3)
    rows = [(i, draw.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in rows]
    rows += [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(60, 100)]
    bad = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan")] * 4),
           (280, [float("inf")] * 4), (300, [1.0, 2.0]), (None, [1.0] * 4), (320, [])]
    schema = "vec_id bigint, embedding array<float>, label int, `class` int, score string"
    table = spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows + bad + rows[:3]], schema)
    got = rp_forest.nearest(table, k=7, recall=1.0, block=block).collect()
    want = brute_neighbours(rows, 7, 20)
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert mine == want
    assert rp_forest.nearest(table.limit(0)).count() == 0
    assert rp_forest.nearest(table.where("vec_id IN (0, 1)")).select("query_id", "vec_id").collect() == [(0, 1)]
    assert rp_forest.nearest(table.where("vec_id = 0")).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_against_plain_python(spark):
    """The stages again without Spark: its own decisions for quality, the rest by brute force."""
    import re

    from test_text import brute_classes
    from test_tokens import check_packing
    from tokenizers import Tokenizer
    import public_tokenizers

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    good = {
        r["doc_id"] for r in quality_qda.score(
            spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
        ).collect() if r["predicted"]
    }
    left = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in good}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    classes = brute_classes(sorted(left.items()))
    left = {i: t for i, t in left.items() if classes[i][0] == i}
    finder = pii_anchors.Finder()
    left = {i: pii_anchors.masked(t, finder.spans(t)) if t else t for i, t in left.items()}
    pieces = [r.asDict() | {"crc": r["ids_crc32"]} for r in corpus_pipeline.run(spark, folder).collect()]
    check_packing(pieces, left, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), mix_packing.WINDOW)


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, none):
    table = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), "key", "row")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "/root/testdata/sf0.001")
        assert out.columns == corpus_pipeline.COLUMNS, name
        out.count()
        assert stage(spark, table.limit(0), "/root/testdata/sf0.001").count() == 0, name
    repeated = [r["doc_id"] for r in corpus_pipeline.exact(spark, table, FOLDER).collect()]
    assert repeated.count(1) == 1 and 2 not in repeated
    assert corpus_pipeline.packing(spark, table.limit(0), FOLDER).count() == 0
