"""HTML rules against a literal reading of them, retrieval, entities, streams and stores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import markup
from pagequarry.functions.fixed import IGNORED_PHRASES, JUNK_CONTAINERS, JUNK_FRAGMENTS
from pagequarry.functions import vectors
from pagequarry.operators import clean as C
from pagequarry.operators import entities as N
from pagequarry.operators import html as E
from pagequarry.operators import keys as A
from pagequarry.operators import metric
from pagequarry.operators import retrieve as R
from pagequarry.operators import segments as G
from pagequarry.operators import silhouette as V
from pagequarry.sources import store
from pagequarry.plans import report as RP
from pagequarry.plans.catalog_streams import table_stream
from pagequarry.streaming import streams as ST

URL = ["url"]

PAGE = ["page_id"]


def valid(text):
    if len(text.strip()) < 10 or any(p in text.lower() for p in IGNORED_PHRASES):
        return False
    return sum(c.isalpha() for c in text) / len(text) >= 0.4


def junk(e):
    def marked(attrs):
        return any(f in attrs for f in JUNK_FRAGMENTS)

    return marked(e["own_attrs"]) or any(a["tag"] in JUNK_CONTAINERS or marked(a["attrs"]) for a in e["ancestors"][:3])


def literal(html):
    """Passes in order, gates on the running count."""
    found = [e for e in markup.elements(html) if e["text"] is not None]
    data = []

    def take(test):
        for e in found:
            if test(e, e["text"], len(e["text"])) and valid(e["text"]) and e["text"] not in data:
                data.append(e["text"])

    titled = ["title", "headline", "heading", "story", "article", "card", "post", "entry", "news"]
    take(lambda e, t, n: e["tag"] in ("h1", "h2", "h3", "h4", "h5", "h6") and not junk(e))
    take(lambda e, t, n: e["tag"] == "a" and not junk(e) and n > 20 and not t.startswith("http"))
    if len(data) < 5:
        take(lambda e, t, n: e["tag"] == "a" and e["has_href"] and 15 < n < 200 and not t.startswith("http") and t.count(" ") >= 2)
    take(lambda e, t, n: e["tag"] in ("article", "section") and not junk(e))
    take(lambda e, t, n: e["tag"] in ("span", "div") and any(w in e["own_attrs"] for w in titled) and not junk(e) and 15 < n < 300)
    if len(data) < 5:
        take(lambda e, t, n: e["tag"] == "p" and not junk(e) and n > 30)
    if len(data) < 5:
        take(lambda e, t, n: e["tag"] == "li" and not junk(e) and 20 < n < 200)
    if len(data) < 10:
        take(lambda e, t, n: e["main_line"] and n > 15)
    return data


def random_page(rng):
    words = "amber basin cedar delta ember fjord grove haven islet jetty knoll lagoon menu footer 12345 98765".split()

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randint(2, 9)))

    def piece(depth):
        tag = rng.choice("h1 h2 a a p p li span div article section nav footer aside".split())
        attrs = rng.choice(["", "", ' class="story-title"', ' id="ad-top"', ' class="Sidebar x"', ' href="/x"', ' class="card" id="n"'])
        inner = text() if depth == 0 or rng.random() < 0.5 else "".join(piece(depth - 1) for _ in range(rng.randint(1, 3)))
        return f"<{tag}{attrs}>{inner}</{tag}>" if rng.random() < 0.9 else f"<{tag}{attrs}>{inner}"

    return "<html><body>" + "".join(piece(3) for _ in range(rng.randint(1, 9))) + "</body></html>"


def test_gated_passes(spark):
    rng = random.Random(11)
    pages = [(i, random_page(rng)) for i in range(150)] + [(150, ""), (151, None)]
    rows = spark.createDataFrame(pages, "page_id bigint, html string")
    got = {}
    for r in E.segments(rows, PAGE).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got == {i: literal(h) for i, h in pages if literal(h)}
    sizes = {len(v) for v in got.values()}
    assert min(sizes) < 5 < max(sizes)


def test_elements_on_broken_markup():
    html = "<p><b>one<br><p>two &amp; three</p><ul><li>four<li>five</ul><script>var t='</p>';</script><h2>six <i>seven</i></h2>"
    assert [(e["tag"], e["text"]) for e in markup.elements(html)] == [
        ("p", "one"), ("p", "two & three"), ("li", "four"), ("li", "five"), ("h2", "six seven"),
    ]


def test_references_without_a_semicolon():
    page = "<h1>a &amp;&amp &lt;b&gt; &eacute;&#33;&ampx; c&d &#x27;&amp</h1>"
    text = lambda closed: markup.elements(page, closed)[0]["text"]
    assert text(True) == "a &&amp <b> é!&ampx; c&d '&amp"
    assert text(False) == "a && <b> é!&x; c&d '&"


def test_junk_within_three_ancestors():
    near = "<nav><div><div><h2>A heading near the top</h2></div></div></nav>"
    far = "<nav><div><div><div><h2>A heading near the top</h2></div></div></div></nav>"
    assert literal(near) == [] and literal(far) == ["A heading near the top"]


def test_script_heavy(spark):
    rows = [(0, "<body>" + "<script>x</script>" * 11 + "short</body>"), (1, "<body>" + "<script>x</script>" * 10 + "short</body>"), (2, "<body>" + "<script>x</script>" * 11 + "w " * 300 + "</body>")]
    got = E.script_heavy(spark.createDataFrame(rows, "page_id bigint, html string"), PAGE)
    assert [r.script_heavy for r in got.orderBy("page_id").collect()] == [True, False, False]


def test_joined_text_cut(spark):
    rows = spark.createDataFrame([("a", i, f"t{i:03d}") for i in range(300)] + [("b", 0, "xy")], "url string, pos bigint, text string")
    got = {r.url: r.doc for r in A.joined_text(rows, ["url"], "text", " ", 52).collect()}
    assert got == {"a": " ".join(f"t{i:03d}" for i in range(300))[:52], "b": "xy"}


@pytest.mark.parametrize("block", [4, 256])
def test_nearest_against_brute_force(spark, block):
    """One key holds most rows; equal vectors tie by id."""
    rng = np.random.RandomState(2)
    rows = [("hot" if i < 40 else f"k{i % 3}", i, rng.randint(0, 3, 4).astype(float).tolist()) for i in range(55)]
    texts = spark.createDataFrame(rows, "key string, text_id bigint, embedding array<double>")
    asks = texts.withColumnRenamed("text_id", "question_id")
    got = {(r.key, r.question_id, r["rank"]): r.text_id for r in R.nearest(asks, texts, ["key"], k=5, block=block).collect()}
    want = {}
    for key, q, v in rows:
        near = sorted((round(float(np.linalg.norm(np.array(v) - np.array(w))), 12), i) for k, i, w in rows if k == key)
        want.update({(key, q, n): i for n, (_d, i) in enumerate(near[:5], 1)})
    assert got == want


@pytest.mark.parametrize("kind", ["far", "equal", "close", "whole", "odd"])
def test_few_differences_find_the_nearest(kind, monkeypatch):
    """Block by block, bit by bit what all differences give; products alone would mistake close vectors."""
    rng = np.random.default_rng(7)
    rows = rng.normal(0, 1, (300, 16))
    if kind == "equal":
        rows[::2] = rows[0]
    elif kind == "close":
        rows = 1e3 + 1e-6 * rows
    elif kind == "whole":
        rows = np.round(rows)
    questions, ids = np.vstack([rows[:90], rng.normal(0, 1, (10, 16))]), rng.permutation(300) * 3
    if kind == "odd":
        rows[3, 2], questions[7, 1] = np.nan, np.inf
    with np.errstate(all="ignore"):
        dist = np.sqrt(((questions[:, None] - rows[None]) ** 2).sum(axis=2))
    order = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :7]
    monkeypatch.setattr(vectors, "NEAR", 2000)
    monkeypatch.setattr(vectors, "distances", None)
    for ends in ([0, 300], [0, 3, 5, 300], [0, 128, 256, 300]):
        state = None
        for low, high in zip(ends, ends[1:]):
            state = vectors.nearest(questions, rows[low:high], ids[low:high], 7, state)
        assert (state[0] == ids[order]).all()
        assert np.array_equal(state[1], np.take_along_axis(dist, order, axis=1), equal_nan=True)


def test_only_texts_that_were_found_are_shuffled(spark, monkeypatch):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 11)], "question_id bigint, rank int, text_id bigint")
    texts = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c"), (11, "B")], "text_id bigint, text string")
    asks = spark.createDataFrame([(1,), (2,), (3,)], "question_id bigint")
    want = {1: "a\n\nB\n\nb", 2: "B\n\nb", 3: ""}
    for told in (R.TOLD, 1):
        monkeypatch.setattr(R, "TOLD", told)
        found = R.contexts(asks, hits, texts, ["question_id"])
        assert {r.question_id: r.context for r in found.collect()} == want
        assert ("LeftSemi, BuildRight" in found._jdf.queryExecution().executedPlan().toString()) == (told > 1)


@pytest.mark.parametrize("spread", [0.05, 0.3, 50.0])
def test_pruning_leaves_no_neighbour_out(spark, spread):
    """Forty clumps, from far apart to one cloud, a hot key, vectors that are equal, far questions."""
    rng = np.random.RandomState(int(spread * 100))
    homes = rng.normal(0, 3, (40, 6))
    points = homes[rng.randint(0, 40, 1500)] + rng.normal(0, spread, (1500, 6))
    points[::50] = points[0]
    keys = np.where(np.arange(1500) < 1300, "hot", np.where(np.arange(1500) % 9, "mid", "few"))
    rows = [(str(k), i, p.tolist()) for i, (k, p) in enumerate(zip(keys, points))]
    texts = spark.createDataFrame(rows, "key string, text_id bigint, embedding array<double>").repartition(5)
    far = [("hot", 9000 + i, (rng.normal(0, 30, 6)).tolist()) for i in range(20)] + [("none", 9999, [0.0] * 6)]
    asks = texts.withColumnRenamed("text_id", "question_id").where("question_id % 7 = 0").unionByName(
        spark.createDataFrame(far, "key string, question_id bigint, embedding array<double>")
    )
    got = {(r.key, r.question_id, r["rank"]): r.text_id for r in R.nearest(asks, texts, ["key"], k=5, block=32).collect()}
    want = {}
    for r in asks.collect():
        own = np.flatnonzero(keys == r.key)
        dist = np.sqrt(((points[own] - np.array(r.embedding)) ** 2).sum(1))
        for n, at in enumerate(np.lexsort((own, dist))[:5], 1):
            want[(r.key, r.question_id, n)] = int(own[at])
    assert got == want
    work = {r.key: r for r in R.nearest_work(asks, texts, ["key"], k=5, block=32).collect()}
    assert work["hot"].texts == 1300 and work["hot"].compared <= work["hot"].pairs
    if spread == 0.05:
        assert work["hot"].compared < 0.35 * work["hot"].pairs


@pytest.mark.parametrize("apart", [0.2, 2.0, 100.0])
def test_silhouette_without_far_clusters(spark, apart):
    rng = np.random.RandomState(int(apart * 10))
    labels = rng.randint(0, 8, 400)
    labels[0] = 8
    points = rng.normal(0, 1, (9, 5))[labels] * apart + rng.normal(0, 1, (400, 5)) + 1000.0
    rows = [(0, i, int(c), p.tolist()) for i, (c, p) in enumerate(zip(labels, points))] + [(1, 500 + i, 0, [float(i)]) for i in range(3)]
    frame = spark.createDataFrame(rows, "scope int, id bigint, cluster int, embedding array<double>")
    got = {(r.scope, r.own): r for r in V.silhouette(frame, ["scope"], "id", block=64).collect()}
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    for c in range(9):
        own = np.flatnonzero(labels == c)
        b = np.min([dist[own][:, labels == o].mean(1) for o in range(9) if o != c], axis=0)
        a = dist[own][:, own].sum(1) / max(len(own) - 1, 1)
        want = ((b - a) / np.maximum(a, b)).mean() if len(own) > 1 else 0.0
        assert got[(0, c)].n == len(own) and abs(got[(0, c)].silhouette - want) < 1e-9
    if apart == 100.0:  # a row meets its own cluster and the nearest other one only
        assert V.wanted_clusters(frame.where("scope = 0"), ["scope"], "id", 64).count() < 400 * 3


def test_silhouette_blocks(spark):
    rng = np.random.RandomState(4)
    rows = [(0, i, i % 3 if i < 29 else 3, (rng.rand(3) + i % 3).tolist()) for i in range(30)]
    frame = spark.createDataFrame(rows, "scope int, id bigint, cluster int, embedding array<double>")
    small = {r.own: (r.n, round(r.silhouette, 9)) for r in V.silhouette(frame, ["scope"], "id", block=7).collect()}
    large = {r.own: (r.n, round(r.silhouette, 9)) for r in V.silhouette(frame, ["scope"], "id").collect()}
    assert small == large and small[3] == (1, 0.0)


def mention_rows(spark, rows):
    return spark.createDataFrame(rows, "url string, sentence bigint, pos bigint, name string, category string")


def test_folded_blocks_let_their_batches_go(spark, monkeypatch):
    """What is kept of a pair of blocks is no view into the batch it came in."""
    rows = spark.createDataFrame([(0, i, [float(i), 1.0], i % 2) for i in range(6)], "g int, id bigint, embedding array<double>, cluster int")
    steps = []

    def caught(pairs, keys, step, result, shape):
        steps.append(step)
        return fold(pairs, keys, step, result, shape)

    fold = metric.fold_pairs
    monkeypatch.setattr(metric, "fold_pairs", caught)
    V.cluster_distances(rows, ["g"], "id")
    R.nearest(rows.withColumnRenamed("id", "question_id"), rows.withColumnRenamed("id", "text_id"), ["g"])
    ids, x = np.arange(3), np.arange(6.0).reshape(3, 2)
    for step, given in zip(steps, ((ids, ids, x, x), (ids, x, ids, x)), strict=True):
        state = None
        for _ in range(3):
            state = step(state, *given)
            assert not any(np.shares_memory(kept, one) for kept in state for one in given)


def test_entity_limits_and_ties(spark):
    rows = [("a", s, i, f"N{i:02d}", "People") for s in range(2) for i in range(22)] + [("a", 9, 0, "N05", "Money"), ("a", 9, 1, "N21", "People")]
    found = mention_rows(spark, rows)
    top = [r.name for r in N.top_entities(found, ["url"]).where("category = 'People'").orderBy("rank").collect()]
    assert top == ["N21", "N00", "N01", "N02", "N03"]
    chosen = N.top_nodes(N.nodes(found, ["url"]), ["url"])
    names = {r.name: r.category for r in chosen.collect()}
    assert len(names) == 20 and "N20" not in names and names["N05"] == "People"
    linked = N.edges(found, chosen, ["url"])
    assert linked.count() == 191 - 1 and linked.where("src = 'N05' AND dst = 'N21'").first().n == 3
    assert N.top_edges(linked, ["url"]).count() == 30
    assert N.neighbours(linked, ["url"]).where("name = 'N05'").count() == 19


def test_longer_names_win(spark):
    split = spark.createDataFrame([("a", 0, "In New York City we met Ann in 2021 for $1,200 and New York.")], "url string, sentence bigint, text string")
    names = spark.createDataFrame([("New York City", "GPE"), ("New York", "GPE"), ("City", "LOC"), ("Ann", "PERSON"), ("we met", "ORG")], "term string, label string")
    got = {(r.name, r.category) for r in N.mentions(N.tagged(split, names, ["url"]), ["url"]).collect()}
    assert got == {("New York City", "Locations"), ("New York", "Locations"), ("Ann", "People"), ("2021", "Dates"), ("$1,200", "Money")}


def test_names_over_signs_and_line_ends(spark):
    text = "Art met O'Neill in New\nYork, at the Upper West  Side Council of Arts. Smart Art, O Neill"
    split = spark.createDataFrame([("a", 0, text)], "url string, sentence bigint, text string")
    terms = ["New\nYork", "Upper West Side Council", "O'Neill", "Art", "Upper West", "(Arts)"]
    names = spark.createDataFrame([(t, "ORG") for t in terms], "term string, label string")
    got = sorted((r.at, r.name) for r in N.tagged(split, names, ["url"]).collect())
    want = [("Art", 0), ("O'Neill", 0), ("New York", 0), ("Upper West Side Council", 0), ("Arts", 0), ("Art", text.index("Smart") + 3)]
    assert got == sorted((text.index(n.replace("New York", "New\nYork").replace("West Side", "West  Side"), s) + 1, n) for n, s in want)


@pytest.mark.parametrize("width", [3, 4096])
def test_sentences_without_gathering_a_page(spark, monkeypatch, width):
    """The same sentences under the same numbers as from the page's joined text."""
    rng = np.random.RandomState(6)
    bits = ["One", "two three", ".", "!?", "", " ", "four. five", "Six!", "seven?? eight", "...", "nine ten. ", " . ", "e.g. this"]
    rows = []
    for page in range(60):
        n = rng.randint(1, 14)
        for p in range(n):
            parts = [bits[i] for i in rng.randint(0, len(bits), rng.randint(0, 4))]
            rows.append((f"p{page}", p * (1 + page % 3), None if rng.rand() < 0.1 else "".join(parts), 3 * n))
    rows += [("open", i, "no end here", 9) for i in range(9)] + [("ends", i, "...", 4) for i in range(4)]
    table = spark.createDataFrame(rows, "url string, pos bigint, text string, n_lines bigint").repartition(4)
    monkeypatch.setattr(A.running_before, "__defaults__", ((), width))
    want = {(r.url, r.sentence, r.text) for r in N.sentences(N.documents(table, ["url"]), ["url"]).collect()}
    assert {(r.url, r.sentence, r.text) for r in N.page_sentences(table, ["url"]).collect()} == want
    assert {(r.url, r.sentence, r.text) for r in N.page_sentences(table.drop("n_lines"), ["url"]).collect()} == want


def test_packed_pages_have_the_same_sentences(spark):
    """Sentences and names of pages that come packed, without a shuffle."""
    lines = ["He met Ann Bo. Then", "they left. In 2020 they", "paid $ 20 and Ann  Bo went", "...", "no end of it Ann"]
    docs = spark.createDataFrame([("a", "\n".join(lines)), ("b", "Ann Bo\n! Ann Bo at last, Bo-Bo."), ("c", None)], "url string, text string")
    rows, pages = C.clean(G.split_lines(docs, URL), URL), C.clean_pages(docs, URL)
    want, got = N.page_sentences(rows, URL), N.page_sentences(pages, URL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    names = spark.createDataFrame([("Ann Bo", "PERSON"), ("Bo", "ORG"), ("Bo-Bo", "GPE")], "term string, label string")
    found = [sorted(map(tuple, N.tagged(got, names, URL, trie_bytes=size).collect())) for size in (1 << 20, 0)]
    assert found[0] == found[1] and {t[2] for t in found[0]} == {"Ann Bo", "Bo-Bo", "2020", "$ 20"}


def test_a_gazetteer_of_any_size_finds_the_same(spark):
    rng = np.random.RandomState(7)
    words = ["New", "York", "City", "Ann", "met", "in", "Art", "O'Neill", "the", "West"]
    signs = [" ", "  ", "\n", ", ", "-", " & "]
    texts = ["".join(words[rng.randint(10)] + signs[rng.randint(6)] for _ in range(rng.randint(1, 30))) + "2021 €5" for _ in range(80)]
    split = spark.createDataFrame([(f"p{i % 7}", i, t) for i, t in enumerate(texts)], "url string, sentence bigint, text string")
    terms = ["New York City", "New York", "York City", "City", "Ann", "Art - West", "Art-West", "O'Neill", "met in", "West & Ann", "in the West", "New"]
    names = spark.createDataFrame([(t, "ORG" if len(t) % 2 else "GPE") for t in terms], "term string, label string")
    for capitals in (True, False):
        small = sorted(map(tuple, N.tagged(split, names, ["url"], capitals).collect()))
        assert small == sorted(map(tuple, N.tagged(split, names, ["url"], capitals, trie_bytes=-1).collect()))
        assert len(small) > 200


def test_a_megabyte_without_a_full_stop(spark):
    """Linear work: 1 MB with a name at every few words, of which each place is exact."""
    text = "we saw Ann Lee and Bob " * 45_000
    split = spark.createDataFrame([("a", 0, text)], "url string, sentence bigint, text string")
    names = spark.createDataFrame([("Ann Lee", "PERSON"), ("Bob", "PERSON"), ("Lee", "ORG")], "term string, label string")
    got = N.tagged(split, names, ["url"]).groupBy("name").agg(F.count("*").alias("n"), F.sum("at").alias("s"), F.max("at").alias("m")).collect()
    step, n = len("we saw Ann Lee and Bob "), 45_000
    want = {name: (n, sum(step * i + at for i in range(n)), step * (n - 1) + at) for name, at in (("Ann Lee", 8), ("Bob", 20))}
    assert {r["name"]: (r["n"], r["s"], r["m"]) for r in got} == want


def test_long_pages_are_read_whole(spark):
    rows = [("a", i, "some words without any name in them" * 30 + ".", 1200) for i in range(1200)] + [("a", 1200, "Here is Ann.", 1201)]
    table = spark.createDataFrame(rows, "url string, pos bigint, text string, n_lines bigint")
    names = spark.createDataFrame([("Ann", "PERSON")], "term string, label string")
    split = N.sentences(N.documents(table, ["url"]), ["url"])
    assert [(r.name, r.at) for r in N.tagged(split, names, ["url"]).collect()] == [("Ann", 9)]
    assert len(N.documents(table, ["url"], max_chars=1000).first().doc) == 1000


def test_a_name_that_starts_small_is_no_name(spark):
    split = spark.createDataFrame([("a", 0, "art and Art")], "url string, sentence bigint, text string")
    names = spark.createDataFrame([("art", "ORG"), ("Art", "ORG")], "term string, label string")
    assert [(r.name, r.at) for r in N.tagged(split, names, ["url"]).collect()] == [("Art", 9)]
    assert N.tagged(split, names, ["url"], capitals=False).count() == 2


def test_empty_graph(spark):
    pages = spark.createDataFrame([("a",)], "url string")
    none = mention_rows(spark, [])
    chosen = N.top_nodes(N.nodes(none, ["url"]), ["url"])
    graph = N.packed_graph(pages, chosen, N.top_edges(N.edges(none, chosen, ["url"]), ["url"]), ["url"]).first().graph
    assert graph.nodes == [] and graph.edges == []


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi", twice\nand go \\ on'), (2, "plain")], "id bigint, text string")
    store.write_csv(rows, str(tmp_path / "x"))
    assert sorted(store.read_csv(spark, str(tmp_path / "x"), "id BIGINT, text STRING").collect()) == sorted(rows.collect())


def test_json_overlay(spark):
    rows = spark.createDataFrame([("u", 3, 0.5, '{"url":"old","takeaways":["t"]}')], "url string, total_items bigint, avg_subjectivity double, results string")
    got = store.unpack(rows, "url STRING, takeaways ARRAY<STRING>, audio_file STRING").first()
    assert (got.url, got.takeaways, got.audio_file, got.total_items) == ("u", ["t"], None, 3)


def test_streams_equal_batch(spark, tmp_path):
    """Several micro-batches, late rows included, give what one batch gives."""
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 4), f"u{rng.randint(1, 3)}", 1000 - i if i % 3 else i, i / 10) for i in range(60)]
    schema = "id bigint, user_id bigint, url string, sec bigint, avg_subjectivity double"
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    source = str(tmp_path / "in")
    for part in range(3):
        table.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: ST.arrivals(spark, source, table.schema, files_per_batch=1)
    ST.toggle_state(stream(), str(tmp_path / "t")).awaitTermination()
    got = {(r.user_id, r.url): (r.n, r.subscribed) for r in ST.read_latest(spark, str(tmp_path / "t"), ["user_id", "url"]).collect()}
    want = {(r.user_id, r.url): (r["count"], r["count"] % 2 == 1) for r in table.groupBy("user_id", "url").count().collect()}
    assert got == want
    ST.latest_by_key(stream(), ["user_id"], "id", str(tmp_path / "l")).awaitTermination()
    got = {r.user_id: r.ts for r in ST.read_latest(spark, str(tmp_path / "l"), ["user_id"]).collect()}
    assert got == {r.user_id: r.ts for r in table.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    ST.append_series(stream(), str(tmp_path / "s")).awaitTermination()
    assert ST.read_series(spark, str(tmp_path / "s")).count() == 60


@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_of_one_file_or_many_is_streamed(spark, tmp_path, parts):
    rows = spark.range(20).select(F.col("id").alias("event_id"), "id")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    if parts:
        rows.repartition(parts).write.parquet(str(tmp_path / "in" / "events.parquet"))
    else:
        (tmp_path / "in").mkdir()
        next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "in" / "events.parquet")
    rows.write.parquet(str(tmp_path / "in" / "pages.parquet"))
    found = table_stream(spark, str(tmp_path / "in"), "events").writeStream.trigger(availableNow=True)
    out = str(tmp_path / "out")
    found.option("checkpointLocation", str(tmp_path / "progress")).start(out, format="parquet").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(20))


def test_state_is_merged_and_batches_may_run_again(spark, tmp_path):
    """Forty batches: the state is the newest per key, few folders are left, and a batch that runs
    again, after a broken run too, adds nothing."""
    base, want = str(tmp_path / "state"), {}
    for number in range(40):
        rows = [(f"k{(number * j) % 9}", number * 10 + j) for j in range(1, 4)]
        rows = list({k: (k, v) for k, v in rows}.values())
        changed = spark.createDataFrame(rows, "k string, v int").coalesce(1)
        for _ in range(2 if number % 5 == 0 else 1):
            ST._merge(changed, base, ["k"], number)
        want.update(dict(rows))
    assert {r.k: r.v for r in ST.read_latest(spark, base, ["k"]).collect()} == want
    assert ST._batches(spark, f"{base}/merged") == [15, 31] and min(ST._batches(spark, f"{base}/changes")) == 16
    before = {r.k: r.v for r in ST._state(spark, base, ["k"], before=39).collect()}
    (tmp_path / "state" / "changes" / "batch=40").mkdir()  # a run that broke leaves no mark of success
    assert {r.k: r.v for r in ST.read_latest(spark, base, ["k"]).collect()} == want and before != want


def test_scheduled_reports_equal_batch(spark, tmp_path):
    """Two batches: only subscribed urls, the newest snapshot of a batch, one copy per subscriber,
    and a page that fails stops nobody."""
    page = "<h1>Rivers carry water down to the wide sea</h1><p>{} burn fuel and turn the wheels all day long</p><p>Wheels turn when engines burn fuel in the night</p>"
    schema = "page_id bigint, url string, html string, ts bigint"
    first = [(1, "a", page.format("Engines"), 1), (2, "a", page.format("Motors"), 2), (3, "b", "<p>x</p>", 1), (4, "c", page.format("Cars"), 1)]
    second = [(5, "a", page.format("Trains"), 3), (6, "d", page.format("Ships"), 3)]
    late = [(9, "a", page.format("Carts"), 2), (8, "d", page.format("Boats"), 3)]  # of "a" a newer one was there
    source = str(tmp_path / "in")
    for rows in (first, second, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    subs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("d", 3)], "url string, user_id bigint")
    names = spark.createDataFrame([("Trains", "ORG")], "term string, label string")

    def make(pages):
        found = RP.stages(pages, E.segments(pages, ["url"]), names, ["url"])
        return RP.report(found, ["url"]).select("url", "status", "total_items", "takeaways", "graph")

    stream = ST.arrivals(spark, source, schema, files_per_batch=1)
    ST.report_snapshots(stream, lambda: subs, make, str(tmp_path / "out")).awaitTermination()
    told = spark.read.parquet(str(tmp_path / "out" / "reports"))
    assert sorted((r.url, r.status) for r in told.collect()) == [("a", "ok"), ("a", "ok"), ("b", "no_content"), ("d", "ok"), ("d", "ok")]
    copies = spark.read.parquet(str(tmp_path / "out" / "copies"))
    assert sorted((r.url, r.user_id) for r in copies.collect()) == [("a", 1), ("a", 1), ("a", 2), ("a", 2), ("d", 3), ("d", 3)]
    whole = make(spark.createDataFrame([second[0]], schema)).first()
    last = max((r for r in told.where("url = 'a'").collect()), key=lambda r: len(r.graph.nodes))
    assert last.graph == whole.graph and last.total_items == whole.total_items and len(whole.graph.nodes) == 1


def test_reports_of_pages_in_their_rows(spark, monkeypatch):
    """The same as by joins; longer pages, keys of several rows and pages without a key go that way still."""
    lines = [
        "Rivers carry water down to the wide sea in the great calm spring", "The wide sea takes good water from rivers! Trains ran in 1999",
        "Engines burn fuel to turn the wheels of bad old Trains", "Engines burn fuel to turn the wheels of bad old Trains.", "Wheels turn when engines burn fuel",
        "It cost $20. The Trains met the Wheels", "Fuel for engines and wheels, terrible and very good wheels", "short",
    ]
    docs = spark.createDataFrame(
        [("a", "\n".join(lines)), ("b", "\n".join(lines[2:])), ("c", "Only one line of text is here"), ("d", None), ("e", "of the and to\nin is it on as"),
         ("f", "\n".join(lines * 2)), ("g", "\n".join(lines[1:5])), ("g", "\n".join(lines[1:5])), (None, "\n".join(lines))],
        "url string, text string",
    )
    names = spark.createDataFrame([("Trains", "ORG"), ("the Wheels", "GPE"), ("Engines", "PERSON")], "term string, label string")
    by_joins = RP.report(RP.stages(docs, G.split_lines(docs, URL), names, URL), URL)
    asked = []
    monkeypatch.setattr(RP, "stages", lambda pages, *args, stages=RP.stages: asked.append({r.url for r in pages.collect()}) or stages(pages, *args))

    def told(df):
        columns = sorted(set(df.columns) - {"avg_subjectivity"})
        rows = df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.round("avg_subjectivity", 9)).collect()
        return sorted(map(str, rows))

    want = told(by_joins)
    for limit, others in ((8, {"f", "g", None}), (64, {"g", None})):
        assert told(RP.report_of(docs, names, URL, limit=limit)) == want
        assert asked.pop() == others
    assert told(RP.report_of(docs.where("url < 'f'"), names, URL)) == told(by_joins.where("url < 'f'")) and not asked


def test_a_hot_user_spans_tasks_in_order(spark):
    from pyspark.sql import functions as F

    from pagequarry.operators import history

    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50 + 100).otherwise(7).alias("user_id"),
        "id", F.lit("u").alias("url"), F.lit(1).alias("total_items"), F.lit(0.5).alias("avg_subjectivity"),
        F.timestamp_seconds(F.col("id") * 37 % 1000).alias("ts"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listed = history.listing(rows).withColumn("task", F.spark_partition_id()).collect()
        points = history.series(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len({r["task"] for r in listed if r["user_id"] == 7}) > 1
    assert len({r["task"] for r in points if r["user_id"] == 7}) > 1
    newest_first = [(r["user_id"], -r["ts"].timestamp(), -r["id"]) for r in listed]
    assert newest_first == sorted(newest_first) and len(newest_first) == 4000
    oldest_first = [(r["user_id"], r["ts"], r["id"]) for r in points]
    assert oldest_first == sorted(oldest_first) and len(oldest_first) == 4000
