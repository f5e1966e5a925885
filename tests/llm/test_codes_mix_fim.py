"""Vector codes, source mixing and the fill-in-middle transformation."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from pagequarry.llm import equal_average, queries, rank_index, source_mix

FOLDER = "/root/testdata/sf0.001"
NEW = ["op11_vector_codes", "op12_source_mix", "op13_fill_in_middle"]


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, name):
    ok, note = oracle.compare(spark, oracle.connect(FOLDER), FOLDER, name)
    assert ok, note


# ---------------------------------------------------------------- vector codes

def brute_codes(vectors, parts, entries, rounds, scale):
    """Plain Python, whole search."""
    whole = [[int(np.floor(float(x) * scale)) for x in v] for v in vectors]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            named = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, named) if n == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return ["".join(f"{e:02x}" for _, e in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize(("n", "d", "entries"), [(60, 8, 16), (5, 4, 256), (40, 12, 40)])
def test_codes_against_brute_force(spark, n, d, entries):
    draw = np.random.default_rng(n)
    vectors = np.round(draw.normal(0, 0.3, (n, d)), 2).astype(np.float32)
    vectors[n // 2 :: 3] = vectors[0]  # repeated vectors, so ties between entries
    rows = [(int(i), v.tolist(), i % 3 if i % 4 else None) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    codes, books = equal_average.compress(frame, entries=entries)
    got = {r["vec_id"]: r for r in codes.collect()}
    want, errors, brute = brute_codes(vectors, 4, entries, 4, 1024)
    assert [got[i]["code"].hex() for i in range(n)] == want
    assert [got[i]["error"] for i in range(n)] == errors
    assert books.entries.tolist() == brute
    sums = {k: sum(e for (_, _, lab), e in zip(rows, errors) if lab == k) for k in {r[2] for r in rows}}
    assert all(got[i]["label_error"] == sums[rows[i][2]] for i in range(n))
    decoded = {r["vec_id"]: r["decoded"] for r in equal_average.decode(codes, books).collect()}
    gap = [(np.floor(vectors[i].astype(float) * 1024) - np.array(decoded[i]) * 1024) for i in range(n)]
    assert [int((g**2).sum()) for g in gap] == errors


@pytest.mark.parametrize("spread", [1, 40, 1000, 1 << 25])
def test_search_finds_the_first_of_the_nearest(spread):
    draw = np.random.default_rng(spread)
    entries = draw.integers(-spread, spread + 1, (200, 6))
    points = draw.integers(-spread, spread + 1, (700, 6))
    points[::7] = entries[draw.integers(0, 200, 100)]
    index, best, compared = equal_average.Codebook(entries).search(points)
    gaps = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (index == gaps.argmin(1)).all() and (best == gaps.min(1)).all()
    if spread > 1:
        assert compared < 0.8 * gaps.size  # the bound on sums leaves entries out


def test_entries_at_exactly_the_bound_are_compared():
    # Gap of sums 4 over 4 components: bound 4, reached by the entry with the lower index.
    entries = np.array([[1, 1, 1, 1], [0, 2, 0, 0], [9, 9, 9, 9]])
    index, best, _ = equal_average.Codebook(entries).search(np.zeros((1, 4), np.int64))
    assert index.tolist() == [0] and best.tolist() == [4]


def test_components_beyond_exact_numbers_are_refused():
    book = equal_average.Codebook(np.array([[1 << 31, 0]]))
    with pytest.raises(ValueError):
        book.search(np.array([[0, 0]]))


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [0.5, 0.25, 0.0, -0.5], None), (None, [0.5, 0.25, 0.0, -0.5], 1), (1, [1.0, 0.0, 0.0, 0.0], 1),
        (1, [1.0, 0.0, 0.0, 0.0], 1), (2, None, 1), (4, [], 1), (5, [nan, 0.0, 0.0, 0.0], 1),
        (6, [inf, 0.0, 0.0, 0.0], 1), (7, [None, 0.0, 0.0, 0.0], None), (8, [0.0, 0.0, 0.0, 0.0], None),
    ]
    schema = "vec_id bigint, embedding array<float>, label int, vec int, code string, `sums` int, error int, part int"
    frame = spark.createDataFrame([(*r, 1, "c", 2, 3, 4) for r in rows], schema)
    codes, _ = equal_average.compress(frame)
    got = sorted(codes.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    assert [r["vec_id"] for r in got] == [1, 1, 3, 8, None]
    assert got[0] == got[1] and {r["error"] for r in got} == {0}
    empty, books = equal_average.compress(frame.limit(0))
    assert books is None and empty.collect() == [] and empty.columns == codes.columns
    assert equal_average.compress(frame.where("vec_id = 2"))[0].count() == 0
    with pytest.raises(ValueError):
        equal_average.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], "vec_id bigint, embedding array<double>, label int"))


# ---------------------------------------------------------------- mixing

def brute_targets(sizes, weights, most):
    """Resharing of the excess, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: float(most * sizes[s]) for s in over}


def brute_mix(rows, weights=(1, 2, 3), most=3):
    """(id, source, size, taken) per row."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = brute_targets(sizes, weights, most)
    out = []
    for source in sizes:
        own = [(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i,
                len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), i) for i, t, s in rows if s == source]
        budget, start = int(np.floor(target[source] + 0.5)), 0
        for _, _, size, i in sorted(own, key=lambda r: r[:3]):
            whole = budget // sizes[source] if sizes[source] else 0
            rest = min(size, max(0, budget - whole * sizes[source] - start))
            out.append((str(i), str(source), size, whole * size + rest))
            start += size
    return sorted(out), target


def mixed_rows(spark, rows, parts=3, **more):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts)
    return source_mix.mix(frame, **more)


CASES = {
    "even": [(i, "w " * (1 + i * 7 % 13), f"s{i % 5}") for i in range(60)],
    "hot": [(i, "w " * 9, "big" if i % 3 else f"s{i % 7}") for i in range(120)],
    "many sources": [(i, "w\tw\n" * (i % 4), f"s{i % 40:02}") for i in range(90)],
    "one source": [(i, "w w", "a") for i in range(7)],
    "tiny first": [(1, "w", "a"), (2, "w " * 500, "b"), (3, "w", "c"), (4, "w w", None)],
    "repeats": [(1, "a b c", "x")] * 20 + [(None, "a b", "x")] * 9 + [(2, "a b c d", "y")] * 3 + [(None, None, None)] * 2,
    "words of other blanks": [(1, "a b c\x1cd \x0b\x0c e", "x"), (2, "𝔘 漢字", "y"), (3, "", "y"), (4, " \t", "z")],
    "nothing": [(1, None, "a"), (2, "", None)],
}


@pytest.mark.parametrize("name", CASES)
def test_mix_against_brute_force(spark, name):
    rows = CASES[name]
    got = mixed_rows(spark, rows).collect()
    want, target = brute_mix(rows)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in got) == want
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        assert r["taken"] <= 3 * r["size"]
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in taken)


def test_mix_agrees_whatever_the_partitions_and_by_weights(spark):
    rows = CASES["hot"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one, two = mixed_rows(spark, rows, 1), mixed_rows(spark, rows, 11)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    other = mixed_rows(spark, rows, weights=(5, 1), most=2)
    want, _ = brute_mix(rows, (5, 1), 2)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in other.collect()) == want


@pytest.mark.parametrize("name", ["tiny first", "repeats", "many sources"])
def test_mixed_texts_are_what_is_taken(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = source_mix.mix(docs)
    made = source_mix.mixed_texts(docs, mixed).withColumn("n", source_mix.words(F.col("text")))
    got = {(r["doc_id"], r["source"]): r["n"] for r in made.groupBy("doc_id", "source").agg(F.sum("n").alias("n")).collect()}
    want = {(r["doc_id"], r["source"]): r["t"] for r in mixed.groupBy("doc_id", "source").agg(F.sum("taken").alias("t")).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert made.agg(F.max("epoch")).first()[0] <= 3


def test_mix_is_native(spark):
    frame = spark.createDataFrame(CASES["even"], "doc_id bigint, text string, source string")
    mixed = source_mix.mix(frame)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_mix_of_odd_rows(spark, odd, none):
    got = source_mix.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert source_mix.mix(none).collect() == []
    with pytest.raises(ValueError):
        source_mix.mix(odd, weights=(1, 0))


# ---------------------------------------------------------------- fill in the middle

def brute_fim(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    shown = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(shown[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", " ", "ab cd", "𝔘 漢字 é́x", "x<P>y", "<S", "S><M", "a<P b>", "\n\n\t", "aB9zZ[`{@", "ſKk", "a\x00b", "<" * 9, "abc" * 50]


def test_transformation_against_brute_force_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id here"), (-5, "minus"), (7, "again"), (7, "again")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit("x"), "output": F.lit(1)})
    cut = rank_index.fill_in_middle(frame)
    got = cut.withColumn("back", rank_index.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *brute_fim(i, t or "")) for i, t in rows]
    key = lambda r: (str(r[0]), str(r[5]))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_every_rank_of_every_index_is_exact():
    draw = np.random.default_rng(3)
    for steps in (draw.integers(1, 9, 5000), draw.geometric(0.2, 20000), np.repeat([1, 300, 1, 5000], 700), np.ones(3, int),
                  draw.pareto(1.1, 3000).astype(int) + 1, np.array([], int)):
        offsets = np.concatenate([[0], np.cumsum(steps)])
        index = rank_index.RankIndex.fit(offsets)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residuals.astype(int)).max() <= rank_index.ERROR
        assert index.units == len(steps)
    assert len(rank_index.RankIndex.fit(np.arange(0, 10**6, 4)).starts) == 1  # a line is one segment


def test_very_long_text(spark):
    text = "".join(f"word{i} " + "z" * (i % 50) for i in range(60_000)) + "q" * 1_000_000
    rows = [(i, text) for i in (0, 1, 2)]
    got = rank_index.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = got.withColumn("same", rank_index.restored(F.col("output"), F.col("form")) == text).collect()
    assert all(r["same"] for r in got)
    assert [tuple(r)[:6] for r in sorted(got)] == [(i, *brute_fim(i, text)) for i, _ in rows]


def test_transformation_of_odd_rows(spark, odd, none):
    assert rank_index.fill_in_middle(odd).count() == odd.count()
    assert rank_index.fill_in_middle(none).collect() == []
    assert queries.op13(spark, FOLDER).where("form <> 'plain' AND prefix_chars IS NULL").count() == 0
