"""Cleaning and near-duplicate removal: properties, and brute force over random pages."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from pagequarry.functions import similar
from pagequarry.operators import clean as C
from pagequarry.operators import neardup as ND

URL = ["url"]


def survivors(rows, **options):
    kept = ND.drop_near_duplicates(C.distinct_cleaned(rows, URL), URL, **options)
    return {(r.url, r.pos) for r in kept.select("url", "pos").collect()}


def greedy(pages, threshold=0.85, autojunk=True):
    """The rule read literally: pages of already normalised, distinct texts."""
    out = set()
    for url, texts in pages.items():
        kept = []
        for pos, text in enumerate(texts):
            if len(text) <= 5 or text in texts[:pos]:
                continue
            if all(SequenceMatcher(None, k, text, autojunk).ratio() <= threshold for k in kept):
                kept.append(text)
                out.add((url, pos))
    return out


def test_exact_duplicates_go(segments):
    rows = segments({"a": ["A first line about rivers", "A first line about rivers", "Something else on mountains"]})
    assert C.clean(rows, URL).count() == 2


def test_near_duplicates_go(segments):
    rows = segments({"a": ["the small cat sleeps on the warm mat in the house", "the small cat sleeps on the warm mat in the garage", "bridges need steel and careful plans"]})
    assert survivors(rows) == {("a", 0), ("a", 2)}


def test_short_and_empty(segments, spark):
    rows = segments({"a": ["Hi", "12345", "123456", "A perfectly long and valid line of text"]})
    assert {r.pos for r in C.clean(rows, URL).collect()} == {2, 3}
    empty = spark.createDataFrame([], "url string, pos bigint, text string, n_lines bigint")
    assert C.clean(empty, URL).count() == 0 and survivors(empty) == set()


def test_normalise_unicode(segments):
    rows = segments({"a": ["  Éa_b!  Ç, 日本語  99% 😀 "]})
    assert C.add_cleaned(rows).first().cleaned == "éa_b ç 日本語 99"


def test_dropped_rows_suppress_nobody(segments):
    base = "abcdefghijklmnopqrstuvwxyz0123456789"
    near = base[:-4] + "!!!!".replace("!", "é")
    far = "éééé".join([base[4:-4], ""])[:32] + "zzzz"
    pages = {"a": [base, near, far]}
    assert survivors(segments(pages)) == greedy(pages)


def noisy(rng, text, rate):
    return "".join(rng.choice("abcdefgh ") if rng.random() < rate else c for c in text).strip()


@pytest.mark.parametrize("limit", [512, 6])
@pytest.mark.parametrize("autojunk", [True, False])
def test_against_brute_force(segments, limit, autojunk):
    rng = random.Random(7)
    pages = {}
    for page in range(4):
        seeds = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([12, 40, 199, 200, 260]))) for _ in range(5)]
        texts = [noisy(rng, rng.choice(seeds), rng.choice([0, 0.03, 0.1, 0.2])) for _ in range(30)]
        pages[f"p{page}"] = [" ".join(t.split()) for t in texts]
    # One page of nothing but near copies: every row but a few is suppressed by the first.
    pages["copies"] = [f"this is copy number {i} of the very same notice board text" for i in range(60)]
    assert survivors(segments(pages), limit=limit, autojunk=autojunk) == greedy(pages, autojunk=autojunk)


@pytest.mark.parametrize("measure", ["ratio", "levenshtein"])
def test_chains_and_copies_over_many_ranges(segments, measure):
    """Thirteen ranges of eight rows: every pair of ranges has to meet, and a chain in which each row
    is like its neighbours only has to be settled from its start."""
    rng = random.Random(5)
    text = [rng.choice("abcdefgh") for _ in range(100)]
    chain = []
    for _ in range(60):
        chain.append("".join(text))
        for spot in rng.sample(range(100), 9):
            text[spot] = rng.choice("ijklmnop")
    far = [c + "x" for c in chain[::2]]
    rng.shuffle(far)
    pages = {"chain": chain, "mixed": chain[:20] + far + chain[20:50], "short": chain[:5]}

    def alike(a, b):
        if measure == "ratio":
            return SequenceMatcher(None, a, b).ratio() > 0.85
        return 1.0 - distance(a, b) / max(len(a), len(b)) > 0.85

    want = set()
    for url, texts in pages.items():
        kept = []
        for pos, t in enumerate(texts):
            if t not in texts[:pos] and not any(alike(k, t) for k in kept):
                kept.append(t)
                want.add((url, pos))
    rows = segments(pages)
    assert survivors(rows, limit=1, measure=measure) == want
    assert survivors(rows, limit=512, measure=measure) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for n, x in enumerate(a, 1):
        before, row[0] = row[0], n
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, before + (x != y))
    return row[-1]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_pairs_side_by_side_against_plain_recurrences():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcde 漢𝔘") for _ in range(rng.choice([1, 9, 63, 64, 65, 128, 130, 250]))) for _ in range(24)]
    block = similar.Block(texts)
    late, early = (x.ravel() for x in np.meshgrid(np.arange(24), np.arange(24), indexing="ij"))
    words = (block.lengths[late] + 63) // 64
    for width in range(1, 5):
        i, j = early[words == width], late[words == width]
        for measure, plain in (("ratio", common), ("levenshtein", distance)):
            got = similar.side_by_side(block, i, block, j, width, measure)
            assert got.tolist() == [plain(texts[a], texts[b]) for a, b in zip(i, j)]


@pytest.mark.parametrize("measure", ["ratio", "levenshtein"])
@pytest.mark.parametrize("threshold", [0.6, 0.85, 0.95])
def test_bounds_leave_no_similar_pair_out(measure, threshold):
    rng = random.Random(int(threshold * 100))
    seeds = ["".join(rng.choice("abcdefgh éx") for _ in range(n)) for n in (1, 6, 30, 64, 199, 260, 300)]
    texts = [noisy(rng, rng.choice(seeds), rng.choice([0, 0.05, 0.1, 0.3])) or "q" for _ in range(70)]
    block = similar.Block(texts)
    rows = np.arange(len(texts))
    found = set(zip(*(x.tolist() for x in similar.bound_pairs(block, rows, block, rows, measure, threshold))))
    for a in range(0, len(texts), 2):
        for b in range(len(texts)):
            if measure == "ratio":
                alike = SequenceMatcher(None, texts[a], texts[b]).ratio() > threshold
                assert (a, b) in found or not alike
            else:
                longest = max(len(texts[a]), len(texts[b]))
                assert ((a, b) in found) == (1.0 - distance(texts[a], texts[b]) / longest > threshold)


@pytest.mark.parametrize("measure", ["ratio", "levenshtein"])
def test_a_page_of_a_hundred_thousand_lines_of_one_length(spark, measure):
    """Copies differ from an original in three of sixty letters, all else is drawn at random, so who
    survives is known: originals, and copies of none."""
    draw = np.random.default_rng(9)
    n, originals = 100_000, 80_000
    letters = draw.integers(0, 26, (originals, 60))
    of = draw.integers(0, originals // 100, n - originals)
    copies = letters[of]
    for _ in range(3):
        copies[np.arange(len(copies)), draw.integers(0, 60, len(copies))] = draw.integers(0, 26, len(copies))
    every = np.concatenate([letters, copies])
    order = draw.permutation(n)
    family = np.concatenate([np.arange(originals), of])[order]
    texts = (every[order] + 97).astype(np.uint8).view("S60").ravel().astype(str)
    frame = pd.DataFrame({"url": "a", "pos": np.arange(n), "cleaned": texts, "n_lines": n}).drop_duplicates("cleaned")
    rows = spark.createDataFrame(frame).repartition(8)
    kept = ND.drop_near_duplicates(rows, URL, measure=measure).select("pos").toPandas()["pos"]
    # Two copies differ from each other in six letters at most, which is within the bound as well.
    first = pd.Series(np.arange(n)).groupby(family).min()
    assert sorted(kept) == sorted(first)


def test_accounting(segments):
    rows = segments({"a": ["One good long line", "One good long line", "one good long line!", "Hi"]})
    kept = ND.drop_near_duplicates(C.distinct_cleaned(rows, URL), URL)
    r = C.accounting(rows, kept, URL).first()
    assert (r.n_before, r.n_exact, r.n_long, r.n_kept, r.removed_exact, r.removed_near) == (4, 3, 2, 1, 1, 1)


@pytest.mark.parametrize("measure", ["ratio", "levenshtein"])
def test_pages_side_by_side_are_as_one_by_one(measure, monkeypatch):
    """Pairs of many pages are compared at once, long texts too; one page at a time keeps the same rows."""
    rng = random.Random(3)
    pages = [[], ["alone here"], ["", "x"]]
    for _ in range(60):
        seeds = ["".join(rng.choice("abcdefgh éx漢") for _ in range(rng.choice([5, 40, 64, 130, 300, 700]))) for _ in range(3)]
        pages.append(list(dict.fromkeys(noisy(rng, rng.choice(seeds), rng.choice([0, 0.04, 0.1, 0.3])) for _ in range(14))))
    taken = []
    plain = similar.side_by_side
    monkeypatch.setattr(similar, "side_by_side", lambda *a: taken.append(a[4]) or plain(*a))
    found = similar.first_wins_of(pages, measure, 0.85)
    assert max(taken) > 4
    monkeypatch.undo()
    for texts, kept in zip(pages, found):
        want = []
        for n, t in enumerate(texts):
            if measure == "ratio":
                alike = (SequenceMatcher(None, texts[k], t).ratio() for k in want)
            else:
                later = similar.Later(t, measure, 0.85)
                alike = (0.86 * later.matches(texts[k]) for k in want)
            if not any(a > 0.85 for a in alike):
                want.append(n)
        assert kept == want


def test_pages_are_decided_in_their_rows(spark):
    """Pages that are a row each are not shuffled; long ones and keys of several rows are as line by line."""
    rng = random.Random(8)
    words = ["river", "stone", "bridge", "Castle!", "old", "new", "green", "hill", "42", "é"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 9])))
    texts = {f"p{n}": "\n".join(line() for _ in range(rng.choice([1, 5, 30]))) for n in range(20)}
    texts |= {"none": None, "empty": "", "short": "Hi\nHi", "long": "\n".join(line() for _ in range(600))}
    rows = list(texts.items())
    schema = "url string, text string"
    pages = spark.createDataFrame(rows, schema)
    found = C.lines_of(pages, URL)
    apart = ND.drop_in_pages(C.Lines(found.small, None), URL)
    assert "Exchange" not in apart._jdf.queryExecution().executedPlan().toString()
    for given in (pages, spark.createDataFrame([*rows, ("p0", "One more line of it\nHi"), (None, "Of no page"), (None, "Of no page!")], schema)):
        lines = C.split_lines(given, URL)
        for measure in ("ratio", "levenshtein"):
            kept = ND.drop_near_duplicates(C.distinct_cleaned(lines, URL), URL, measure=measure)
            new = ND.drop_in_pages(C.lines_of(given, URL), URL, measure=measure)
            as_rows = lambda df: sorted(map(str, df.collect()))
            assert as_rows(new) == as_rows(kept.select("url", "pos", "cleaned"))
            told = ND.accounting(C.lines_of(given, URL), URL, measure=measure)
            assert as_rows(told) == as_rows(C.accounting(lines, kept, URL).select(told.columns))
