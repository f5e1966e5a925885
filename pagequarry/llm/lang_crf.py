"""Language identification by a linear-chain conditional random field over words.

Every word of letters is scored for each language by hashed features: its affixes, its character
n-grams, and itself as a lexicon entry. Learned transitions tie neighbouring words together, and
forward-backward gives each word its probabilities, so text that switches between languages is
labelled word by word. A document's language is the one with the largest share of its words.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import held_out, map_batches, slices, worker_cache

NO_LANGUAGE = "und"
# The bounds of the sample that the model is fitted on: documents in all, and bytes of one.
SAMPLE_ROWS, SAMPLE_BYTES = 1600, 20_000
BUCKETS = 1 << 18
# Words that are labelled side by side; the messages of a longer text are carried from one such chain
# to the next.
CHAIN = 128
TRAIN_CHAIN, ROUNDS, RATE, DECAY = 64, 25, 0.5, 1e-6
MOST_WORDS = 600_000

_words = re.compile(r"[^\W\d_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; signs such as ² or ½ are none."""
    words = []
    for word in _words(text.lower()):
        if word.isalpha():
            words.append(word)
        else:
            words += "".join(c if c.isalpha() else " " for c in word).split()
    return words


def _buckets(codes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (codes + np.uint64(salt)) * _MIX
    return (mixed >> np.uint64(64 - 18)).astype(np.int64) % BUCKETS


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, end to end, and where each word's begin.

    With a mark at both ends of a word, its n-grams at the ends are its affixes.
    """
    joined = "".join([f"\x02{w}\x03" for w in words])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(c)) - starts[owner]
    left = sizes[owner] - place
    shift = np.uint64(21)
    with np.errstate(over="ignore"):
        two = c[:-1] << shift | c[1:]
        three = two[:-1] * _MIX + c[2:]
        four = three[:-1] * _MIX + c[3:]
        power = np.cumprod(np.full(int(sizes.max(initial=1)), np.uint64(0x100000001B3), np.uint64))
        whole = np.add.reduceat(c * power[place], starts) if len(words) else c
    grams = [
        (owner[:-1][left[:-1] >= 2], _buckets(two[left[:-1] >= 2], 1)),
        (owner[:-2][left[:-2] >= 3], _buckets(three[left[:-2] >= 3], 2)),
    ]
    edge = (left[:-3] >= 4) & ((place[:-3] == 0) | (left[:-3] == 4))
    grams.append((owner[:-3][edge], _buckets(four[edge], 3)))
    grams.append((np.arange(len(words)), _buckets(whole, 4)))
    of = np.concatenate([g[0] for g in grams])
    hashed = np.concatenate([g[1] for g in grams])
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(words))
    return hashed[order], np.cumsum(counts) - counts


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    moves: np.ndarray  # languages x languages, from row to column

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, self.weights.shape[1]), np.float32)
        hashed, starts = word_features(words)
        return np.add.reduceat(self.weights[hashed], starts, axis=0)


def forward_backward(
    potentials: np.ndarray,
    valid: np.ndarray,
    moves: np.ndarray,
    pairs: bool = False,
    entering: np.ndarray | None = None,
    leaving: np.ndarray | None = None,
):
    """Probabilities of every word of every chain (chains x places x languages).

    All chains advance together, scaled at each place. ``pairs`` adds the expected transitions.
    ``entering`` and ``leaving`` are the messages from what stands before and after each chain; one
    that something follows has a word at every place.
    """
    chains, places, k = potentials.shape
    step = np.exp(moves).astype(potentials.dtype)
    forward = np.empty_like(potentials)
    forward[:, 0] = potentials[:, 0] if entering is None else potentials[:, 0] * entering
    forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
    for t in range(1, places):
        now = (forward[:, t - 1] @ step) * potentials[:, t]
        forward[:, t] = now / now.sum(1, keepdims=True)
    expected = np.zeros((k, k))
    backward = np.ones((chains, k), potentials.dtype) if leaving is None else leaving.astype(potentials.dtype)
    marginals = np.empty_like(potentials)
    for t in range(places - 1, -1, -1):
        if t + 1 < places:
            later = potentials[:, t + 1] * backward
            passed = later @ step.T
            follows = valid[:, t + 1]
            if pairs and follows.any():
                joint = forward[follows, t][:, :, None] * step[None] * later[follows][:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            backward = np.where(follows[:, None], passed / passed.sum(1, keepdims=True), 1.0).astype(potentials.dtype)
        now = forward[:, t] * backward
        marginals[:, t] = now / now.sum(1, keepdims=True)
    return marginals, expected


def messages(
    potentials: np.ndarray, valid: np.ndarray, nth: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """What every chain hears from the chains before and after it in its text, scaled; ones at the
    ends of a text. ``nth``: the chain's place in its text, chains of a text in order.

    A chain as a whole is a matrix from the language before its first word to that of its last;
    these are made side by side, then applied one after the other, all texts together.
    """
    chains, places, k = potentials.shape
    step = np.exp(moves).astype(np.float64)
    entering, leaving = np.ones((chains, k)), np.ones((chains, k))
    followed = np.flatnonzero(np.r_[nth[1:] > 0, False])
    if not len(followed):
        return entering, leaving
    row = np.full(chains, -1)
    row[followed] = np.arange(len(followed))
    own = potentials[followed].astype(np.float64)
    through = np.eye(k)[None] * own[:, 0][:, None, :]
    for t in range(1, places):
        through = (through @ step) * own[:, t][:, None, :]
        through /= through.max((1, 2), keepdims=True)
    for n in range(1, int(nth.max()) + 1):
        at = np.flatnonzero(nth == n)
        heard = np.einsum("ci,cij->cj", entering[at - 1], through[row[at - 1]]) @ step
        entering[at] = heard / heard.sum(1, keepdims=True)
    # From the last chain of each text backwards: what a chain says to the one before it.
    first_place = potentials[:, 0].astype(np.float64)
    for n in range(int(nth.max()), 0, -1):
        at = np.flatnonzero(nth == n)
        inner = np.empty((len(at), k))
        whole = row[at] >= 0
        inner[whole] = np.einsum("cij,cj->ci", through[row[at[whole]]], leaving[at[whole]])
        inner[~whole] = first_place[at[~whole]] * _tail(potentials[at[~whole]].astype(np.float64), valid[at[~whole]], step)
        heard = inner @ step.T
        leaving[at - 1] = heard / heard.sum(1, keepdims=True)
    return entering, leaving


def _tail(potentials: np.ndarray, valid: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Backward messages at the first place of chains that nothing follows."""
    chains, places, k = potentials.shape
    backward = np.ones((chains, k))
    for t in range(places - 1, 0, -1):
        passed = (potentials[:, t] * backward) @ step.T
        backward = np.where(valid[:, t][:, None], passed / passed.sum(1, keepdims=True), 1.0)
    return backward


def potentials_of(emissions: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """exp of the emissions of (chains x places) word numbers; -1 is no word."""
    found = emissions[ids]
    found = np.exp(np.clip(found - found.max(-1, keepdims=True), -60, 0))
    found[ids < 0] = 1.0
    return found


def train(samples: list[tuple[str, str]]) -> Crf:
    """Fit on (text, language) pairs by gradient steps on the likelihood.

    Half of the chains are spliced from two documents of different languages, so that transitions
    between languages are learned, not only staying.
    """
    languages = sorted({lang for _, lang in samples})
    k = len(languages)
    number: dict[str, int] = {}
    runs = []
    for text, lang in samples:
        ids = [number.setdefault(w, len(number)) for w in words_of(text)]
        runs += [(ids[i : i + TRAIN_CHAIN], languages.index(lang)) for i in range(0, len(ids), TRAIN_CHAIN)]
    if not number or k == 0:
        return Crf(languages, np.zeros((BUCKETS, max(k, 1)), np.float32), np.zeros((max(k, 1), max(k, 1))))
    rng = np.random.default_rng(17)
    ids = np.full((len(runs), TRAIN_CHAIN), -1, np.int64)
    gold = np.zeros((len(runs), TRAIN_CHAIN), np.int64)
    other = rng.permutation(len(runs))
    for i, (words, lang) in enumerate(runs):
        second = runs[other[i]]
        if i % 2 and second[1] != lang:
            cut = int(rng.integers(4, TRAIN_CHAIN - 4))
            first, rest = words[:cut], second[0][: TRAIN_CHAIN - len(words[:cut])]
            row, labels = first + rest, [lang] * len(first) + [second[1]] * len(rest)
        else:
            row, labels = words, [lang] * len(words)
        ids[i, : len(row)], gold[i, : len(row)] = row, labels
    valid = ids >= 0
    hashed, starts = word_features(list(number))
    owner = np.repeat(np.arange(len(number)), np.diff([*starts, len(hashed)]))
    truth = np.zeros((len(number), k))
    np.add.at(truth, (ids[valid], gold[valid]), 1.0)
    both = valid[:, 1:] & valid[:, :-1]
    moved = np.zeros((k, k))
    np.add.at(moved, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen, seen_moves = np.full((BUCKETS, k), 1e-8), np.full((k, k), 1e-8)
    total = float(valid.sum())
    for _ in range(ROUNDS):
        emissions = np.add.reduceat(weights[hashed], starts, axis=0).astype(np.float32)
        got, expected = forward_backward(potentials_of(emissions, ids), valid, moves, pairs=True)
        excess = -truth
        flat = ids[valid]
        for j in range(k):
            excess[:, j] += np.bincount(flat, got[..., j][valid], len(number))
        slope = np.stack([np.bincount(hashed, excess[owner, j], BUCKETS) for j in range(k)], 1) / total
        slope += DECAY * weights
        slope_moves = (expected - moved) / total + 1e-4 * moves
        seen += slope**2
        seen_moves += slope_moves**2
        weights -= RATE * slope / np.sqrt(seen)
        moves -= RATE * slope_moves / np.sqrt(seen_moves)
    return Crf(languages, weights.astype(np.float32), moves)


class Labeller:
    """A model with the emissions of the words met so far, bounded by starting over."""

    def __init__(self, model: Crf):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.emissions = np.zeros((0, self.model.weights.shape[1]), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > MOST_WORDS:
            self._reset()
        number, known = self.number, len(self.number)
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if len(number) > known:
            fresh = list(number)[known:] if known == 0 else [w for w, i in zip(reversed(number), range(len(number) - known))][::-1]
            self.emissions = np.concatenate([self.emissions, self.model.emissions(fresh)])
        return ids

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all words of all texts, end to end, and the number of words of each."""
        words, counts = [], []
        for t in texts:
            own = words_of(t)
            counts.append(len(own))
            words += own
        counts = np.array(counts, np.int64)
        if not words:
            return np.zeros((0, self.model.weights.shape[1]), np.float32), counts
        flat = self._numbers(words)
        chains = -(-counts // CHAIN)
        owner = np.repeat(np.arange(len(texts)), chains)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chains) - chains, chains)
        begin = (np.cumsum(counts) - counts)[owner] + nth * CHAIN
        size = np.minimum(CHAIN, counts[owner] - nth * CHAIN)
        grid = begin[:, None] + np.arange(min(CHAIN, int(size.max())))
        valid = np.arange(grid.shape[1]) < size[:, None]
        ids = np.where(valid, flat[np.minimum(grid, len(flat) - 1)], -1)
        potentials = potentials_of(self.emissions, ids)
        entering, leaving = messages(potentials, valid, nth, self.model.moves)
        got, _ = forward_backward(potentials, valid, self.model.moves, False, entering, leaving)
        return got[valid], counts


def sample(docs: DataFrame, text: str, id_col: str, lang: str, rows: int, most_bytes: int) -> list[tuple[str, str]]:
    """At most ``rows`` labelled documents that aren't held out, evenly from the languages: those of
    least hash. Of a document of more bytes, a window of a quarter as many characters, at a place
    drawn by hash. Both bounds hold for fitting alone."""
    known = docs.where(
        F.col(lang).isNotNull() & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(text).isNotNull()
    )
    width = max(most_bytes // 4, 1)
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit("window")), F.greatest(F.length(text) - width + 1, F.lit(1))) + 1
    window = F.substring(F.col(text), start.cast("int"), F.lit(width))
    window = F.when(F.octet_length(F.col(text)) <= most_bytes, F.col(text)).otherwise(window)
    names = [r[0] for r in known.select(lang).distinct().limit(rows + 1).collect()]
    if not names:
        return []
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (
        known.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= max(1, rows // len(names)))
        .select("id")
        .distinct()
    )
    # No more rows than the bound, so the join is by broadcast and the texts stay where they are.
    found = known.select(F.col(id_col).alias("id"), window.alias("text"), F.col(lang).alias("lang")).join(
        F.broadcast(chosen.limit(rows)), "id", "left_semi"
    )
    return sorted((r["text"], r["lang"]) for r in found.limit(2 * rows).collect())


def identify(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    lang: str = "lang",
    rows: int = SAMPLE_ROWS,
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (its share of the words), switches
    (how often neighbouring words differ in language).

    Learns from ``text`` and non-null ``lang`` of a bounded sample of the documents that aren't held
    out. One row per input row, no shuffle of texts; null texts, texts without a letter, and all
    texts if there is nothing to learn from give ``und`` with score 0; rows that repeat are labelled
    each, other columns are ignored. A text of any length is labelled as one chain of words in its own
    task; of equal shares, the language that sorts first wins.
    """
    model = train(sample(docs, text, id_col, lang, rows, most_bytes))
    packed = pickle.dumps((model.languages, model.weights, model.moves))
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    name = hashlib.sha256(packed).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("languages")
        if name not in cache:
            cache.clear()
            cache[name] = Labeller(Crf(*pickle.loads(shared.value)))
        labeller = cache[name]
        names = np.array([*labeller.model.languages, NO_LANGUAGE], object)
        for batch in slices(batches, "text", 4 << 20):
            got, counts = labeller.marginals([t or "" for t in batch.column("text").to_pylist()])
            has = (counts > 0) & (len(names) > 1)
            starts = (np.cumsum(counts) - counts)[has]
            best, score, switches = np.full(len(counts), len(names) - 1), np.zeros(len(counts)), np.zeros(len(counts), np.int64)
            if has.any():
                shares = np.add.reduceat(got.astype(np.float64), starts, axis=0) / counts[has][:, None]
                best[has] = shares.argmax(1)
                score[has] = np.clip(shares.max(1), 0, 1)
                label = got.argmax(1)
                change = np.r_[False, label[1:] != label[:-1]]
                change[starts] = False
                switches[has] = np.add.reduceat(change.astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(switches)],
                ["doc_id", "lang_pred", "score", "switches"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("switches", T.LongType()),
        ]
    )
    return map_batches(docs.selectExpr(f"`{id_col}` AS id", f"`{text}` AS text"), run, schema)
