"""String similarity for near-duplicate tests, with cheap upper bounds tried first.

Small helpers for Arrow-batched UDFs. ``ratio`` is the standard library's matcher ratio with the
arguments in (earlier, later) order; ``levenshtein`` is 1 - distance / longer length.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

CHAR_BINS, PAIR_BINS, PAIR_LEVELS = 64, 256, 4
# Longer runs of characters, for Levenshtein only: an edit takes few of them away.
GRAM, GRAM_BITS = 4, 40
# They are looked up pair by pair; so many pairs of texts this short are sooner compared side by side.
MANY, SHORT = 512, 192
# Bytes of one temporary array, words of a text up to which pairs are compared side by side, by classes.
TEMPORARY, SIDE_BY_SIDE = 1 << 23, (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
# Rows of a page up to which it is decided together with others, and characters and pairs of such a group.
TOGETHER, GROUP_CHARS, GROUP_PAIRS = 256, 1 << 21, 1 << 19


def length_floor(measure: str, threshold: float) -> float:
    """Least shorter/longer length quotient a pair above the threshold can have."""
    return threshold / (2 - threshold) if measure == "ratio" else threshold


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


class Later:
    """One later text, prepared to be tested against many earlier ones."""

    def __init__(self, text: str, measure: str, threshold: float, autojunk: bool = True):
        self.text, self.measure, self.threshold = text, measure, threshold
        self.masks = _masks(text)
        self.full = (1 << len(text)) - 1
        self.autojunk = autojunk
        self.matcher: SequenceMatcher | None = None

    def common(self, other: str, least: float = 0.0) -> int:
        """Length of the longest common subsequence, one machine word row at a time; less than
        ``least`` as soon as what is left of ``other`` cannot reach that."""
        row, size, masks, full = self.full, len(self.text), self.masks, self.full
        for start in range(0, len(other), 64):
            for ch in other[start : start + 64]:
                hit = row & masks.get(ch, 0)
                row = ((row + hit) | (row - hit)) & full
            if size - row.bit_count() + len(other) - start - 64 < least:
                break
        return size - row.bit_count()

    def edits(self, other: str) -> int:
        """Levenshtein distance by the bit-vector recurrence over columns of ``other``."""
        size = len(self.text)
        if not size:
            return len(other)
        up, down, score, last = self.full, 0, size, 1 << (size - 1)
        for ch in other:
            eq = self.masks.get(ch, 0)
            diag = (((eq & up) + up) ^ up) | eq | down
            plus = down | (self.full & ~(diag | up))
            minus = up & diag
            if plus & last:
                score += 1
            elif minus & last:
                score -= 1
            plus = ((plus << 1) | 1) & self.full
            minus = (minus << 1) & self.full
            up = minus | (self.full & ~(diag | plus))
            down = plus & diag
        return score

    def matches(self, earlier: str) -> bool:
        total = len(earlier) + len(self.text)
        if self.measure == "levenshtein":
            longest = max(len(earlier), len(self.text), 1)
            return 1.0 - self.edits(earlier) / longest > self.threshold
        # Of a pair that is too short of common characters, it need not be known by how many.
        if total and 2.0 * min(len(earlier), len(self.text)) / total <= self.threshold:
            return False
        if not total or 2.0 * self.common(earlier, self.threshold * total / 2 - 1e-6) / total <= self.threshold:
            return not total and 1.0 > self.threshold
        if self.matcher is None:
            self.matcher = SequenceMatcher(None, "", self.text, self.autojunk)
        self.matcher.set_seq1(earlier)
        return self.matcher.ratio() > self.threshold


class Block:
    """Texts with what the bounds need: code points, lengths, and bags of characters and of
    neighbouring characters.

    A bag is folded into bins, and a bin's count kept as that many ones (up to a level, the rest
    counted apart), so the size of the common part of two bags is a number of common bits. Folding
    and cutting only raise it.
    """

    def __init__(self, texts: Sequence[str]):
        self.texts = list(texts)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        rows = self._rows()
        longest = int(self.lengths.max(initial=1))
        self.levels = 8 * int(np.clip(longest // 128 + 1, 1, 8))
        self.chars = self._counts(rows, self.codes % CHAR_BINS, CHAR_BINS)
        self._pairs: tuple[np.ndarray, np.ndarray] | None = None
        self._places: np.ndarray | None = None
        self._grams: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._packed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _counts(self, rows: np.ndarray, bins: np.ndarray, width: int) -> np.ndarray:
        n = len(self.texts)
        return np.bincount(rows * width + bins, minlength=n * width).reshape(n, width)

    def packed_chars(self, levels: int) -> tuple[np.ndarray, np.ndarray]:
        if levels not in self._packed:
            self._packed[levels] = packed(self.chars, levels)
        return self._packed[levels]

    def _rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.lengths)

    @property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Bags of neighbouring characters: bits, and what is above them."""
        if self._pairs is None:
            rows = self._rows()
            inside = rows[1:] == rows[:-1]
            pairs = (self.codes[:-1] * 31 + self.codes[1:]) % PAIR_BINS
            self._pairs = packed(self._counts(rows[:-1][inside], pairs[inside], PAIR_BINS), PAIR_LEVELS)
        return self._pairs

    @property
    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bags of runs of ``GRAM`` characters: numbers in ascending order and how often each occurs, of all
        rows, and where a row's begin."""
        if self._grams is None:
            runs = np.maximum(self.lengths - GRAM + 1, 0)
            at = spans(self.starts[:-1], runs)
            code = np.zeros(len(at), np.uint64)
            for n in range(GRAM):
                code = (code ^ self.codes[at + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            row = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
            named, counts = np.unique(row << np.uint64(GRAM_BITS) | code >> np.uint64(64 - GRAM_BITS), return_counts=True)
            starts = np.searchsorted(named >> np.uint64(GRAM_BITS), np.arange(len(runs) + 1, dtype=np.uint64))
            self._grams = named & np.uint64((1 << GRAM_BITS) - 1), counts, starts
        return self._grams

    @property
    def places(self) -> np.ndarray:
        """A number per character that occurs, by code point; that of all others is 0."""
        if self._places is None:
            seen = np.zeros(0x110000, bool)
            seen[self.codes] = True
            self._places = np.where(seen, np.cumsum(seen, dtype=np.int32), np.int32(0))
        return self._places


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start``, ``start + 1`` and so on, so many of each, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def packed(counts: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits as 64-bit words, what is above the levels)."""
    ones = counts[:, :, None] > np.arange(levels)
    bits = np.packbits(ones.reshape(len(counts), -1), axis=1)
    return bits.view(np.uint64), np.maximum(counts - levels, 0).sum(1).astype(np.int32)


def bound_pairs(
    early: Block, early_rows: np.ndarray, late: Block, late_rows: np.ndarray, measure: str, threshold: float, ordered: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (early row, late row) that may be similar, by late row: nothing similar is left out.

    Tried in turn: lengths, common characters, common neighbours, and last the longest common
    subsequence, or for Levenshtein the distance itself, so those pairs are final. ``ordered``: both
    blocks are one, and a row only meets rows before it.
    """
    levels = max(early.levels, late.levels)
    early_bits, early_rest = (x[early_rows] for x in early.packed_chars(levels))
    late_bits, late_rest = (x[late_rows] for x in late.packed_chars(levels))
    early_bits = np.ascontiguousarray(early_bits.T)
    early_sizes = early.lengths[early_rows].astype(np.int32)
    step = max(1, TEMPORARY // 8 // max(1, len(early_rows)))
    left, right = [], []
    for low in range(0, len(late_rows), step):
        rows = late_rows[low : low + step]
        sizes = late.lengths[rows][:, None].astype(np.int32)
        shared = np.minimum(late_rest[low : low + step, None], early_rest)
        words = late_bits[low : low + step]
        for w in range(words.shape[1]):
            shared += np.bitwise_count(words[:, w, None] & early_bits[w])
        shared = np.minimum(shared, np.minimum(sizes, early_sizes))
        able = _passes(shared, early_sizes, sizes, measure, threshold)
        if ordered:
            able &= early_rows < rows[:, None]
        j, i = np.nonzero(able)
        i, j = early_rows[i], rows[j]
        keep = _neighbours(early, i, late, j, measure, threshold)
        left.append(i[keep])
        right.append(j[keep])
    i = np.concatenate(left) if left else np.zeros(0, np.int64)
    j = np.concatenate(right) if right else np.zeros(0, np.int64)
    if measure == "levenshtein":
        keep = _grams(early, i, late, j, threshold)
        i, j = i[keep], j[keep]
    keep = _subsequences(early, i, late, j, measure, threshold)
    return i[keep], j[keep]


def _passes(shared: np.ndarray, a: np.ndarray, b: np.ndarray, measure: str, threshold: float) -> np.ndarray:
    """Whether so many common characters are enough."""
    if measure == "levenshtein":
        longest = np.maximum(np.maximum(a, b), 1)
        return 1.0 - (longest - shared) / longest > threshold
    return 2.0 * shared / np.maximum(a + b, 1) > threshold


def _neighbours(early: Block, i: np.ndarray, late: Block, j: np.ndarray, measure: str, threshold: float) -> np.ndarray:
    """A common subsequence that long leaves so many of its characters side by side in both texts."""
    a, b = early.lengths[i], late.lengths[j]
    if measure == "levenshtein":
        longest = np.maximum(a, b)
        need = longest - 1 - 2 * np.floor((1 - threshold) * longest + 1e-6)
    else:
        need = 3 * np.ceil(threshold * (a + b) / 2 - 1e-6) - a - b - 1
    keep = np.zeros(len(i), bool)
    if not len(i):
        return keep
    (early_bits, early_rest), (late_bits, late_rest) = early.pairs, late.pairs
    step = TEMPORARY // 8 // early_bits.shape[1]
    for low in range(0, len(i), step):
        x, y = i[low : low + step], j[low : low + step]
        shared = np.bitwise_count(early_bits[x] & late_bits[y]).sum(1, dtype=np.int64)
        keep[low : low + step] = shared + np.minimum(early_rest[x], late_rest[y]) >= need[low : low + step]
    return keep


def _grams(early: Block, i: np.ndarray, late: Block, j: np.ndarray, threshold: float) -> np.ndarray:
    """So few edits leave so many runs of ``GRAM`` characters of the longer text in both: an edit takes
    ``GRAM`` of them at most."""
    longest = np.maximum(early.lengths[i], late.lengths[j])
    need = longest - GRAM + 1 - GRAM * np.floor((1 - threshold) * longest + 1e-6)
    keep = (need <= 0) | ((longest <= SHORT) & (len(i) >= MANY))
    if keep.all():
        return keep
    (names, counts, starts), (others, held, begins) = early.grams, late.grams
    for n in np.flatnonzero(~keep).tolist():
        own, other = slice(starts[i[n]], starts[i[n] + 1]), slice(begins[j[n]], begins[j[n] + 1])
        if own.start < own.stop and other.start < other.stop:
            at = np.minimum(np.searchsorted(others[other], names[own]), other.stop - other.start - 1)
            same = others[other][at] == names[own]
            keep[n] = np.minimum(counts[own], held[other][at])[same].sum() >= need[n]
    return keep


def _subsequences(early: Block, i: np.ndarray, late: Block, j: np.ndarray, measure: str, threshold: float) -> np.ndarray:
    a, b = early.lengths[i], late.lengths[j]
    keep = np.zeros(len(i), bool)
    words = (b + 63) // 64
    many = (words <= SIDE_BY_SIDE[-1]) & (b > 0) & (a > 0)
    for less, width in zip((0, *SIDE_BY_SIDE), SIDE_BY_SIDE):
        at = np.flatnonzero(many & (words > less) & (words <= width))
        # A step costs as much as it does on a few dozen pairs, per word; where it is not worth it, pairs come one by one.
        if at.size < 8 + (16 if measure == "levenshtein" else 6) * width:
            many[at] = False
        else:
            least = None if measure == "levenshtein" else np.ceil(threshold * (a[at] + b[at]) / 2 - 1e-6).astype(np.int64)
            found = side_by_side(early, i[at], late, j[at], width, measure, least)
            if measure == "levenshtein":
                keep[at] = 1.0 - found / np.maximum(np.maximum(a[at], b[at]), 1) > threshold
            else:
                keep[at] = 2.0 * found / np.maximum(a[at] + b[at], 1) > threshold
    later: tuple[int, Later] | None = None
    for n in np.flatnonzero(~many):
        if later is None or later[0] != j[n]:
            later = (j[n], Later(late.texts[j[n]], measure, threshold))
        text = early.texts[i[n]]
        if measure == "levenshtein":
            keep[n] = later[1].matches(text)
        else:
            total = a[n] + b[n]
            least = threshold * total / 2 - 1e-6
            keep[n] = (2.0 * later[1].common(text, least) / total if total else 1.0) > threshold
    return keep


def side_by_side(
    early: Block, i: np.ndarray, late: Block, j: np.ndarray, width: int, measure: str, least: np.ndarray | None = None
) -> np.ndarray:
    """Longest common subsequence, or Levenshtein distance, of many pairs at once: each step of the
    bit-vector recurrences takes one character of every early text. Late texts have ``width`` words at most.

    Of pairs whose subsequence is shorter than ``least``, it may be given as shorter than it is.
    """
    out = np.zeros(len(i), np.int64)
    places = late.places
    count = int(places.max(initial=0)) + 1
    # Pairs come by late row; a chunk has as many late rows and characters as the arrays allow.
    names, first = np.unique(j, return_index=True)
    low = 0
    while low < len(names):
        sizes = late.lengths[names[low : low + max(1, TEMPORARY // 8 // count)]]
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes), TEMPORARY // 8 // width, "right")))
        rows, sizes = names[low:high], sizes[: high - low]
        # The characters of a row have a slot each; slot 0 is that of all others, and has no marks.
        spots = spans(late.starts[rows], sizes)
        keys = np.repeat(np.arange(len(rows)) * count, sizes) + places[late.codes[spots]]
        used = np.zeros(len(rows) * count, bool)
        used[keys] = True
        slots = np.where(used, np.cumsum(used, dtype=np.int32), np.int32(0))
        at = spots - np.repeat(late.starts[rows], sizes)
        table = np.zeros((width, int(used.sum()) + 1), np.uint64)
        # Each mark is there once, so their sum is all of them.
        np.add.at(table.reshape(-1), at // 64 * table.shape[1] + slots[keys], np.left_shift(np.uint64(1), (at % 64).astype(np.uint64)))
        end = first[high] if high < len(names) else len(j)
        span = np.arange(first[low], end)
        span = span[np.argsort(early.lengths[i[span]], kind="stable")]
        start = 0
        while start < len(span):
            reach = early.lengths[i[span[start : start + TEMPORARY // 64]]]
            able = reach * np.arange(1, len(reach) + 1) <= TEMPORARY // 8
            at = span[start : start + max(1, int(able.sum()))]
            start += len(at)
            sizes = early.lengths[i[at]]
            steps = np.arange(int(sizes.max()))[:, None]
            seen = places[early.codes[np.minimum(early.starts[i[at]] + steps, len(early.codes) - 1)]]
            seen = np.where((seen > 0) & (steps < sizes), slots[np.searchsorted(rows, j[at]) * count + seen], np.int32(0))
            if measure == "levenshtein":
                out[at] = _distances(table, seen, sizes, late.lengths[j[at]], width)
            else:
                out[at] = _common(table, seen, sizes, late.lengths[j[at]], width, None if least is None else least[at])
        low = high
    return out


def _common(table, seen, sizes, lengths, width: int, least: np.ndarray | None) -> np.ndarray:
    """What is as long as ``least`` leaves few characters of either text out, so its pairs of places stay
    near the diagonal: only those words are looked at, and a pair goes that has left out too many."""
    row, out, live = np.full((width, len(lengths)), ~np.uint64(0)), np.zeros(len(lengths), np.int64), np.arange(len(lengths))
    bounded = least is not None

    def so_far() -> np.ndarray:
        return sum(np.bitwise_count(~row[w] & _lowest(lengths - 64 * w)).astype(np.int64) for w in range(width))

    for step in range(len(seen)):
        if bounded and step % 64 == 0:
            if step:
                found = so_far()
                able = found + np.maximum(sizes - step, 0) >= least
                out[live] = found
                if not able.any():
                    return out
                if able.sum() < 0.8 * len(live):
                    row, seen, live = row[:, able], seen[:, able], live[able]
                    sizes, lengths, least = sizes[able], lengths[able], least[able]
            behind, ahead = (int(max(0, (x - least).max())) for x in (sizes, lengths))
        first, end = (max(0, (step - behind) // 64), min(width, (step + ahead) // 64 + 1)) if bounded else (0, width)
        slots, carry = seen[step], None
        for w in range(first, end):
            hit = row[w] & table[w].take(slots)
            total = row[w] + hit
            if w + 1 < end:
                over = total < hit
            if carry is not None:
                total += carry
                if w + 1 < end:
                    over |= total < carry
            if w + 1 < end:
                carry = over.astype(np.uint64)
            row[w] ^= hit
            row[w] |= total
    out[live] = so_far()
    return out


def _lowest(bits: np.ndarray) -> np.ndarray:
    """Words with so many low ones."""
    bits = np.clip(bits, 0, 64)
    ones = np.left_shift(np.uint64(1), np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1)
    return np.where(bits == 64, ~np.uint64(0), ones)


def _distances(table, seen, sizes, lengths, width: int) -> np.ndarray:
    one = np.uint64(1)
    up = [np.full(len(lengths), ~np.uint64(0)) for _ in range(width)]
    down = [np.zeros(len(lengths), np.uint64) for _ in range(width)]
    score = lengths.copy()
    last = ((lengths - 1) % 64).astype(np.uint64)
    final = (lengths - 1) // 64
    for step, slots in enumerate(seen):
        carry = np.zeros(len(lengths), np.uint64)
        plus_in, minus_in = np.full(len(lengths), one), np.zeros(len(lengths), np.uint64)
        for w in range(width):
            equal = table[w].take(slots)
            total = up[w] + (equal & up[w])
            over = total < up[w]
            total = total + carry
            over |= total < carry
            carry = over.astype(np.uint64)
            diagonal = (total ^ up[w]) | equal | down[w]
            plus = down[w] | ~(diagonal | up[w])
            minus = up[w] & diagonal
            here = (final == w) & (step < sizes)
            score += here & ((plus >> last) & one).astype(bool)
            score -= here & ((minus >> last) & one).astype(bool)
            plus, plus_in = (plus << one) | plus_in, plus >> np.uint64(63)
            minus, minus_in = (minus << one) | minus_in, minus >> np.uint64(63)
            up[w] = minus | ~(diagonal | plus)
            down[w] = plus & diagonal
    return score


class _Confirm:
    """The exact decision on a pair that passed the bounds."""

    def __init__(self, measure: str, threshold: float, autojunk: bool):
        self.measure, self.threshold, self.autojunk = measure, threshold, autojunk
        self.text: str | None = None

    def __call__(self, earlier: str, later: str) -> bool:
        if self.measure == "levenshtein":
            return True
        if not earlier and not later:
            return 1.0 > self.threshold
        if later != self.text:
            self.text = later
            self.matcher = SequenceMatcher(None, "", later, self.autojunk)
        self.matcher.set_seq1(earlier)
        return self.matcher.ratio() > self.threshold


def first_wins(texts: Sequence[str], measure: str, threshold: float, autojunk: bool = True, chunk: int = 256) -> list[int]:
    """Indices kept by the greedy rule: a text goes when an earlier kept one is similar.

    Rows are taken in chunks, against the rows kept so far and those of the chunk, so copies that are
    gone cost nothing.
    """
    if len(texts) == 1:
        return [0]
    block, confirm = Block(texts), _Confirm(measure, threshold, autojunk)
    kept = np.zeros(len(texts), bool)
    for low in range(0, len(texts), chunk):
        rows = np.arange(low, min(low + chunk, len(texts)))
        earlier = np.concatenate([np.flatnonzero(kept[:low]), rows])
        i, j = bound_pairs(block, earlier, block, rows, measure, threshold, ordered=True)
        kept[rows] = True
        for a, b in zip(i.tolist(), j.tolist()):  # by later row, so all before it are decided
            if kept[b] and kept[a] and confirm(texts[a], texts[b]):
                kept[b] = False
    return np.flatnonzero(kept).tolist()


def first_wins_of(pages: Sequence[Sequence[str]], measure: str, threshold: float, autojunk: bool = True) -> list[list[int]]:
    """:func:`first_wins` of each of many pages. Small ones are decided side by side, in groups of bounded
    size: a page of few rows has few pairs, and a step on a few costs as much as on many."""
    out: list[list[int]] = [[0] if len(p) == 1 else [] for p in pages]
    group, chars, pairs = [], 0, 0
    for n, texts in enumerate(pages):
        if len(texts) > TOGETHER:
            out[n] = first_wins(texts, measure, threshold, autojunk)
        elif len(texts) > 1:
            group.append(n)
            chars += sum(map(len, texts))
            pairs += len(texts) ** 2 // 2
            if chars >= GROUP_CHARS or pairs >= GROUP_PAIRS:
                _decide(pages, group, out, measure, threshold, autojunk)
                group, chars, pairs = [], 0, 0
    if group:
        _decide(pages, group, out, measure, threshold, autojunk)
    return out


def _decide(pages, group: list[int], out: list[list[int]], measure: str, threshold: float, autojunk: bool) -> None:
    sizes = np.array([len(pages[n]) for n in group])
    starts = np.cumsum(sizes) - sizes
    texts = [t for n in group for t in pages[n]]
    block, confirm = Block(texts), _Confirm(measure, threshold, autojunk)
    before = spans(np.zeros(len(sizes), int), sizes)
    i, j = spans(np.repeat(starts, sizes), before), np.repeat(np.arange(len(texts)), before)
    least = np.minimum(block.lengths[i], block.lengths[j])
    able = _passes(least, block.lengths[i], block.lengths[j], measure, threshold)
    i, j, chars = i[able], j[able], block.chars.astype(np.int32)
    able, step = np.zeros(len(i), bool), TEMPORARY // 8 // CHAR_BINS
    for low in range(0, len(i), step):
        x, y = i[low : low + step], j[low : low + step]
        shared = np.minimum(chars[x], chars[y]).sum(1, dtype=np.int64)
        able[low : low + step] = _passes(shared, block.lengths[x], block.lengths[y], measure, threshold)
    i, j = i[able], j[able]
    if measure == "levenshtein":
        able = _grams(block, i, block, j, threshold)
        i, j = i[able], j[able]
    able = _subsequences(block, i, block, j, measure, threshold)
    kept = np.ones(len(texts), bool)
    for a, b in zip(i[able].tolist(), j[able].tolist()):  # by later row, so all before it are decided
        if kept[b] and kept[a] and confirm(texts[a], texts[b]):
            kept[b] = False
    for n, start, size in zip(group, starts.tolist(), sizes.tolist()):
        out[n] = np.flatnonzero(kept[start : start + size]).tolist()


def any_similar(
    earlier: Sequence[str], later: Sequence[str], measure: str, threshold: float, autojunk: bool = True, chunk: int = 256
) -> list[int]:
    """Indices of the later texts that are similar to some earlier one."""
    early, late, confirm = Block(earlier), Block(later), _Confirm(measure, threshold, autojunk)
    gone = np.zeros(len(late.texts), bool)
    every = np.arange(len(early.texts))
    for low in range(0, len(gone), chunk):
        rows = np.arange(low, min(low + chunk, len(gone)))
        i, j = bound_pairs(early, every, late, rows, measure, threshold)
        for a, b in zip(i.tolist(), j.tolist()):
            if not gone[b] and confirm(early.texts[a], late.texts[b]):
                gone[b] = True
    return np.flatnonzero(gone).tolist()
