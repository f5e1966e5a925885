"""Names in tokenised text: a trie of tokens, walked once, with offsets from running sums.

Small helpers for Arrow-batched UDFs. A text comes with its tokens, as the expressions of the operator
cut it, or as tokens and the gaps around them (one gap more than tokens).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np

BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def trie(names: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dictionaries by token; under None the names that end there, with their labels."""
    root: dict = {}
    for key, name, label in names:
        node = root
        for token in key.split(" "):
            node = node.setdefault(token, {})
        node.setdefault(None, {})[name] = label
    return root


def places(words: Sequence[str], gaps: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each token starts and ends, from 0."""
    sizes = np.array([len(w) for w in words], np.int64)
    spaces = np.array([len(g) for g in gaps], np.int64)
    ends = np.cumsum(sizes) + np.cumsum(spaces[: len(sizes)])
    return ends - sizes, ends


def spelled(words: Sequence[str], gaps: Sequence[str], i: int, n: int) -> str:
    """How the text writes ``n`` tokens from the i-th on, blanks as one space."""
    if n == 1:
        return words[i]
    pieces = [words[i]]
    for j in range(i + 1, i + n):
        pieces += [gaps[j], words[j]]
    return BLANKS.sub(" ", "".join(pieces))


def gaps_of(words: Sequence[str], text: str) -> list[str]:
    """The gaps around the tokens of a text. They hold no sign of a token, so the next place that reads like
    a token is where it stands."""
    out, end = [], 0
    for word in words:
        at = text.index(word, end)
        out.append(text[end:at])
        end = at + len(word)
    out.append(text[end:])
    return out


def hits(words: Sequence[str], text: str, starts: Sequence[bool] | None, patterns: Sequence[dict], root: dict) -> list[dict]:
    """Names at their places, none inside a longer one, and pattern matches."""
    found: list[tuple[int, int, str, str]] = []
    words = words.tolist() if isinstance(words, np.ndarray) else words
    gaps: list[str] | None = None
    if root.keys().isdisjoint(words):
        return pattern_hits(patterns)
    for i, word in enumerate(words):
        node = root.get(word)
        if node is None or (starts is not None and not starts[i]):
            continue
        gaps = gaps_of(words, text) if gaps is None else gaps
        n, own = 1, []
        while node is not None:
            ended = node.get(None)
            if ended is not None:
                name = spelled(words, gaps, i, n)
                if name in ended:
                    own.append((i, n, name, ended[name]))
            node = node.get(words[i + n]) if i + n < len(words) else None
            n += 1
        found += reversed(own)  # the longer first
    out = pattern_hits(patterns)
    if found:
        at, _ = places(words, gaps)
        end = 0
        for i, n, name, label in found:
            if i + n > end:
                end = i + n
                out.append({"name": name, "label": label, "at": int(at[i]) + 1})
    return out


def spellings(words: Sequence[str], gaps: Sequence[str], starts: Sequence[bool] | None, sizes: Sequence[int]) -> list[dict]:
    """Every run of tokens that has a size, as it is written."""
    at, _ = places(words, gaps)
    return [
        {"i": i, "n": n, "at": int(at[i]) + 1, "spelled": spelled(words, gaps, i, n)}
        for i in range(len(words))
        if starts is None or starts[i]
        for n in sizes
        if i + n <= len(words)
    ]


def pattern_hits(patterns: Sequence[dict]) -> list[dict]:
    """Matches with their places, from the pieces between them."""
    out = []
    for one in patterns:
        if len(one["found"]):
            at, _ = places(one["found"], one["between"])
            out += [{"name": m, "label": one["label"], "at": int(p) + 1} for m, p in zip(one["found"], at)]
    return out
