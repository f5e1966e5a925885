"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in one pass: at-signs, schemes, cues of identifiers, and
the digits and plus signs that numbers begin with. At each anchor a deterministic local parser
expands to the left and right as far as its form goes, and validates what it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagequarry.llm.common import map_batches, slices, worker_cache

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+")
_ADDRESS = re.compile(r"[A-Za-z0-9][A-Za-z0-9./?=&%_#:+~-]*")
# What may stand between a cue and its number: signs, or signs, a word and signs.
_LEAD = re.compile(r"[\x20:#.]{1,3}(?:(?i:number|no)[\x20:#.]{1,4})?")
_NUMBER = re.compile(r"[A-Z0-9]*[0-9][A-Z0-9]*")
_IBAN = re.compile(r"[A-Z]{2}\x20?[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[a-z]{2}\x20?[0-9]{2}(?:\x20?[a-z0-9]){11,30}")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark, kind in (
        [("@", "email"), ("+", "phone")]
        + [(str(d), "digit") for d in range(10)]
        + [(s, "url") for s in SCHEMES]
        + [(c, "account") for c in CUES]
    ):
        found.add_word(mark, (kind, len(mark)))
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """The text with its ASCII letters in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def iban_end(text: str, at: int) -> int:
    """Where an international account number that begins at ``at`` ends, 0 if none does. Single
    blanks may split it; of several ends that pass the check digits the last one counts."""
    run = _IBAN.match(text, at)
    end = run.end() if run else -1
    while end > at:
        number = text[at:end].replace(" ", "")
        if len(number) < 15:
            break
        if text[end : end + 1] not in _WORD and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1:
            return end
        end = text.rfind(" ", at, end)
    return 0


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


class Finder:
    """Finds spans (kind number, start, end) in a text; per kind leftmost and without overlap."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        # Where the next match of a kind may begin; an attempt that fails validation uses up its text.
        free = {"email": 0, "ip": 0, "card": 0, "phone": 0, "url": 0, "account": 0}
        for last, (anchor, width) in self.anchors.iter(folded(text)):
            at = last - width + 1
            if anchor == "digit":
                if at >= free["ip"]:
                    self._ip(text, at, free, found)
                if at >= free["card"]:
                    self._card(text, at, free, found)
            elif anchor == "email":
                start = at
                while start > free["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (domain := _DOMAIN.match(text, at + 1)):
                    found.append((0, start, domain.end()))
                    free["email"] = domain.end()
            elif anchor == "phone":
                self._phone(text, at, free, found)
            elif anchor == "url":
                if at >= free["url"] and (rest := _ADDRESS.match(text, last + 1)):
                    found.append((4, at, rest.end()))
                    free["url"] = rest.end()
            elif at >= free["account"]:
                self._account(text, at, last + 1, free, found)
        return sorted(found)

    def _ip(self, text: str, at: int, free: dict, found: list) -> None:
        """A chain of dotted numbers falls into groups of four, from the left."""
        chain = _DOTTED.match(text, at)
        free["ip"] = chain.end()
        parts, start = chain[0].split("."), at
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            # Whole numbers of any length are compared without making an integer of them.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((1, start, end))
            start = end + 1

    def _card(self, text: str, at: int, free: dict, found: list) -> None:
        chain = _GROUPED.match(text, at)
        free["card"] = chain.end()
        digits = chain[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, at, chain.end()))

    def _phone(self, text: str, at: int, free: dict, found: list) -> None:
        run = _DIALLED.match(text, at)
        if not run:
            return
        number = run[0].rstrip(" ().-")
        if len(number) < 4:  # a plus, a digit, at least one more character and a last digit
            return
        free["phone"] = at + len(number)
        if 9 <= sum(map(number.count, "0123456789")) <= 15:
            found.append((3, at, at + len(number)))

    def _account(self, text: str, at: int, after: int, free: dict, found: list) -> None:
        """A cue, what leads over, and an international number with its check or one unbroken number."""
        lead = _LEAD.match(text, after)
        if not lead:
            return
        if end := iban_end(text, lead.end()):
            free["account"] = end
            found.append((5, at, end))
        elif number := _NUMBER.match(text, lead.end()):
            free["account"] = number.end()
            if 6 <= len(number[0]) <= 34:
                found.append((5, at, number.end()))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = worker_cache("pii")
    finder = cache.get("finder") or cache.setdefault("finder", Finder())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in slices(batches, "text"):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = [finder.spans(t) for t in texts]
        listed = pa.array(
            [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans] for spans in found], pa.list_(span)
        )
        yield pa.RecordBatch.from_arrays([batch.column("id"), listed], ["doc_id", "spans"])


def find(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every span of personal data: doc_id, spans (array of kind, start, end; by kind, then start).

    Kinds are those of ``KINDS``; offsets are code points, end exclusive. One row per input row, no
    shuffle; null counts as empty, a text without any has an empty array, repeated rows get their
    result each, other columns are ignored. Memory is bounded by the longest text.
    """
    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))])
    return map_batches(docs.selectExpr(f"`{id_col}` AS id", f"`{text}` AS text"), _run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; where spans overlap, their union is one."""
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the same columns and rows, personal data in ``text`` replaced by its kind; a
    null text stays null."""
    if text not in docs.columns:
        raise ValueError(f"no column {text}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("pii")
        finder = cache.get("finder") or cache.setdefault("finder", Finder())
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            new = [t and (masked(t, s) if (s := finder.spans(t)) else t) for t in batch.column(at).to_pylist()]
            columns = [batch.column(i) if i != at else pa.array(new, batch.schema.field(at).type) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, run, docs.schema)
