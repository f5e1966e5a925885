"""A SentencePiece BPE model as plain tables: character map, pieces, and the units that no merge
leaves."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
NONE = float("-inf")


def read_char_map(blob: bytes) -> dict[str, str]:
    """All entries of a compiled character map: a double-array trie over UTF-8 keys whose leaves
    point at zero-ended replacements."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
    texts = blob[4 + size :]

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    found, labels = {}, np.arange(1, 256)
    waiting = [(0, b"")]
    while waiting:
        node, key = waiting.pop()
        children = node ^ offset(int(units[node])) ^ labels
        inside = children < len(units)
        hits = labels[inside][(units[children[inside]] & 0x800000FF) == labels[inside]]
        for label in hits.tolist():
            child = node ^ offset(int(units[node])) ^ label
            unit, name = int(units[child]), key + bytes([label])
            if unit >> 8 & 1:
                start = int(units[child ^ offset(unit)]) & 0x7FFFFFFF
                found[name.decode()] = texts[start : texts.index(b"\0", start)].decode()
            waiting.append((child, name))
    return found


class Normaliser:
    """Longest-prefix replacement by a character map, then the model's rules for spaces.

    Keeps for every code point of the result the byte of the original text where its source begins.
    """

    def __init__(self, char_map: dict[str, str], dummy_prefix: bool, squeeze: bool, escape: bool):
        self.char_map, self.dummy_prefix, self.squeeze = char_map, dummy_prefix, squeeze
        self.space = SPACE if escape else " "
        self.longest = max(map(len, char_map), default=0)
        firsts = "".join(sorted({re.escape(k[0]) for k in char_map}))
        self.touched = re.compile(f"[{firsts}]") if firsts else None

    def plain(self, text: str) -> bool:
        """Whether only the spaces change: then every code point maps to itself."""
        return not self.squeeze and (self.touched is None or not self.touched.search(text))

    def text(self, text: str) -> str:
        if not text:
            return ""
        if self.plain(text):
            return (self.space if self.dummy_prefix else "") + text.replace(" ", self.space)
        return self.aligned(text)[0]

    def sources(self, text: str) -> list[tuple[str, int]]:
        """(replacement, byte where the replaced prefix begins), longest prefix first."""
        out, at, byte = [], 0, 0
        while at < len(text):
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (new := self.char_map.get(text[at : at + n])) is not None:
                    break
            else:
                n, new = 1, text[at]
            out.append((new, byte))
            byte += len(text[at : at + n].encode("utf-8", "surrogatepass"))
            at += n
        return out

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the original byte offset of each of its code points and of its end."""
        total = len(text.encode("utf-8", "surrogatepass"))
        if not text:
            return "", np.zeros(1, np.int64)
        if self.plain(text):
            lead = 1 if self.dummy_prefix else 0
            starts = np.zeros(len(text) + 1 + lead, np.int64)
            if total == len(text):
                starts[lead:] = np.arange(total + 1)
            else:
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
                starts[lead + 1 :] = np.cumsum(widths)
            return (self.space if lead else "") + text.replace(" ", self.space), starts
        chars, starts, lead, end = [], [], True, total
        parts = self.sources(text)
        if self.squeeze:
            while parts and parts[0][0] == " ":
                parts.pop(0)
            while parts and parts[-1][0] == " ":
                end = parts.pop()[1]
        if not parts:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            chars.append(self.space)
            starts.append(parts[0][1])
        lead = self.squeeze
        for new, byte in parts:
            if lead:
                new = new.lstrip(" ")
            for c in new:
                chars.append(self.space if c == " " else c)
                starts.append(byte)
            if new:
                lead = self.squeeze and new.endswith(" ")
        while self.squeeze and chars and chars[-1] == self.space:
            chars.pop()
            end = starts.pop()
        return "".join(chars), np.array([*starts, end], np.int64)


class Memo(dict):
    """Values by unit, made on first sight. Beyond ``most`` entries, or for long units, a value is
    made anew each time, so the table stays bounded."""

    def __init__(self, make: Callable, most: int = 500_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, unit):
        value = self.make(unit)
        if len(self) < self.most and len(unit) <= self.longest:
            self[unit] = value
        return value


class PieceModel:
    """The tables of a model file, compiled.

    A *unit* is a longest run of characters that merges might join: it ends where a space mark
    follows another character (if no piece holds one inside) and at characters that occur in no
    longer piece. Where units end depends on the two characters there alone, and no merge crosses
    such a place, so a text's encoding is that of its units, one after the other.
    """

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(content)
        trained, rules = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if trained.model_type != BPE or not trained.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without user-defined pieces are compiled")
        if trained.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("suffix spaces and denormalisers are not compiled")
        self.normaliser = Normaliser(
            read_char_map(rules.precompiled_charsmap),
            rules.add_dummy_prefix,
            rules.remove_extra_whitespaces,
            rules.escape_whitespaces,
        )
        if max(len(p.piece) for p in model.pieces) > 255:
            raise ValueError("pieces of over 255 characters are not compiled")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.surface = [p.piece.replace(SPACE, " ") for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == CONTROL:
                self.surface[i] = ""
            elif p.type == UNKNOWN:
                self.surface[i] = trained.unk_surface
        for value, i in self.bytes.items():
            self.surface[i] = chr(value) if value < 128 else ""
        self.wide_bytes = {i: value for value, i in self.bytes.items() if value >= 128}
        long = [p for p in self.ids if len(p) > 1]
        joined = set("".join(long))
        inside = any(SPACE in p.lstrip(SPACE) for p in long)
        others = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        mark = f"{SPACE}+[{others}]*|[{others}]+|." if not inside else f"[{SPACE}{others}]+|."
        self.units = re.compile(mark, re.S).findall
        self.starts_space = self.normaliser.dummy_prefix or self.normaliser.squeeze

    def merge(self, unit: str) -> list[str]:
        """Merge the adjacent pair of best score, the leftmost of equals, until none is a piece."""
        parts, score = list(unit), self.scores.get
        if len(parts) > 64:
            return self._merge_long(parts)
        found = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while found and (best := max(found)) != NONE:
            at = found.index(best)
            joined = parts[at] + parts.pop(at + 1)
            parts[at] = joined
            del found[at]
            if at < len(found):
                found[at] = score(joined + parts[at + 1], NONE)
            if at:
                found[at - 1] = score(parts[at - 1] + joined, NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a queue, for units of any length."""
        import heapq

        scores, n = self.scores, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n:
                pair = parts[i] + parts[j]
                if (score := scores.get(pair)) is not None:
                    heapq.heappush(queue, (-score, i, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def encode_unit(self, unit: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Ids, and the code points that each takes up (a character in bytes belongs to its last byte)."""
        parts = self.merge(unit)
        ids = list(map(self.ids.get, parts))
        if None not in ids:
            return tuple(ids), tuple(map(len, parts))
        ids, widths = [], []
        for piece in parts:
            if (number := self.ids.get(piece)) is not None:
                ids.append(number)
                widths.append(len(piece))
            else:
                raw = piece.encode("utf-8", "surrogatepass")
                ids.extend(self.bytes[b] for b in raw)
                widths.extend([0] * (len(raw) - 1) + [len(piece)])
        return tuple(ids), tuple(widths)

    def count_unit(self, unit: str) -> int:
        return sum(
            1 if p in self.ids else len(p.encode("utf-8", "surrogatepass")) for p in self.merge(unit)
        )

    def decode(self, ids: list[int]) -> str:
        """Pieces side by side; bytes of a run read as UTF-8, one replacement mark per wrong byte."""
        text = "".join(map(self.surface.__getitem__, ids)) if self.wide_bytes.keys().isdisjoint(ids) else self._wide(ids)
        # Only a first piece that begins with the space mark loses it.
        if self.starts_space and ids and self.surface[ids[0]].startswith(" ") and ids[0] not in self._byte_ids:
            return text[1:]
        return text

    @property
    def _byte_ids(self) -> set[int]:
        known = self.__dict__.get("_known_bytes")
        if known is None:
            known = self.__dict__["_known_bytes"] = set(self.bytes.values())
        return known

    def _wide(self, ids: list[int]) -> str:
        value_of = {i: v for v, i in self.bytes.items()}
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in value_of:
                run.append(value_of[i])
                continue
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as error:
                    out.append(run[: error.start].decode() + "�")
                    del run[: error.start + 1]
            if i >= 0:
                out.append(self.surface[i])
        return "".join(out)


def load(content: bytes, cache: dict) -> PieceModel:
    """The compiled model, once per worker process."""
    name = hashlib.sha256(content).hexdigest()
    if name not in cache:
        cache[name] = PieceModel(content)
    return cache[name]
