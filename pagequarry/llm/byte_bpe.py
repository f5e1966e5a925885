"""Ids of a byte-level BPE tokenizer file, with a table of words met before."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

from pagequarry.llm.sp_model import Memo

# The usual alphabet in which byte-level vocabularies spell their bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _SHOWN} | {
    chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(_SHOWN))
}
# The splitting rule of such tokenizers, spelled out for code points below U+0250, where what is a
# letter, a digit or a blank is settled; other texts go to the tokenizer library.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
).findall
PLAIN = re.compile("[\x00-ɏ]*").fullmatch


class ByteBpe:
    """Encodes as the tokenizers library does with the same file, without special tokens added."""

    def __init__(self, content: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.slow = Tokenizer.from_str(content.decode())
        self.marks = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.known_rule = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
        )
        added = set(self.marks)
        ranks = {bytes(BYTE_OF[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        self.kind = np.dtype("<u2") if max(spec["model"]["vocab"].values()) < 1 << 16 else np.dtype("<u4")
        self.fast = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.words = Memo(self._word, most=300_000)

    def _word(self, word: str) -> bytes:
        return np.array(self.fast.encode_ordinary(word), self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as a packed array of ``kind``."""
        if not text:
            return b""
        if self.known_rule and PLAIN(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.words.__getitem__, WORDS(text)))
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def load(content: bytes, cache: dict) -> ByteBpe:
    name = hashlib.sha256(content).hexdigest()
    if name not in cache:
        cache[name] = ByteBpe(content)
    return cache[name]
