"""Byte-level BPE token ids as bytes; the vocabulary is read from a tokenizer's JSON file."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The pre-tokenizer that the fast encoder stands for, and its pattern.
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, all others as code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """``encode(text)``: little-endian unsigned 32-bit ids, as the tokenizer file with add_special_tokens=False gives.

    A fast encoder of the same merges takes the texts; the tokenizer itself takes those with which the fast one fails (it gives
    up on white space of some 100,000 characters on end), and all texts if the file asks for another kind of splitting."""

    _loaded: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        usual = model["type"] == "BPE" and not spec.get("normalizer") and all(split.get(k) == v for k, v in PLAIN.items())
        usual &= not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        usual &= not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.core = None
        if not usual:
            return
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = _byte_of()
        ranks = {bytes(back[ch] for ch in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.core = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _plain(self, text: str) -> bytes:
        return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        if self.core is not None:
            try:
                return self._fast(text)
            except ValueError:  # the pattern's stack is used up
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fast(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return b"".join(np.uint32(self.added[p]).astype("<u4").tobytes() if p in self.added else self._plain(p) for p in parts if p)
        return self._plain(text)
