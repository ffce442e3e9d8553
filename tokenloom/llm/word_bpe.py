"""The rules of a word-level BPE vocabulary file: which words a text has, and which pairs merge.

The file's own settings are read and checked; texts are split by this module, not by the library:
composed form, runs of white space as one space, lower case, then contractions, letter runs, single
digits and symbol runs. Special strings are cut out of the raw text first and stand for themselves.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

# The settings this module implements, as the file states them.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same words of lower-case ASCII text, whose letters, digits and white space can be listed.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
END = "</w>"

DEFAULT_FILE = "word_bpe_49k.json"


def default_path() -> str:
    """Where the public vocabulary file lies on this machine. Every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def byte_letters() -> list[str]:
    """The printable letter of each byte, by the public rule of byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class Rules:
    """Vocabulary, merges and splitting of one file. Built once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        plain = not (spec["post_processor"] or spec["decoder"] or model["byte_fallback"])
        if kinds != NORMALIZER or split != PATTERN or model["end_of_word_suffix"] != END or not plain:
            raise ValueError(f"{path}: a vocabulary file of another kind")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: special strings with settings of their own")
        vocab = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + END] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # token of each rank
        self.keys = left << 32 | right
        self.merges = {int(k): r for r, k in reversed(list(enumerate(self.keys.tolist())))}
        order = np.argsort(self.keys, kind="stable")
        self.sorted_keys, self.sorted_ranks = self.keys[order], order.astype(np.int64)
        # Ranks whose token takes part in a pair of a lower rank: one word's places must then be
        # merged one at a time, because the lower pair comes first as soon as it appears.
        first_use = np.full(len(self.tokens), len(pairs), np.int64)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        self.careful = first_use[self.made] < np.arange(len(pairs))
        self._split_plain = re.compile(PLAIN_PATTERN)
        self._split = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}"))
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._marks = regex.compile(f"({marks})") if marks else None
        self.white = regex.compile(r"\p{White_Space}+")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where the pair never merges."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.sorted_ranks[at], -1)

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no word-final form
        return text.lower()

    def _split_normal(self, text: str) -> list[str]:
        split = self._split_plain if text.isascii() else self._split
        return split.findall(self.normal(text))

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special string is a word that no other word equals."""
        if self._marks is None or "<|" not in text:
            return self._split_normal(text)
        out = []
        for i, part in enumerate(self._marks.split(text)):
            if i % 2:
                out.append("\0" + part)  # a NUL is a word of its own kind, never before a letter
            elif part:
                out.extend(self._split_normal(part))
        return out


@lru_cache(maxsize=4)
def rules(path: str) -> Rules:
    return Rules(path)
