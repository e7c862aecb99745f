"""Exact and fast ids of a word-level BPE tokenizer file, by a bounded cache of pre-tokens."""

from __future__ import annotations

import os
import re

import numpy as np

#: The pre-tokenizer's pattern for plain texts, where [^\W\d_] is a letter and \d the only number.
PRETOKEN = r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+"
#: Any other character sends a text through the tokenizer whole: these here are their own normal form, and their case doesn't hang on what stands beside them.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u012f\u0131-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac]")
_ALONE = "<|"  # may begin a special token


class WordTokenizer:
    """batch([text]) holds the ids that Tokenizer.encode(text, add_special_tokens=False) gives.

    Each pre-token is encoded once by the tokenizer itself and its ids are kept, up to
    `cache_size` pre-tokens (then the cache starts anew). Texts with characters whose
    normalisation isn't plain go through the tokenizer whole.
    """

    def __init__(self, path: str, cache_size: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.find = re.compile(PRETOKEN).findall
        self.cache_size = cache_size
        self.cache: dict[str, bytes] = {}
        # pre-tokens need neither the normaliser nor the pattern
        self.model = Tokenizer(self.full.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn(self, new: list[str]) -> None:
        ids = self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids
        flat = np.asarray(ids, dtype="<u4")
        stops = (4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()
        if len(stops) != len(new):
            raise ValueError("the tokenizer does not mark word ends")
        raw = flat.tobytes()
        self.cache.update(zip(new, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit numbers."""
        found: list[list[str] | None] = []
        new: set[str] = set()
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        for t in texts:
            if not _ODD.search(t) and _ALONE not in t:
                ws = self.find(t.lower())
                found.append(ws)
                new.update(set(ws).difference(cache))
            else:
                found.append(None)
        if new:
            self._learn(list(new))
        return [np.asarray(self.full.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if ws is None else b"".join(map(cache.__getitem__, ws)) for t, ws in zip(texts, found, strict=True)]


_KEPT: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per process and file."""
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]
