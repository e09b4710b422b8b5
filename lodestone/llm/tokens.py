"""Tokens of a public tokenizer: counts and offsets. The path of the vocabulary is a parameter.

The vocabulary is a file of base64 tokens with ranks. Text is cut by PATTERN before merging. Its last two
alternatives need a look ahead, which makes the scan slow; counts therefore use a pattern without it and are put
right for runs of white space, where alone the two differ.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import tiktoken

#: Fixed value: the pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_RUNS = re.compile(r"\s{3,}|\s{2,}\Z")
_made: dict[str, "Tokenizer"] = {}


class Tokenizer:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = tiktoken.Encoding("exact", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._fast = tiktoken.Encoding("fast", pat_str=PATTERN.replace(r"\s+(?!\S)|\s+", r"\s"), mergeable_ranks=ranks, special_tokens={})
        self._length = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, r in ranks.items():
            self._length[r] = len(b)
        self._more: dict[str, int] = {}

    def count(self, text: str) -> int:
        n = len(self._fast.encode_ordinary(text))
        for run in _RUNS.findall(text):
            n += self._difference(run if text.endswith(run) else run[:-1])
        return n

    def _difference(self, run: str) -> int:
        d = self._more.get(run)
        if d is None:
            d = self._more[run] = len(self.exact.encode_ordinary(run)) - sum(len(self.exact.encode_ordinary(c)) for c in run)
        return d

    def ends(self, text: str) -> np.ndarray:
        """For each token the byte where it ends."""
        return np.cumsum(self._length[self.exact.encode_ordinary(text)])


def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One for each Python worker and path."""
    if path not in _made:
        _made[path] = Tokenizer(path)
    return _made[path]
