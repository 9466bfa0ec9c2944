"""Word shingles as 64-bit hashes, for tasks that look at whole texts."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash

from depotlens.llm import kept

WORD = re.compile(r"\w+")
#: Words in a shingle, and words whose hash a Python worker remembers.
LENGTH, KEPT_WORDS = 5, 150_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def _forget() -> bool:
    held = bool(_hashes())
    _hashes.cache_clear()
    return held


kept.remembered("shingles", _forget)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of the input over the whole word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a text."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one shingle, a text without words none."""
    if not len(words):
        return words
    n = max(1, len(words) - LENGTH + 1)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        part = words[i:i + n]
        total[:len(part)] += part * factor
    return mixed(total)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """The shingles told apart by how often each occurred before: no value repeats."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    if not same.any():
        return shingles
    starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    occurrence = np.empty(len(same), np.uint64)
    occurrence[order] = (np.arange(len(same)) - starts).astype(np.uint64)
    return np.where(occurrence > 0, mixed(shingles + occurrence * np.uint64(0xE7037ED1A0B428DB)), shingles)
