"""Plain versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def repeats(texts: list[str | None], window: int = 400) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    raws = [(t or "").encode() for t in texts]
    places: dict[bytes, list[tuple[int, int]]] = {}
    for d, raw in enumerate(raws):
        for i in range(len(raw) - window + 1):
            places.setdefault(raw[i:i + window], []).append((d, i))
    gone = [bytearray(len(raw)) for raw in raws]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i:i + window] = b"\x01" * window
    out = []
    for raw, mask in zip(raws, gone):
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        spans = len(re.findall(rb"\x01+", bytes(mask)))
        out.append((len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None) -> Counter:
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def edit_similarity(a: list[str], b: list[str]) -> float:
    """One less the edit distance in words over the longer text, by the full table."""
    names = {w: i for i, w in enumerate({*a, *b})}
    other, at = np.array([names[w] for w in b]), np.arange(len(b) + 1)
    row = at.copy()
    for i, word in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (other != names[word]))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - at) + at
    return 1 - row[-1] / max(len(a), len(b))


def classes(texts: dict[int, str | None], least: float = 0.8) -> dict[int, int]:
    """Smallest id of each document's class by comparing all pairs."""
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts.items()}
    bags = {i: Counter(w) for i, w in words.items()}
    label = {i: i for i in texts}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    def alike(a: int, b: int) -> bool:
        longer = max(len(words[a]), len(words[b]))
        if texts[a] == texts[b]:
            return True
        if not longer or min(len(words[a]), len(words[b])) < least * longer or sum((bags[a] & bags[b]).values()) < least * longer:
            return False
        return edit_similarity(words[a], words[b]) >= least - 1e-9

    ids = sorted(i for i, t in texts.items() if t is not None)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if root(a) != root(b) and alike(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in texts}


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), share=1.5, cap=2.0) -> dict[str | None, float]:
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= cap * sizes[s]]
        if not full:
            out.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def base_places(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and start and label of every base phrase."""
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for phrase, label in phrases.items():
        wanted = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(wanted)] == wanted]
    return len(words), found


def leaks(texts: dict[int, str | None], items: dict[int, str], least: float = 0.8) -> set[tuple[int, int]]:
    """Pairs whose item is found by comparing every window of the item's length."""
    out = set()
    for i, text in texts.items():
        words = re.findall(r"\w+", (text or "").lower())
        grams = [tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        own = set(grams)
        for j, item in items.items():
            wanted = shingles(item)
            n = sum(wanted.values())
            if not n or len(own & set(wanted)) < least * len(wanted):
                continue
            if any(jaccard(Counter(grams[k:k + n]), wanted) >= least for k in range(max(1, len(grams) - n + 1))):
                out.add((i, j))
    return out
