"""Benchmark decontamination by SimHash windows.

A benchmark item and the documents are sequences of five-word shingles.  Windows of some ladder lengths
get a 64-bit SimHash: the longest length that fits the item, and a short one that fits between the edits
an item can have at a similarity of 0.8.  Windows start at content-chosen places, the minima of small
neighbourhoods of shingle hashes, which a passage keeps wherever it is copied.  The fingerprints of the
items are indexed by four 16-bit blocks: within the radius, one block at least differs by no more than the
radius over four, so looking up every such neighbour of every block finds all fingerprints within the
radius.  Each candidate is then aligned with its item, and the weighted Jaccard similarity of their
shingles, counts as weights, is computed exactly.

Documents are searched where they lie; only the benchmark moves, in blocks of bounded size, with one pass
over the documents for each block.

Defined cases: null texts and texts without words contain nothing; an item without words is in no
document; items or documents of fewer than five words are one shingle; repeated rows are searched
separately; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm import kept
from depotlens.llm.shingles import LENGTH, shingle_hashes, word_hashes

SIMILARITY = 0.8
#: Items, and bytes of their texts, that one pass over the documents takes along.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 8 << 20
#: Shingles that are fingerprinted together.
PIECE = 65_536
BLOCKS, BITS = 4, 16


def neighbourhood(length: int) -> int:
    """Shingles among which a window of ``length`` shingles chooses its start."""
    return max(1, length // 4)


def radius(length: int) -> int:
    """Bits by which fingerprints of windows of ``length`` shingles may differ."""
    return 7 if length >= 16 else 3


def window_lengths(n: int) -> list[int]:
    """Lengths of the windows of an item of ``n`` shingles.

    With at least 0.8 of all shingles shared, an edit spoils four shingles or more, so some run of
    0.8 n / (0.05 n + 1) shingles is untouched; the short length fits into it with its neighbourhood.
    """
    def fits(run: float) -> int:
        length = 1
        while 2 * length + neighbourhood(2 * length) - 1 <= run:
            length *= 2
        return length

    return sorted({fits(n), fits(0.8 * n / (0.05 * n + 1))})


def starts(shingles: np.ndarray, length: int) -> np.ndarray:
    """Whether a window starts at each shingle: it is the least of some neighbourhood."""
    wide = neighbourhood(length)
    if wide == 1:
        return np.ones(len(shingles), bool)
    n = len(shingles) - wide + 1
    out = np.zeros(len(shingles), bool)
    if n < 1:
        return out
    least = shingles[:n].copy()
    for i in range(1, wide):
        np.minimum(least, shingles[i:i + n], out=least)
    for i in range(wide):
        out[i:i + n] |= shingles[i:i + n] == least
    return out


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    """Running counts of every bit; differences stay right when the counts wrap around."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(shingles) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows of ``length`` shingles that start at ``at``."""
    ones = sums[at + length] - sums[at]
    return np.packbits(2 * ones > length, axis=1).view(np.uint64).ravel()


class BlockIndex:
    """Item fingerprints by the value of each block, with its neighbours within the block's radius."""

    def __init__(self, prints: np.ndarray, within: int) -> None:
        self.prints, self.within = prints, within
        flips = [0] + ([1 << b for b in range(BITS)] if within // BLOCKS else [])
        self.tables = []
        for k in range(BLOCKS):
            block = ((prints >> np.uint64(BITS * k)) & np.uint64(0xFFFF)).astype(np.int64)
            values = (block[:, None] ^ np.array(flips)[None, :]).ravel()
            owners = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(values, kind="stable")
            counts = np.bincount(values, minlength=1 << BITS)
            self.tables.append((counts, np.concatenate([[0], np.cumsum(counts)]), owners[order]))

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a window and an item fingerprint that differ by ``within`` bits at most."""
        found_w, found_p = [], []
        for k, (counts, begins, owners) in enumerate(self.tables):
            block = ((windows >> np.uint64(BITS * k)) & np.uint64(0xFFFF)).astype(np.int64)
            number = counts[block]
            hit = np.flatnonzero(number)
            if not len(hit):
                continue
            number = number[hit]
            w = np.repeat(hit, number)
            inside = np.arange(len(w)) - np.repeat(np.cumsum(number) - number, number)
            p = owners[np.repeat(begins[block[hit]], number) + inside]
            near = np.bitwise_count(windows[w] ^ self.prints[p]) <= self.within
            found_w.append(w[near])
            found_p.append(p[near])
        if not found_w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_w), np.concatenate(found_p)


@dataclass(frozen=True)
class Leak:
    item: int
    similarity: float
    first: int
    length: int


class Searcher:
    """Finds items in documents; built in every task from the texts of a block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.items = [shingle_hashes(word_hashes(text)) for _, text in items]
        self.counted = [np.unique(item, return_counts=True) for item in self.items]
        prints: dict[int, list[np.ndarray]] = {}
        places: dict[int, list[tuple[np.ndarray, int]]] = {}
        for number, item in enumerate(self.items):
            if not len(item):
                continue
            sums = bit_sums(item)
            for length in window_lengths(len(item)):
                at = np.flatnonzero(starts(item, length)[:len(item) - length + 1])
                prints.setdefault(length, []).append(fingerprints(sums, at, length))
                places.setdefault(length, []).append((at, number))
        self.indexes = {}
        for length, parts in prints.items():
            at = np.concatenate([a for a, _ in places[length]])
            owner = np.concatenate([np.full(len(a), number) for a, number in places[length]])
            self.indexes[length] = (BlockIndex(np.concatenate(parts), radius(length)), at, owner)
        self.longest = max(self.indexes, default=1)

    def candidates(self, flat: np.ndarray, document: np.ndarray) -> set[tuple[int, int, int]]:
        """Document, item, and the place in ``flat`` where the item would begin."""
        found: set[tuple[int, int, int]] = set()
        masks = {length: starts(flat, length) for length in self.indexes}
        for begin in range(0, len(flat), PIECE):
            piece = flat[begin:begin + PIECE + self.longest]
            sums = bit_sums(piece)
            for length, (index, item_at, owner) in self.indexes.items():
                last = min(PIECE, len(piece) - length + 1)
                at = np.flatnonzero(masks[length][begin:begin + max(last, 0)])
                at = at[document[begin + at] == document[begin + at + length - 1]]
                if not len(at):
                    continue
                w, p = index.search(fingerprints(sums, at, length))
                where = begin + at[w]
                found.update(zip(document[where].tolist(), owner[p].tolist(), (where - item_at[p]).tolist()))
        return found

    def _weighed(self, values: np.ndarray, number: int) -> float:
        """Weighted Jaccard similarity of some shingles and an item."""
        known, counts = self.counted[number]
        own, own_counts = np.unique(values, return_counts=True)
        _, i, j = np.intersect1d(known, own, assume_unique=True, return_indices=True)
        shared = np.minimum(counts[i], own_counts[j]).sum()
        return float(shared / (len(values) + len(self.items[number]) - shared))

    def verified(self, shingles: np.ndarray, number: int, at: int) -> tuple[float, int, int]:
        """Best similarity near ``at`` with the first shingle and the number of shingles it spans."""
        n = len(self.items[number])
        slack = n // 4 + 1
        low = max(0, at - slack)
        region = shingles[low:max(at, 0) + n + slack]
        inside = np.flatnonzero(np.isin(region, self.counted[number][0]))
        if len(inside) < SIMILARITY * len(self.counted[number][0]) - 1e-9:
            return 0.0, 0, 0
        best = (0.0, 0, 0)
        spans = [(int(inside[0]), int(inside[-1]) + 1)] + [(int(s), int(s) + n) for s in inside]
        for begin, end in spans:
            part = region[begin:end]
            score = self._weighed(part, number)
            if score > best[0]:
                best = (score, low + begin, len(part))
            if score == 1.0:
                break
        return best

    def leaks(self, texts: list[str]) -> list[list[Leak]]:
        """For every text the items it contains, best place of each."""
        shingles = [shingle_hashes(word_hashes(t)) for t in texts]
        sizes = [len(s) for s in shingles]
        flat = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        best: list[dict[int, Leak]] = [{} for _ in texts]
        for doc, number, place in self.candidates(flat, np.repeat(np.arange(len(texts)), sizes)):
            score, first, n = self.verified(shingles[doc], number, place - int(base[doc]))
            known = best[doc].get(number)
            if score >= SIMILARITY - 1e-9 and (known is None or (-score, first) < (-known.similarity, known.first)):
                best[doc][number] = Leak(self.ids[number], score, first, n + LENGTH - 1)
        return [[b[k] for k in sorted(b)] for b in best]


def _parts(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, streamed through the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size = [], 0
    for row in rows.filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _reporting(items: list[tuple[int, str]]) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items)
        for batch in kept.pieces(batches):
            ids, at = batch.column("doc_id").to_pylist(), 0
            for part in _parts(batch.column("text").to_pylist()):
                rows = [
                    {"doc_id": ids[at + i], "item_id": leak.item, "similarity": leak.similarity,
                     "first_word": leak.first, "n_words": leak.length}
                    for i, leaks in enumerate(searcher.leaks(part)) for leak in leaks
                ]
                at += len(part)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        kept.only(None)

    return run


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                    ("first_word", pa.int64()), ("n_words", pa.int64())])
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: every item that a document contains."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [rows.mapInArrow(_reporting(items), SCHEMA) for items in benchmark_blocks(benchmark)]
    if not found:
        return rows.limit(0).mapInArrow(_reporting([]), SCHEMA)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _filtering(items: list[tuple[int, str]]) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items)
        for batch in kept.pieces(batches):
            clean: list[bool] = []
            for part in _parts(batch.column("text").cast(pa.string()).to_pylist()):
                clean += [not leaks for leaks in searcher.leaks(part)]
            yield batch.filter(pa.array(clean, pa.bool_()))
        kept.only(None)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns as they were, nothing shuffled."""
    for items in benchmark_blocks(benchmark):
        docs = docs.mapInArrow(_filtering(items), docs.schema)
    return docs
