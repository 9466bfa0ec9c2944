"""Near-duplicate classes by SimHash fingerprints and a binary trie self-join.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the hashes (XXH64, seed 42) of the
text's three-word shingles.  Fingerprints that differ in few bits are linked; classes are the connected
components of the links.

The links come from a binary trie over the distinct fingerprints that is joined with itself: pairs of trie
nodes of one depth are walked together, every step to children that differ adds a differing bit, and a pair is
dropped as soon as its bits exceed the error budget.  If two fingerprints differ in no more than r bits, one of
their halves differs in no more than r // 2.  So there are two tries, one that reads the upper half first and
one that reads the lower half first, and the budget is r // 2 down to bit 32 and r below.  That keeps the
pairs alive at a depth near the number of fingerprints.

On the cluster a pair of nodes is a key.  All pairs of nodes at a first depth, which follows the number of
fingerprints, are formed by giving every fingerprint the keys of the nodes within the budget.  Pairs with more
than ``MOST`` fingerprints step down ``STEP`` bits, again and again, until none is that large; pairs with an
empty side go.  The rest of the walk happens inside a task, a bounded number of node pairs at a time, and a task
sends on a spanning star of the components it finds, so a dense group never turns into all its pairs.

Defined cases: null and empty texts and texts without words have the fingerprint zero, which links like any
other; fewer than three words are one shingle; texts of any length are read whole; equal fingerprints are
one class whatever their texts; repeated rows come back as often as they came; a null ``doc_id`` is never
the smallest of a class, and a class of null ids only has a null ``component_id``; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.hot_keys import lookup
from depotlens.llm.near_dedup import components
from depotlens.session import written_table

#: Words of a shingle, seed of its hash, differing bits of a link.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints a trie node has on average at the first depth, most in a pair of nodes that one task walks,
#: bits of a step down; all three only bound memory.
AVERAGE, MOST, STEP = 2_048, 16_384, 4
#: Hashes whose bits are counted at once, node pairs walked at once, products small enough to compare directly.
_HASHES, _PAIRS, _DIRECT = 200_000, 500_000, 16
_SIGN = 1 << 63


def shingle_hashes(raw: bytes) -> np.ndarray:
    """XXH64 of all three-word shingles; ``bytes`` lower-case A to Z only and split at ASCII white space only."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[:len(words) - SHINGLE + 1]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends[SHINGLE - 1:].tolist())),
                       np.uint64, len(begins))


def _bit_counts(hashes: np.ndarray, starts: list[int]) -> np.ndarray:
    """How often each bit is set in every run of hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > n[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprint_of(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints of whole texts."""
    out = np.zeros(len(texts), np.uint64)
    group: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if group:
            n = np.array([len(h) for _, h in group])
            starts = [0, *np.cumsum(n)[:-1].tolist()]
            out[[i for i, _ in group]] = _majority(_bit_counts(np.concatenate([h for _, h in group]), starts), n)
            group.clear()

    size = 0
    for i, raw in enumerate(texts):
        hashes = shingle_hashes(raw or b"")
        if len(hashes) > _HASHES:
            counts = sum(_bit_counts(hashes[k:k + _HASHES], [0]) for k in range(0, len(hashes), _HASHES))
            out[i] = _majority(counts, np.array([len(hashes)]))[0]
        elif len(hashes):
            group.append((i, hashes))
            size += len(hashes)
        if size > _HASHES:
            flush()
            size = 0
    flush()
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = fingerprint_of(batch.column("text").to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` of every row; the 64 bits as a signed number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprinted, "doc_id long, print long")


def _budget(depth: int, radius: int) -> int:
    return radius // 2 if depth <= 32 else radius


def star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the first member that the links connect it with."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def walk(left: np.ndarray, right: np.ndarray | None, depth: int, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius`` of the sorted prints under two trie nodes, or under one with itself.

    ``bits`` is how many of the first ``depth`` bits differ between the nodes.  A node is a range of the sorted
    prints.  Pairs of nodes are walked a level at a time; a level above ``_PAIRS`` pairs is halved.
    """
    same, other = right is None, left if right is None else right
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def split(level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in ones:
            shift = np.uint64(63 - level)
            ones[level] = tuple(np.concatenate([[0], np.cumsum((x >> shift) & np.uint64(1), dtype=np.int64)])
                                for x in ((left,) if same else (left, other)))
            if same:
                ones[level] *= 2
        return ones[level]

    def compared(a0, a1, b0, b1, itself):
        count = (a1 - a0) * (b1 - b0)
        at = np.repeat(np.arange(len(a0)), count)
        step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        width = (b1 - b0)[at]
        i, j = a0[at] + step // width, b0[at] + step % width
        near = (np.bitwise_count(left[i] ^ other[j]) <= radius) & (~itself[at] | (i < j))
        return i[near], j[near]

    one = np.array([1])
    stack = [(depth, 0 * one, len(left) * one, 0 * one, len(other) * one, bits * one, np.array([same]))]
    while stack:
        level, a0, a1, b0, b1, d, itself = stack.pop()
        if len(a0) > _PAIRS:
            half = len(a0) // 2
            stack += [(level, *(x[part] for x in (a0, a1, b0, b1, d, itself))) for part in (slice(half), slice(half, None))]
            continue
        small = (a1 - a0) * (b1 - b0) <= _DIRECT
        if small.any():
            yield compared(*(x[small] for x in (a0, a1, b0, b1, itself)))
            a0, a1, b0, b1, d, itself = (x[~small] for x in (a0, a1, b0, b1, d, itself))
        if not len(a0):
            continue
        count_a, count_b = split(level)
        am, bm = a1 - (count_a[a1] - count_a[a0]), b1 - (count_b[b1] - count_b[b0])
        cross = ~itself
        parts = [(a0, am, b0, bm, d, itself), (am, a1, bm, b1, d, itself), (a0, am, bm, b1, d + 1, itself & False),
                 tuple(x[cross] for x in (am, a1, b0, bm, d + 1, itself))]
        a0, a1, b0, b1, d, itself = (np.concatenate(x) for x in zip(*parts))
        alive = (a1 > a0) & (b1 > b0) & (d <= _budget(level + 1, radius)) & ~(itself & (a1 - a0 < 2))
        stack.append((level + 1, *(x[alive] for x in (a0, a1, b0, b1, d, itself))))


def _stars(prints: np.ndarray, sides: np.ndarray, depth: int, bits: int, itself: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``print, first print`` that connect what one pair of nodes connects."""
    n = len(prints)
    cut = n if itself else int(np.searchsorted(sides, 1))
    label, held, size = np.arange(n), [], 0
    for i, j in walk(prints[:cut], None if itself else prints[cut:], depth, bits, radius):
        held.append((i, j if itself else j + cut))
        size += len(i)
        if size > _PAIRS:
            a, b = (np.concatenate(x) for x in zip(*held))
            members = np.arange(n)
            label, size = star(n, np.concatenate([a, members]), np.concatenate([b, label])), 0
            held = []
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        label = star(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, label]))
    linked = np.flatnonzero(label != np.arange(n))
    return prints[linked], prints[label[linked]]


_KEY = ("trie", "depth", "x", "y", "bits")


def _walked(radius: int):
    """Cuts a sorted stream into pairs of nodes and walks each."""

    def found(block: pa.Table) -> pa.RecordBatch:
        trie, depth, x, y, bits = (block[c][0].as_py() for c in _KEY)
        prints = (block["print"].to_numpy() ^ np.int64(-_SIGN)).view(np.uint64)  # stored so that signed order is theirs
        a, b = _stars(prints, block["side"].to_numpy(), depth, bits, x == y, radius)
        if trie:
            a, b = ((v << np.uint64(32)) | (v >> np.uint64(32)) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch])
            ids = [table[c].to_numpy() for c in _KEY]
            starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ids], axis=0)) + 1
            cuts = [0, *starts.tolist()]
            for begin, end in zip(cuts, cuts[1:]):
                yield found(table.slice(begin, end - begin))
            rest = table.slice(cuts[-1]).to_batches()
        if rest:
            yield found(pa.Table.from_batches(rest))

    return run


def _masks(step: int, most: int) -> list[tuple[int, int]]:
    return [(m, m.bit_count()) for m in range(1 << step) if m.bit_count() <= most]


def _children(rows: DataFrame, depth: int, step: int, radius: int) -> DataFrame:
    """The pairs of nodes ``step`` bits further down that each fingerprint belongs to.

    Every fingerprint knows its own child; the other side's child is its bits with as many changes as the
    budget has left.  Both sides of a pair arrive at the same key.
    """
    most = _budget(depth + step, radius)
    mask = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(n).alias("n")) for m, n in _masks(step, most)]))
    plain = F.col("print").bitwiseXOR(F.lit(-_SIGN).cast("long"))
    own = F.shiftrightunsigned(plain, 64 - depth - step) if depth + step else F.lit(0).cast("long")
    low = own.bitwiseAND((1 << step) - 1)
    spread = rows.select("*", own.alias("own"), low.alias("low"), mask.alias("mask")).filter(F.col("bits") + F.col("mask.n") <= most)
    partner = F.shiftleft(F.when(F.col("side") == 0, F.col("y")).otherwise(F.col("x")), step).bitwiseOR(
        F.col("low").bitwiseXOR(F.col("mask.m")))
    itself = F.col("x") == F.col("y")
    moved = spread.select("trie", "print", "own", "side", itself.alias("itself"), partner.alias("partner"),
                          (F.col("bits") + F.col("mask.n")).alias("bits"))
    swap = F.when(F.col("itself"), F.col("own") > F.col("partner")).otherwise(F.col("side") == 1)
    return moved.select(
        "trie", F.lit(depth + step).alias("depth"), F.when(swap, F.col("partner")).otherwise(F.col("own")).alias("x"),
        F.when(swap, F.col("own")).otherwise(F.col("partner")).alias("y"), "bits",
        F.when(F.col("own") == F.col("partner"), 0).otherwise(swap.cast("int")).alias("side"), "print")


def _sizes(rows: DataFrame) -> DataFrame:
    """Fingerprints of every pair of nodes, without pairs that have an empty side."""
    sizes = rows.groupBy(*_KEY).agg(F.count("*").alias("n"), F.sum("side").alias("of_y"))
    both = F.when(F.col("x") == F.col("y"), F.col("n") > 1).otherwise((F.col("of_y") > 0) & (F.col("of_y") < F.col("n")))
    return sizes.filter(both).select(*_KEY, "n")


def trie_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints (``print``) within ``radius`` bits."""
    count = prints.count()
    depth = min(32, max(0, ceil(log2(max(count, 1) / AVERAGE))))
    turned = F.shiftleft("print", 32).bitwiseOR(F.shiftrightunsigned("print", 32))
    tries = F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("print")), F.struct(F.lit(1).alias("trie"), turned.alias("print")))).alias("t")
    rows = prints.select(tries).select(
        "t.trie", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"),
        F.lit(0).alias("bits"), F.lit(0).alias("side"), F.col("t.print").bitwiseXOR(F.lit(-_SIGN).cast("long")).alias("print"))
    at = 0
    while at < depth:  # the first depth in steps; the plan stays one stage
        step = min(STEP, depth - at)
        rows = _children(rows, at, step, radius)
        at += step
    rows, done = written_table(rows, "trie-nodes"), []
    while True:
        named = lookup(rows, _sizes(rows), _KEY, "inner")
        done.append(written_table(named.filter(f"n <= {MOST} OR depth = 64").drop("n"), "trie-light"))
        heavy = named.filter(f"n > {MOST} AND depth < 64").drop("n")
        if heavy.isEmpty():
            break
        step = min(STEP, 64 - at)
        rows = written_table(_children(heavy, at, step, radius), "trie-nodes")
        at += step
    light = done[0]
    for more in done[1:]:
        light = light.unionByName(more)
    ordered = light.repartition(*_KEY).sortWithinPartitions(*_KEY, "side", "print")
    return ordered.mapInArrow(_walked(radius), "a long, b long").distinct()


def simhash_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, print, component_id`` of every row: the smallest ``doc_id`` of its class."""
    rows = written_table(fingerprints(docs), "simhash-prints")
    distinct = written_table(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components(trie_links(distinct.select("print"), radius))
    named = distinct.join(labels.withColumnRenamed("doc", "print"), "print", "left").select(
        "print", "first", F.coalesce("label", "print").alias("label"))
    named = written_table(named, "simhash-labels")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = lookup(named, least, ["label"]).select("print", "component_id")
    return lookup(rows, of_print, ["print"]).select("doc_id", "print", "component_id")
