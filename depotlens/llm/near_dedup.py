"""Near-duplicate classes by Order MinHash.

The k-mers of a text are its runs of five words, told apart by occurrence.  For each of several hash
functions the ``KMERS`` smallest k-mers are taken and kept in text order; two texts agree on such a sketch
only if they share these k-mers in the same order, which follows edit similarity.  Texts that agree on a
sketch are candidates, and a candidate pair is a link if a banded alignment leaves at least 0.8 of the
longer text unedited, counted in words.  Classes are the connected components of the links.

Equal texts are collapsed first, so copies cost nothing further.  Inside a bucket every text is compared
with the first text of similar length.  Buckets that still hold several classes are then looked through
whole.  Texts that meet in one bucket mostly meet in others too, so buckets of one first text and band are
put together as a crowd, which holds every text once, and are looked through in blocks of at most about
``BLOCK`` texts against another: a pair that is in no class together is taken up in the first bucket it
shares and left out only if the words of the two texts, order aside, rule a link out.  The nearest pairs are
compared first and all others that no link connects by then after them, so no candidate pair is left open.
This work grows with the square of a crowd of unlike texts, but pairs are formed inside the tasks, from
sketches and word counts; no crowd is gathered in one task.

Texts that share a part J of their k-mers agree on a sketch of two with a probability of about J squared: on 31
of 48 at J = 0.8, on 12 at J = 0.5.  Edits spread over a tenth of the words leave J near 0.4, over 0.18 of them
0.23, where about nine pairs in ten meet; the README has measured figures.

Defined cases: equal texts, the empty text included, are one class; texts without words are alike only if
equal; a null text or a null ``doc_id`` is in no class with others (its class is its own ``doc_id``);
repeated rows come back as often as they came; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm import kept as worker
from depotlens.llm.shingles import LENGTH, labelled, mixed, shingle_hashes, word_hashes
from depotlens.session import written_table

#: Sketches for each text, k-mers in a sketch, least similarity of a link.
SKETCHES, KMERS, SIMILARITY = 48, 2, 0.8
#: Texts in a block of a crowd, counters of a text's words, pairs a text that are compared first in a block.
BLOCK, COUNTERS, NEAREST = 2048, 512, 2
#: Longest gap between matched k-mers that is aligned word by word in Python; longer ones by bit vectors.
GAP = 64
_RANDOM = np.random.default_rng(20240229)
_TIMES = _RANDOM.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_AT_ONCE = 2_000_000


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One key for each hash function from the labelled k-mers of a text."""
    n, keep = len(kmers), min(KMERS, len(kmers))
    if not n:
        return np.zeros(0, np.uint64)
    keys = np.empty(SKETCHES, np.uint64)
    rows = max(1, _AT_ONCE // n)
    for begin in range(0, SKETCHES, rows):
        part = slice(begin, begin + rows)
        values = kmers[None, :] * _TIMES[part, None] + _PLUS[part, None]
        values ^= values >> np.uint64(29)
        if keep < n:
            at, each = np.empty((len(values), keep), np.int64), np.arange(len(values))
            for i in range(keep):  # k-mers differ, and so do their values
                at[:, i] = values.argmin(axis=1)
                values[each, at[:, i]] = np.iinfo(np.uint64).max
        else:
            at = np.tile(np.arange(n), (len(values), 1))
        chosen = kmers[np.sort(at, axis=1)]  # text order
        key = _PLUS[part].copy()
        for i in range(keep):
            key = mixed(key + chosen[:, i])
        keys[part] = key
    return keys


def _distance(a: list[int], b: list[int]) -> int:
    """Edit distance of two short word sequences."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def banded(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is ``most`` or less, else a value above.

    A column of the alignment is a pair of bit vectors, one bit a word of ``a``, that say where it rises and
    falls; a word of ``b`` costs a dozen operations on them.  A path that ends within ``most`` edits stays
    inside the band of that width, so it ends as soon as the last cell is too far above for what is left.
    """
    n, left = len(a), len(b)
    if abs(n - left) > most:
        return most + 1
    if not n:
        return left
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full, last = (1 << n) - 1, n - 1
    rises, falls, distance = full, 0, n
    for word in b.tolist():
        same = places.get(word, 0)
        down = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        up = falls | (full & ~(across | rises))
        low = rises & across
        left -= 1
        distance += (up >> last & 1) - (low >> last & 1)
        if distance - left > most:
            return most + 1
        up = (up << 1 | 1) & full
        rises, falls = (low << 1 | ~(down | up)) & full, up & down
    return distance


def _anchors(a: np.ndarray, b: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k-mers matched by the longest chain that keeps order and stays inside the band."""
    _, at_a, at_b = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if not (np.diff(at_b) > 0).all():
        ends: list[int] = []  # smallest end of a chain of each length
        places: list[int] = []
        before = np.full(len(at_b), -1)
        for i, value in enumerate(at_b.tolist()):
            k = bisect_left(ends, value)
            before[i] = places[k - 1] if k else -1
            ends[k:k + 1], places[k:k + 1] = [value], [i]
        chain, i = [], places[-1]
        while i >= 0:
            chain.append(i)
            i = int(before[i])
        at_a, at_b = at_a[chain[::-1]], at_b[chain[::-1]]
    return at_a, at_b


def _common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words of both, order aside."""
    return len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))


def _along_anchors(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits of the alignment through k-mers that match in order inside the band; above ``most`` as a bound only."""
    at_a, at_b = _anchors(shingle_hashes(a), shingle_hashes(b), most)
    # A gap lies between the end of one matched k-mer and the start of the next on another diagonal.
    begin_a = np.concatenate([[0], at_a + LENGTH]).astype(np.int64)
    begin_b = np.concatenate([[0], at_b + LENGTH]).astype(np.int64)
    end_a, end_b = np.append(at_a, len(a)).astype(np.int64), np.append(at_b, len(b)).astype(np.int64)
    gap_a, gap_b = end_a - begin_a, end_b - begin_b
    overlap = np.minimum(np.minimum(gap_a, gap_b), 0)  # k-mers of one diagonal overlap
    gap_a, gap_b, begin_a, begin_b = gap_a - overlap, gap_b - overlap, begin_a + overlap, begin_b + overlap
    least = np.abs(gap_a - gap_b)
    open_ = np.flatnonzero(np.maximum(gap_a, gap_b) > 0)
    open_ = open_[np.argsort(np.maximum(gap_a, gap_b)[open_], kind="stable")]  # short ones first
    distance, rest = 0, int(least[open_].sum())
    for i in open_.tolist():
        if distance + rest > most:
            break
        x, y = a[begin_a[i]:begin_a[i] + gap_a[i]], b[begin_b[i]:begin_b[i] + gap_b[i]]
        rest -= int(least[i])
        allowed = most - distance - rest
        longer = max(len(x), len(y))
        if longer <= GAP:
            distance += _distance(x.tolist(), y.tolist())
        elif longer - _common_words(x, y) > allowed:
            return most + 1
        else:
            distance += banded(x, y, allowed)
    return distance + rest


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """One less the edit distance over the longer text, both in words, by banded alignment; 0 below the threshold.

    At most (1 - s) of the longer text may be edited, so an alignment never leaves that band.  K-mers that
    match in order inside the band are tried as its backbone, with the gaps between them aligned inside
    theirs.  A pair that is no link that way, though enough words are common for one, is aligned over the
    whole band, so no link is lost to a wrong backbone.
    """
    longer = max(len(a), len(b))
    if not longer:
        return 0.0
    most = int(longer * (1 - SIMILARITY) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    distance = _along_anchors(a, b, most)
    if distance > most and longer - _common_words(a, b) <= most:
        distance = banded(a, b, most)
    return 1 - distance / longer if distance <= most else 0.0


def _kmers(text: str) -> np.ndarray:
    return labelled(shingle_hashes(word_hashes(text)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.only("shingles")
    for batch in worker.pieces(batches):
        kmers = [_kmers(t) for t in batch.column("text").to_pylist()]
        keys = [sketches(k) for k in kmers]
        flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("digest"),
                pa.array([len(k) for k in kmers], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            ],
            names=["doc_id", "digest", "n", "keys"],
        )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in worker.pieces(batches):
        left, right = (batch.column(c).to_pylist() for c in ("text_a", "text_b"))
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        found = []
        for a, b in zip(left, right):
            if b != last[0]:
                last = (b, word_hashes(b))
            found.append(similarity(word_hashes(a), last[1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
        )
    worker.only(None)


def _identified(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest"))


def _words(n: str) -> Column:
    """Words of a text of ``n`` k-mers; texts of one k-mer that share it are equal in words."""
    return F.col(n) + (LENGTH - 1)


def _near_in_length(a: str, b: str) -> Column:
    return F.least(_words(a), _words(b)) >= F.greatest(_words(a), _words(b)) * SIMILARITY - 1e-9


def _shared(rows: DataFrame) -> DataFrame:
    """``number, key, doc, n`` in two overlapping bands of length each, where a band has two members or more.

    Texts whose lengths differ by no more than 0.8 share one of the bands, the even or the odd one.
    ``lead`` is the band's first member.
    """
    unit = F.log(_words("n")) / F.lit(log(1 / (SIMILARITY - 0.005)))
    bands = F.array(F.floor(unit / 2) * 2, F.floor((unit + 1) / 2) * 2 + 1)
    banded = rows.select("number", "key", "doc", "n", bands[0].alias("even"), F.explode(bands).alias("band"))
    leads = banded.groupBy("key", "band").agg(
        F.min(F.struct("doc", "n")).alias("lead"), F.count("*").alias("members")
    ).filter("members > 1")
    return banded.join(leads, ["key", "band"])


def _pairs(open_: DataFrame) -> DataFrame:
    """Every member with the first of its band, where their lengths allow a link; ``shared`` counts their buckets."""
    pairs = open_.filter((F.col("doc") != F.col("lead.doc")) & _near_in_length("n", "lead.n"))
    return pairs.groupBy(F.col("doc").alias("a"), F.col("lead.doc").alias("b")).agg(F.count("*").alias("shared"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of a text fall to each counter; all full where one would run over."""
    for batch in worker.pieces(batches):
        bags = []
        for text in batch.column("text").to_pylist():
            counts = np.bincount((word_hashes(text) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            full = counts.max() > np.iinfo(np.uint16).max
            bags.append((np.full(COUNTERS, 65535) if full else counts).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(bags, pa.binary())], names=["doc", "bag"])


def _block_pairs(block: pa.Table, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block with another, or of a block with itself, that this crowd has to settle.

    A pair belongs to the first sketch that its texts share, there to the even band if they share it;
    ``numbers`` has a bit for each sketch whose bucket of the text is in the crowd.
    With ``most`` only the pairs of each text that share most sketches.
    """
    doc, label, n, even, mine, numbers = (block[c].to_numpy() for c in ("doc", "label", "n", "even", "mine", "numbers"))
    band, i, j = (block[c][0].as_py() for c in ("band", "i", "j"))
    keys = block["keys"].combine_chunks().flatten().to_numpy().reshape(len(doc), SKETCHES)
    bags = np.frombuffer(b"".join(block["bag"].to_pylist()), np.uint16).reshape(len(doc), COUNTERS)
    words = n + (LENGTH - 1)
    full = bags.min(axis=1) == 65535
    left = np.flatnonzero(mine == i)
    right = left if i == j else np.flatnonzero(mine == j)
    for at, x in enumerate(left.tolist()):
        others = right[at + 1:] if i == j and most is None else right
        others = others[label[others] != label[x]]
        longer = np.maximum(words[others], words[x])
        fits = np.minimum(words[others], words[x]) >= longer * SIMILARITY - 1e-9
        if band != even[x]:
            fits &= even[others] != even[x]
        others, longer = others[fits], longer[fits]
        same = keys[others] == keys[x]
        first = same.any(axis=1) & (numbers[x] >> np.argmax(same, axis=1) & 1 > 0)
        others, longer, same = others[first], longer[first], same[first]
        common = np.minimum(bags[others], bags[x]).sum(axis=1, dtype=np.int64)
        near = (common >= longer * SIMILARITY - 1e-9) | full[others] | full[x]
        others, shared = others[near], same[near].sum(axis=1)
        if most is not None:
            others = others[np.argsort(-shared, kind="stable")[:most]]
        if len(others):
            yield np.maximum(doc[others], doc[x]), np.minimum(doc[others], doc[x])


def _blocks_compared(most: int | None):
    """Cuts a sorted stream into its blocks."""
    names = ("lead", "band", "i", "j")

    def pairs(block: pa.Table) -> pa.RecordBatch:
        found = list(_block_pairs(block, most))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch])
            ids = [table[c].to_numpy() for c in names]
            starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ids], axis=0)) + 1
            cuts = [0, *starts.tolist()]
            for begin, end in zip(cuts, cuts[1:]):
                yield pairs(table.slice(begin, end - begin))
            rest = table.slice(cuts[-1]).to_batches()
        if rest:
            yield pairs(pa.Table.from_batches(rest))

    return run


def _crowds(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``lead, band, doc, n, even, label, numbers, members``: every text once in all open buckets of a lead and band.

    A bucket is open if it holds several classes; a bucket of two is settled by its lead.  A pair that shares
    a bucket is in the crowd of that bucket together.
    """
    named = buckets.filter("members > 2").join(labels, "doc", "left").select(
        "key", "band", "number", F.col("lead.doc").alias("lead"), "doc", "n", "even", F.coalesce("label", "doc").alias("label"))
    mixed_ = named.groupBy("key", "band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    open_ = named.join(mixed_.select("key", "band"), ["key", "band"])
    crowds = written_table(open_.groupBy("lead", "band", "doc").agg(
        *(F.first(c).alias(c) for c in ("n", "even", "label")), F.expr("bit_or(shiftleft(1L, number))").alias("numbers")),
        "near-crowds")
    return crowds.join(crowds.groupBy("lead", "band").agg(F.count("*").alias("members")), ["lead", "band"])


def _open_pairs(
    buckets: DataFrame, tested: DataFrame, labels: DataFrame, bags: DataFrame, most: int | None
) -> DataFrame:
    """Candidate pairs ``a, b`` that no link found so far connects, without those tested and those ruled out."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    crowds = _crowds(buckets, labels)
    spread = crowds.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    spread = spread.select("lead", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                           "mine", "numbers", "doc", "n", "even", "label")
    rows = spread.join(bags, "doc").repartition("lead", "band", "i", "j").sortWithinPartitions("lead", "band", "i", "j")
    found = rows.mapInArrow(_blocks_compared(most), "a long, b long").distinct()
    return written_table(
        found.join(tested.select("a", "b"), ["a", "b"], "left_anti").join(
            tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "near-open")


def _apart(buckets: DataFrame, tested: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of a member with a lead of another class than its own, without those tested.

    Classes are put to the members before pairs are formed, so pairs inside a class never become rows.
    """
    of_a = labels.select(F.col("doc").alias("a"), F.col("label").alias("class_a"))
    of_b = labels.select(F.col("doc").alias("b"), F.col("label").alias("class_b"))
    open_ = buckets.filter((F.col("doc") != F.col("lead.doc")) & _near_in_length("n", "lead.n")).select(
        F.col("doc").alias("a"), F.col("lead.doc").alias("b"))
    named = open_.join(of_a, "a", "left").join(of_b, "b", "left")
    pairs = named.filter(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b").distinct()
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def _compare(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Similarity of every pair; 0 below the threshold."""
    left = kept.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = kept.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written_table(found.mapInArrow(_compared, "a long, b long, similarity double"), "near-compared")


def linked_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc, label`` of all texts with a link, by the links that connect them; ``texts``: ``doc, digest, n, keys``.

    Every text is first compared with the smallest of its leads and with the one it shares most buckets
    with; that settles large groups of near copies with two comparisons each.  The other pairs with leads
    follow unless their texts are connected by then, and last what crowds of several classes hold.
    """
    sketched = texts.select("doc", "n", F.posexplode("keys").alias("number", "key"))
    repeated = sketched.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    first = written_table(_shared(sketched.join(repeated, "key")), "near-buckets")
    wanted = first.select(F.col("doc").alias("doc_id")).distinct().join(
        texts.select(F.col("doc").alias("doc_id"), "digest"), "doc_id")
    kept = _identified(docs).join(wanted, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    kept = written_table(kept.select(F.col("doc_id").alias("doc"), "text"), "near-texts")
    pairs = written_table(_pairs(first), "near-pairs")
    leads = pairs.groupBy("a").agg(F.array_distinct(F.array(
        F.min("b"), F.max(F.struct("shared", (-F.col("b")).alias("b")))["b"] * -1)).alias("leads"))
    chosen = leads.select("a", F.explode("leads").alias("b"))
    tested = _compare(chosen, kept)
    labels = components(tested.filter("similarity > 0"))
    more = _compare(_apart(first, tested, labels), kept)
    tested, labels = tested.unionByName(more), merged(labels, more.filter("similarity > 0"))
    bags = kept.mapInArrow(_counted, "doc long, bag binary").join(texts.select("doc", "keys"), "doc")
    bags = written_table(bags, "near-words")
    for most in (NEAREST, None):
        more = _compare(_open_pairs(first, tested, labels, bags, most), kept)
        tested, labels = tested.unionByName(more), merged(labels, more.filter("similarity > 0"))
    return labels


def components(links: DataFrame) -> DataFrame:
    """``doc, label``: the smallest document that each linked document is connected to.

    Labels spread along links and jump to the label of the label, so the rounds grow with the logarithm
    of the longest chain; a round that changes nothing ends it.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written_table(edges.distinct(), "near-edges")
    labels = written_table(
        edges.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels"
    )
    while True:
        around = edges.join(labels.withColumnRenamed("doc", "b"), "b").groupBy(F.col("a").alias("doc")).agg(
            F.min("label").alias("seen"))
        spread = labels.join(around, "doc").select("doc", F.least("label", "seen").alias("near"), F.col("label").alias("old"))
        jump = labels.select(F.col("doc").alias("near"), F.col("label").alias("far"))
        new = spread.join(jump, "near").select("doc", F.least("near", "far").alias("label"), "old")
        new = written_table(new, "near-labels")
        if new.filter("label <> old").isEmpty():
            return new.select("doc", "label")
        labels = new.select("doc", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more ``links``; only what the links join is worked on, not the classes known before."""
    if links.isEmpty():
        return labels
    of_a = labels.select(F.col("doc").alias("a"), F.col("label").alias("class_a"))
    of_b = labels.select(F.col("doc").alias("b"), F.col("label").alias("class_b"))
    named = links.select("a", "b").join(of_a, "a", "left").join(of_b, "b", "left")
    between = written_table(named.select(
        F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).distinct(), "near-between")
    joined = components(between.filter("a <> b"))
    known = labels.unionByName(joined.select("doc", F.col("doc").alias("label")).join(labels, "doc", "left_anti"))
    new = known.join(joined.select(F.col("doc").alias("label"), F.col("label").alias("into")), "label", "left")
    return written_table(new.select("doc", F.coalesce("into", "label").alias("label")), "near-labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, text_digest`` for every row of ``docs`` (``doc_id``, ``text``).

    ``class_id`` is the smallest ``doc_id`` of the class.
    """
    rows = _identified(docs)
    known = "text IS NOT NULL AND doc_id IS NOT NULL"
    sketched = written_table(
        rows.filter(known).mapInArrow(_sketched, "doc_id long, digest string, n long, keys array<long>"), "near-sketches"
    )
    texts = sketched.groupBy("digest").agg(
        F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = written_table(texts, "near-distinct")
    labels = linked_texts(docs, texts.filter("n > 0"))
    named = texts.select("digest", "doc").join(labels, "doc", "left").select(
        "digest", F.coalesce("label", "doc").alias("class_id"))
    found = sketched.select("doc_id", "digest").join(named, "digest")
    alone = rows.filter(f"NOT ({known})").select("doc_id", "digest", F.col("doc_id").alias("class_id"))
    return found.select("doc_id", "digest", "class_id").unionByName(alone).withColumnRenamed("digest", "text_digest")


def keep_one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of every class: that of its smallest ``doc_id``; rows outside the classes stay."""
    names = docs.columns
    gone = classes.filter("doc_id <> class_id").select(
        F.col("doc_id").alias("gone_id"), F.col("text_digest").alias("gone_digest")).distinct()
    rows = docs.select(F.struct(*names).alias("record"), F.col("doc_id").cast("long").alias("row_id"),
                       F.sha2(F.col("text").cast("string"), 256).alias("row_digest"))
    left = rows.join(gone, (F.col("row_id") == F.col("gone_id")) & (F.col("row_digest") == F.col("gone_digest")), "left_anti")
    copies = Window.partitionBy("row_id", "row_digest").orderBy(F.lit(1))
    whole = F.col("row_id").isNull() | F.col("row_digest").isNull() | (F.row_number().over(copies) == 1)
    return left.select("record.*", whole.alias("first_of_copies")).filter("first_of_copies").select(
        *[F.col(f"`{n}`") for n in names])
