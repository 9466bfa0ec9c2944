"""Alignment of the tokens that two tokenizers cut from the same text.

Both tokenizers cut a text into runs of bytes.  Where a run of each ends at the same byte, the text can be
cut for both: these common ends divide the tokens into groups that cover the same bytes.  They are found by
galloping intersection: every end of the shorter list looks for its place in the longer one by steps that
double until they pass it, and then by halving the last step.  The ranks of the common ends in the two lists
slice the groups; their differences are the ranges of tokens that overlap.

Neither tokenizer joins a character that is no white space with a space or line feed after it, or a Latin letter
with white space or common punctuation after it (checked for the sentence pieces when the vocabulary is read;
otherwise texts stay whole), so a text is cut there and every distinct piece is encoded and intersected once in
a worker.  Cuts are common ends, so the groups of a text are those of its pieces one after the other.

Corpus-wide counts: a task writes its link lists in chunks of at most ``CHUNK`` links as indexes into the
distinct id pairs of the chunk.  Only those pairs are counted and looked up over the network, so a pair that
occurs everywhere is one row a chunk; a chunk's counts then meet its lists again.

Defined cases: a null or empty text, and a text that either tokenizer does not give back byte for byte, has
no tokens: zeros and an empty digest; a very long text is encoded piece by piece and its links may spread
over several chunks; repeated rows and null ``doc_id`` stay separate rows; ties for the highest count all
count as best; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.token_output import groups_of
from depotlens.session import written_table

#: Pieces and id pairs that a worker remembers, pieces encoded in one call, links of a chunk.
KEPT, PAIRS, TOGETHER, CHUNK = 200_000, 1_000_000, 512, 1 << 20
_L, _P = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?"
#: Up to a letter before punctuation or white space, or another character before a space or line feed.
PIECE = re.compile(rf"\s*[^\s{_L}]*(?:[{_L}]+(?![{_P}])[^\s{_L}]+|[^\S \n]\s*[^\s{_L}]*)*[{_L}]*")
JOINED = re.compile(rf"\n|[^▁]▁|[{_L}][\s{_P}]")  # no sentence piece may hold what a cut would part
LEAD = " a"  # one token for both; stands before a piece where its left neighbour matters
SPACE = "▁"
_SCHEMA = (
    "chunk long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links array<int>, pairs array<long>, counts array<long>"
)
_GROUPS = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of the sorted ``short`` its index in the sorted ``long``, or -1.

    All values move together: each starts at the place its rank suggests, steps away from it by 1, 2, 4 and
    so on until the value is passed, and halves the last step.
    """
    n = len(long)
    if not n or not len(short):
        return np.full(len(short), -1, np.int64)
    guess = np.arange(len(short), dtype=np.int64) * n // len(short)
    low, high = guess.copy(), guess.copy()  # long[low] <= value or low == -1; long[high] > value or high == n
    up = long[guess] <= short
    step, active = 1, np.flatnonzero(up)
    while len(active):
        high[active] = np.minimum(low[active] + step, n)
        passed = high[active] >= n
        passed[~passed] = long[high[active[~passed]]] > short[active[~passed]]
        on = active[~passed]
        low[on] = high[on]
        active, step = on, 2 * step
    step, active = 1, np.flatnonzero(~up)
    while len(active):
        low[active] = np.maximum(high[active] - step, -1)
        passed = low[active] < 0
        passed[~passed] = long[low[active[~passed]]] <= short[active[~passed]]
        on = active[~passed]
        high[on] = low[on]
        active, step = on, 2 * step
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) // 2
        below = long[middle] <= short[active]
        low[active[below]], high[active[~below]] = middle[below], middle[~below]
        active = active[high[active] - low[active] > 1]
    return np.where((low >= 0) & (long[np.maximum(low, 0)] == short), low, -1)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, in both lists, of the ends they share; the shorter list drives the search."""
    if len(ends_a) <= len(ends_b):
        at = gallop(ends_a, ends_b)
        return np.flatnonzero(at >= 0), at[at >= 0]
    at = gallop(ends_b, ends_a)
    return at[at >= 0], np.flatnonzero(at >= 0)


def _byte_values() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the runs that begin at ``starts`` and hold ``counts`` values, one after the other."""
    before = np.concatenate([[0], np.cumsum(counts)])
    return np.repeat(starts - before[:-1], counts) + np.arange(before[-1])


class Aligner:
    """Two tokenizers and what they made of the pieces seen so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        values = _byte_values()
        names = sorted(self.a.get_vocab().items(), key=lambda item: item[1])
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.bytes_a = [name.encode() if i in special else bytes(map(values.__getitem__, name)) for name, i in names]
        self.bytes_b = []
        cuts = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
            cuts &= not JOINED.search(piece)
        self.cuts = cuts
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.size_a, self.size_b = (np.array(list(map(len, t))) for t in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.pair_number: dict[int, int] = {}
        self.valid, *self.counts = np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3))
        self.ids_a = self.ids_b = self.at_a = self.at_b = self.links = np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.int64)
        self.new: list[tuple] = []

    def _thin(self) -> None:
        """Forgets the pieces seen least, half of what is kept; numbers of pairs stay."""
        kept = np.sort(np.argsort(-self.seen, kind="stable")[:KEPT // 2])
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.texts = [self.texts[k] for k in kept.tolist()]
        self.ids_a, self.ids_b = (self.gather(kept, i, v) for i, v in enumerate((self.ids_a, self.ids_b)))
        self.at_a, self.at_b, self.links = (self.gather(kept, 2, v) for v in (self.at_a, self.at_b, self.links))
        self.valid, self.seen = self.valid[kept], self.seen[kept] // 2
        self._placed([c[kept] for c in self.counts])

    def _placed(self, counts: list[np.ndarray]) -> None:
        self.counts, self.begins = counts, [np.concatenate([[0], np.cumsum(c)[:-1]]) for c in counts]

    def pieces(self, text: str) -> list[str]:
        return PIECE.findall(" " + text)[:-1] if self.cuts else [" " + text]  # the last match is empty

    def _learn(self, pieces: list[str], apart: bool = False) -> None:
        """Encodes pieces together and intersects the ends; pieces that can't be told apart again one by one.

        ``LEAD`` stands before the first piece, or with ``apart`` before each.
        """
        text = LEAD + (LEAD if apart else "").join(pieces)
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        b = np.array(self.b.encode(text[1:]), np.int32)
        right = all(b"".join(map(table.__getitem__, ids.tolist())) == text.encode()
                    for ids, table in ((a, self.bytes_a), (b, self.bytes_b)))
        if right:
            sizes = np.array([len(p.encode()) for p in pieces])
            guards = np.full(len(pieces), len(LEAD) if apart else 0)
            guards[0] = len(LEAD)
            ends = np.cumsum(sizes + guards)
            ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            at_a, at_b = common_ends(ends_a, ends_b)
            common = ends_a[at_a]
            begin, end = np.searchsorted(common, ends - sizes), np.searchsorted(common, ends)
            right = bool(end[-1] < len(common) and (common[begin] == ends - sizes).all() and (common[end] == ends).all())
        if not right and len(pieces) > 1:
            for piece in pieces:
                self._learn([piece])
            return
        if not right:
            none = np.zeros(0, np.int32)
            self._keep(pieces, [""], False, [0], [0], [0], none, none, none, none, none)
            return
        groups, n_a, n_b = end - begin, at_a[end] - at_a[begin], at_b[end] - at_b[begin]
        link = _ragged(begin + 1, groups)
        link_a, link_b = at_a[link], at_b[link]
        id_a, id_b, names = a[link_a], b[link_b], self.names
        before_a, before_b = at_a[link - 1], at_b[link - 1]
        sliced = [f"{names[x]}|{names[y]}" for x, y in zip(id_a.tolist(), id_b.tolist())]
        for i in np.flatnonzero((link_a - before_a > 1) | (link_b - before_b > 1)).tolist():
            of_a, of_b = a[before_a[i] + 1:link_a[i] + 1], b[before_b[i] + 1:link_b[i] + 1]
            sliced[i] = f"{','.join(map(names.__getitem__, of_a.tolist()))}|{','.join(map(names.__getitem__, of_b.tolist()))}"
        stops = np.cumsum(groups)
        texts = [sliced[x] if y - x == 1 else ";".join(sliced[x:y]) for x, y in zip((stops - groups).tolist(), stops.tolist())]
        distinct, inverse = np.unique((id_a.astype(np.int64) << 32) | id_b, return_inverse=True)
        number = self.pair_number
        numbers = np.array([number.setdefault(p, len(number)) for p in distinct.tolist()], np.int32)
        first = np.repeat(begin, groups)
        self._keep(pieces, texts, True, n_a, n_b, groups, a[_ragged(at_a[begin] + 1, n_a)], b[_ragged(at_b[begin] + 1, n_b)],
                   link_a - at_a[first], link_b - at_b[first], numbers[inverse])

    def _keep(self, pieces, texts, valid, n_a, n_b, groups, ids_a, ids_b, at_a, at_b, links) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.texts += texts
        self.new.append((np.full(len(pieces), valid), n_a, n_b, groups, ids_a, ids_b, at_a, at_b, links))

    def learn(self, pieces: list[str]) -> None:
        """Makes all of ``pieces`` known."""
        kinds: tuple[list[str], ...] = [], [], []
        for p in pieces:
            alone = p[-1].isspace() or SPACE in p or not self.cuts
            kinds[2 if alone else p[0] not in " \n"].append(p)
        for kind, together in zip(kinds, (TOGETHER, TOGETHER, 1)):
            for begin in range(0, len(kind), together):
                self._learn(kind[begin:begin + together], apart=kind is kinds[1])
        if self.new:
            parts = list(zip(*self.new))
            self.valid = np.concatenate([self.valid, *parts[0]])
            self._placed([np.concatenate([c, *p]).astype(np.int64) for c, p in zip(self.counts, parts[1:4])])
            self.seen = np.concatenate([self.seen, np.zeros(len(self.valid) - len(self.seen), np.int64)])
            self.ids_a, self.ids_b, self.at_a, self.at_b, self.links = (
                np.concatenate([c, *p]).astype(np.int32) for c, p in
                zip((self.ids_a, self.ids_b, self.at_a, self.at_b, self.links), parts[4:]))
            self.new = []

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The pieces of every text as numbers of known pieces; no pieces where a text can't be aligned."""
        if len(self.known) > KEPT:
            self._thin()
        cut = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        self.learn(list({p for pieces in cut for p in pieces if p not in known}))
        found = [np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)) for pieces in cut]
        if found:
            self.seen += np.bincount(np.concatenate(found), minlength=len(self.seen))
        return [n if len(n) and self.valid[n].all() else n[:0] for n in found]

    def sums(self, found: list[np.ndarray]) -> np.ndarray:
        """n_a, n_b and n_groups of every text."""
        return np.array([[int(c[n].sum()) for c in self.counts] for n in found], np.int64).reshape(-1, 3)

    def text(self, numbers: np.ndarray) -> str:
        """The groups of a text: ``a1,a2|b1;a3|b2``."""
        return ";".join(map(self.texts.__getitem__, numbers.tolist()))

    def gather(self, numbers: np.ndarray, which: int, values: np.ndarray) -> np.ndarray:
        """The values of all pieces, one after the other; ``which``: counted by A, B or groups."""
        return values[_ragged(self.begins[which][numbers], self.counts[which][numbers])] if len(numbers) else values[:0]

    def ends(self, numbers: np.ndarray, which: int) -> np.ndarray:
        """Tokens of A (0) or B (1) up to each common end."""
        counts = self.counts[which][numbers]
        before = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(numbers) else counts
        ranks = self.gather(numbers, 2, (self.at_a, self.at_b)[which])
        return (ranks + np.repeat(before, self.counts[2][numbers])).astype(np.int32)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for all tasks of a Python worker."""
    return Aligner(path_a, path_b)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(list(map(len, parts)))])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _grouped(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            at = 0
            for group in groups_of([t or "" for t in batch.column("text").to_pylist()]):
                if len(both.pair_number) > PAIRS:
                    both.forget()
                found = both.numbers(group)
                lists = [[both.gather(n, 0, both.ids_a) for n in found], [both.gather(n, 1, both.ids_b) for n in found],
                         [both.ends(n, 0) for n in found], [both.ends(n, 1) for n in found]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(group)), *[_lists(x, pa.int32()) for x in lists]],
                    names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])
                at += len(group)

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_ends, b_ends``: the tokens of both, and how many of each lie before every common end.

    Group k holds the tokens ``a_ends[k-1]`` to ``a_ends[k]`` of A and ``b_ends[k-1]`` to ``b_ends[k]`` of B.
    """
    return _rows(docs).mapInArrow(_grouped(path_a, path_b), _GROUPS)


class _Chunk:
    """Link lists of one chunk, written as indexes into its distinct pairs."""

    def __init__(self, both: Aligner, number: int) -> None:
        self.both, self.number, self.rows, self.size = both, number, [], 0

    def add(self, links: np.ndarray, *shown) -> None:
        self.rows.append((links, shown))
        self.size += len(links)

    def batch(self) -> pa.RecordBatch:
        pairs = np.fromiter(self.both.pair_number, np.int64, len(self.both.pair_number))
        links = [r[0] for r in self.rows]
        used = np.bincount(np.concatenate(links), minlength=len(pairs)) if links else np.zeros(0, np.int64)
        kept = np.flatnonzero(used)
        index = np.zeros(len(used), np.int32)
        index[kept] = np.arange(len(kept), dtype=np.int32)
        shown = [list(c) for c in zip(*(r[1] for r in self.rows))]
        n = len(self.rows)
        lists = _lists([index[x] for x in links], pa.int32())
        none = pa.nulls(1, pa.int64())
        head = [pa.array([self.number] * (n + 1), pa.int64())]
        for c in shown[:-1]:
            head.append(pa.concat_arrays([pa.array(c, pa.int64()), none]))
        head.append(pa.array([*shown[-1], None], pa.string()))
        lists = pa.concat_arrays([lists, pa.nulls(1, pa.list_(pa.int32()))])
        numbers = [pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), _lists([v], pa.int64())])
                   for v in (pairs[kept], used[kept])]
        names = [f.strip().split(" ")[0] for f in _SCHEMA.split(",")]
        return pa.RecordBatch.from_arrays([*head, lists, *numbers], names=names)


def _linked(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        row = chunks = TaskContext.get().partitionId() << 33
        chunk = _Chunk(both, chunks)
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for group in groups_of([t or "" for t in batch.column("text").to_pylist()]):
                if len(both.pair_number) > PAIRS:
                    if chunk.rows:  # its links are numbered in this memory
                        yield chunk.batch()
                        chunks += 1
                        chunk = _Chunk(both, chunks)
                    both.forget()
                found = both.numbers(group)
                for n, (n_a, n_b, groups) in zip(found, both.sums(found).tolist()):
                    digest = hashlib.sha256(both.text(n).encode()).hexdigest() if len(n) else ""
                    links = both.gather(n, 2, both.links)
                    chunk.add(links[:CHUNK], row, ids[at], n_a, n_b, groups, len(links), digest)
                    for begin in range(CHUNK, len(links), CHUNK):
                        yield chunk.batch()
                        chunks += 1
                        chunk = _Chunk(both, chunks)
                        chunk.add(links[begin:begin + CHUNK], row, None, 0, 0, 0, 0, None)
                    at, row = at + 1, row + 1
                    if chunk.size >= CHUNK:
                        yield chunk.batch()
                        chunks += 1
                        chunk = _Chunk(both, chunks)
        if chunk.rows:
            yield chunk.batch()

    return run


def _scored(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of the counts of every link list of one chunk."""
    n = counts.num_rows
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = counts["at"].to_numpy()
    total[at], best[at] = counts["total"].to_numpy(), counts["best"].to_numpy()
    lists = rows["links"].combine_chunks()
    flat, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    sums = [np.diff(np.concatenate([[0], np.cumsum(v[flat])])[offsets]) for v in (best, total)]
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return pa.table([*[rows[c] for c in kept], *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])


def pair_counts(entries: DataFrame) -> DataFrame:
    """``pair, total, best``: links of every id pair, and whether no pair of its B id has more.

    ``best`` per B id is one row for each id of a vocabulary, a bound that no corpus changes.
    """
    totals = entries.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    return totals.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))


def alignment_digest(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    A link is a pair of tokens that end together; ``count_sum`` adds up how often each link's id pair is
    linked in the corpus, and ``n_best`` counts links whose pair is the most frequent of its B id.
    """
    stored = written_table(_rows(docs).mapInArrow(_linked(path_a, path_b), _SCHEMA), "token-links")
    entries = stored.filter("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "e"))
    entries = entries.select("chunk", "at", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    counted = written_table(pair_counts(entries), "token-pairs")
    looked = entries.join(counted, "pair").select(F.col("chunk").alias("of_chunk"), "at", "total", "best")
    rows = stored.filter("row IS NOT NULL").drop("pairs", "counts")
    scored = rows.groupBy("chunk").cogroup(looked.groupBy("of_chunk")).applyInArrow(
        _scored, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                 "n_best long, count_sum long")
    whole = scored.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        F.max("groups_sha256").alias("groups_sha256"))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
