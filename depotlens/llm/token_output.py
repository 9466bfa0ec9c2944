"""Token ids as ORC files.

Documents are range-partitioned and sorted by ``doc_id``, encoded inside the sorted partitions and
written as one ORC file per partition: ids in the integer run-length encoding, a row index, and a
Bloom filter on ``doc_id``.  A reader takes stripes in parallel and skips those that cannot hold the
documents it asks for.  The text crosses the network once and the ids never do.

Defined cases: a null text counts as empty and yields only the end id; rows with a null ``doc_id`` come
first; repeated ids stay as separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlens.llm import kept
from depotlens.session import shared_dir

#: Between words that are encoded together; as a word of its own it is always one id.
MARK = "\x01"
#: Punctuation that is cut off the end of a word of letters.
TAILS = ".,;:!?)"
#: Words whose ids a Python worker remembers, and words encoded in one call.
KEPT_WORDS, TOGETHER = 400_000, 256
SCHEMA = "doc_id long, row long, local_start long, n_tokens long, ids array<int>"
STORED = SCHEMA + ", part int"


class WordEncoder:
    """Encodes texts word by word.

    The vocabulary's pre-tokeniser never joins characters across ASCII white space and drops it, so the
    ids of a text are the ids of its words one after the other.  It also separates letters from the
    punctuation after them, and case is dropped, so a word of letters is looked up in lower case and apart
    from its punctuation.  Only distinct words pass through Python; frequent ones are remembered, new ones
    are encoded together, separated by a mark.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case ASCII letters pass normaliser and pre-tokeniser as they are; their regexes cost a third of the time.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.last_of_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        if suffix:
            self.last_of_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.mark = self._encode([MARK])[0]
        if len(self.mark) != 1:
            raise ValueError("the vocabulary must encode the mark as one id")

    def _encode(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        found = (self.plain if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _together(self, words: list[str], marked: bool, plain: bool = False) -> dict[str, bytes]:
        """Ids of words, many words a call.

        Words of letters end where an id says so; others are kept apart by the mark, which they don't hold.
        """
        new: dict[str, bytes] = {}
        groups = [words[i:i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        between = f" {MARK} " if marked else " "
        for group, ids in zip(groups, self._encode([between.join(g) for g in groups], plain)):
            if marked:
                ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            else:
                ends = np.flatnonzero(self.last_of_word[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):  # a letter that decomposes; each on its own
                new.update((w, x.tobytes()) for w, x in zip(group, self._encode(group)))
                continue
            raw, begin, skip = ids.tobytes(), 0, 4 * marked
            for word, end in zip(group, (4 * ends).tolist()):
                new[word] = raw[begin:end]
                begin = end + skip
        return new

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words."""
        plain, letters, others, odd = [], [], [], []
        for word in words:
            if MARK in word:
                odd.append(word)
            elif word.isascii() and word.isalpha():  # lower case by now
                plain.append(word)
            elif word.isalpha() and _of_letters(word):
                letters.append(word)
            elif word:
                others.append(word)
        table = {"": b""} | self._together(plain, False, True) | self._together(letters, False) | self._together(others, True)
        table.update((w, x.tobytes()) for w, x in zip(odd, self._encode(odd)))
        return table

    def _found(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; new ones are remembered while there is room."""
        found = list(map(self.known.get, words))
        table = self._learn([word for word, ids in zip(words, found) if ids is None])
        self.known.update(islice(table.items(), max(0, KEPT_WORDS - len(self.known))))
        return [table[word] if ids is None else ids for word, ids in zip(words, found)]

    def _word_ids(self, words: pa.Array, end: np.ndarray) -> pa.ListArray:
        """Ids of each of some distinct words, and ``end`` as a last one."""
        letters = pc.utf8_rtrim(words, characters=TAILS)
        size, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (letters, words))
        ascii_ = pc.string_is_ascii(letters).to_numpy(zero_copy_only=False)
        plain = ascii_ & pc.ascii_is_alpha(letters).to_numpy(zero_copy_only=False)
        cut = plain & (size < whole)
        foreign = np.flatnonzero(~ascii_ & (size < whole))
        cut[foreign] = [_of_letters(w) for w in _strings(letters.take(pa.array(foreign)))]
        heads = pc.if_else(pa.array(plain), pc.ascii_lower(letters), pc.if_else(pa.array(cut), letters, words)).dictionary_encode()
        at = np.flatnonzero(cut)
        tailed = zip(_strings(words.take(pa.array(at))), (whole - size)[at].tolist())
        tails = pa.array([word[-n:] for word, n in tailed], pa.string()).dictionary_encode()
        found = [b"", *self._found(_strings(heads.dictionary)), *self._found(_strings(tails.dictionary)), end.tobytes()]
        pairs = np.zeros((len(words) + 1, 2), np.int64)  # of places in ``found``: letters and what follows them
        pairs[:-1, 0] = heads.indices.to_numpy() + 1
        pairs[at, 1] = tails.indices.to_numpy() + 1 + len(heads.dictionary)
        pairs[-1, 0] = len(found) - 1
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        parts = pa.ListArray.from_arrays(_offsets(sizes), pa.array(np.frombuffer(b"".join(found), "<i4")))
        return pa.ListArray.from_arrays(_offsets(sizes[pairs].sum(axis=1)), parts.take(pa.array(pairs.ravel())).flatten())

    def encoded(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, ``end`` behind each, and how many each text has.

        Texts are cut at ASCII white space only.
        """
        split = pc.ascii_split_whitespace(texts)
        distinct = split.flatten().dictionary_encode()
        ids = self._word_ids(distinct.dictionary, end)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        places = np.insert(distinct.indices.to_numpy(), ends, len(ids) - 1)
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(sizes[places])[ends + np.arange(len(ends))]
        return ids.take(pa.array(places)).flatten().to_numpy(), np.diff(upto, prepend=0)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian unsigned 32-bit integers."""
        values, counts = self.encoded(pa.array(texts, pa.binary()).cast(pa.string()), np.zeros(0, "<u4"))
        return [part.tobytes() for part in np.split(values, np.cumsum(counts)[:-1])][:len(texts)]


def _of_letters(word: str) -> bool:
    """Whether a word stays letters when it is folded, so no mark joins the punctuation after it."""
    return unicodedata.normalize("NFC", word.lower()).isalpha()


def _strings(array: pa.Array) -> list[str]:
    """The values, without a scalar object for each."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def _forget() -> bool:
    held = word_encoder.cache_info().currsize > 0
    word_encoder.cache_clear()
    return held


kept.remembered("word encoder", _forget)


def groups_of(texts: list, most: int = 4_000_000) -> Iterator[list]:
    """Consecutive texts of at most ``most`` characters (or bytes) together, or a single longer one."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _slices(sizes: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """First and number of consecutive texts of at most ``most`` bytes together, or a single longer one."""
    begin = total = 0
    for at, size in enumerate(sizes.tolist()):
        if at > begin and total + size > most:
            yield begin, at - begin
            begin, total = at, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes) - begin


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.only("word encoder")
        encoder, end = word_encoder(path), np.array([end_id], "<u4")
        row = start = 0
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), b"").cast(pa.string())
            for at, many in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                values, counts = encoder.encoded(texts.slice(at, many), end)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, many),
                        pa.array(np.arange(row, row + many)),
                        pa.array(start + np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.ListArray.from_arrays(_offsets(counts), pa.array(values)),
                    ],
                    names=["doc_id", "row", "local_start", "n_tokens", "ids"],
                )
                row, start = row + many, start + len(values)

    return run


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, stripe_bytes: int = 64 << 20,
    index_stride: int = 10_000,
) -> str:
    """Writes the ids of ``docs`` (``doc_id``, ``text``) in ascending ``doc_id`` order; returns ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    (
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(_encoder(vocabulary, end_id), SCHEMA)
        .withColumn("part", F.spark_partition_id())
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )
    return path


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; filters on ``doc_id`` reach the stripes' indexes and Bloom filters."""
    return spark.read.schema(STORED).orc(path)


def part_starts(stored: DataFrame) -> DataFrame:
    """Ids before each file: one row per file."""
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def with_starts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids of all documents before the row."""
    return rows.join(part_starts(stored), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored rows of some documents, read from the stripes that may hold them."""
    return token_files(spark, path).filter(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = np.asarray(ids.values).astype("<u4", copy=False)
        bounds = ids.offsets.to_pylist()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        kept = [batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"]
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, read from the files."""
    stored = token_files(spark, path)
    sums = stored.mapInArrow(_checksums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return with_starts(sums, stored).select("doc_id", "start", "n_tokens", "ids_crc32")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder."""
    return f"{shared_dir(spark)}/depotlens-{name}-{uuid4().hex}"
