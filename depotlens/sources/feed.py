"""A change feed whose files are numbered as they are found, so that a position in it is one number.

The ledger of a stream lists every file of the feed once, in the order of discovery.  An offset counts files
of that list: "latest" is its length when the stream first opens, a restart goes on from the number in the
checkpoint, and any range of numbers can be read again.  File times decide nothing after a file was found:
touched files keep their number and are not read twice.

Files are written whole and do not change (writers rename them into place); names that begin with a dot or
an underscore are not part of the feed.  A ledger belongs to one checkpoint and has one writer, the driver of
that stream.  A crash leaves it at worst ahead of the checkpoint, which only means files that wait.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from depotlens.schemas import CHANGE
from depotlens.session import share_package

#: Entry files of a ledger before they are merged into one.
MERGE = 64
#: Bytes of feed files that one task reads; a larger file is one task.
TASK_BYTES = 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


class Ledger:
    """The numbered files of the feed at ``feed``, kept in the folder ``path``."""

    def __init__(self, path: str, feed: str, merge: int = MERGE) -> None:
        self._fs, self._at = _open(path)
        self._feed_fs, self._feed = _open(feed)
        self._merge = merge
        self._count, self._known = 0, set()
        for first, last in self._covering():
            self._known.update(name for name, _ in self._entry(first, last))
            self._count = last

    def _read(self, name: str):
        with self._fs.open_input_stream(f"{self._at}/{name}") as stream:
            return json.loads(stream.read())

    def _write(self, name: str, content) -> None:
        """The file appears whole under its name or not at all."""
        self._fs.create_dir(f"{self._at}/entries", recursive=True)
        begun = f"{self._at}/.{name.replace('/', '-')}.begun"
        with self._fs.open_output_stream(begun) as stream:
            stream.write(json.dumps(content).encode())
        self._fs.move(begun, f"{self._at}/{name}")

    def _entry(self, first: int, last: int) -> list[list]:
        return self._read(f"entries/{first:015d}-{last:015d}.json")

    def _entries(self) -> list[tuple[int, int]]:
        found = self._fs.get_file_info(fs.FileSelector(f"{self._at}/entries", allow_not_found=True))
        spans = [tuple(map(int, f.base_name[:-5].split("-"))) for f in found if f.base_name.endswith(".json")]
        return sorted(spans, key=lambda s: (s[0], -s[1]))

    def _covering(self) -> list[tuple[int, int]]:
        """Entries from the first file on.  What a merge has replaced but not yet removed is passed over."""
        taken, until = [], 0
        for first, last in self._entries():
            if first > until:
                raise RuntimeError(f"ledger {self._at} lacks the files {until} to {first}")
            if first == until:
                taken.append((first, last))
                until = last
        return taken

    def refresh(self) -> int:
        """Numbers the files that are new, by time and name, and returns how many there are in all."""
        listed = self._feed_fs.get_file_info(fs.FileSelector(self._feed, recursive=True, allow_not_found=True))
        new = []
        for f in listed:
            name = f.path[len(self._feed):].lstrip("/") if f.path.startswith(self._feed) else f.path
            hidden = any(part[0] in "._" for part in name.split("/"))
            if f.type == fs.FileType.File and not hidden and name not in self._known:
                new.append((f.mtime_ns or 0, name, f.size))
        if new:
            files = [[name, size] for _, name, size in sorted(new)]
            self._write(f"entries/{self._count:015d}-{self._count + len(files):015d}.json", files)
            self._known.update(name for name, _ in files)
            self._count += len(files)
        return self._count

    def start(self, wanted: str) -> int:
        """Where the stream began.  It is settled once, so a batch that is repeated begins where it did."""
        info = self._fs.get_file_info(f"{self._at}/start.json")
        if info.type == fs.FileType.File:
            return self._read("start.json")
        begin = {"latest": self.refresh, "earliest": lambda: 0}.get(wanted, lambda: int(wanted))()
        if not 0 <= begin <= self.refresh():
            raise ValueError(f"the feed has {self._count} files, it cannot start at {begin}")
        self._write("start.json", begin)
        return begin

    def files(self, first: int, last: int) -> list[tuple[str, int]]:
        """Full names and sizes of the files from number ``first`` to before ``last``."""
        found = []
        for low, high in self._covering():
            if low < last and high > first:
                found += self._entry(low, high)[max(first - low, 0):last - low]
        if len(found) != max(last - first, 0):
            raise ValueError(f"the ledger has no files {first} to {last}")
        return [(f"{self._feed}/{name}", size) for name, size in found]

    def merge(self) -> None:
        """Many small entries become one, which is in place before the old ones go."""
        entries = self._entries()
        if len(entries) < self._merge:
            return
        covering = self._covering()
        if len(covering) > 1:
            files = [f for span in covering for f in self._entry(*span)]
            self._write(f"entries/{0:015d}-{covering[-1][1]:015d}.json", files)
        for first, last in entries:
            if (first, last) != (0, covering[-1][1]):
                self._fs.delete_file(f"{self._at}/entries/{first:015d}-{last:015d}.json")


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(None)
        self.files = files


class _Reading:
    """What the stream and the replay of a range have in common."""

    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, dict(options)

    def ledger(self) -> Ledger:
        return Ledger(self.options["ledger"], self.options["path"])

    def tasks(self, files: list[tuple[str, int]]) -> list[_Files]:
        tasks, held = [], 0
        for name, size in files:
            if not tasks or held + size > TASK_BYTES:
                tasks.append([])
                held = 0
            tasks[-1].append((name, size))
            held += size
        return [_Files(t) for t in tasks]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        store, _ = _open(self.options["path"])
        for name, size in partition.files:
            if store.get_file_info(name).size != size:
                raise RuntimeError(f"{name} is not the file that was found; files of a feed do not change")
            if size:
                batches = _parquet if self.options.get("files", "json") == "parquet" else _json
                for batch in batches(store, name, wanted):
                    yield _fitted(batch, wanted, self.options.get("zone", "UTC"))


def _json(store: fs.FileSystem, name: str, wanted: pa.Schema) -> Iterator[pa.RecordBatch]:
    texts = pa.schema([pa.field(f.name, pa.string() if pa.types.is_temporal(f.type) else f.type) for f in wanted])
    how = pj.ParseOptions(explicit_schema=texts, unexpected_field_behavior="ignore")
    with store.open_input_stream(name) as stream:
        yield from pj.open_json(stream, pj.ReadOptions(block_size=4 << 20), how)


def _parquet(store: fs.FileSystem, name: str, wanted: pa.Schema) -> Iterator[pa.RecordBatch]:
    with pq.ParquetFile(store.open_input_file(name)) as file:
        there = set(file.schema_arrow.names)
        yield from file.iter_batches(columns=[n for n in wanted.names if n in there])


def _instants(values: pa.Array, kind: pa.TimestampType, zone: str) -> pa.Array:
    """Timestamps; where a text or a file names no zone, it is the session's, as in Spark's own readers."""
    bare = pa.timestamp(kind.unit)
    if pa.types.is_string(values.type):
        named = pc.match_substring_regex(values, r"(Z|[+-]\d\d:?\d\d)$")
        none = pa.scalar(None, pa.string())
        with_zone = pc.if_else(named, values, none).cast(pa.timestamp(kind.unit, "UTC")).cast(kind)
        without = _instants(pc.if_else(named, none, values).cast(bare), kind, zone)
        return pc.coalesce(with_zone, without)
    if pa.types.is_timestamp(values.type) and values.type.tz is None:
        return pc.assume_timezone(values.cast(bare), zone, ambiguous="earliest", nonexistent="latest").cast(kind)
    return values.cast(kind)


def _fitted(batch: pa.RecordBatch, wanted: pa.Schema, zone: str) -> pa.RecordBatch:
    """The batch with the columns and types of the feed; a column that a file lacks is null."""
    columns = []
    for f in wanted:
        if f.name not in batch.schema.names:
            columns.append(pa.nulls(batch.num_rows, f.type))
        elif pa.types.is_timestamp(f.type) and f.type.tz is not None:
            columns.append(_instants(batch.column(f.name), f.type, zone))
        else:
            columns.append(batch.column(f.name).cast(f.type))
    return pa.RecordBatch.from_arrays(columns, schema=wanted)


class _FeedStream(_Reading, DataSourceStreamReader):
    _opened: Ledger | None = None

    def _known(self) -> Ledger:
        # The stream's reader lives as long as the query, so files are listed, not numbered anew, each time.
        if self._opened is None:
            self._opened = self.ledger()
            self._opened.start(self.options.get("start", "latest"))
        return self._opened

    def initialOffset(self) -> dict:
        return {"file": self._known().start(self.options.get("start", "latest"))}

    def latestOffset(self) -> dict:
        return {"file": self._known().refresh()}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        return self.tasks(self._known().files(start["file"], end["file"]))

    def commit(self, end: dict) -> None:
        self._known().merge()


class _FeedRange(_Reading, DataSourceReader):
    def partitions(self) -> list[_Files]:
        return self.tasks(self.ledger().files(int(self.options["first"]), int(self.options["last"])))


class NumberedFeed(DataSource):
    """Options: ``path``, ``ledger``, ``files`` (json or parquet); streams ``start``; ranges ``first``, ``last``."""

    @classmethod
    def name(cls) -> str:
        return "numbered_feed"

    def schema(self) -> T.StructType:
        return CHANGE

    def reader(self, schema: T.StructType) -> _FeedRange:
        return _FeedRange(schema, self.options)

    def streamReader(self, schema: T.StructType) -> _FeedStream:
        return _FeedStream(schema, self.options)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def _prepared(reader, spark: SparkSession, path: str, ledger: str, schema: T.StructType, files: str):
    share_package(spark)
    spark.dataSource.register(NumberedFeed)
    source = reader.format("numbered_feed").schema(_nullable(schema))
    return source.option("path", path).option("ledger", ledger).option("files", files).option(
        "zone", spark.conf.get("spark.sql.session.timeZone"))


def read_feed(
    spark: SparkSession, path: str, ledger: str, start: str | int = "latest", schema: T.StructType = CHANGE,
    files: str = "json",
) -> DataFrame:
    """The feed at ``path`` as a stream from ``start``: "latest", "earliest" or the number of a file.

    ``ledger`` is a folder of this stream alone, best below its checkpoint.  ``start`` counts when the ledger
    is new; afterwards the checkpoint decides.  A micro-batch takes all files there are, split over tasks by
    their bytes.
    """
    return _prepared(spark.readStream, spark, path, ledger, schema, files).option("start", str(start)).load()


def replay_feed(
    spark: SparkSession, path: str, ledger: str, first: int, last: int, schema: T.StructType = CHANGE,
    files: str = "json",
) -> DataFrame:
    """Once more the files from number ``first`` to before ``last``, as a table."""
    source = _prepared(spark.read, spark, path, ledger, schema, files)
    return source.option("first", str(first)).option("last", str(last)).load()


def feed_length(path: str, ledger: str) -> int:
    """How many files the stream of this ledger has found so far."""
    return Ledger(ledger, path)._count
