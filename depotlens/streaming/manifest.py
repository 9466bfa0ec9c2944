"""Tables made of folders that a manifest names, advanced one version at a time.

A version is one small JSON file: the folders a reader has to read, and whatever the writer needs to go on.
New folders are written first and are invisible until a manifest names them; the manifest is renamed into
place in one step.  A crash before that leaves the last version as it was, and the folders it had begun are
written again under the same names.  Files are reached through the file system of the path, as Spark's own
are, so the driver and any reader see the same versions wherever they run.

There is one writer a path.  A reader that has just read an older version still finds its folders: those of
the last ``KEPT`` versions stay.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

#: Versions whose manifests and folders are kept.
KEPT = 4


class Manifest:
    """The versions of the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path, spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json")]

    def read(self, version: int | None = None) -> dict | None:
        """A version, the newest by default; None where nothing was published."""
        if version is None:
            version = max(self.versions(), default=None)
            if version is None:
                return None
        stream = self._fs.open(self._at(f"manifest/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, content: dict) -> None:
        """Makes ``content`` the version it names; an error if that version is there already."""
        final = self._at(f"manifest/{content['version']:012d}.json")
        if self._fs.exists(final):
            raise RuntimeError(f"version {content['version']} of {self.path} has another writer")
        begun = self._at(f"manifest/.{content['version']:012d}.json.begun")
        stream = self._fs.create(begun, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if not self._fs.rename(begun, final):
            raise RuntimeError(f"could not publish version {content['version']} of {self.path}")

    def folders(self, content: dict | None) -> list[str]:
        """Full names of the folders that a version reads."""
        return [f"{self.path}/{run['folder']}" for run in (content or {}).get("runs", [])]

    def vacuum(self) -> None:
        """Removes manifests before the last ``KEPT`` and data folders that none of those names."""
        versions = sorted(self.versions())
        kept = versions[-KEPT:]
        read = [self.read(v) for v in kept]
        named = {run["folder"] for c in read for run in c["runs"]} | {c["totals"] for c in read if "totals" in c}
        newest = max(kept, default=-1)
        for name in self._names("data"):
            if f"data/{name}" not in named and int(name.split("-")[0]) <= newest:
                self._fs.delete(self._at(f"data/{name}"), True)
        for version in versions[:-KEPT]:
            self._fs.delete(self._at(f"manifest/{version:012d}.json"), False)


def query_id(spark: SparkSession) -> str:
    """The stream that runs the current ``foreachBatch``; it keeps its id across restarts."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
