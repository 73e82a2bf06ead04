"""Versioned store: each write is a new folder ``v{n}-{writer}``; the pointer ``CURRENT-{n}`` with the highest
number names the one to read.

Pointers never change once they are there, and a writer makes its own by creating it exclusively, so there is
no moment without one, and of two writers of the same number one fails (where the file system's rename does
not overwrite; a local one's may, if they come at the same instant). Readers keep their version: a write
leaves the version before it, and older ones and unfinished writes go only when they are older than
``KEEP_SECONDS``, in a write, never when a store is opened. All through Spark's file systems.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.refresh import overlay

TABLES = ("documents", "nodes", "edges")
#: Folders that no reader can be given any more go after this time.
KEEP_SECONDS = 3600


class StoreError(RuntimeError):
    """The store cannot be read or written."""


class Conflict(StoreError):
    """Another writer has written this version."""


def parts_of(meta: dict) -> list[str]:
    """Folders that a version is read from: a whole one, then changes."""
    return meta.get("parts") or [meta["folder"]]


def store_path(path: str) -> str:
    """A path that names an index is kept; else ``index`` is put below it, without its extension."""
    folder, slash, last = path.rstrip("/").rpartition("/")
    if last == "index":
        return path.rstrip("/")
    stem = last.rsplit(".", 1)[0] if "." in last[1:] else last
    return f"{folder}{slash}{stem}" if "index" in stem else f"{folder}{slash}{stem}/index"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, store_path(path)
        self._path = lambda x="": spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}" if x else self.path)
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path())

    def _pointers(self) -> list[int]:
        names = [x.getPath().getName() for x in self.fs.listStatus(self._path())]
        return sorted(int(m[1]) for m in map(re.compile(r"CURRENT-(\d+)").fullmatch, names) if m)

    def meta(self) -> dict | None:
        """``version, folder, revision, repo_path`` of the current version; none if nothing was written."""
        found = self._pointers()
        if not found:
            return None
        try:
            return json.loads(self.spark.read.text(f"{self.path}/CURRENT-{found[-1]}").first()[0])
        except (TypeError, ValueError) as e:
            raise StoreError(f"the pointer {found[-1]} of {self.path} is damaged") from e

    def read(self, table: str, meta: dict | None = None) -> DataFrame:
        """A table of the current version, or of the one that ``meta`` is of."""
        meta = meta or self.meta()
        if meta is None:
            raise StoreError(f"nothing is stored at {self.path}")
        first, *changes = parts_of(meta)
        df = self.spark.read.parquet(f"{self.path}/{first}/{table}")
        for folder in changes:
            df = overlay(table, df, lambda name, schema, folder=folder: self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{name}"))
        return df

    def size(self) -> int:
        return self.fs.getContentSummary(self._path()).getLength()

    def replace(self, tables: dict[str, DataFrame], repo_path: str, revision: int, keep_seconds: float = KEEP_SECONDS, onto: dict | None = None) -> int:
        """Write a version and point to it; returns the bytes that old versions have freed. With ``onto`` (the meta of
        the current version) the tables are a change of that one."""
        meta = self.meta()
        if onto is not None and (meta is None or meta["version"] != onto["version"]):
            raise Conflict(f"version {onto['version']} of {self.path} is not the current one any more")
        version = (meta["version"] if meta else 0) + 1
        folder = f"v{version}-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            w = df.write.mode("overwrite")
            (w.partitionBy("kind") if name == "edges" else w).parquet(f"{self.path}/{folder}/{name}")
        text = json.dumps({"version": version, "folder": folder, "revision": revision, "repo_path": repo_path, "parts": [*(parts_of(onto) if onto else []), folder]})
        if self.fs.exists(self._path(f"CURRENT-{version}")):
            raise Conflict(f"version {version} of {self.path} is there already")
        # The pointer appears whole: it is written aside and renamed, which fails where one is there.
        aside = self._path(f"_next-{folder}")
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(aside, self._path(f"CURRENT-{version}")):
            self.fs.delete(aside, False)
            raise Conflict(f"cannot point to version {version} of {self.path}")
        before = self.size()
        self.vacuum(keep_seconds)
        return max(0, before - self.size())

    def vacuum(self, keep_seconds: float = KEEP_SECONDS) -> None:
        """Delete what is neither the current version nor the one before, and older than ``keep_seconds``."""
        meta = self.meta()
        current = meta["version"] if meta else 0
        used = set(parts_of(meta)) if meta else set()
        limit = time.time() * 1000 - 1000 * keep_seconds
        for status in self.fs.listStatus(self._path()):
            name = status.getPath().getName()
            m = re.fullmatch(r"(?:_next-)?v(\d+)-\w+|CURRENT-(\d+)", name)
            if m is None or name in used:
                continue
            n = int(m[1] or m[2])
            if not (m[2] and n == current) and n != current - 1 and status.getModificationTime() < limit:
                self.fs.delete(status.getPath(), True)
