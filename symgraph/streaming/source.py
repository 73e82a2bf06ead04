"""Changes of a repository's files as a stream, with offsets: ``spark.readStream.format("repository_changes")``.

An offset is the number of a snapshot: path, time and size of each file, kept as a file of the folder ``log``. A new one
is written only when the repository differs from the last one, so an offset means the same files after a restart,
and a batch from one to another is the difference of two snapshots: nothing is lost, whatever happened meanwhile, and
nothing comes twice. Executors read the changed files, ``FILES_PER_TASK`` a task; the driver sees names only. A commit
deletes the snapshots before it. Both folders must be seen by the driver and all executors.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.repository import FILES_PER_TASK, known, walk

SCHEMA = "path string, op string, source string, seq long"


def snapshot(root: str) -> dict[str, list[int]]:
    """Time and size of each file below a folder that an index may hold."""
    found = {}
    for path in walk(root):
        if known(os.path.basename(path)):
            try:
                s = os.stat(path)
            except FileNotFoundError:  # it went meanwhile
                continue
            found[path] = [s.st_mtime_ns, s.st_size]
    return found


class _Changes(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int]]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.log = os.path.realpath(options["path"]), options["log"]
        self.everything = options.get("from", "nothing") == "nothing"
        os.makedirs(self.log, exist_ok=True)

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(re.compile(r"snapshot-(\d+)\.json").fullmatch, os.listdir(self.log)) if m)

    def _load(self, n: int) -> dict[str, list[int]]:
        with open(f"{self.log}/snapshot-{n}.json", encoding="utf-8") as f:
            return json.load(f)

    def _store(self, n: int, files: dict) -> None:
        aside = f"{self.log}/.{uuid.uuid4().hex}"
        with open(aside, "w", encoding="utf-8") as f:
            json.dump(files, f)
        os.replace(aside, f"{self.log}/snapshot-{n}.json")

    def initialOffset(self) -> dict:
        """Before any file, or (``from`` = ``now``) at the files as they are."""
        if not self._numbers():
            self._store(0, {} if self.everything else snapshot(self.root))
        return {"snapshot": self._numbers()[0]}

    def latestOffset(self) -> dict:
        numbers, now = self._numbers(), snapshot(self.root)
        if not numbers:
            self._store(0, {} if self.everything else now)
            numbers = [0]
        if self._load(numbers[-1]) == now:
            return {"snapshot": numbers[-1]}
        self._store(numbers[-1] + 1, now)
        return {"snapshot": numbers[-1] + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self._load(start["snapshot"]), self._load(end["snapshot"])
        rows = [(p, "upsert" if p in after else "delete", end["snapshot"]) for p in sorted(before.keys() | after.keys()) if before.get(p) != after.get(p)]
        return [_Changes(rows[i : i + FILES_PER_TASK]) for i in range(0, len(rows), FILES_PER_TASK)]

    def read(self, partition):
        for path, op, seq in partition.rows:
            source = None
            if op == "upsert":
                try:
                    with open(path, "rb") as f:
                        source = f.read().decode("utf-8")
                except FileNotFoundError:  # it went since; the next snapshot says so
                    continue
            yield path, op, source, seq

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["snapshot"]:
                os.remove(f"{self.log}/snapshot-{n}.json")


class RepositoryChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def repository_changes(spark: SparkSession, root: str, log: str, start: str = "now") -> DataFrame:
    """The stream ``path, op, source, seq`` of a repository's changes from now on, or from ``nothing``."""
    spark.dataSource.register(RepositoryChanges)
    return spark.readStream.format("repository_changes").options(**{"path": root, "log": log, "from": start}).load()
