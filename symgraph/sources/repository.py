"""Source files and manifests of a repository, as a Spark data source.

The driver lists the root and a few folders below it, ``FOLDERS`` at most; executors walk what is below those and
read the files. Filters on ``path`` (equality, prefix, suffix, part) are applied to names, before a file is read, with
the option ``pushdown`` (set where ``spark.sql.python.filterPushdown.enabled`` is). Spark's own file sources hide names that begin with ``_`` or ``.``,
which a repository needs (``__init__.py``, ``.github``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ..functions.ids import EXTENSIONS, language_of, norm_path

#: Names that a walk leaves out, files and folders alike.
SKIPPED = (".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "dist", "build", "target", ".symgraph", "__pycache__", ".venv", "venv")
FILES_PER_TASK = 200
#: Folders that the driver opens; what is below them is walked by executors, a folder a task.
FOLDERS = 64


def known(name: str) -> bool:
    stem, dot, ext = name.rpartition(".")
    return bool(stem and dot) and ext.lower() in EXTENSIONS


def walk(root: str, skip: bool = True) -> Iterator[str]:
    """Paths of the files below ``root``, sorted; the root's own name counts as well."""
    if skip and os.path.basename(root.rstrip("/")) in SKIPPED:
        return

    def fail(error: OSError):
        raise error

    for folder, inner, names in os.walk(root, onerror=fail):
        inner[:] = sorted(x for x in inner if not (skip and x in SKIPPED))
        yield from (os.path.join(folder, x) for x in sorted(names) if not (skip and x in SKIPPED))


def spread(root: str, skip: bool = True, folders: int = FOLDERS) -> tuple[list[str], list[str]]:
    """Files of the root and of the folders that are opened, level by level, and the folders left to be walked."""
    if skip and os.path.basename(root.rstrip("/")) in SKIPPED:
        return [], []
    files, left, opened = [], [root], 0
    while left and opened < folders:
        folder, opened = left.pop(0), opened + 1
        with os.scandir(folder) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                if not (skip and e.name in SKIPPED):
                    if e.is_dir(follow_symlinks=False):
                        left.append(e.path)
                    elif not e.is_dir():
                        files.append(e.path)
    return files, left


#: Tests of a path by filters that are pushed down.
TESTS = {EqualTo: str.__eq__, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__, In: lambda path, values: path in values}


class _Files(InputPartition):
    def __init__(self, paths: list[str], folder: str | None = None):
        self.paths, self.folder = paths, folder


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.filters = options, []
        self.manifests = options.get("manifests") == "true"

    def _wanted(self, path: str) -> bool:
        name = os.path.basename(path)
        if not (self.options.get("paths") or (name == "Cargo.toml" if self.manifests else known(name))):
            return False
        return all(TESTS[kind](path, value) for kind, value in self.filters)

    def partitions(self):
        o, folders = self.options, []
        if o.get("paths"):
            paths = [p for p in o["paths"].split("\n") if os.path.isfile(p)]
        else:
            paths, folders = spread(o["path"], not self.manifests)
        paths = [p for p in paths if self._wanted(p)]
        parts = [_Files(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)]
        return [*parts, *[_Files([], x) for x in folders]] or [_Files([])]

    def read(self, partition):
        below = walk(partition.folder, not self.manifests) if partition.folder else []
        for p in (*partition.paths, *(x for x in below if self._wanted(x))):
            with open(p, "rb") as f:
                yield p, f.read().decode("utf-8")  # other encodings fail, as the walk's errors do


class _FilteringReader(_Reader):
    """Spark takes a reader with this method only where the session pushes filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the path are applied by name; others are left to Spark."""
        for f in filters:
            if type(f) in TESTS and f.attribute == ("path",):
                self.filters.append((type(f), f.value))
            else:
                yield f


class RepositorySource(DataSource):
    """``spark.read.format("repository")`` with ``path`` (a folder that executors see), ``manifests`` or ``paths``."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, source string"

    def reader(self, schema) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushdown") == "true" else _Reader)(self.options)


def _read(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(RepositorySource)
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("repository").options(**options).load()


def files(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """``doc_key, path, language, source`` of the files in known languages (of ``paths`` only, if given)."""
    raw = _read(spark, path=root) if paths is None else _read(spark, path=root, paths="\n".join(paths))
    return with_language(raw)


def with_language(raw: DataFrame) -> DataFrame:
    """``path, source`` with key and language; unknown languages go, of equal keys the last path stays."""
    found = raw.select(norm_path(F.col("path")).alias("doc_key"), "path", language_of(F.col("path")).alias("language"), "source").where("language IS NOT NULL")
    return found.groupBy("doc_key").agg(F.max_by(F.struct("path", "language", "source"), "path").alias("x")).select("doc_key", "x.*")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, path=root, manifests="true").withColumnRenamed("source", "content")
