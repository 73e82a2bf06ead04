"""A repository's session: index, refresh, watch, queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import LANGUAGES, norm_path
from .functions.scanner import RULES
from .operators.build import build_graph
from .operators.extract import extract_documents, tables
from .operators.packages import package_graph
from .operators.query import Graph
from .operators.refresh import apply_delta, graph_delta, next_documents, written
from .sources import repository
from .sources.shared import Keeper
from .sources.store import Store, parts_of

#: Changes that a version is read with; the next one writes it as a whole first.
MAX_PARTS = 16
#: A change that reaches a greater share of the documents is written as a whole version; others apart.
WHOLE_SHARE = 0.1


def memory_budget(value: str | None) -> int | None:
    """Megabytes of a setting: 1024 if unset or blank, none if 0; other text is an error. Spark's own memory
    manager does the guarding."""
    n = int(value) if value and value.strip() else 1024
    if n < 0:
        raise ValueError(f"no memory budget: {value}")
    return n or None


class RepositorySession:
    def __init__(self, spark: SparkSession, repo_path: str, store_path: str):
        self.spark, self.repo_path, self.store = spark, os.path.realpath(repo_path), Store(spark, store_path)

    def build_full(self) -> dict:
        """Index the whole repository; its revision is 1."""
        return self._write(extract_documents(repository.files(self.spark, self.repo_path)), 1)

    def _write(self, documents: DataFrame, revision: int) -> dict:
        documents = documents.persist()
        try:
            nodes, edges = build_graph(self.repo_path, *tables(documents))
            freed = self.store.replace({"documents": documents, "nodes": nodes, "edges": edges}, self.repo_path, revision)
        finally:
            documents.unpersist()
        return self.stats() | {"bytes_reclaimed": freed}

    def stats(self) -> dict:
        meta = self.store.meta() or {"revision": 0}
        if not meta["revision"]:
            return {"revision": 0, "file_count": 0, "symbol_count": 0, "edge_count": 0, "bytes_reclaimed": None}
        count = lambda t, where="true": self.store.read(t).where(where).count()
        return {"revision": meta["revision"], "file_count": count("documents"), "symbol_count": count("nodes", "kind = 'Symbol'"), "edge_count": count("edges"), "bytes_reclaimed": None}

    def refresh_paths(self, paths: list[str]) -> dict:
        """Take over changed files; missing paths go with all below them, existing folders change nothing, and
        without any change the revision stays."""
        paths = [os.path.normpath(os.path.join(self.repo_path, p)) for p in paths]
        present = [p for p in paths if os.path.isfile(p)]
        key = lambda p: p.replace("\\", "/").translate({i: i + 32 for i in range(65, 91)})
        changes = [(key(p), "file" if os.path.isfile(p) else "missing") for p in paths if not os.path.isdir(p)]
        return self.apply_changes(self.spark.createDataFrame(changes, "key string, state string"), repository.files(self.spark, self.repo_path, present))

    def apply_changes(self, changes: DataFrame, files: DataFrame) -> dict:
        """``changes`` (key, state): keys whose documents ``files`` replace, or that are missing, folders included. Only
        edges and nodes that the change reaches are built and written."""
        if self.store.meta() is None:
            return self.build_full()
        meta = self.store.meta()
        old = self.store.read("documents", meta)
        new = extract_documents(files).persist()
        # A document goes if its key or a folder above it is named: equal keys only, no prefix join.
        parts = F.split("doc_key", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        named = old.select("doc_key", F.explode(above).alias("key")).join(changes.distinct(), "key").where("state = 'missing' OR key = doc_key").select("doc_key").distinct()
        kept = new.select("doc_key", "content_hash", "language").join(old.select("doc_key", "content_hash", "language"), ["doc_key", "content_hash", "language"])
        gone = named.join(kept.select("doc_key"), "doc_key", "left_anti")
        changed = new.join(kept.select("doc_key"), "doc_key", "left_anti")
        keep = Keeper(self.spark)
        try:
            if gone.isEmpty() and changed.isEmpty():
                return self.stats()
            if len(parts_of(meta)) > MAX_PARTS:
                meta = self.compact()
                old = self.store.read("documents", meta)
            delta = graph_delta(self.repo_path, tables(old), tables(changed), gone, keep)
            if delta.replaced.count() > WHOLE_SHARE * old.count():
                nodes, edges = apply_delta(self.store.read("nodes", meta), self.store.read("edges", meta), delta)
                whole = {"documents": next_documents(old, delta.touched, changed.select(*old.columns)), "nodes": nodes, "edges": edges}
                freed = self.store.replace(whole, self.repo_path, meta["revision"] + 1)
            else:
                freed = self.store.replace(written(delta, changed), self.repo_path, meta["revision"] + 1, onto=meta)
        finally:
            keep.release()
            new.unpersist()
        return self.stats() | {"bytes_reclaimed": freed}

    def compact(self) -> dict:
        """Write the current version as a whole, without its changes apart; the revision stays. Nothing is built anew."""
        meta = self.store.meta()
        self.store.replace({t: self.store.read(t, meta) for t in ("documents", "nodes", "edges")}, self.repo_path, meta["revision"])
        return self.store.meta()

    def graph(self) -> Graph:
        """The graph of the current version; later writes leave it as it is."""
        meta = self.store.meta()
        return Graph(self.store.read("nodes", meta), self.store.read("edges", meta).select("id", "kind", "src", "dst", "file_path", "reason"))

    def explain(self, target: str) -> DataFrame:
        return self.graph().explain(target, self.snippet)

    def register_views(self) -> None:
        """SQL views ``nodes, edges, documents, symbols, relations`` of the current version."""
        meta, g = self.store.meta(), self.graph()
        g.nodes.createOrReplaceTempView("nodes")
        g.edges.createOrReplaceTempView("edges")
        documents = self.store.read("documents", meta)
        for name, df in zip(("documents", "symbols", "relations"), tables(documents), strict=True):
            df.createOrReplaceTempView(name)

    def package_graph(self) -> tuple[DataFrame, DataFrame]:
        return package_graph(self.graph(), repository.manifests(self.spark, self.repo_path))

    def snippet(self, node_id: str, lines: int = 40) -> str | None:
        """Lines of a symbol in its file as it is now."""
        row = self.store.read("nodes").where(F.col("id") == node_id).select("path", "start_line", "end_line").first()
        if row is None or row["start_line"] is None or not os.path.isfile(row["path"]):
            return None
        with open(row["path"], encoding="utf-8", newline="") as f:
            found = [x.removesuffix("\r") for x in f.read().split("\n")]
        return "\n".join(found[row["start_line"] - 1 : min(row["end_line"], row["start_line"] - 1 + lines)]) or None

    def indexed_files(self) -> DataFrame:
        return self.store.read("documents").select("doc_key").distinct()

    def health(self) -> dict:
        s = self.stats()
        return {"repo_path": self.repo_path, "revision": s["revision"], "indexed_files": s["file_count"], "supported_languages": list(LANGUAGES), "scanned_languages": sorted(RULES)}


def change_keys(paths: DataFrame) -> DataFrame:
    """``path`` of change events as keys, without those in skipped folders."""
    split = F.split(F.translate("path", "\\", "/"), "/")
    return paths.where(~F.arrays_overlap(split, F.array(*[F.lit(x) for x in repository.SKIPPED]))).select(norm_path(F.col("path")).alias("key"))
