"""Typed queries over the graph: every method returns DataFrames; only a target's id is looked up eagerly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ascii_lower, norm_path

IMPACT_KINDS = ("DependsOn", "Calls", "References", "Imports")
#: Frontiers up to this many nodes are broadcast to the edges; larger ones shuffle.
FRONTIER_ROWS = 100_000


class NotFound(LookupError):
    """No node has this id, name or qualified name."""


@dataclass(frozen=True)
class SymbolFilter:
    name: str | None = None
    fq_name: str | None = None
    kind: str | None = None
    name_contains: str | None = None
    name_prefix: str | None = None
    limit: int | None = 50
    unlimited: bool = False


def _lower(x: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


class Graph:
    """Nodes and edges, as built or read from a store."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def resolve(self, target: str) -> str:
        """The node with this id, else the least id with this name or qualified name."""
        t = F.lit(target)
        n = self.nodes.where((F.col("id") == t) | (F.col("name") == t) | (F.col("fq_name") == t))
        row = n.orderBy(F.col("id") != t, "id").select("id").first()
        if row is None:
            raise NotFound(target)
        return row["id"]

    def node(self, node_id: str) -> DataFrame:
        """The node with exactly this id; an error if there is none."""
        found = self.nodes.where(F.col("id") == node_id)
        if found.isEmpty():
            raise NotFound(node_id)
        return found

    def _rows(self, ids: DataFrame) -> DataFrame:
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi")

    def find_symbol(self, f: SymbolFilter) -> DataFrame:
        n = self.nodes.where("kind = 'Symbol'")
        for column, value in (("name", f.name), ("fq_name", f.fq_name), ("symbol_kind", f.kind)):
            n = n if value is None else n.where(F.col(column) == value)
        if f.name_contains is not None:
            n = n.where(ascii_lower(F.col("name")).contains(_lower(f.name_contains)))
        if f.name_prefix is not None:
            n = n.where(ascii_lower(F.col("name")).startswith(_lower(f.name_prefix)))
        return n if f.unlimited else n.orderBy("id").limit(50 if f.limit is None else f.limit)

    def neighbours(self, target: str, kinds: tuple[str, ...], inbound: bool) -> tuple[DataFrame, DataFrame]:
        """Edges of ``kinds`` into (or out of) the target, and the target with their endpoints."""
        t = self.resolve(target)
        e = self.edges.where(F.col("kind").isin(*kinds) & (F.col("dst" if inbound else "src") == t))
        ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
        return self._rows(ids.unionByName(self.nodes.where(F.col("id") == t).select("id"))), e

    def callers(self, target: str) -> tuple[DataFrame, DataFrame]:
        return self.neighbours(target, ("Calls",), True)

    def callees(self, target: str) -> tuple[DataFrame, DataFrame]:
        return self.neighbours(target, ("Calls",), False)

    def references(self, target: str) -> DataFrame:
        """References to the target; one source row per edge."""
        t = self.resolve(target)
        e = self.edges.where(F.col("kind").isin("References", "Calls", "Imports") & (F.col("dst") == t))
        return e.select(F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), "src").join(self.nodes.withColumnRenamed("id", "src"), "src")

    def traverse(self, target: str, depth: int, kinds: tuple[str, ...], direction: str) -> tuple[str, DataFrame, DataFrame]:
        """Bounded breadth-first search: target, ``id, level`` of what is reached, edges of expanded nodes."""
        t = self.resolve(target)
        edges = self.edges.where(F.col("kind").isin(*kinds))
        spark = self.nodes.sparkSession
        seen = frontier = spark.createDataFrame([(t, 0)], "id string, level int")
        before, rows = None, 1
        for level in range(depth):
            near = F.broadcast(frontier)
            if level:
                n = frontier.limit(FRONTIER_ROWS + 1).count()
                if not n:
                    break
                near, rows = near if n <= FRONTIER_ROWS else frontier, rows + n
            at = near.select(F.col("id").alias("cur"))
            on = {"outbound": F.col("src") == F.col("cur"), "inbound": F.col("dst") == F.col("cur")}
            hops = [edges.join(at, on[d]).withColumn("next", F.col("dst" if d == "outbound" else "src")) for d in on if direction in (d, "both")]
            hop = hops[0] if len(hops) == 1 else hops[0].unionByName(hops[1])
            reached = hop.select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("level", F.lit(level + 1))
            # One table of all that is reached so far is kept; the one before is let go once this one is there.
            seen = seen.unionByName(reached).persist()
            frontier = seen.where(F.col("level") == level + 1)
            if level + 1 < depth:
                seen.count()
            if before is not None:
                before.unpersist()
            before = seen
        # Edges of all that was expanded, in one pass; one whose ends both were is taken by its source.
        expanded = seen.where(F.col("level") < depth).select(F.col("id").alias("cur"))
        expanded = F.broadcast(expanded) if rows <= FRONTIER_ROWS else expanded
        found = edges.join(expanded, F.col("dst" if direction == "inbound" else "src") == F.col("cur"), "left_semi")
        if direction == "both":
            found = found.unionByName(edges.join(expanded, F.col("dst") == F.col("cur"), "left_semi").join(expanded, F.col("src") == F.col("cur"), "left_anti"))
        return t, seen, found

    def dependencies(self, target: str, direction: str = "outbound", depth: int = 2) -> tuple[DataFrame, DataFrame]:
        _, seen, e = self.traverse(target, depth, ("DependsOn",), direction)
        return self._rows(seen), e

    def impact(self, target: str, depth: int = 3) -> tuple[DataFrame, DataFrame]:
        """What the target reaches against the edges; itself only by a cycle."""
        t, seen, e = self.traverse(target, depth, IMPACT_KINDS, "inbound")
        ids = seen.where("level > 0").select("id").unionByName(e.where(F.col("src") == t).select(F.col("src").alias("id")))
        return self._rows(ids), e

    def explain(self, target: str, snippet=None) -> DataFrame:
        """One row: counts of all edges in and out, up to five caller and callee names, summary; with
        ``snippet`` (a function of the node's id) its source as well."""
        t = self.resolve(target)
        e = self.edges.where((F.col("src") == t) | (F.col("dst") == t))
        x = e.join(self.nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), F.col("other") == F.when(F.col("dst") == t, F.col("src")).otherwise(F.col("dst")), "left")
        five = lambda c: F.slice(F.array_sort(F.collect_set(F.when(c, F.col("other_name")))), 1, 5)
        c = x.agg(
            F.count_if(F.col("dst") == t).alias("incoming"), F.count_if(F.col("src") == t).alias("outgoing"),
            five((F.col("dst") == t) & F.col("kind").isin("Calls", "References")).alias("top_callers"), five((F.col("src") == t) & (F.col("kind") == "Calls")).alias("top_callees"),
        )
        n = self.nodes.where(F.col("id") == t).select("id", F.coalesce("fq_name", "name").alias("label"), F.coalesce("symbol_kind", "kind").alias("what"), "path", "start_line")
        place = F.coalesce(F.concat("path", F.lit(":"), F.col("start_line").cast("string")), F.lit("unknown location"))
        text = F.concat("label", F.lit(" ["), "what", F.lit("] — "), F.col("incoming").cast("string"), F.lit(" callers, "), F.col("outgoing").cast("string"), F.lit(" dependencies. Defined at "), place, F.lit("."))
        out = n.join(F.broadcast(c)).select("id", text.alias("summary"), "incoming", "outgoing", "top_callers", "top_callees")  # single rows
        return out if snippet is None else out.withColumn("source_snippet", F.lit(snippet(t)))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        q = _lower(query)
        by_name, by_path = ascii_lower(F.col("name")).contains(q), F.coalesce(norm_path(F.col("path")).contains(q), F.lit(False))
        by_fq = F.coalesce(ascii_lower(F.col("fq_name")).contains(q), F.lit(False)) & ~by_name
        plus = lambda c, n: F.when(c, F.lit(n)).otherwise(0)
        kind = F.coalesce("symbol_kind", F.lit(""))
        score = plus(by_name, 50) + plus(by_path, 30) + plus(by_fq, 20) + plus(kind.isin("Type", "Trait", "Interface", "Class"), 10) - plus(kind.isin("Variable", "Constant"), 10)
        why = F.concat_ws(", ", F.when(by_name, "name match"), F.when(by_path, "file path match"), F.when(by_fq, "qualified name match"))
        n = self.nodes.where("kind = 'Symbol'").withColumns({"raw": score, "match_reason": why}).where("raw > 0")
        return n.withColumn("score", F.least(F.lit(100), "raw")).drop("raw").orderBy(F.desc("score"), "name", "id").limit(limit)

    def summary_counts(self) -> DataFrame:
        n = self.nodes.agg(F.count_if(F.col("kind") == "File").alias("files"), F.count_if(F.col("kind") == "Symbol").alias("symbols"))
        return n.join(F.broadcast(self.edges.agg(F.count("*").alias("edges"))))  # single rows

    def languages(self) -> DataFrame:
        """Files by language, most files first."""
        return self.nodes.where("kind = 'File'").groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")

    def top_referenced(self, n: int = 10) -> DataFrame:
        inbound = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))
        return self.nodes.where("kind = 'Symbol'").join(inbound, "id").orderBy(F.desc("inbound"), "name", "id").limit(n).select("id", "name", "inbound")

    def entry_points(self, n: int = 10) -> DataFrame:
        """Functions without any edge in; extracted symbols always have their definition's."""
        f = self.nodes.where("kind = 'Symbol' AND symbol_kind = 'Function'")
        return f.join(self.edges.select(F.col("dst").alias("id")), "id", "left_anti").orderBy("id").limit(n)

    def largest_files(self, n: int = 10) -> DataFrame:
        by = self.nodes.where("kind = 'Symbol' AND path IS NOT NULL").groupBy("path").agg(F.count("*").alias("symbols"))
        return by.orderBy(F.desc("symbols"), F.split("path", "/")).limit(n)
