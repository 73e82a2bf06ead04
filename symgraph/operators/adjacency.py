"""Dense node numbers, adjacency bucketed both ways, and a sorted table for lookups by name.

``encode`` numbers nodes in the order of their ids: rows are range-sorted, each range counts its own, and the
counts' running sums (a row a range) shift them. Edges are then two numbers, a kind's place in ``KINDS``, the
number of the file they come from and a reason; every string of an edge follows from those and the node table.

``Adjacency`` keeps the edges in two tables, bucketed and sorted by source and by destination. A frontier that is
too large to be broadcast is dealt to the same buckets, eight bytes a node, and meets the edges where they are:
edges are never shuffled for a hop. Strings are joined at the end, to the rows of the result.

``lookup`` rows (key, id) stand for every id, name and qualified name, range-sorted by key, with Bloom filters:
a lookup reads the row groups that may hold its key and no others.

The tables live in the session's catalog and warehouse, which a cluster's executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_id, file_id, norm_path
from .query import IMPACT_KINDS, NotFound

#: Kinds of edges, by the number that stands for them.
KINDS = ("Contains", "Defines", "Imports", "References", "Calls", "Inherits", "Implements", "DependsOn", "OwnedBy")
#: Frontiers up to this many nodes are broadcast; larger ones are dealt to the edges' buckets.
FRONTIER_ROWS = 100_000
#: Node rows up to this many are read by a list of their numbers.
FEW = 200
EDGE_COLUMNS = ["id", "kind", "src", "dst", "file_path", "reason"]


def dense_numbers(ids: DataFrame, keep) -> DataFrame:
    """``id, nid``: distinct ``id`` numbered from 0 in their order. ``keep`` writes a table."""
    ranged = ids.select("id").distinct().repartitionByRange(F.col("id")).sortWithinPartitions("id")
    low = F.lit((1 << 33) - 1)
    rows = keep(ranged.select("id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(low).alias("place")))
    counts = rows.groupBy("range").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("range", before.alias("start")))  # a row a range
    return rows.join(starts, "range").select("id", (F.col("start") + F.col("place")).alias("nid"))


def kind_number(kind: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1).cast("tinyint")


def encode(nodes: DataFrame, edges: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``nid``, and edges as ``src, dst, kind, doc, reason``: numbers of nodes and of the edge's file. The
    two ends and the file are looked up one after the other, and each join after the first carries numbers only."""
    numbers = keep(dense_numbers(nodes.select("id"), keep))
    files = keep(numbers.where(F.col("id").startswith("file::")))  # far fewer than edges, each in very many of them
    e = edges.select("src", "dst", kind_number(F.col("kind")).alias("kind"), "reason", file_id(norm_path(F.col("file_path"))).alias("doc"))
    for c in ("doc", "src", "dst"):
        named = (files if c == "doc" else numbers).select(F.col("id").alias(c), F.col("nid").alias(f"{c}_"))
        e = e.join(named, c, "left" if c == "doc" else "inner").drop(c).withColumnRenamed(f"{c}_", c)
    return nodes.join(numbers, "id"), e.select("src", "dst", "kind", "doc", "reason")


class Adjacency:
    """A stored graph: tables ``{name}_nodes, _out, _in, _keys`` of the session's catalog."""

    def __init__(self, spark: SparkSession, name: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets

    @classmethod
    def store(cls, name: str, nodes: DataFrame, edges: DataFrame, keep, buckets: int | None = None) -> Adjacency:
        """Write the tables anew. There are as many buckets as the session has shuffle partitions, unless they are given."""
        spark = nodes.sparkSession
        self = cls(spark, name, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        numbered, coded = encode(nodes, edges, keep)
        numbered, coded = keep.write(numbered), keep.write(coded)
        for table in ("nodes", "out", "in", "keys"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")
        numbered.repartition(self.buckets, "nid").write.bucketBy(self.buckets, "nid").sortBy("nid").option("parquet.page.row.count.limit", 1000).saveAsTable(f"{name}_nodes")
        for table, by in (("out", "src"), ("in", "dst")):
            coded.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by).saveAsTable(f"{name}_{table}")
        keys = lookup_rows(numbered)
        keys.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.page.row.count.limit", 1000).saveAsTable(f"{name}_keys")
        return self

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def resolve(self, target: str) -> tuple[int, str]:
        """Number and id of the node with this id, else of the least id with this name or qualified name."""
        row = self.table("keys").where(F.col("key") == target).orderBy(F.col("id") != target, "id").select("nid", "id").first()
        if row is None:
            raise NotFound(target)
        return row["nid"], row["id"]

    def hop(self, frontier: DataFrame, inbound: bool, kinds: tuple[str, ...], small: bool) -> DataFrame:
        """Edges out of (or into) the nodes ``nid`` of a frontier. One that is not small is dealt to the edges' buckets."""
        by = "dst" if inbound else "src"
        edges = self.table("in" if inbound else "out").where(F.col("kind").isin(*[KINDS.index(k) for k in kinds]))
        at = frontier.select(F.col("nid").alias(by))
        at = F.broadcast(at) if small else at.repartition(self.buckets, by).hint("shuffle_merge")
        return edges.join(at, by, "left_semi")

    def traverse(self, target: str, depth: int, kinds: tuple[str, ...], direction: str, keep, limit: int = FRONTIER_ROWS) -> tuple[int, DataFrame, DataFrame]:
        """Bounded breadth-first search in numbers: target, ``nid, level`` of what is reached, edges of expanded nodes."""
        t = self.resolve(target)[0]
        seen = frontier = self.spark.createDataFrame([(t, 0)], "nid long, level int")
        rows, hops = 1, []
        for level in range(depth):
            some = [keep.write(self.hop(frontier, d == "inbound", kinds, rows <= limit)) for d in ("outbound", "inbound") if direction in (d, "both")]
            hops += some
            ends = [h.select(F.col(c).alias("nid")) for h, c in zip(some, [c for d, c in (("outbound", "dst"), ("inbound", "src")) if direction in (d, "both")], strict=True)]
            ends = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
            frontier = keep.write(ends.distinct().join(seen, "nid", "left_anti").withColumn("level", F.lit(level + 1)))
            rows = frontier.limit(limit + 1).count()
            seen = seen.unionByName(frontier)
            if not rows:
                break
        columns = ["src", "dst", "kind", "doc", "reason"]
        found = self.table("out").limit(0) if not hops else hops[0]
        for h in hops[1:]:
            found = found.unionByName(h)
        # Each level expands other nodes, so an edge comes twice only where both directions are walked.
        return t, seen, found.select(*columns).distinct() if direction == "both" else found.select(*columns)

    def node_rows(self, nids: DataFrame) -> DataFrame:
        """Nodes by number: a few are read from their buckets and pages, more are met in the buckets."""
        some = nids.select("nid").distinct().limit(FEW + 1).collect()  # FEW numbers at most, or a sign that there are more
        if len(some) <= FEW:
            return self.table("nodes").where(F.col("nid").isin([r[0] for r in some])).drop("nid")
        return self.table("nodes").join(nids.select("nid").distinct(), "nid", "left_semi").drop("nid")

    def edge_rows(self, coded: DataFrame) -> DataFrame:
        """Edges as they were before they were numbered."""
        nodes = self.table("nodes")
        files = nodes.where("kind = 'File'")
        if files.select("nid").limit(FRONTIER_ROWS + 1).count() <= FRONTIER_ROWS:
            files = F.broadcast(files)  # a file is that of very many edges
        e = coded
        for c in ("doc", "dst", "src"):  # from the bucketed table ``in``, ends are met in its buckets first
            named = (files if c == "doc" else nodes).select(F.col("nid").alias(c), F.col("path" if c == "doc" else "id").alias(f"{c}_"))
            e = e.join(named, c, "left").drop(c).withColumnRenamed(f"{c}_", c)
        kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind").cast("int"))
        return e.select(edge_id(kind, F.col("src"), F.col("dst"), F.col("doc")).alias("id"), kind.alias("kind"), "src", "dst", F.col("doc").alias("file_path"), "reason")

    def dependencies(self, target: str, keep, direction: str = "outbound", depth: int = 2, limit: int = FRONTIER_ROWS) -> tuple[DataFrame, DataFrame]:
        _, seen, e = self.traverse(target, depth, ("DependsOn",), direction, keep, limit)
        return self.node_rows(seen), self.edge_rows(e)

    def impact(self, target: str, keep, depth: int = 3, limit: int = FRONTIER_ROWS) -> tuple[DataFrame, DataFrame]:
        """What the target reaches against the edges; itself only by a cycle."""
        t, seen, e = self.traverse(target, depth, IMPACT_KINDS, "inbound", keep, limit)
        ids = seen.where("level > 0").select("nid").unionByName(e.where(F.col("src") == t).select(F.col("src").alias("nid")))
        return self.node_rows(ids), self.edge_rows(e)

    def drop(self) -> None:
        for table in ("nodes", "out", "in", "keys"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")


def lookup_rows(numbered: DataFrame) -> DataFrame:
    """``key, nid, id``, range-sorted: each id, name and qualified name, once for each node."""
    keys = numbered.select(F.explode(F.array_distinct(F.array("id", "name", "fq_name"))).alias("key"), "nid", "id").where("key IS NOT NULL")
    return keys.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
