"""A code graph projected from TPC-H-like tables, to try every operator on data of any size."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_id, norm_path
from ..operators.build import SPAN, build_graph, stored_tables
from ..operators.query import Graph
from ..sources.shared import Keeper

REPO = "/repo"
#: Order keys of a range whose lines are numbered together.
RANGE = 1 << 16
LINE_ORDER = "l_orderkey l_linenumber l_suppkey l_partkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def numbered_lines(lines: DataFrame, names: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Lines with ``k``: their number within a nation in ``LINE_ORDER``; joined to ``orders`` (o_orderkey, o_orderpriority),
    unless they are already. Lines of an order are ranked by the sort that their join needs anyway, and are narrow from there
    on, so a task sorts wide rows once. Then each range of order keys numbers its own, and the counts of the ranges before (a
    row a nation and range) shift them: a nation is never sorted in one task. ``names`` (p_partkey, p_name; each key once)
    are joined before, so that rows stay grouped by nation and shuffle well."""
    of_range = F.floor(F.col("l_orderkey") / RANGE)

    def met(df: DataFrame, how: str) -> DataFrame:
        return df if orders is None else df.join(orders.hint(how), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")

    # Counting needs no order: the keys of orders are hashed, and narrow lines, many of which make a partition, pass unsorted.
    counts = met(lines, "shuffle_hash").select(F.col("s_nationkey").alias("nation_"), of_range.alias("range_")).groupBy("nation_", "range_").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("nation_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select("nation_", "range_", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")))
    own = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[1:]))
    some = lines.withColumn("own", own).drop(*[c for c in LINE_ORDER if c not in ("l_orderkey", "l_suppkey", "l_partkey", "l_linestatus")])
    some = met(some, "shuffle_merge").select("l_orderkey", "own", "l_suppkey", "l_partkey", "l_linestatus", "s_nationkey", "o_orderpriority", of_range.alias("range"))
    some = some.join(names, F.col("l_partkey") == F.col("p_partkey"), "left").drop("l_partkey", "p_partkey")
    # Lines of an order that is there twice have one rank, and a place each.
    place = F.row_number().over(Window.partitionBy("s_nationkey", "range").orderBy("l_orderkey", "own"))
    some = some.withColumn("place", place).drop("l_orderkey", "own")
    return some.join(starts, (F.col("s_nationkey") == F.col("nation_")) & (F.col("range") == F.col("range_"))).withColumn("k", F.col("start") + F.col("place")).drop("nation_", "range_", "range", "start", "place")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, symbols and relations."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # Parquet of regular rows is far smaller than they are in memory: sides that grow are shuffled, whatever their files' size.
    met = lambda df: df.hint("shuffle_merge")
    part = read("part").withColumn("path", F.concat(F.lit("/repo/parts/"), F.translate("p_brand", "#", "_"), F.lit(".rs")))
    nation = F.broadcast(read("nation"))  # 25 rows
    supplier = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("path", F.concat(F.lit("/repo/suppliers/"), "n_name", F.lit(".py")))
    docs = part.select("path", F.lit("rust").alias("language")).unionByName(supplier.select("path", F.lit("python").alias("language"))).distinct()
    docs = docs.select(norm_path(F.col("path")).alias("doc_key"), "path", "language")

    def symbols_of(df: DataFrame, ordinal, kind, name, fq, line, col, parent) -> DataFrame:
        local = F.concat(F.lower(kind), F.lit(":"), name, F.lit(":"), line.cast("string"), F.lit(f":{col}"))
        return df.select(norm_path(F.col("path")).alias("doc_key"), ordinal.cast("long").alias("ordinal"), local.alias("local_id"), name.alias("name"), fq.alias("fq_name"), kind.alias("kind"), parent.alias("parent_local_id"), *[x.cast("int").alias(c) for c, x in zip(SPAN, (line, F.lit(col), line, F.lit(col)), strict=True)])

    none = F.lit(None).cast("string")
    types = F.broadcast(part.select("p_type").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy("p_type"))))  # a handful of types
    kinds = part.select("path", "p_type").distinct().join(types, "p_type")
    fq = F.concat("p_type", F.lit("::"), "p_name")
    symbols = symbols_of(kinds, F.col("rank"), F.lit("Type"), F.col("p_type"), F.col("p_type"), F.lit(1), 1, none)
    symbols = symbols.unionByName(symbols_of(part, 1000 + F.col("p_partkey"), F.lit("Function"), F.col("p_name"), fq, F.col("p_partkey") + 2, 5, F.concat(F.lit("type:"), "p_type", F.lit(":1:1"))))
    kind = F.element_at(F.array(F.lit("Class"), F.lit("Constant"), F.lit("Function")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    symbols = symbols.unionByName(symbols_of(supplier, F.col("s_suppkey"), kind, F.col("s_name"), F.col("s_name"), F.col("s_suppkey") + 1, 1, none))

    of_supplier = F.concat(F.lower(kind), F.lit(":"), "s_name", F.lit(":"), (F.col("s_suppkey") + 1).cast("string"), F.lit(":1"))
    # The wide rows are shuffled once, to meet their orders; names are joined to what is left of them.
    lines = read("lineitem").join(F.broadcast(supplier.select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")  # a row a supplier
    lines = numbered_lines(lines, met(part.select("p_partkey", "p_name")), read("orders").select("o_orderkey", "o_orderpriority"))
    lines = lines.join(F.broadcast(supplier.select("s_suppkey", "s_name", "path")), F.col("l_suppkey") == F.col("s_suppkey"))
    imports = (F.col("l_linestatus") == "F") & (F.col("s_nationkey") >= 5)

    def relations_of(df: DataFrame, ordinal, kind, source, target) -> DataFrame:
        reason = F.element_at(F.create_map(*[F.lit(x) for x in ("Import", "import", "Reference", "identifier", "Call", "call")]), kind)
        return df.select(norm_path(F.col("path")).alias("doc_key"), ordinal.cast("long").alias("ordinal"), kind.alias("kind"), source.alias("source_local_id"), target.alias("target_name"), reason.alias("reason"))

    # Both relations of a line come from one pass.
    named = F.struct((2 * F.col("k")).alias("at"), F.when(imports, "Import").otherwise("Reference").alias("kind"), F.col("o_orderpriority").alias("target"))
    called = F.struct((2 * F.col("k") + 1).alias("at"), F.lit("Call").alias("kind"), F.col("p_name").alias("target"))
    both = F.when(F.col("p_name").isNull(), F.array(named)).otherwise(F.array(named, called))
    each = lines.select("path", of_supplier.alias("source"), F.explode(both).alias("x"))
    rel = relations_of(each, F.col("x.at"), F.col("x.kind"), F.col("source"), F.col("x.target"))
    source = F.concat(F.lit("function:"), "p_name", F.lit(":"), (F.col("p_partkey") + 2).cast("string"), F.lit(":5"))
    succ = part.join(met(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))), "p_partkey")
    rel = rel.unionByName(relations_of(succ, 3 * F.col("p_partkey"), F.lit("Reference"), source, F.col("next")))
    n = part.count()
    seven = part.withColumn("to", 7 * F.col("p_partkey") % n).join(met(part.select(F.col("p_partkey").alias("to"), fq.alias("called"))), "to")
    rel = rel.unionByName(relations_of(seven, 3 * F.col("p_partkey") + 1, F.lit("Call"), source, F.col("called")))
    rel = rel.unionByName(relations_of(part.where("p_partkey % 10 = 0"), 3 * F.col("p_partkey") + 2, F.lit("Reference"), source, F.lit("missing")))
    return docs, symbols, rel


def earlier(docs: DataFrame, symbols: DataFrame, relations: DataFrame) -> tuple[tuple, tuple, DataFrame]:
    """An earlier state of the tables, and the change to the present one: documents that come or replace others (with
    their symbols and relations), and keys of those that go.

    Of the parts, files of brands that end in 1 are not there yet, those in 2 (and a supplier's file) have half their
    symbols and relations, and copies of those in 3 are in a folder that comes first of all."""
    comes, changes, copied = F.col("doc_key").endswith("1.rs"), F.col("doc_key").endswith("2.rs") | F.col("doc_key").endswith("_3.py"), F.col("doc_key").endswith("3.rs")
    half = ~comes & ~(changes & (F.col("ordinal") % 2 == 0))
    away = lambda df, c: df.where(copied).withColumn(c, F.replace(F.col(c), F.lit("/repo/parts/"), F.lit("/repo/Old/" if c == "path" else "/repo/old/")))
    old_docs = docs.where(~comes).unionByName(away(away(docs, "path"), "doc_key"))
    old = old_docs, *[t.where(half).unionByName(away(t, "doc_key")) for t in (symbols, relations)]
    gone = old_docs.where(F.col("doc_key").startswith("/repo/old/")).select("doc_key")
    return old, tuple(t.where(comes | changes) for t in (docs, symbols, relations)), gone


class StoredGraph(Graph):
    """The graph of tables, which are written at first use as it is. An edge's id is put together from the rest when it is read."""

    def __init__(self, tables: tuple[DataFrame, DataFrame, DataFrame]):
        self._tables, self._keep = tables, Keeper(tables[0].sparkSession)

    @cached_property
    def stored(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return stored_tables(*self._tables, self._keep)

    @cached_property
    def _plans(self) -> tuple[DataFrame, DataFrame]:
        return build_graph(REPO, *self.stored, keep=self._keep)

    @cached_property
    def nodes(self) -> DataFrame:
        return self._keep.write(self._plans[0])

    @cached_property
    def edges(self) -> DataFrame:
        e = self._keep.write(self._plans[1].drop("id"))
        return e.select(edge_id(*[F.col(c) for c in ("kind", "src", "dst", "file_path")]).alias("id"), *e.columns)


_graphs: dict[tuple[str, str], tuple[Graph, tuple]] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, tuple[DataFrame, DataFrame, DataFrame]]:
    """The graph of a folder, built once a session and kept for its queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        t = tables(spark, sf_dir)
        _graphs[key] = StoredGraph(t), t
    return _graphs[key]
