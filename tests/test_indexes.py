"""Numbered and bucketed adjacency, lookups and trigrams: rows against the plain graph, and what the plans read."""

import random

import pytest
from pyspark.sql import functions as F

from symgraph.operators.adjacency import Adjacency, dense_numbers
from symgraph.operators.query import Graph, NotFound
from symgraph.operators.textindex import TrigramIndex, lower
from symgraph.sources.shared import Keeper

NODE = "id string, kind string, name string, fq_name string, path string, symbol_kind string"
EDGE = "id string, kind string, src string, dst string, file_path string, reason string"


@pytest.fixture(scope="module")
def stored(spark):
    rnd = random.Random(9)
    files = [("file::/r/a.rs", "File", "a.rs", "/r/a.rs", "/R/a.rs", None)]
    nodes = files + [(f"symbol::/r/a.rs::function:n{i}:{i}:1", "Symbol", f"n{i % 40}", f"m::n{i}", "/R/a.rs", "Function") for i in range(60)] + [("module::x.y", "Symbol", "x.y", "x.y", None, "Module")]
    edges = {}
    for _ in range(300):
        a, b, k = rnd.choice(nodes)[0], rnd.choice(nodes)[0], rnd.choice(["Calls", "DependsOn", "Imports", "Defines"])
        edges[f"edge::{k}::{a}::{b}::/r/a.rs"] = (f"edge::{k}::{a}::{b}::/r/a.rs", k, a, b, "/R/a.rs", rnd.choice([None, "why"]))
    g = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(list(edges.values()), EDGE))
    keep = Keeper(spark)
    a = Adjacency.store("test_graph", g.nodes, g.edges, keep, buckets=8)
    yield g, a, keep
    a.drop()
    keep.release()


def rows(df, like):
    return sorted(map(str, df.select(*like.columns).collect()))


def scanned(df):
    """Rows that the scans of a plan without exchanges have put out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("direction, depth", [("outbound", 0), ("outbound", 2), ("inbound", 3), ("both", 2)])
def test_walks(stored, limit, direction, depth):
    g, a, keep = stored
    for target in ("n7", "x.y"):
        got, want = a.dependencies(target, keep, direction, depth, limit), g.dependencies(target, direction, depth)
        assert rows(got[0], want[0]) == rows(want[0], want[0]) and rows(got[1], want[1]) == rows(want[1], want[1])
    got, want = a.impact("m::n3", keep, depth, limit), g.impact("m::n3", depth)
    assert rows(got[0], want[0]) == rows(want[0], want[0]) and rows(got[1], want[1]) == rows(want[1], want[1])


def test_edges_stay_where_they_are(spark, stored):
    _, a, _ = stored
    frontier = spark.range(1000).withColumnRenamed("id", "nid")
    for small in (False, True):
        plan = a.hop(frontier, True, ("Calls",), small)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = next(i for i, x in enumerate(lines) if "FileScan" in x)
        depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
        above = [x for i, x in enumerate(lines[:scan]) if depth(x) < depth(lines[scan]) and all(depth(y) > depth(x) for y in lines[i + 1 : scan + 1])]
        assert above and not any("Exchange" in x for x in above), plan
        assert ("SortMergeJoin" in plan) != small and plan.count("Exchange hashpartitioning") == (0 if small else 1)


def test_lookups(spark, stored):
    g, a, _ = stored
    for target in ("n7", "m::n3", "file::/r/a.rs", "x.y", "a.rs"):
        assert a.resolve(target)[1] == g.resolve(target)
    with pytest.raises(NotFound):
        a.resolve("nothing")


def test_numbers_are_dense_and_in_order(spark):
    keep = Keeper(spark)
    ids = [f"k{i * 7919 % 5003}" for i in range(5003)]
    got = dense_numbers(spark.createDataFrame([(x,) for x in ids * 2], "id string").repartition(9), keep).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["nid"])] == sorted(ids) and {r["nid"] for r in got} == set(range(5003))
    keep.release()


def test_a_lookup_reads_few_rows(spark):
    keep = Keeper(spark)
    n = 60_000
    nodes = spark.range(n).select(F.concat(F.lit("symbol::"), F.sha2(F.col("id").cast("string"), 256)).alias("id"), F.lit("Symbol").alias("kind"), F.concat(F.lit("name"), F.col("id") % 20_000).alias("name"), F.concat(F.lit("m::name"), "id").alias("fq_name"), F.lit(None).cast("string").alias("path"), F.lit("Function").alias("symbol_kind"))
    edges = spark.createDataFrame([], EDGE)
    a = Adjacency.store("test_lookup", nodes, edges, keep, buckets=4)
    try:
        for key in ("name77", "m::name31234", "no such key"):
            assert scanned(a.table("keys").where(F.col("key") == key)) < 0.05 * 3 * n
        index = TrigramIndex(a.table("nodes").select("nid", "name"), "name", keep)
        found = index.containing("E7771")
        assert scanned(found) < 0.05 * n
        want = nodes.where("contains(name, 'e7771')")
        assert rows(a.node_rows(found), want) == rows(want, want) and want.count() == found.count() > 0
        assert scanned(a.table("nodes").where(F.col("nid").isin([1, 2]))) < 0.1 * n
    finally:
        a.drop()
        keep.release()


@pytest.mark.parametrize("pattern", ["plate", "PLATE", "ab", "", "é日", "日本語", "a%b_c", "zzz", "aaaa"])
def test_trigrams(spark, pattern):
    keep = Keeper(spark)
    texts = ["red Plate", "PLATE", "ab", "", None, "É日本語é日", "x a%b_c y", "aaa", "aaaaa", "plat e", "pla", "tel"] * 3
    index = TrigramIndex(spark.createDataFrame(list(enumerate(texts)), "nid long, t string"), "t", keep)
    assert sorted(r[0] for r in index.containing(pattern).collect()) == [i for i, t in enumerate(texts) if t is not None and lower(pattern) in lower(t)]
    keep.release()
