"""What keeps the graph's cost in proportion: numbering by ranges, relations counted once, walks and joins that leave edges where they are."""

import random

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from symgraph.operators.adjacency import Adjacency
from symgraph.operators.build import build_graph, id_counts, stored_tables
from symgraph.operators.query import Graph
from symgraph.plans import projection
from symgraph.sources.shared import Keeper

DOC = "doc_key string, path string, language string"
SYMBOL = "doc_key string, ordinal long, local_id string, name string, fq_name string, kind string, parent_local_id string, start_line int, start_column int, end_line int, end_column int"
RELATION = "doc_key string, ordinal long, kind string, source_local_id string, target_name string, reason string"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(4)
    docs = [(f"/r/d{i}.rs", f"/R/d{i}.rs", "rust") for i in range(5)]
    symbols = [(d, 10 * i, f"function:n{i}:{i}:1", f"n{i}", rnd.choice([None, f"m::n{i}", "twice"]), "Function", None, i, 1, i, 1) for d, _, _ in docs for i in range(6) if rnd.random() < 0.7]
    targets = ["n1", "n2", "m::n3", "twice", "a.b", "c.d", "e-f", "none", None]
    relations = [(rnd.choice(docs)[0], n, rnd.choice(["Import", "Reference", "Call", "Odd"]), rnd.choice([None, "gone", "function:n1:1:1", "function:n2:2:1"]), rnd.choice(targets), rnd.choice([None, "a", "b"])) for n in range(3000)]
    # A name that is imported late and used before and after.
    relations += [("/r/d0.rs", n, kind, None, "late.module", "a") for n, kind in ((5000, "Call"), (5001, "Import"), (5002, "Reference"))]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(relations, RELATION)


def rows(df):
    return sorted(map(str, df.collect()))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lines_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(projection, "RANGE", 7)
    rnd = random.Random(2)
    lines = [Row(l_orderkey=rnd.randrange(60), l_linenumber=rnd.randrange(3), l_suppkey=n, l_partkey=rnd.randrange(9), l_quantity=1.0, l_extendedprice=2.0, l_discount=0.0, l_tax=0.0, l_returnflag="A", l_linestatus="F", l_shipdate=None, s_nationkey=rnd.randrange(3), o_orderpriority="x") for n in range(800)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp, s_nationkey long, o_orderpriority string")
    names = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "p_partkey long, p_name string")
    got = projection.numbered_lines(lines, names)
    want = lines.withColumn("k", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*projection.LINE_ORDER))).join(names, F.col("l_partkey") == F.col("p_partkey"), "left")
    assert rows(got.select("l_suppkey", "p_name", F.col("k").cast("long"))) == rows(want.select("l_suppkey", "p_name", F.col("k").cast("long")))
    windows = [x for x in plan(got).split("\n") if "Window [row_number" in x]
    assert windows and not any("[s_nationkey" in x and "range" not in x and "l_orderkey" not in x for x in windows)


def test_wide_lines_are_sorted_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(projection, "RANGE", 7)
    rnd = random.Random(5)
    lines = [(rnd.choice([None, *range(40)]), rnd.randrange(3), n % 4, rnd.randrange(9), 1.0, rnd.choice("FO")) for n in range(500)]
    orders = [(rnd.randrange(5, 50), f"{rnd.randrange(5)}-X") for _ in range(50)]  # some are missing, some are there twice
    given = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_linestatus string").select("*", *[F.col("l_quantity").alias(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")]),
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string"),
        "part": spark.createDataFrame([(i, f"p{i}", "T", "Brand#11") for i in range(6)], "p_partkey long, p_name string, p_type string, p_brand string"),
        "supplier": spark.createDataFrame([(i, f"s{i}", i % 2) for i in range(4)], "s_suppkey long, s_name string, s_nationkey long"),
        "nation": spark.createDataFrame([(i, f"N{i}") for i in range(2)], "n_nationkey long, n_name string"),
    }
    for name, df in given.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    relations = projection.tables(spark, str(tmp_path))[2].where("kind = 'Call' AND doc_key LIKE '%.py'")
    sorts = [x for x in plan(relations).split("\n") if "Sort [" in x and "l_orderkey" in x]
    assert [x.split("Sort [")[1].split("#")[0] for x in sorts] == ["s_nationkey", "l_orderkey"]  # the narrow ones by range, the wide ones by order
    met = [(n % 2, k, i, s, p) for (k, i, s, p, *_), n in zip(lines, [x[2] for x in lines], strict=True) for o, _ in orders if o == k]
    want, at = [], {}
    for nation, _, _, _, p in sorted(met):
        at[nation] = at.get(nation, 0) + 1
        want += [(f"/repo/suppliers/n{nation}.py", 2 * at[nation] + 1, f"p{p}")] if p < 6 else []
    assert sorted((r["doc_key"], r["ordinal"], r["target_name"]) for r in relations.collect()) == sorted(want) and want


def test_relations_count_once(spark, tables):
    keep = Keeper(spark)
    stored = stored_tables(*tables, keep)
    assert stored[2].count() < tables[2].count() / 2
    for got, want in zip(build_graph("/r", *stored, keep=keep), build_graph("/r", *tables), strict=True):
        assert rows(got) == rows(want)
    keep.release()


@pytest.mark.parametrize("direction", ["outbound", "inbound", "both"])
def test_walks_leave_edges_where_they_are(tables, direction):
    g = Graph(*(x.persist() for x in build_graph("/r", *tables)))
    _, seen, found = g.traverse("n1", 2, ("DependsOn", "Calls"), direction)
    assert "hashpartitioning(id" not in plan(found)  # edges are not told apart after the walk
    near = {r["id"] for r in seen.where("level < 2").collect()}
    ends = {"outbound": lambda r: r["src"] in near, "inbound": lambda r: r["dst"] in near, "both": lambda r: r["src"] in near or r["dst"] in near}
    want = [r["id"] for r in g.edges.where("kind IN ('DependsOn', 'Calls')").collect() if ends[direction](r)]
    assert sorted(r["id"] for r in found.collect()) == sorted(want) and want


def test_files_of_edges_are_broadcast(spark, tables):
    keep = Keeper(spark)
    nodes, edges = build_graph("/r", *tables)
    a = Adjacency.store("test_growth", nodes, edges, keep, buckets=4)
    try:
        decoded = a.edge_rows(a.table("in"))
        assert rows(decoded.select(*edges.columns)) == rows(edges)
        assert "hashpartitioning(doc" not in plan(decoded) and "hashpartitioning(dst" not in plan(decoded)
    finally:
        a.drop()
        keep.release()


def test_ids_are_counted_by_hashes(spark):
    keep = Keeper(spark)
    edges = spark.createDataFrame([("a", "k"), ("a", "k"), ("b", None), (None, "k"), ("c", "k"), ("c", "k"), ("c", "k")], "id string, kind string")
    assert id_counts(edges, keep).collect() == [(7, 3, 2)]
    assert id_counts(edges.limit(0), keep).collect() == [(0, 0, 0)]
    keep.release()
