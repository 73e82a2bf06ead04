"""The graph on hand-made files, and on the projected tables against SQL."""

import duckdb
import pytest

import __spark_entry__
from symgraph.operators.build import build_graph
from symgraph.operators.query import Graph, NotFound, SymbolFilter

SF = "/root/testdata/sf0.001"
SYMBOL = "doc_key string, ordinal long, local_id string, name string, fq_name string, kind string, parent_local_id string, start_line int, start_column int, end_line int, end_column int"
RELATION = "doc_key string, ordinal long, kind string, source_local_id string, target_name string, reason string"


@pytest.fixture(scope="module")
def chain(spark):
    """root calls middle calls leaf; two files import and name an external module."""
    docs = spark.createDataFrame([("/r/a.rs", "/r/A.rs", "rust"), ("/r/b.rs", "/r/b.rs", "rust")], "doc_key string, path string, language string")
    symbols = [("/r/a.rs", i, f"function:{n}:{i}:1", n, n, "Function", None, i, 1, i, 9) for i, n in enumerate(["leaf", "middle", "root"], 2)]
    rel = [
        ("/r/a.rs", 0, "Reference", "function:leaf:2:1", "x::y", "identifier"), ("/r/a.rs", 1, "Import", None, "x::y", "import"), ("/r/a.rs", 2, "Call", "function:middle:3:1", "leaf", "call"),
        ("/r/a.rs", 3, "Call", "function:root:4:1", "middle", "call"), ("/r/b.rs", 0, "Reference", None, "x::y", "identifier"), ("/r/b.rs", 1, "Call", None, "os", "call"),
    ]
    nodes, edges = build_graph("/r", docs, spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(rel, RELATION))
    return Graph(nodes.persist(), edges.persist())


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_counts(chain):
    assert chain.nodes.count() == 1 + 2 + 3 + 1
    kinds = {r["kind"]: r["count"] for r in chain.edges.groupBy("kind").count().collect()}
    # The reference before the import has no module yet; the one in the later file has.
    assert kinds == {"Contains": 2, "Defines": 3, "OwnedBy": 3, "Imports": 1, "References": 1, "Calls": 2, "DependsOn": 4}


def test_walks(chain):
    assert names(chain.dependencies("root", "outbound", 2)[0]) == ["leaf", "middle", "root"]
    assert names(chain.dependencies("leaf", "inbound", 2)[0]) == ["leaf", "middle", "root"]
    assert names(chain.dependencies("root", "both", 0)[0]) == ["root"]
    assert names(chain.impact("leaf", 3)[0]) == ["middle", "root"]
    assert names(chain.callers("leaf")[0]) == ["leaf", "middle"]


def test_find(chain):
    assert names(chain.find_symbol(SymbolFilter(name_contains="EA"))) == ["leaf"]
    assert names(chain.find_symbol(SymbolFilter(limit=0))) == []
    with pytest.raises(NotFound):
        chain.resolve("nothing")


def test_find_unlimited(spark):
    nodes = spark.createDataFrame([(f"id{i}", "Symbol", f"name{i}", f"m::name{i}", "Class") for i in range(1200)], "id string, kind string, name string, fq_name string, symbol_kind string")
    g = Graph(nodes, None)
    for f in ({"kind": "Class"}, {"name_contains": "AME"}, {"name_prefix": "Name"}):
        assert g.find_symbol(SymbolFilter(**f, unlimited=True)).count() == 1200 and g.find_symbol(SymbolFilter(**f)).count() == 50


@pytest.mark.parametrize("name", ["find_symbol_name_all", "find_symbol_kind_all", "find_symbol_contains_all", "find_symbol_prefix_all"])
def test_sql_unlimited(spark, name):
    test_sql(spark, name)


@pytest.mark.parametrize("name", ["nodes_build", "edges_dependson", "external_modules", "impact_d1_edges", "explain"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in "nation supplier part orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    order = [df.columns.index(c) for c in want.columns]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[i] for i in order)) for r in df.collect())
