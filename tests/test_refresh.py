"""Incremental maintenance against building the whole graph anew; edges with odd relations."""

import random

import pytest
from pyspark.sql import functions as F

from symgraph.operators.build import build_graph
from symgraph.operators.refresh import apply_delta, graph_delta, kept_edges
from symgraph.session import RepositorySession
from symgraph.sources.shared import Keeper
from symgraph.sources.store import parts_of

DOC = "doc_key string, path string, language string"
SYMBOL = "doc_key string, ordinal long, local_id string, name string, fq_name string, kind string, parent_local_id string, start_line int, start_column int, end_line int, end_column int"
RELATION = "doc_key string, ordinal long, kind string, source_local_id string, target_name string, reason string"


def document(rnd, key):
    """A file's row, its symbols and its relations; names are few, so files share them."""
    names = ["a", "b", "c", "d", "e::f", "x.y", "m-n"]
    symbols, relations = [], []
    for i in range(rnd.randint(0, 4)):
        name = rnd.choice(names)
        parent = symbols[0][2] if symbols and rnd.random() < 0.4 else None
        symbols.append((key, i, f"function:{name}:{rnd.choice([i, 1])}:1", name, rnd.choice([name, f"m::{name}", None]), "Function", parent, i, 1, i, 2))
    for i in range(rnd.randint(0, 6)):
        source = rnd.choice([None, "function:nowhere:1:1", *[s[2] for s in symbols]])
        relations.append((key, i, rnd.choice(["Import", "Import", "Call", "Reference", "Inherit", "Strange"]), source, rnd.choice([*names, "os", "p/q", "u.v", "m::a"]), rnd.choice(["import", "call", None])))
    return (key, key.replace("/r/", "/R/"), "rust"), symbols, relations


def frames(spark, found):
    return tuple(spark.createDataFrame([r for d in found for r in ([d[0]] if k == 0 else d[k])], kind) for k, kind in enumerate((DOC, SYMBOL, RELATION)))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_change_equals_full_build(spark, seed):
    rnd = random.Random(seed)
    keys = [f"/r/f{i}.rs" for i in range(12)]
    old = {k: document(rnd, k) for k in keys[:9]}
    come = {k: document(rnd, k) for k in rnd.sample(keys, 3)}
    gone = rnd.sample(sorted(set(old) - set(come)), seed)
    after = {k: v for k, v in (old | come).items() if k not in gone}
    keep = Keeper(spark)
    before = frames(spark, old.values())
    nodes, edges = build_graph("/r", *before)
    delta = graph_delta("/r", before, frames(spark, come.values()), spark.createDataFrame([(k,) for k in gone], "doc_key string"), keep)
    got = apply_delta(nodes, edges, delta)
    want = build_graph("/r", *frames(spark, after.values()))
    assert rows(got[1]) == rows(want[1]) and rows(got[0]) == rows(want[0])
    keep.release()


def test_one_file_of_many(spark):
    n = 10_000
    key = F.format_string("/r/f%05d.rs", "id")
    docs = spark.range(n).select(key.alias("doc_key"), key.alias("path"), F.lit("rust").alias("language"))
    name = lambda i: F.concat(F.lit("fn"), i.cast("string"))
    symbols = spark.range(n).select(key.alias("doc_key"), F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit("function:"), name(F.col("id")), F.lit(":1:1")).alias("local_id"), name(F.col("id")).alias("name"), name(F.col("id")).alias("fq_name"), F.lit("Function").alias("kind"), F.lit(None).cast("string").alias("parent_local_id"), *[F.lit(1).alias(c) for c in ("start_line", "start_column", "end_line", "end_column")])
    target = F.when(F.col("k") == 3, F.lit("ext.lib")).otherwise(name((F.col("id") * 7 + F.col("k")) % n))
    relations = spark.range(n).select(key.alias("doc_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"), "id").select("doc_key", F.col("k").alias("ordinal"), F.when(F.col("k") == 3, "Import").otherwise("Call").alias("kind"), F.lit(None).cast("string").alias("source_local_id"), target.alias("target_name"), F.lit("call").alias("reason"))
    keep = Keeper(spark)
    old = tuple(keep.write(t) for t in (docs, symbols, relations))
    edges = keep.write(build_graph("/r", *old)[1])
    one = F.col("doc_key") == "/r/f00000.rs"  # the first import of all, and a definition that three files aim at
    new = old[0].where(one), old[1].where(one).withColumn("name", F.lit("other")).withColumn("fq_name", F.lit("other")), old[2].where(one & (F.col("ordinal") < 3))
    delta = graph_delta("/r", old, new, old[0].where("false").select("doc_key"), keep)
    total, left = edges.count(), kept_edges(edges, delta.replaced).count()
    assert 0 < total - left < 0.01 * total and 1 < delta.replaced.count() <= 5 and delta.edges.count() < 0.01 * total
    after = tuple(t.where(~one).unionByName(x) for t, x in zip(old, new, strict=True))
    want = build_graph("/r", *after)[1]
    got = kept_edges(edges, delta.replaced).unionByName(delta.edges)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    keep.release()


def test_ids_are_unique(spark):
    docs = [("/r/a.rs", "/r/a.rs", "rust")]
    symbol = ("/r/a.rs", 0, "function:a:1:1", "a", "a", "Function", None, 1, 1, 1, 2)
    nested = ("/r/a.rs", 1, "function:b:2:1", "b", "a::b", "Function", "function:a:1:1", 2, 1, 2, 2)
    relations = [("/r/a.rs", i, k, "function:a:1:1", "b", why) for i, (k, why) in enumerate([("Call", None), ("Call", "call"), ("Call", "again"), ("Inherit", None), ("Strange", "x"), (None, None)])]
    nodes, edges = build_graph("/r", spark.createDataFrame(docs, DOC), spark.createDataFrame([symbol, symbol, nested, nested], SYMBOL), spark.createDataFrame(relations, RELATION))
    found = edges.collect()
    assert len({r["id"] for r in found}) == len(found) and all(r["id"] and r["kind"] for r in found)
    assert {(r["kind"], r["reason"]) for r in found if r["src"] == "symbol::/r/a.rs::function:a:1:1" and r["dst"].endswith("b:2:1")} == {("Calls", "again"), ("Inherits", None), ("DependsOn", "derived dependency"), ("Contains", "nested symbol"), ("Defines", "symbol definition")}
    assert nodes.count() == 4


def test_session_writes_changes_only(spark, tmp_path, monkeypatch):
    repo = tmp_path / "repo"
    repo.mkdir()
    for i in range(6):
        (repo / f"f{i}.py").write_text(f"import lib.x\n\ndef fn{i}():\n    fn{(i + 1) % 6}()\n")
    s = RepositorySession(spark, str(repo), str(tmp_path / "store"))
    s.build_full()
    for step in range(3):
        (repo / "f0.py").write_text(f"def fn0():\n    fn{step + 2}()\n\ndef more{step}():\n    pass\n")
        if step == 1:
            (repo / "f3.py").unlink()
        monkeypatch.setattr("symgraph.session.MAX_PARTS", 2)
        monkeypatch.setattr("symgraph.session.WHOLE_SHARE", 1.0)
        s.refresh_paths(["f0.py", "f3.py"])
        other = RepositorySession(spark, str(repo), str(tmp_path / f"fresh{step}"))
        other.build_full()
        assert rows(s.graph().edges) == rows(other.graph().edges.select(*s.graph().edges.columns)) and rows(s.graph().nodes.select(*other.graph().nodes.columns)) == rows(other.graph().nodes)
        meta = s.store.meta()
        assert meta["revision"] == step + 2 and len(parts_of(meta)) == (step + 2 if step < 2 else 2)
    assert spark.read.parquet(f"{s.store.path}/{parts_of(meta)[-1]}/edges").count() < s.graph().edges.count() / 2
    assert s.refresh_paths(["f0.py"])["revision"] == 4  # nothing changed
