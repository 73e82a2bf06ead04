"""Extraction, store, refresh, change feed and package graph on small repositories."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from symgraph import cli
from symgraph.functions.scanner import extract
from symgraph.operators.query import NotFound, SymbolFilter
from symgraph.serve import serve
from symgraph.session import RepositorySession, memory_budget
from symgraph.sources.store import Conflict, StoreError, store_path
from symgraph.streaming.watch import latest, poll, watch


def test_scanner():
    symbols, relations = extract("python", "from m import (a, b)\nclass A(B):\n    def f(self):\n        return self.g(1)\nx = f()\n")
    assert [(s["local_id"], s["fq_name"], s["end_line"]) for s in symbols] == [("class:A:2:1", "A", 4), ("function:f:3:5", "A::f", 4)]
    assert [(r["kind"], r["target_name"]) for r in relations if r["kind"] != "Reference"] == [("Import", "b"), ("Call", "g"), ("Call", "f")]
    symbols, relations = extract("rust", 'use a::b::{c, d};\npub struct S;\nimpl T for S { pub fn m(&self) -> Z { r#"fn no() {}"#; a::f(x) } }\n')
    assert [(s["kind"], s["fq_name"]) for s in symbols] == [("Type", "S"), ("Type", "S"), ("Function", "S::m")]
    assert relations[0]["target_name"] == "a::b" and ("Call", "f") in [(r["kind"], r["target_name"]) for r in relations]
    symbols, _ = extract("go", "package m\ntype (\n  A struct { b int }\n  I interface { F() }\n)\nfunc (a A) G() error { return nil }\n")
    assert [(s["kind"], s["name"]) for s in symbols] == [("Type", "A"), ("Interface", "I"), ("Method", "G")]
    symbols, _ = extract("javascript", "const f = (a) => {\n  return g(a)\n}\nlet {q, r} = z;\nclass K { m(a) { } }\n")
    assert [(s["kind"], s["fq_name"]) for s in symbols] == [("Constant", "f"), ("Variable", "{q, r}"), ("Class", "K"), ("Method", "K::m")]


@pytest.mark.parametrize("source", [None, "", "{", "fn", "class", "import", "def f(:", "impl<", "use", "'''", "const", "type (", "x" * 100_000])
def test_odd_sources(source):
    for language in ("python", "rust", "go", "javascript", "java", "lua", "bash", "php", "css", None):
        extract(language, source)


def test_settings():
    assert [memory_budget(x) for x in (None, " ", "2048", "0")] == [1024, 1024, 2048, None]
    with pytest.raises(ValueError):
        memory_budget("much")
    assert [store_path(x) for x in ("/a/index", "/a/my_index.db", "/a/b.db")] == ["/a/index", "/a/my_index", "/a/b/index"]


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules").mkdir(parents=True)
    (root / "pkg").mkdir()
    (root / "node_modules" / "x.js").write_text("function no() {}")
    (root / "main.rs").write_text("\nfn helper() {}\n\nfn main() {\n    helper();\n}\n")
    (root / "pkg" / "__init__.py").write_text("def keep():\n    return helper()\n")
    (root / "pkg" / "Cargo.toml").write_text('[package]\nname = "pkg"\n[lib]\nname = "no"\n')
    (root / "Cargo.toml").write_text("[workspace]\n")
    return root


def test_session(spark, repo, tmp_path):
    s = RepositorySession(spark, str(repo), f"file://{tmp_path}/index")
    stats = s.build_full()
    assert (stats["revision"], stats["file_count"], stats["symbol_count"]) == (1, 2, 3)
    assert sorted(r["name"] for r in s.graph().callers("helper")[0].collect()) == ["helper", "keep", "main"]
    assert s.snippet(s.graph().resolve("main")).startswith("fn main() {")
    packages, _ = s.package_graph()
    assert [(r["name"], r["file_count"], r["symbol_count"]) for r in packages.collect()] == [("pkg", 1, 1)]
    assert s.refresh_paths(["main.rs", "pkg"])["revision"] == 1
    (repo / "main.rs").write_text("fn other() {}\n")
    stats = s.refresh_paths(["./main.rs"])
    assert (stats["revision"], stats["file_count"], stats["symbol_count"]) == (2, 2, 2)
    (repo / "pkg" / "__init__.py").unlink()
    (repo / "pkg" / "Cargo.toml").unlink()
    (repo / "pkg").rmdir()
    assert s.refresh_paths(["pkg"])["file_count"] == 1
    assert s.health()["revision"] == 3
    s.store.vacuum(0)
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "index").glob("v*")) == ["v2", "v3"]


def test_two_sessions(spark, repo, tmp_path):
    at = f"file://{tmp_path}/index"
    one = RepositorySession(spark, str(repo), at)
    one.build_full()
    held = one.graph()
    two = RepositorySession(spark, str(repo), at)  # opening deletes nothing
    unfinished = tmp_path / "index" / "v9-beef"
    unfinished.mkdir()
    RepositorySession(spark, str(repo), at)
    assert unfinished.exists()
    (repo / "main.rs").write_text("fn other() {}\n")
    assert two.refresh_paths(["main.rs"])["revision"] == 2
    assert {r["name"] for r in held.find_symbol(SymbolFilter()).collect()} == {"helper", "main", "keep"}  # the version that it began with
    assert {r["name"] for r in one.graph().find_symbol(SymbolFilter()).collect()} == {"other", "keep"}
    documents, nodes, edges = (one.store.read(t) for t in ("documents", "nodes", "edges"))
    (tmp_path / "index" / "CURRENT-3").write_text("{}")  # as if a writer had been faster
    one.store.meta = lambda: json.loads((tmp_path / "index" / "CURRENT-2").read_text())
    with pytest.raises(Conflict):
        one.store.replace({"documents": documents, "nodes": nodes, "edges": edges}, str(repo), 3)
    (tmp_path / "index" / "CURRENT-3").write_text("not json")
    with pytest.raises(StoreError):
        two.store.meta()


def test_snippets_views_and_nodes(spark, repo, tmp_path):
    (repo / "main.rs").write_bytes(b"// \x0c one\xe2\x80\xa8\r\nfn helper() {\r\n}\r\n\nfn main() {\n    helper();\n}\n")
    s = RepositorySession(spark, str(repo), f"file://{tmp_path}/index")
    s.build_full()
    assert s.snippet(s.graph().resolve("helper")) == "fn helper() {\n}"
    row = s.explain("helper").first()
    assert row["source_snippet"] == "fn helper() {\n}" and row["top_callers"] == ["keep", "main"] and row["top_callees"] == []
    s.register_views()
    assert spark.sql("SELECT count(*) FROM nodes n JOIN edges e ON e.dst = n.id WHERE n.name = 'helper' AND e.kind = 'Calls'").first()[0] == 2
    assert {spark.table(t).count() > 0 for t in ("nodes", "edges", "documents", "symbols", "relations")} == {True}
    assert s.graph().node("file::" + str(repo).lower() + "/main.rs").first()["name"] == "main.rs"
    with pytest.raises(NotFound):
        s.graph().node("main")
    (repo / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    with pytest.raises(Exception, match="(?i)utf|decode"):
        s.build_full()


def test_http(spark, repo, tmp_path):
    s = RepositorySession(spark, str(repo), f"file://{tmp_path}/index")
    server = serve(s)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(r, timeout=120) as x:
                return x.status, json.loads(x.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/graph/callers?symbol=helper")[0] == 503  # nothing is stored yet
        assert call("/index/open", {})[1]["file_count"] == 2
        assert sorted(x["name"] for x in call("/graph/callers?symbol=helper")[1]["nodes"]) == ["helper", "keep", "main"]
        assert call("/graph/find_symbol?name=main")[1]["nodes"][0]["symbol_kind"] == "Function"
        assert call("/graph/explain?symbol=main")[1]["top_callees"] == ["helper"]
        assert all(call(f"/graph/{x}&target=helper")[1]["edges"] for x in ("dependencies?direction=inbound", "impact?depth=1"))
        assert len(call("/graph/references?symbol=helper")[1]["references"]) >= 2 and call("/graph/callees?symbol=main")[0] == 200
        assert call("/graph/callers?symbol=none") == (404, {"error": "NotFound", "message": "none"})
        assert call("/nowhere")[0] == 404 and call("/index/refresh", {"paths": 3})[0] == 400 and call("/graph/impact?target=main&depth=x")[0] == 400
        (repo / "main.rs").write_text("fn fresh() {}\n")
        assert call("/index/refresh", {"paths": ["main.rs"]})[1]["revision"] == 2
        assert call("/graph/find_symbol?name=fresh")[1]["nodes"] and call("/graph/find_symbol?name=main")[1]["nodes"] == []  # the graph was swapped
        assert call("/health")[1]["revision"] == 2
    finally:
        server.shutdown()


def test_watched_folder(spark, repo, tmp_path):
    s = RepositorySession(spark, str(repo), f"file://{tmp_path}/index")
    s.build_full()
    events = poll(s, 0.05, quiet=0.1)
    timer = threading.Timer(0.5, lambda: [(repo / "main.rs").write_text("fn seen() {}\n"), (repo / "note.unknown").write_text("x"), (repo / "node_modules" / "y.js").write_text("function no() {}")])
    timer.start()
    assert next(events)["revision"] == 2
    assert "seen" in {r["name"] for r in s.graph().find_symbol(SymbolFilter()).collect()}
    timer = threading.Timer(0.5, lambda: (repo / "main.rs").unlink())
    timer.start()
    assert next(events)["file_count"] == 1


def test_equal_sequence_numbers(spark):
    rows = [("/a.py", "upsert", "one", 1), ("/a.py", "upsert", "two", 1), ("/A.py", "delete", None, 0)]
    for some in (rows, rows[::-1]):
        assert [tuple(r) for r in latest(spark.createDataFrame(some, "path string, op string, source string, seq long").repartition(3)).collect()] == [("/a.py", "/a.py", "upsert", "two")]


def test_single_file_counts(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "main.rs").write_text("\nfn helper() {}\n\nfn main() {\n    helper();\n}\n")
    s = RepositorySession(spark, str(tmp_path / "r"), f"file://{tmp_path}/index")
    assert s.build_full()["edge_count"] == 8
    assert s.graph().nodes.count() == 4


def test_watch(spark, repo, tmp_path):
    s = RepositorySession(spark, str(repo), f"file://{tmp_path}/index")
    s.build_full()
    feed = str(tmp_path / "feed")
    rows = [(f"{s.repo_path}/new.py", "upsert", "def fresh(): pass\n", 1), (f"{s.repo_path}/main.rs", "upsert", "fn x() {}", 2), (f"{s.repo_path}/main.rs", "delete", None, 3), (f"{s.repo_path}/dist/n.py", "upsert", "def no(): pass", 4)]
    schema = "path string, op string, source string, seq long"
    spark.createDataFrame(rows, schema).write.parquet(feed)
    q = watch(s, spark.readStream.schema(schema).parquet(feed), str(tmp_path / "at"), {"availableNow": True})
    q.awaitTermination(120)
    assert sorted(r[0].rsplit("/", 1)[1] for r in s.indexed_files().collect()) == ["__init__.py", "new.py"]


def test_cli(spark, repo, tmp_path, capsys):
    at = ["--repo", str(repo), "--store", f"file://{tmp_path}/index"]
    said = lambda *args: (cli.main([*at, *args]), json.loads(capsys.readouterr().out))[1]
    assert said("index")["file_count"] == 2
    assert [n["name"] for n in said("query", "find-symbol", "--name-prefix", "HEL")["nodes"]] == ["helper"]
    assert {n["name"] for n in said("query", "impact", "helper")["nodes"]} == {"keep", "main"}
    assert said("query", "summary")["counts"][0]["files"] == 2
    assert said("query", "crate-graph")["nodes"][0]["name"] == "pkg"
    assert said("query", "explain", "main")["explain"][0]["source_snippet"].startswith("fn main")
    export = said("export")
    assert {n["id"] for n in export["nodes"]} >= {e[k] for e in export["edges"] for k in ("src", "dst")} and len(export["edges"]) == len({e["id"] for e in export["edges"]})
