"""Streams of changes with restarts and late events; snippets and JSON exchange against plain Python."""

import json
import random

import pytest

from symgraph import cli
from symgraph.operators.snippets import snippets
from symgraph.session import RepositorySession
from symgraph.sources.exchange import ExchangeError, export_graph, import_graph
from symgraph.streaming import state
from symgraph.streaming.source import _Reader, repository_changes
from symgraph.streaming.state import newer
from symgraph.streaming.watch import watch, watch_folder


def run(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_changes_of_a_folder_with_restarts(spark, tmp_path):
    repo, out = tmp_path / "repo", str(tmp_path / "out")
    (repo / "sub").mkdir(parents=True)
    (repo / "node_modules").mkdir()

    def once():
        stream = repository_changes(spark, str(repo), str(tmp_path / "log"), "nothing")
        run(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(out))
        return sorted((r["path"].rsplit("/", 1)[1], r["op"], r["source"], r["seq"]) for r in spark.read.parquet(out).collect())

    (repo / "a.py").write_text("one")
    (repo / "sub" / "b.rs").write_text("two é")
    (repo / "c.unknown").write_text("no")
    (repo / "node_modules" / "d.js").write_text("no")
    first = once()
    assert [x[:3] for x in first] == [("a.py", "upsert", "one"), ("b.rs", "upsert", "two é")]
    assert once() == first  # started again, nothing comes twice
    (repo / "a.py").write_text("one more")
    (repo / "sub" / "b.rs").unlink()
    (repo / "e.go").write_text("three")
    second = [x for x in once() if x not in first]
    assert [x[:3] for x in second] == [("a.py", "upsert", "one more"), ("b.rs", "delete", None), ("e.go", "upsert", "three")]
    assert min(x[3] for x in second) > max(x[3] for x in first)
    # A snapshot that was written but never became an offset is covered by the next batch.
    (repo / "f.py").write_text("four")
    _Reader({"path": str(repo), "log": str(tmp_path / "log")}).latestOffset()
    (repo / "g.py").write_text("five")
    third = [x[:3] for x in once() if x not in first + second]
    assert third == [("f.py", "upsert", "four"), ("g.py", "upsert", "five")] and once()[-1] == once()[-1]


def test_late_and_repeated_events_do_nothing(spark, tmp_path):
    feed, out, at = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "at")
    schema = "path string, op string, source string, seq long"
    batches = [
        [("/r/a.py", "upsert", "one", 5), ("/r/a.py", "upsert", "older", 4), ("/r/b.py", "upsert", "x", 1), (None, "upsert", "x", 9), ("/r/c.py", "upsert", "x", None)],
        [("/r/A.py", "delete", None, 3), ("/r/a.py", "upsert", "one", 5), ("/r/b.py", "delete", None, 2)],
        [("/r/b.py", "upsert", "late", 1), ("/r/a.py", "upsert", "two", 6), ("/r/a.py", "delete", None, 6)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = newer(spark.readStream.schema(schema).parquet(feed))
        run(stream.writeStream.format("parquet").option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start(out))
    got = sorted((r["path"], r["op"], r["source"] or "", r["seq"]) for r in spark.read.parquet(out).collect())
    assert got == [("/r/a.py", "upsert", "one", 5), ("/r/a.py", "upsert", "two", 6), ("/r/b.py", "delete", "", 2), ("/r/b.py", "upsert", "x", 1)]


def test_state_is_kept_by_groups_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "GROUPS", 3, raising=False)
    rnd = random.Random(3)
    feed, out, at = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "at")
    schema = "path string, op string, source string, seq long"
    last, want = {}, []
    for _ in range(3):
        rows = [(f"/{rnd.choice('rR')}/f{rnd.randrange(60)}.py", rnd.choice(["upsert", "delete", None]), rnd.choice(["a", "b", "", None]), rnd.randrange(40)) for _ in range(400)]
        best = {}
        for path, op, source, seq in rows:
            key, order = path.lower(), (seq, op or "", source is not None, source or "", path)
            if seq > last.get(key, -1) and (key not in best or order > best[key][0]):
                best[key] = order, (path, op, source, seq)
        want += [event for _, event in best.values()]
        last |= {key: event[3] for key, (_, event) in best.items()}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        query = newer(spark.readStream.schema(schema).parquet(feed)).writeStream.format("parquet").option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start(out)
        run(query)
        assert max(x["numRowsTotal"] for p in query.recentProgress for x in p["stateOperators"]) <= 3  # Python is called once a group
    got = [tuple(r[c] for c in ("path", "op", "source", "seq")) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 60


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "repo"
    at.mkdir()
    (at / "main.rs").write_text("fn main() {\n    helper();\n}\n\nfn helper() {}\n")
    (at / "other.py").write_text("def other():\n    pass\n")
    return at


def test_session_follows_a_folder(spark, repo, tmp_path):
    s = RepositorySession(spark, str(repo), f"file://{tmp_path}/index")
    s.build_full()
    stats = []
    run(watch_folder(s, str(tmp_path / "log"), {"availableNow": True}, stats.append))
    assert s.stats()["revision"] == 1
    (repo / "main.rs").write_text("fn main() {}\n")
    (repo / "other.py").unlink()
    run(watch_folder(s, str(tmp_path / "log"), {"availableNow": True}, stats.append))
    assert stats[-1]["revision"] == 2 and sorted(r[0].rsplit("/", 1)[1] for r in s.indexed_files().collect()) == ["main.rs"]
    assert "helper" not in {r["name"] for r in s.graph().nodes.collect()}


def test_an_old_event_in_a_later_batch(spark, repo, tmp_path):
    s = RepositorySession(spark, str(repo), f"file://{tmp_path}/index")
    s.build_full()
    feed, schema = str(tmp_path / "feed"), "path string, op string, source string, seq long"
    for rows in ([(f"{s.repo_path}/main.rs", "upsert", "fn newest() {}\n", 7)], [(f"{s.repo_path}/main.rs", "delete", None, 6)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
        run(watch(s, spark.readStream.schema(schema).parquet(feed), str(tmp_path / "at"), {"availableNow": True}))
    assert s.stats()["revision"] == 2 and "newest" in {r["name"] for r in s.graph().nodes.collect()}


def test_snippets(spark):
    rnd = random.Random(4)
    texts = ["", "one", "a\nb\nc", "é\r\nü\r\n\r\nz\r", "\n\n\n", None, "😀 x\ny\n" * 50]
    files = [(f"/r/{i}", t) for i, t in enumerate(texts)]
    places = [(f"n{k}", f"/r/{rnd.randint(0, 8)}", rnd.choice([None, rnd.randint(0, 6), 70]), rnd.randint(0, 110)) for k in range(200)]
    got = {r["id"]: r["snippet"] for r in snippets(spark.createDataFrame(places, "id string, doc_key string, start_line int, end_line int"), spark.createDataFrame(files, "doc_key string, source string")).collect()}
    by = dict(files)
    for i, key, a, b in places:
        lines = [x.removesuffix("\r") for x in (by.get(key) or "").split("\n")]
        want = None if a is None or by.get(key) is None else "\n".join(lines[max(a, 1) - 1 : min(b, max(a, 1) + 39)]) or None
        assert got[i] == want, (i, key, a, b)


def test_exchange(spark, tmp_path):
    rows = [(i, None if i % 3 == 0 else f'te"xt\n\\ é {i}', [i, None] if i % 2 else None, (None, f"[{i}")) for i in range(500)]
    kind = "id long, t string, a array<int>, s struct<x: string, y: string>"
    df, empty = spark.createDataFrame(rows, kind).repartition(5), spark.createDataFrame([], kind)
    at = str(tmp_path / "export")
    assert {k: v["rows"] for k, v in export_graph({"nodes": df, "none": empty}, at).items()} == {"nodes": 500, "none": 0}
    parts = [p for p in (tmp_path / "export" / "nodes").iterdir() if p.name.startswith("part-")]
    found = [json.loads(p.read_text()) for p in parts]
    assert len(parts) == 5 and sum(map(len, found)) == 500 and all(set(r) == {"id", "t", "a", "s"} for d in found for r in d)
    back = import_graph(spark, at)
    assert back["nodes"].schema == df.schema and back["nodes"].exceptAll(df).isEmpty() and df.exceptAll(back["nodes"]).isEmpty() and back["none"].isEmpty()
    parts[0].unlink()
    with pytest.raises(ExchangeError):
        import_graph(spark, at)


def test_cli_export_to_a_folder(spark, repo, tmp_path, capsys):
    args = ["--repo", str(repo), "--store", f"file://{tmp_path}/index"]
    cli.main([*args, "index"])
    capsys.readouterr()
    cli.main([*args, "export", "--to", str(tmp_path / "out")])
    said = json.loads(capsys.readouterr().out)
    g = RepositorySession(spark, str(repo), f"file://{tmp_path}/index").graph()
    back = import_graph(spark, str(tmp_path / "out"))
    assert said == {"nodes": g.nodes.count(), "edges": g.edges.count()} and back["edges"].exceptAll(g.edges).isEmpty() and back["nodes"].exceptAll(g.nodes).isEmpty()
