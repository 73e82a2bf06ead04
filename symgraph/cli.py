"""Command line: ``python -m symgraph.cli --repo R --store S index|doctor|export|watch|serve|query ...``; JSON out."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import queue

from pyspark.sql import SparkSession

from .operators.query import SymbolFilter
from .serve import serve
from .session import RepositorySession
from .sources.exchange import export_graph
from .streaming.watch import watch_folder


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symgraph")
    p.add_argument("--repo", default=".")
    p.add_argument("--store", default=".symgraph/index")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "doctor"):
        sub.add_parser(name)
    sub.add_parser("export").add_argument("--to", help="a folder: executors write the graph there, in parts; else it is printed")
    w = sub.add_parser("watch")
    w.add_argument("--seconds", type=float, default=0.5)
    w.add_argument("--changes", type=int, help="end after so many refreshes")
    v = sub.add_parser("serve")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=7878)
    q = sub.add_parser("query").add_subparsers(dest="query", required=True)
    f = q.add_parser("find-symbol")
    for name in ("--name", "--fq-name", "--kind", "--name-contains", "--name-prefix"):
        f.add_argument(name)
    f.add_argument("--limit", type=int, default=50)
    for name, depth in (("dependencies", 2), ("callers", None), ("callees", None), ("references", None), ("impact", 3), ("explain", None)):
        one = q.add_parser(name)
        one.add_argument("target")
        if depth:
            one.add_argument("--depth", type=int, default=depth)
        if name == "dependencies":
            one.add_argument("--direction", default="outbound")
    s = q.add_parser("search")
    s.add_argument("text")
    s.add_argument("--limit", type=int, default=20)
    q.add_parser("crate-graph")
    q.add_parser("summary").add_argument("--top", type=int, default=10)
    return p


def _frames(session: RepositorySession, a: argparse.Namespace) -> dict:
    g = session.graph()
    if a.command == "export":
        return {"nodes": g.nodes.orderBy("id"), "edges": g.edges.orderBy("id")}
    pair = lambda x: {"nodes": x[0].orderBy("id"), "edges": x[1].orderBy("id")}
    if a.query == "find-symbol":
        return {"nodes": g.find_symbol(SymbolFilter(a.name, a.fq_name, a.kind, a.name_contains, a.name_prefix, a.limit))}
    if a.query == "dependencies":
        direction = a.direction if a.direction in ("inbound", "both") else "outbound"
        return pair(g.dependencies(a.target, direction, a.depth))
    if a.query in ("callers", "callees"):
        return pair(getattr(g, a.query)(a.target))
    if a.query == "impact":
        return pair(g.impact(a.target, a.depth))
    if a.query in ("references", "explain"):
        return {a.query: getattr(session if a.query == "explain" else g, a.query)(a.target)}
    if a.query == "search":
        return {"results": g.search(a.text, a.limit)}
    if a.query == "crate-graph":
        nodes, edges = session.package_graph()
        return {"nodes": nodes.orderBy("name"), "edges": edges.orderBy("src", "dst")}
    return {"counts": g.summary_counts(), "languages": g.languages(), "top_referenced": g.top_referenced(a.top), "entry_points": g.entry_points(a.top), "largest_files": g.largest_files(a.top)}


def main(argv: list[str] | None = None) -> None:
    """Print one JSON object; rows stream from the executors a partition at a time."""
    a = _parser().parse_args(argv)
    session = RepositorySession(SparkSession.builder.getOrCreate(), a.repo, a.store)
    if a.command in ("index", "doctor"):
        print(json.dumps(session.build_full() if a.command == "index" else session.health()))
        return
    if a.command == "export" and a.to:
        g = session.graph()
        print(json.dumps({k: v["rows"] for k, v in export_graph({"nodes": g.nodes, "edges": g.edges}, a.to).items()}))
        return
    if a.command == "watch":
        if session.store.meta() is None:
            print(json.dumps(session.build_full()), flush=True)
        seen = queue.Queue()
        query = watch_folder(session, os.path.join(session.repo_path, ".symgraph", "watch"), {"processingTime": f"{a.seconds} seconds"}, seen.put)
        revision, left = session.stats()["revision"], a.changes
        while query.isActive and left != 0:
            with contextlib.suppress(queue.Empty):
                stats = seen.get(timeout=1)
                if stats["revision"] != revision:
                    revision, left = stats["revision"], None if left is None else left - 1
                    print(json.dumps(stats), flush=True)
        query.stop()
        return
    if a.command == "serve":
        serve(session, a.host, a.port).serve_forever()
        return
    print("{")
    for i, (name, df) in enumerate(_frames(session, a).items()):
        print(", " * bool(i) + json.dumps(name) + ": [")
        for j, row in enumerate(df.toLocalIterator()):
            print(", " * bool(j) + json.dumps(row.asDict(True)))
        print("]")
    print("}")


if __name__ == "__main__":
    main()
