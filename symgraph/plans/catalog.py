"""Queries of the code graph by name, each with the same result in SQL over the same tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build
from ..operators.adjacency import Adjacency
from ..operators.packages import package_graph, packages
from ..operators.query import Graph, SymbolFilter
from ..operators.refresh import apply_delta, graph_delta, kept_edges
from ..operators.snippets import snippets
from ..operators.textindex import TrigramIndex
from ..session import change_keys
from ..sources.exchange import export_graph, import_graph
from ..sources.shared import Keeper, shared_folder
from ..streaming.state import newer
from ..streaming.watch import latest
from .projection import REPO, earlier, graph, tables

PLATE, SUPPLIER = "red plate", "Supplier#000000003"
NODE_COLUMNS = ["id", "kind", "language", "symbol_kind", "name", "fq_name", "path", "start_line"]
EDGE_COLUMNS = ["id", "kind", "src", "dst", "file_path", "reason"]

#: The projected tables and the graph, as common table expressions.
PRELUDE = r"""
WITH RECURSIVE part_ AS (SELECT *, '/repo/parts/' || replace(p_brand, '#', '_') || '.rs' AS path FROM part),
supplier_ AS (SELECT *, '/repo/suppliers/' || n_name || '.py' AS path,
  ['Class', 'Constant', 'Function'][(s_suppkey % 3 + 1)::INT] AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey),
documents_ AS (SELECT DISTINCT lower(path) AS doc_key, path, language FROM (SELECT path, 'rust' AS language FROM part_ UNION ALL SELECT path, 'python' FROM supplier_)),
symbols_ AS (
  SELECT lower(path) AS doc_key, dense_rank() OVER (ORDER BY p_type)::BIGINT AS ordinal, 'type:' || p_type || ':1:1' AS local_id, p_type AS name, p_type AS fq_name, 'Type' AS kind, NULL::VARCHAR AS parent, 1::INT AS line
  FROM (SELECT DISTINCT path, p_type FROM part_)
  UNION ALL SELECT lower(path), 1000 + p_partkey, 'function:' || p_name || ':' || (p_partkey + 2) || ':5', p_name, p_type || '::' || p_name, 'Function', 'type:' || p_type || ':1:1', (p_partkey + 2)::INT FROM part_
  UNION ALL SELECT lower(path), s_suppkey, lower(kind) || ':' || s_name || ':' || (s_suppkey + 1) || ':1', s_name, s_name, kind, NULL, (s_suppkey + 1)::INT FROM supplier_),
lines_ AS (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k,
    lower(kind) || ':' || s_name || ':' || (s_suppkey + 1) || ':1' AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier_ ON l_suppkey = s_suppkey LEFT JOIN (SELECT p_partkey, p_name FROM part) ON l_partkey = p_partkey),
fn_ AS (SELECT *, 'function:' || p_name || ':' || (p_partkey + 2) || ':5' AS source FROM part_),
relations_ AS (
  SELECT lower(path) AS doc_key, 2 * k AS ordinal, CASE WHEN l_linestatus = 'F' AND s_nationkey >= 5 THEN 'Import' ELSE 'Reference' END AS kind, source, o_orderpriority AS target FROM lines_
  UNION ALL SELECT lower(path), 2 * k + 1, 'Call', source, p_name FROM lines_ WHERE p_name IS NOT NULL
  UNION ALL SELECT lower(a.path), 3 * a.p_partkey, 'Reference', a.source, b.p_name FROM fn_ a JOIN part b ON b.p_partkey = a.p_partkey + 1
  UNION ALL SELECT lower(a.path), 3 * a.p_partkey + 1, 'Call', a.source, b.p_type || '::' || b.p_name FROM fn_ a JOIN part b ON b.p_partkey = 7 * a.p_partkey % (SELECT count(*) FROM part)
  UNION ALL SELECT lower(path), 3 * p_partkey + 2, 'Reference', source, 'missing' FROM fn_ WHERE p_partkey % 10 = 0),
names_ AS (
  SELECT n, doc_key, ordinal, 'symbol::' || doc_key || '::' || local_id AS id FROM (SELECT name AS n, doc_key, ordinal, local_id FROM symbols_ UNION ALL SELECT fq_name, doc_key, ordinal, local_id FROM symbols_)),
local_ AS (SELECT n, doc_key, arg_min(id, (ordinal, id)) AS id FROM names_ GROUP BY ALL),
global_ AS (SELECT n, arg_min(id, (doc_key, ordinal, id)) AS id FROM names_ GROUP BY ALL),
resolved_ AS (
  SELECT r.*, coalesce(l.id, g.id) IS NULL AS external, coalesce(l.id, g.id, CASE WHEN regexp_matches(target, '[./-]|::') THEN 'module::' || target END) AS dst
  FROM relations_ r LEFT JOIN local_ l ON l.n = r.target AND l.doc_key = r.doc_key LEFT JOIN global_ g ON g.n = r.target),
imports_ AS (SELECT dst, min((doc_key, ordinal)) AS at FROM resolved_ WHERE external AND kind = 'Import' AND dst IS NOT NULL GROUP BY dst),
nodes AS (
  SELECT 'repo::/repo' AS id, 'Repository' AS kind, NULL AS language, NULL AS symbol_kind, 'repo' AS name, '/repo' AS fq_name, '/repo' AS path, NULL::INT AS start_line
  UNION ALL SELECT 'file::' || doc_key, 'File', language, NULL, string_split(path, '/')[-1], doc_key, path, NULL FROM documents_
  UNION ALL SELECT 'symbol::' || doc_key || '::' || local_id, 'Symbol', language, kind, name, fq_name, path, line FROM symbols_ JOIN documents_ USING (doc_key)
  UNION ALL SELECT dst, 'Symbol', NULL, 'Module', dst[9:], dst[9:], NULL, NULL FROM imports_),
kept_ AS (
  SELECT DISTINCT r.kind, 'symbol::' || r.doc_key || '::' || source AS src, r.dst, path, doc_key
  FROM resolved_ r JOIN documents_ USING (doc_key) LEFT JOIN imports_ i ON i.dst = r.dst WHERE r.dst IS NOT NULL AND (NOT external OR r.kind = 'Import' OR (r.doc_key, r.ordinal) > i.at)),
raw_ AS (
  SELECT 'Contains' AS kind, 'repo::/repo' AS src, 'file::' || doc_key AS dst, path AS file_path, 'repository contains file' AS reason FROM documents_
  UNION ALL SELECT 'Defines', CASE WHEN parent IS NULL THEN 'file::' || doc_key ELSE 'symbol::' || doc_key || '::' || parent END, 'symbol::' || doc_key || '::' || local_id, path, 'symbol definition' FROM symbols_ JOIN documents_ USING (doc_key)
  UNION ALL SELECT 'OwnedBy', 'symbol::' || doc_key || '::' || local_id, 'file::' || doc_key, path, 'symbol declared in file' FROM symbols_ JOIN documents_ USING (doc_key)
  UNION ALL SELECT 'Contains', 'symbol::' || doc_key || '::' || parent, 'symbol::' || doc_key || '::' || local_id, path, 'nested symbol' FROM symbols_ JOIN documents_ USING (doc_key) WHERE parent IS NOT NULL
  UNION ALL SELECT CASE kind WHEN 'Import' THEN 'Imports' WHEN 'Call' THEN 'Calls' ELSE 'References' END, src, dst, path, CASE kind WHEN 'Import' THEN 'import' WHEN 'Call' THEN 'call' ELSE 'identifier' END FROM kept_
  UNION ALL SELECT DISTINCT 'DependsOn', src, dst, path, 'derived dependency' FROM kept_),
edges AS MATERIALIZED (SELECT 'edge::' || kind || '::' || src || '::' || dst || '::' || lower(file_path) AS id, * FROM raw_)
"""
NODES, EDGES = ", ".join(NODE_COLUMNS), ", ".join(EDGE_COLUMNS)
TARGET = "(SELECT id FROM nodes WHERE id = '{0}' OR name = '{0}' OR fq_name = '{0}' ORDER BY id <> '{0}', id LIMIT 1)"


def _walk(target: str, depth: int, kinds: str, direction: str) -> str:
    """CTEs: ``seen(id, level)`` and ``found`` edges of a bounded search."""
    hop = {"outbound": "SELECT src AS cur, dst AS nxt, id FROM edges WHERE kind IN ({0})", "inbound": "SELECT dst AS cur, src AS nxt, id FROM edges WHERE kind IN ({0})"}
    hop["both"] = f"{hop['outbound']} UNION ALL {hop['inbound']}"
    return f""", hops AS MATERIALIZED ({hop[direction].format(kinds)}),
reach(id, level) AS (SELECT {TARGET.format(target)}, 0 UNION SELECT nxt, level + 1 FROM reach JOIN hops ON cur = reach.id WHERE level < {depth}),
seen AS (SELECT id, min(level) AS level FROM reach GROUP BY id),
found AS (SELECT DISTINCT hops.id FROM hops JOIN seen ON cur = seen.id WHERE level < {depth})
"""


#: Packages of the projected repository: all of it, the parts, and the suppliers of some nations.
MANIFESTS = {"/repo": "root", "/repo/parts": "parts", "/repo/suppliers/NATION_1": "ones"}
PACKAGES = f""", m(path, name) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in MANIFESTS.items())}),
owned AS (SELECT id, kind, CASE WHEN starts_with(lower(path), '/repo/parts') THEN 'parts' WHEN starts_with(lower(path), '/repo/suppliers/nation_1') THEN 'ones' ELSE 'root' END AS package
  FROM nodes WHERE path IS NOT NULL AND kind IN ('File', 'Symbol'))
"""


def manifests(spark: SparkSession) -> DataFrame:
    rows = [(f"{path}/Cargo.toml", f'[workspace]\nname = "no"\n\n[package]\nversion = "1"\nname = "{name}"\n[lib]\nname = "no"\n') for path, name in MANIFESTS.items()]
    return spark.createDataFrame([*rows, ("/repo/target/x/Cargo.toml", '[package]\nname = "built"\n'), ("/repo/y/Cargo.toml", "[workspace]\n")], "path string, content string")


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of manifests made from ``nation``; every fifth has no name, so its folder's counts."""
    t = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(' name="'), "n_name", F.lit('"\r\n')))
    content = F.concat(F.lit("[package]\r\n"), line, F.lit("[dependencies]\nname = \"no\"\n"))
    return packages(t.select(F.concat(F.lit("/Repo/Pkg"), F.col("n_regionkey").cast("string"), F.lit("\\"), "n_name", F.lit("_/Cargo.toml")).alias("path"), content.alias("content")))


def changes(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """A change feed made from ``orders``: a path for each customer, some of them in folders that are skipped."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet") if orders is None else orders
    folder = F.when(F.col("o_custkey") % 7 == 0, F.lit("node_modules")).otherwise(F.lit("Src"))
    path = F.concat(F.lit("/repo/"), folder, F.lit("/C"), F.col("o_custkey").cast("string"), F.lit(".py"))
    op = F.when(F.col("o_orderstatus") == "F", F.lit("delete")).otherwise(F.lit("upsert"))
    return t.select(path.alias("path"), op.alias("op"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("long").alias("seq"))


def refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph of an earlier state of the projected tables, after the change to the present one."""
    keep = Keeper(spark)
    old, new, gone = earlier(*build.stored_tables(*tables(spark, sf_dir), keep))
    nodes, edges = build.build_graph(REPO, *old, keep=keep)
    return apply_delta(nodes, edges, graph_delta(REPO, old, new, gone, keep))


_indexes: dict[tuple[str, str], tuple[Adjacency, TrigramIndex, Keeper]] = {}


def _dropped(adjacency: Adjacency) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        adjacency.drop()


def index(spark: SparkSession, sf_dir: str) -> tuple[Adjacency, TrigramIndex, Keeper]:
    """The numbered, bucketed and indexed graph of a folder, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        g, keep = graph(spark, sf_dir)[0], Keeper(spark)
        adjacency = Adjacency.store(f"symgraph_{uuid.uuid4().hex}", g.nodes, g.edges, keep)
        atexit.register(_dropped, adjacency)
        names = adjacency.table("nodes").where("kind = 'Symbol'").select("nid", "name")
        _indexes[key] = adjacency, TrigramIndex(names, "name", keep), keep
    return _indexes[key]


def removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of one file reaches: documents built anew or dropped, edges dropped, edges of all."""
    g, keep = graph(spark, sf_dir)[0], Keeper(spark)
    t = g.stored
    gone = t[0].where(F.col("doc_key") == GONE).select("doc_key")
    delta = graph_delta(REPO, t, tuple(x.limit(0) for x in t), gone, keep)
    left = kept_edges(g.edges, delta.replaced).agg(F.count("*").alias("left"))
    n = g.edges.agg(F.count("*").alias("edges"))
    return delta.replaced.agg(F.count("*").alias("documents")).join(F.broadcast(n)).join(F.broadcast(left)).select("documents", "edges", (F.col("edges") - F.col("left")).alias("dropped"))  # single rows


GONE = "/repo/parts/brand_11.rs"
REMOVAL = f"""
, gone_ AS (SELECT n FROM global_ WHERE starts_with(id, 'symbol::{GONE}::')),
reached_ AS (SELECT '{GONE}' AS doc_key UNION SELECT r.doc_key FROM relations_ r JOIN gone_ ON n = target WHERE NOT EXISTS (FROM local_ l WHERE l.n = r.target AND l.doc_key = r.doc_key))
SELECT (SELECT count(*) FROM reached_) AS documents, count(*) AS edges, count(*) FILTER (lower(file_path) IN (SELECT doc_key FROM reached_)) AS dropped FROM edges
"""
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed through a stream with keyed state: the last event of each key."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    events = changes(spark, sf_dir, spark.readStream.schema(schema).parquet(f"{sf_dir}/orders*.parquet"))
    at = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    query = newer(events).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()
    return latest(spark.read.parquet(f"{at}/out"))


def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of places in ``documents``: of each text from its second line on, and beyond its end."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_key"), F.col("text").alias("source"), F.col("doc_id").cast("int").alias("n"))
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for k, (a, b) in enumerate(PLACES)])).alias("p")
    places = d.select("doc_key", place).select(F.concat("doc_key", F.lit(":"), F.col("p.k").cast("string")).alias("id"), "doc_key", "p.start_line", "p.end_line")
    return snippets(places, d, 3)


def exchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after an export to JSON and back."""
    at = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    export_graph({"edges": graph(spark, sf_dir)[0].edges.select(*EDGE_COLUMNS)}, at)
    return import_graph(spark, at)["edges"]


PLACES = [(2, 9), (1, 1), (3, 3), (50, 60)]
CHANGES = """WITH c AS (SELECT '/repo/' || CASE WHEN o_custkey % 7 = 0 THEN 'node_modules' ELSE 'Src' END || '/C' || o_custkey || '.py' AS path, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END AS op, o_orderpriority AS source, o_orderkey AS seq FROM orders)
"""
#: Queries of the tables themselves, without the graph.
PLAIN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "package_names": (package_names, "SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_name || '_' ELSE n_name END AS name, '/Repo/Pkg' || n_regionkey || '/' || n_name || '_' AS path, lower('/Repo/Pkg' || n_regionkey || '/' || n_name || '_') AS prefix FROM nation"),
    "change_feed_latest": (lambda spark, d: latest(changes(spark, d)), CHANGES + "SELECT lower(path) AS key, arg_max(path, (seq, op)) AS path, arg_max(op, (seq, op)) AS op, arg_max(source, (seq, op)) AS source FROM c GROUP BY lower(path)"),
    "change_feed_keys": (lambda spark, d: change_keys(changes(spark, d).select("path")).groupBy("key").agg(F.count("*").alias("n")), CHANGES + "SELECT lower(path) AS key, count(*) AS n FROM c WHERE NOT contains(path, '/node_modules/') GROUP BY ALL"),
}
PLAIN |= {
    "refreshed_nodes": (lambda spark, d: refreshed(spark, d)[0].select(*NODE_COLUMNS), f"{PRELUDE} SELECT {NODES} FROM nodes"),
    "refreshed_edges": (lambda spark, d: refreshed(spark, d)[1].select(*EDGE_COLUMNS), f"{PRELUDE} SELECT {EDGES} FROM edges"),
    "refresh_removal": (removal, PRELUDE + REMOVAL),
    "lookup_target": (lambda spark, d: index(spark, d)[0].table("keys").where(F.col("key") == PLATE).select("key", "id"), f"{PRELUDE} SELECT '{PLATE}' AS key, id FROM nodes WHERE id = '{PLATE}' OR name = '{PLATE}' OR fq_name = '{PLATE}'"),
    "lookup_keys": (lambda spark, d: index(spark, d)[0].table("keys").select("key", "id"), f"{PRELUDE} SELECT id AS key, id FROM nodes UNION SELECT name, id FROM nodes UNION SELECT fq_name, id FROM nodes WHERE fq_name IS NOT NULL"),
    "node_numbers": (lambda spark, d: index(spark, d)[0].table("nodes").select("id", "nid"), f"{PRELUDE} SELECT id, row_number() OVER (ORDER BY id) - 1 AS nid FROM nodes"),
    "edges_decoded": (lambda spark, d: (lambda a: a.edge_rows(a.table("in")).select(*EDGE_COLUMNS))(index(spark, d)[0]), f"{PRELUDE} SELECT {EDGES} FROM edges"),
    "trigram_contains": (lambda spark, d: (lambda a, x, _: a.node_rows(x.containing("PLATE")).select(*NODE_COLUMNS))(*index(spark, d)), f"{PRELUDE} SELECT {NODES} FROM nodes WHERE kind = 'Symbol' AND contains(lower(name), 'plate')"),
    "change_feed_streamed": (streamed, CHANGES + "SELECT lower(path) AS key, arg_max(path, (seq, op)) AS path, arg_max(op, (seq, op)) AS op, arg_max(source, (seq, op)) AS source FROM c GROUP BY lower(path)"),
    "snippets": (
        text_snippets,
        f"""WITH p(k, a, b) AS (VALUES {', '.join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(PLACES))}), d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id || ':' || k AS id, CASE WHEN len(x) >= a THEN nullif(regexp_replace(replace(array_to_string(x[a:least(b, a + 2)], chr(10)), chr(13) || chr(10), chr(10)), chr(13) || '$', ''), '') END AS snippet FROM d, p""",
    ),
    "exported_edges": (exchanged, f"{PRELUDE} SELECT {EDGES} FROM edges"),
    "edge_ids_repeated": (
        lambda spark, d: build.id_counts(graph(spark, d)[0].edges, Keeper(spark)),
        f"{PRELUDE} SELECT count(*) AS edges, count(DISTINCT id) AS ids, count(*) FILTER (id IS NULL OR kind IS NULL) AS without FROM edges",
    ),
}
ALL_KINDS = "'DependsOn', 'Calls', 'References', 'Imports'"
Entry = tuple[Callable[[Graph, tuple], DataFrame], str]


def entries() -> dict[str, Entry]:
    n = lambda df: df.select(*NODE_COLUMNS)
    e = lambda df: df.select(*EDGE_COLUMNS)
    out: dict[str, Entry] = {
        "files_scan": (lambda g, t: t[0], "SELECT doc_key, path, language FROM documents_"),
        "nodes_build": (lambda g, t: n(g.nodes), f"SELECT {NODES} FROM nodes"),
        "resolve_names": (
            lambda g, t: build.resolve_names(t[1], t[2]).groupBy("dst", "external", "kind").agg(F.count("*").alias("n")),
            "SELECT dst, external, kind, count(*) AS n FROM resolved_ WHERE dst IS NOT NULL GROUP BY ALL",
        ),
        "external_modules": (lambda g, t: build.first_imports(build.resolve_names(t[1], t[2])).select("dst", "at.doc_key", "at.ordinal"), "SELECT dst, imports_.at[1] AS doc_key, imports_.at[2] AS ordinal FROM imports_"),
        "index_stats": (lambda g, t: build.index_stats(t[0], g.nodes, g.edges), "SELECT (SELECT count(*) FROM documents_) AS file_count, (SELECT count(*) FROM nodes WHERE kind = 'Symbol') AS symbol_count, (SELECT count(*) FROM edges) AS edge_count"),
        "resolve_target": (lambda g, t: n(g.nodes.where(F.col("id") == g.resolve(PLATE))), f"SELECT {NODES} FROM nodes WHERE id = {TARGET.format(PLATE)}"),
        "callers_nodes": (lambda g, t: n(g.callers(PLATE)[0]), f"SELECT {NODES} FROM nodes WHERE id = {TARGET.format(PLATE)} OR id IN (SELECT src FROM edges WHERE kind = 'Calls' AND dst = {TARGET.format(PLATE)})"),
        "callers_edges": (lambda g, t: e(g.callers(PLATE)[1]), f"SELECT {EDGES} FROM edges WHERE kind = 'Calls' AND dst = {TARGET.format(PLATE)}"),
        "callees_nodes": (lambda g, t: n(g.callees(SUPPLIER)[0]), f"SELECT {NODES} FROM nodes WHERE id = {TARGET.format(SUPPLIER)} OR id IN (SELECT dst FROM edges WHERE kind = 'Calls' AND src = {TARGET.format(SUPPLIER)})"),
        "callees_edges": (lambda g, t: e(g.callees(SUPPLIER)[1]), f"SELECT {EDGES} FROM edges WHERE kind = 'Calls' AND src = {TARGET.format(SUPPLIER)}"),
        "node": (lambda g, t: n(g.node("file::/repo/suppliers/nation_3.py")), f"SELECT {NODES} FROM nodes WHERE id = 'file::/repo/suppliers/nation_3.py'"),
        "references": (
            lambda g, t: g.references(PLATE).select("edge_id", "edge_kind", "src", "name"),
            f"SELECT e.id AS edge_id, e.kind AS edge_kind, src, n.name FROM edges e JOIN nodes n ON n.id = src WHERE e.kind IN ('References', 'Calls', 'Imports') AND dst = {TARGET.format(PLATE)}",
        ),
        "explain": (
            lambda g, t: g.explain(PLATE).withColumns({c: F.array_join(c, ",") for c in ("top_callers", "top_callees")}),
            f""", t AS (SELECT {TARGET.format(PLATE)} AS t),
x AS (SELECT e.*, n.name AS other FROM edges e JOIN t ON src = t OR dst = t JOIN nodes n ON n.id = CASE WHEN dst = t THEN src ELSE dst END),
c AS (SELECT count(*) FILTER (dst = t) AS incoming, count(*) FILTER (src = t) AS outgoing,
  array_to_string(list_sort(list(DISTINCT other) FILTER (dst = t AND kind IN ('Calls', 'References')))[1:5], ',') AS top_callers,
  array_to_string(list_sort(list(DISTINCT other) FILTER (src = t AND kind = 'Calls'))[1:5], ',') AS top_callees FROM x, t)
SELECT id, fq_name || ' [' || symbol_kind || '] — ' || incoming || ' callers, ' || outgoing || ' dependencies. Defined at ' || path || ':' || start_line || '.' AS summary, incoming, outgoing, top_callers, top_callees
FROM nodes JOIN t ON id = t, c""",
        ),
        "search_ranked": (
            lambda g, t: g.search("plate", 20).select("id", "score", "match_reason"),
            """, m AS (SELECT *, contains(lower(name), 'plate') AS a, coalesce(contains(lower(path), 'plate'), false) AS b, contains(lower(fq_name), 'plate') AND NOT contains(lower(name), 'plate') AS c FROM nodes WHERE kind = 'Symbol'),
s AS (SELECT *, 50 * a::INT + 30 * b::INT + 20 * c::INT + 10 * (symbol_kind IN ('Type', 'Trait', 'Interface', 'Class'))::INT - 10 * (symbol_kind IN ('Variable', 'Constant'))::INT AS raw FROM m)
SELECT id, least(100, raw)::INT AS score, concat_ws(', ', CASE WHEN a THEN 'name match' END, CASE WHEN b THEN 'file path match' END, CASE WHEN c THEN 'qualified name match' END) AS match_reason
FROM s WHERE raw > 0 ORDER BY score DESC, name, id LIMIT 20""",
        ),
        "summary_counts": (lambda g, t: g.summary_counts(), "SELECT count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind = 'Symbol') AS symbols, (SELECT count(*) FROM edges) AS edges FROM nodes"),
        "summary_languages": (lambda g, t: g.languages(), "SELECT language, count(*) AS files FROM nodes WHERE kind = 'File' GROUP BY language"),
        "summary_top_referenced": (lambda g, t: g.top_referenced(10), "SELECT n.id, name, count(*) AS inbound FROM nodes n JOIN edges e ON dst = n.id WHERE n.kind = 'Symbol' GROUP BY ALL ORDER BY inbound DESC, name, n.id LIMIT 10"),
        "summary_entry_points": (lambda g, t: g.entry_points(10).select("id"), "SELECT id FROM nodes WHERE kind = 'Symbol' AND symbol_kind = 'Function' AND id NOT IN (SELECT dst FROM edges) ORDER BY id LIMIT 10"),
        "entry_points_of_calls": (lambda g, t: Graph(g.nodes, g.edges.where("kind = 'Calls'")).entry_points(10).select("id"), "SELECT id FROM nodes WHERE kind = 'Symbol' AND symbol_kind = 'Function' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'Calls') ORDER BY id LIMIT 10"),
        "package_nodes": (lambda g, t: package_graph(g, manifests(g.nodes.sparkSession))[0], f"{PACKAGES} SELECT name, m.path, count(*) FILTER (kind = 'File') AS file_count, count(*) FILTER (kind = 'Symbol') AS symbol_count FROM m LEFT JOIN owned ON package = name GROUP BY ALL"),
        "package_edges": (
            lambda g, t: package_graph(g, manifests(g.nodes.sparkSession))[1],
            f"{PACKAGES} SELECT a.package AS src, b.package AS dst, count(*) AS evidence_count FROM edges e JOIN owned a ON a.id = src JOIN owned b ON b.id = dst WHERE e.kind = 'DependsOn' AND a.package <> b.package GROUP BY ALL",
        ),
        "summary_largest_files": (lambda g, t: g.largest_files(10), "SELECT path, count(*) AS symbols FROM nodes WHERE kind = 'Symbol' AND path IS NOT NULL GROUP BY path ORDER BY symbols DESC, string_split(path, '/') LIMIT 10"),
    }
    for kind in ("Contains", "Defines", "OwnedBy", "Imports", "References", "Calls", "DependsOn"):
        out[f"edges_{kind.lower()}"] = (lambda g, t, k=kind: e(g.edges.where(F.col("kind") == k)), f"SELECT {EDGES} FROM edges WHERE kind = '{kind}'")
    filters = {
        "name": (SymbolFilter(name=PLATE), f"name = '{PLATE}'"), "fq": (SymbolFilter(fq_name="LARGE::red plate"), "fq_name = 'LARGE::red plate'"), "kind": (SymbolFilter(kind="Class"), "symbol_kind = 'Class'"),
        "contains": (SymbolFilter(name_contains="PLATE", limit=1000), "contains(lower(name), 'plate')"), "prefix": (SymbolFilter(name_prefix="Red", limit=1000), "starts_with(lower(name), 'red')"), "limit": (SymbolFilter(limit=7), "true"),
    }
    for name, (f, where) in filters.items():
        out[f"find_symbol_{name}"] = (lambda g, t, f=f: n(g.find_symbol(f)), f"SELECT {NODES} FROM nodes WHERE kind = 'Symbol' AND {where} ORDER BY id LIMIT {f.limit}")
        if name in ("name", "kind", "contains", "prefix"):
            every = replace(f, unlimited=True)
            out[f"find_symbol_{name}_all"] = (lambda g, t, f=every: n(g.find_symbol(f)), f"SELECT {NODES} FROM nodes WHERE kind = 'Symbol' AND {where}")
    for direction, depth in (("outbound", 0), ("outbound", 1), ("outbound", 3), ("inbound", 2), ("both", 2)):
        target = PLATE if direction == "inbound" else SUPPLIER
        walk = _walk(target, depth, "'DependsOn'", direction)
        out[f"deps_{direction}_d{depth}_nodes"] = (lambda g, t, a=(target, direction, depth): n(g.dependencies(*a)[0]), f"{walk} SELECT {NODES} FROM nodes WHERE id IN (SELECT id FROM seen)")
        out[f"deps_{direction}_d{depth}_edges"] = (lambda g, t, a=(target, direction, depth): e(g.dependencies(*a)[1]), f"{walk} SELECT {EDGES} FROM edges WHERE id IN (SELECT id FROM found)")
    for depth in (1, 3):
        walk = _walk(PLATE, depth, ALL_KINDS, "inbound")
        own = "OR id IN (SELECT src FROM edges WHERE id IN (SELECT id FROM found))"
        out[f"impact_d{depth}_nodes"] = (lambda g, t, d=depth: n(g.impact(PLATE, d)[0]), f"{walk} SELECT {NODES} FROM nodes WHERE id IN (SELECT id FROM seen WHERE level > 0) {own}")
        out[f"impact_d{depth}_edges"] = (lambda g, t, d=depth: e(g.impact(PLATE, d)[1]), f"{walk} SELECT {EDGES} FROM edges WHERE id IN (SELECT id FROM found)")
    return out


def indexed() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Walks over the bucketed adjacency, with the SQL of those over the edges; frontiers of over 10 nodes are dealt."""
    out = {}
    for kind, target, direction, depth in (("deps", SUPPLIER, "outbound", 3), ("deps", SUPPLIER, "both", 2), ("impact", PLATE, "inbound", 3)):

        def run(spark, d, part, kind=kind, target=target, direction=direction, depth=depth):
            a, _, keep = index(spark, d)
            found = a.impact(target, keep, depth, 10) if kind == "impact" else a.dependencies(target, keep, direction, depth, 10)
            return found[part].select(*(EDGE_COLUMNS if part else NODE_COLUMNS))

        name = f"{kind}_d{depth}" if kind == "impact" else f"{kind}_{direction}_d{depth}"
        for part, what in enumerate(("nodes", "edges")):
            out[f"dense_{name}_{what}"] = (lambda spark, d, run=run, part=part: run(spark, d, part)), f"{name}_{what}"
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in indexed().items()} | {k: (lambda spark, sf_dir, f=f: f(*graph(spark, sf_dir))) for k, (f, _) in entries().items()} | {k: f for k, (f, _) in PLAIN.items()}


def oracle_sql() -> dict[str, str]:
    found = {k: PRELUDE + sql for k, (_, sql) in entries().items()}
    return found | {k: found[like] for k, (_, like) in indexed().items()} | {k: sql for k, (_, sql) in PLAIN.items()}
