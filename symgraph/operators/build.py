"""Documents, symbols and relations to the typed property graph.

All relational: names resolve through two pre-reduced indexes (first symbol per name and file, first
symbol per name), so a name with very many definitions never fans out; external modules follow the
rule that only an import makes one, and other relations count from the first such import on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import base_name, edge_id, file_id, norm_path, repo_id, symbol_id

NODE = "id string, kind string, language string, symbol_kind string, name string, fq_name string, path string, start_line int, start_column int, end_line int, end_column int"
SPAN = ("start_line", "start_column", "end_line", "end_column")
#: Kinds of relations and of their edges.
RELATION_EDGES = {"Import": "Imports", "Reference": "References", "Call": "Calls", "Inherit": "Inherits", "Implement": "Implements"}


def _node(df: DataFrame, **columns) -> DataFrame:
    given = {k: v for k, v in columns.items()}
    fields = [x.split() for x in NODE.split(", ")]
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def _edge(df: DataFrame, kind, src, dst, path, reason) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(edge_id(kind, src, dst, path).alias("id"), kind.alias("kind"), src.alias("src"), dst.alias("dst"), path.alias("file_path"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def name_index(symbols: DataFrame) -> DataFrame:
    """``n, doc_key, f``: of each name and qualified name in a file its first symbol there, ``f`` (doc_key, ordinal, id)."""
    first = F.struct("doc_key", "ordinal", symbol_id(F.col("doc_key"), F.col("local_id")).alias("id"))
    names = symbols.select(F.col("name").alias("n"), "doc_key", first.alias("f")).unionByName(symbols.where("fq_name IS NOT NULL").select(F.col("fq_name").alias("n"), "doc_key", first.alias("f")))
    return names.groupBy("n", "doc_key").agg(F.min("f").alias("f"))


def first_definitions(local: DataFrame) -> DataFrame:
    """``n, first_id_``: the first symbol of all with a name, from a name index."""
    return local.groupBy("n").agg(F.min("f")["id"].alias("first_id_"))


def is_module(target: Column) -> Column:
    """Whether a name without a definition stands for an external module."""
    return target.contains(".") | target.contains("/") | target.contains("::") | target.contains("-")


def resolve(relations: DataFrame, local: DataFrame, over: DataFrame) -> DataFrame:
    """``relations`` with ``dst`` by a name index and the first definitions of all (see ``resolve_names``)."""
    r = relations.join(local.select(F.col("n").alias("target_name"), "doc_key", F.col("f.id").alias("local_id_")), ["target_name", "doc_key"], "left")
    r = r.join(over.withColumnRenamed("n", "target_name"), "target_name", "left")
    t = F.col("target_name")
    found = F.coalesce("local_id_", "first_id_")
    dst = F.coalesce(found, F.when(is_module(t), F.concat(F.lit("module::"), t)))
    return r.withColumns({"external": found.isNull(), "dst": dst}).where("dst IS NOT NULL").drop("local_id_", "first_id_")


def resolve_names(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """``relations`` with ``dst``: a symbol of the same file, else the first of all, else an external
    module (``external``); rows without any are dropped."""
    local = name_index(symbols)
    return resolve(relations, local, first_definitions(local))


def first_imports(resolved: DataFrame) -> DataFrame:
    """``dst, at``: each external module, and where it is imported first."""
    first = resolved.where("external AND kind = 'Import'").groupBy("dst", "doc_key").agg(F.min("ordinal").alias("ordinal"))  # numbers need no sort
    return first.groupBy("dst").agg(F.min(F.struct("doc_key", "ordinal")).alias("at"))


def module_nodes(modules: DataFrame) -> DataFrame:
    """Nodes of external modules ``dst``."""
    module = F.regexp_replace("dst", "^(module::)+", "")
    return _node(modules, id=F.col("dst"), kind=F.lit("Symbol"), symbol_kind=F.lit("Module"), name=module, fq_name=module)


def file_nodes(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes of files and of their symbols; of a repeated local id the last symbol counts."""
    s = symbols.join(docs, "doc_key").withColumn("sid", symbol_id(F.col("doc_key"), F.col("local_id")))
    last = s.groupBy("sid").agg(F.max_by(F.struct("language", "kind", "name", "fq_name", "path", *SPAN), "ordinal").alias("x")).select("sid", "x.*")
    nodes = _node(docs, id=file_id(F.col("doc_key")), kind=F.lit("File"), language=F.col("language"), name=base_name(F.col("path")), fq_name=F.col("doc_key"), path=F.col("path"))
    return nodes.unionByName(_node(last, id=F.col("sid"), kind=F.lit("Symbol"), language=F.col("language"), symbol_kind=F.col("kind"), name=F.col("name"), fq_name=F.col("fq_name"), path=F.col("path"), **{c: F.col(c) for c in SPAN}))


def graph_nodes(repo_path: str, docs: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Nodes of the repository, its files and symbols, and the external modules."""
    repo = docs.sparkSession.range(1).select(F.lit(repo_path).alias("path"))
    name = F.coalesce(F.nullif(base_name(F.lit(repo_path)), F.lit("")), F.lit("repository"))
    nodes = _node(repo, id=repo_id(F.lit(repo_path)), kind=F.lit("Repository"), name=name, fq_name=norm_path(F.lit(repo_path)), path=F.lit(repo_path))
    return nodes.unionByName(file_nodes(docs, symbols)).unionByName(module_nodes(modules))


def structure_edges(repo_path: str, docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Contains, Defines and OwnedBy edges of files and symbols, each id once."""
    path, fid = F.col("path"), file_id(F.col("doc_key"))
    sid = symbol_id(F.col("doc_key"), F.col("local_id"))
    parents = symbols.groupBy("doc_key", F.col("local_id").alias("parent_local_id")).agg(F.min("ordinal").alias("parent_ordinal"))
    owned = symbols.select("doc_key", "local_id", "parent_local_id", "ordinal").join(parents, ["doc_key", "parent_local_id"], "left")
    owned = owned.withColumn("parent", F.when(F.col("parent_ordinal") < F.col("ordinal"), F.col("parent_local_id")))
    # A document may declare a local id twice: its parents are kept apart, the rest is one edge.
    owned = owned.groupBy("doc_key", "local_id").agg(F.collect_set(F.coalesce("parent", F.lit(""))).alias("parents")).join(docs, "doc_key").withColumn("sid", sid)
    each = owned.withColumn("parent", F.explode("parents"))
    parent = symbol_id(F.col("doc_key"), F.col("parent"))
    edges = _edge(docs, "Contains", repo_id(F.lit(repo_path)), fid, path, "repository contains file")
    edges = edges.unionByName(_edge(each, "Defines", F.when(F.col("parent") == "", fid).otherwise(parent), F.col("sid"), path, "symbol definition"))
    edges = edges.unionByName(_edge(owned, "OwnedBy", F.col("sid"), fid, path, "symbol declared in file"))
    return edges.unionByName(_edge(each.where("parent <> ''"), "Contains", parent, F.col("sid"), path, "nested symbol"))


def relation_edges(docs: DataFrame, symbols: DataFrame, resolved: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges of relations and the dependencies that follow from them, each id once. Relations of an unknown kind give
    none; of several reasons the least counts, null only where there is no other."""
    known = symbols.select("doc_key", F.col("local_id").alias("source_local_id"), F.lit(True).alias("known")).distinct()
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in RELATION_EDGES.items() for x in kv]), F.col("kind"))
    r = resolved.join(imports, "dst", "left").where("NOT external OR kind = 'Import' OR struct(doc_key, ordinal) > at").withColumn("edge", kind).where("edge IS NOT NULL")
    r = r.join(known, ["doc_key", "source_local_id"], "left").withColumn("own", F.when(F.col("known"), F.col("source_local_id")))
    # One shuffle, on the short parts of the ids: a pair's kinds (five at most) with their reasons, and its derived edge.
    r = r.groupBy("doc_key", "own", "dst").agg(F.collect_set(F.struct(F.col("edge").alias("kind"), "reason")).alias("kinds"))
    kinds = F.array_distinct(F.transform("kinds", lambda x: x["kind"]))
    least = F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.array_min(F.transform(F.filter("kinds", lambda x: x["kind"] == k), lambda x: x["reason"])).alias("reason")))
    once = F.when(F.size(kinds) == F.size("kinds"), F.col("kinds")).otherwise(least)
    derived = F.array(F.struct(F.lit("DependsOn").alias("kind"), F.lit("derived dependency").alias("reason")))
    r = r.select("doc_key", "own", "dst", F.explode(F.concat(once, derived)).alias("x")).join(docs, "doc_key")
    src = F.when(F.col("own").isNotNull(), symbol_id(F.col("doc_key"), F.col("own"))).otherwise(file_id(F.col("doc_key")))
    return _edge(r, F.col("x.kind"), src, F.col("dst"), F.col("path"), F.col("x.reason"))


def uses(relations: DataFrame) -> DataFrame:
    """``relations`` that make the same edges, each once: of an import its first place counts, of others their last. They
    are dealt by their source before they are counted, so that a task holds its own only."""
    dealt = relations.where("target_name IS NOT NULL").repartition("doc_key", "source_local_id")
    once = dealt.groupBy("doc_key", "source_local_id", "kind", "target_name", "reason").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    return once.withColumn("ordinal", F.when(F.col("kind") == "Import", F.col("first")).otherwise(F.col("last"))).select(*relations.columns)


def stored_tables(documents: DataFrame, symbols: DataFrame, relations: DataFrame, keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of a graph, written by ``keep`` (a Keeper): few documents are broadcast, relations are those of ``uses``."""
    return keep(documents), keep.write(symbols), keep.write(uses(relations))


def resolve_kept(symbols: DataFrame, some: DataFrame, keep) -> DataFrame:
    """``resolve_names``, where each name of a document is resolved once; ``keep`` writes these names and broadcasts few."""
    names = keep(resolve_names(symbols, some.select("doc_key", "target_name").distinct()))
    return some.join(names, ["doc_key", "target_name"])


def build_graph(repo_path: str, documents: DataFrame, symbols: DataFrame, relations: DataFrame, keep=None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``documents`` (doc_key, path, language), ``symbols`` (doc_key, ordinal, local_id,
    name, fq_name, kind, parent_local_id and the span's columns) and ``relations`` (doc_key, ordinal, kind,
    source_local_id, target_name, reason). No job runs until they are read, unless there is a ``keep``: it writes
    the names and imports that are met by all relations, and broadcasts them where they turn out to be few."""
    docs = documents.select("doc_key", "path", "language")
    if keep is None:
        resolved = resolve_names(symbols, relations)
        imports = first_imports(resolved)
    else:
        resolved = resolve_kept(symbols, relations, keep)
        imports = keep(first_imports(resolved))
    # Kinds of structure and of relations are apart, so no id is in both.
    edges = structure_edges(repo_path, docs, symbols).unionByName(relation_edges(docs, symbols, resolved, imports))
    return graph_nodes(repo_path, docs, symbols, imports), edges


def id_counts(edges: DataFrame, keep) -> DataFrame:
    """``edges, ids, without``: rows, distinct ids, rows without an id or a kind. Ids are told apart by 64-bit hashes, and
    themselves compared where a hash comes more than once."""
    hashed = edges.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("hash"))
    shared = keep(hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    again = hashed.join(shared, "hash", "left_semi").agg(F.count_distinct("id").alias("again"))
    rows = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    all_ = edges.agg(F.count("*").alias("edges"), F.count("id").alias("with_id"), F.count_if(F.col("id").isNull() | F.col("kind").isNull()).alias("without"))
    return all_.join(F.broadcast(rows)).join(F.broadcast(again)).select("edges", (F.col("with_id") - F.col("rows") + F.col("again")).alias("ids"), "without")  # single rows


def index_stats(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = [documents.select(F.count("*").alias("file_count")), nodes.select(F.count_if(F.col("kind") == "Symbol").alias("symbol_count")), edges.select(F.count("*").alias("edge_count"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # single rows
