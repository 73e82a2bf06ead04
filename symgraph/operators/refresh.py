"""Incremental maintenance of the graph: from changed documents to the edges and nodes that change.

An edge depends on its own document, on the first definition of the name that its relation aims at, and, for an
external module, on the place where that is imported first. So a change reaches other documents only through

* names whose first definition of all is another one than before: relations that aim at them and have no
  definition in their own file;
* modules whose first import is another one than before: relations placed between the old and the new one.

Both indexes are compared for the names of changed documents only. The documents found this way are built anew,
by the same functions as a whole graph; edges of all others stay as they are stored. Names and documents of a
change are written once and met by semi-joins, broadcast where they are small, so that tables of the whole
repository are read in the columns needed and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.ids import norm_path
from ..sources.shared import Keeper
from .build import file_nodes, first_definitions, is_module, module_nodes, name_index, relation_edges, resolve, structure_edges

Tables = tuple[DataFrame, DataFrame, DataFrame]


@dataclass(frozen=True)
class Delta:
    """What a change does: edges of ``replaced`` documents (doc_key) give way to ``edges``; nodes of ``touched`` documents
    and of ``lost`` modules (id) to ``nodes``."""

    replaced: DataFrame
    edges: DataFrame
    touched: DataFrame
    lost: DataFrame
    nodes: DataFrame


def _differ(a: str, b: str) -> str:
    return f"NOT ({a} <=> {b})"


def moved_names(before: DataFrame, after: DataFrame, names: DataFrame) -> DataFrame:
    """Those of ``names`` (n) whose first definition differs between two tables of symbols: ``n, was, is``."""

    def firsts(symbols: DataFrame, column: str) -> DataFrame:
        some = symbols.select("doc_key", "ordinal", "local_id", "name", "fq_name")
        mine = some.join(names.withColumnRenamed("n", "name"), "name", "left_semi").unionByName(some.join(names.withColumnRenamed("n", "fq_name"), "fq_name", "left_semi")).distinct()
        index = name_index(mine.select(*some.columns)).join(names, "n", "left_semi")
        return first_definitions(index).withColumnRenamed("first_id_", column)

    return names.join(firsts(before, "was"), "n", "left").join(firsts(after, "is"), "n", "left").where(_differ("was", "is"))


def first_import_places(symbols: DataFrame, relations: DataFrame, names: DataFrame) -> DataFrame:
    """``n, at``: of those of ``names`` that stand for a module and have no definition, where they are imported first."""
    some = names.where(is_module(F.col("n")))
    for c in ("name", "fq_name"):
        some = some.join(symbols.select(F.col(c).alias("n")).where("n IS NOT NULL").join(names, "n", "left_semi").distinct(), "n", "left_anti")
    imports = relations.where("kind = 'Import'").select(F.col("target_name").alias("n"), "doc_key", "ordinal").join(some, "n", "left_semi")
    return imports.groupBy("n").agg(F.min(F.struct("doc_key", "ordinal")).alias("at"))


def graph_delta(repo_path: str, old: Tables, new: Tables, gone: DataFrame, keep: Keeper) -> Delta:
    """The change of a graph of ``old`` (documents, symbols, relations) when the documents of ``new`` come, in place of
    those with the same key, and those of ``gone`` (doc_key) go. The tables of ``keep`` must stay until it is written."""
    docs, symbols, relations = old
    touched = keep(gone.select("doc_key").unionByName(new[0].select("doc_key")).distinct())
    rest_symbols, rest_relations = (t.join(touched, "doc_key", "left_anti") for t in (symbols, relations))
    out_symbols, out_relations = (t.join(touched, "doc_key", "left_semi") for t in (symbols, relations))
    all_symbols = rest_symbols.unionByName(new[1].select(*symbols.columns))
    all_relations = rest_relations.unionByName(new[2].select(*relations.columns))

    defined = out_symbols.select("name", "fq_name").unionByName(new[1].select("name", "fq_name"))
    names = defined.select(F.explode(F.array("name", "fq_name")).alias("n")).where("n IS NOT NULL").distinct()
    moved = keep(moved_names(symbols, all_symbols, keep(names)))
    aims = out_relations.select("target_name").unionByName(new[2].select("target_name")).select(F.col("target_name").alias("n"))
    modules = keep(aims.unionByName(moved.select("n")).where(F.col("n").isNotNull()).where(is_module(F.col("n"))).distinct())
    places = modules.join(first_import_places(symbols, relations, modules).withColumnRenamed("at", "was"), "n", "left").join(first_import_places(all_symbols, all_relations, modules).withColumnRenamed("at", "is"), "n", "left")
    places = keep(places.where(_differ("was", "is")))

    aimed = rest_relations.select("doc_key", "ordinal", F.col("target_name").alias("n"))
    own = rest_symbols.select("doc_key", F.explode(F.array("name", "fq_name")).alias("n")).join(moved.select("n"), "n", "left_semi")
    by_name = aimed.join(moved.select("n"), "n", "left_semi").join(own, ["doc_key", "n"], "left_anti").select("doc_key")
    after = lambda at: f"coalesce(struct(doc_key, ordinal) > {at}, false)"
    by_module = aimed.join(places, "n").where(_differ(after("was"), after("is"))).select("doc_key")
    reached = by_name.unionByName(by_module).distinct()
    anew = keep(reached.unionByName(new[0].select("doc_key")).distinct())
    replaced = keep(reached.unionByName(touched).distinct())

    new_docs = docs.select("doc_key", "path", "language").join(touched, "doc_key", "left_anti").unionByName(new[0].select("doc_key", "path", "language")).join(anew, "doc_key", "left_semi")
    some_symbols, some_relations = all_symbols.join(anew, "doc_key", "left_semi"), all_relations.join(anew, "doc_key", "left_semi")
    targets = keep(some_relations.select(F.col("target_name").alias("n")).where("n IS NOT NULL").distinct())
    over = all_symbols.select("doc_key", "ordinal", "local_id", "name", "fq_name")
    over = over.join(targets.withColumnRenamed("n", "name"), "name", "left_semi").unionByName(over.join(targets.withColumnRenamed("n", "fq_name"), "fq_name", "left_semi").select(*over.columns))
    resolved = resolve(some_relations, name_index(some_symbols), first_definitions(name_index(over).join(targets, "n", "left_semi")))
    imports = first_import_places(all_symbols, all_relations, targets).select(F.concat(F.lit("module::"), "n").alias("dst"), "at")
    edges = structure_edges(repo_path, new_docs, some_symbols).unionByName(relation_edges(new_docs, some_symbols, resolved, imports))

    module = F.concat(F.lit("module::"), "n")
    lost = places.where("was IS NOT NULL AND is IS NULL").select(module.alias("id"))
    found = places.where("was IS NULL AND is IS NOT NULL").select(module.alias("dst"))
    nodes = file_nodes(new[0].select("doc_key", "path", "language"), new[1]).unionByName(module_nodes(found))
    return Delta(replaced, edges, touched, lost, nodes)


def kept_edges(edges: DataFrame, replaced: DataFrame) -> DataFrame:
    """Stored edges that a change leaves as they are: those of other documents than ``replaced`` (doc_key)."""
    return edges.join(replaced.select(F.col("doc_key").alias("doc")), norm_path(F.col("file_path")) == F.col("doc"), "left_anti")


def kept_nodes(nodes: DataFrame, touched: DataFrame, lost: DataFrame) -> DataFrame:
    """Stored nodes that a change leaves as they are: without those of ``touched`` (doc_key) and of ``lost`` (id)."""
    mine = F.col("path").isNotNull() & (norm_path(F.col("path")) == F.col("doc")) & (F.col("kind") != "Repository")
    return nodes.join(touched.select(F.col("doc_key").alias("doc")), mine, "left_anti").join(lost, "id", "left_anti")


def apply_delta(nodes: DataFrame, edges: DataFrame, delta: Delta) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a change."""
    return kept_nodes(nodes, delta.touched, delta.lost).unionByName(delta.nodes), kept_edges(edges, delta.replaced).unionByName(delta.edges)


def written(delta: Delta, documents: DataFrame) -> dict[str, DataFrame]:
    """The tables that a change is stored as; ``documents`` are the new ones, as they are stored."""
    return {"documents": documents, "nodes": delta.nodes, "edges": delta.edges, "touched": delta.touched, "replaced": delta.replaced, "lost": delta.lost}


def next_documents(documents: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """Stored documents after a change."""
    return documents.join(touched, "doc_key", "left_anti").unionByName(new)


def overlay(table: str, before: DataFrame, part) -> DataFrame:
    """A stored table after one more stored change, of which ``part(name, schema)`` reads the tables."""
    new, keys = part(table, before.schema), StructType([before.schema["doc_key"] if table == "documents" else StructField("doc_key", StringType())])
    if table == "documents":
        return next_documents(before, part("touched", keys), new)
    if table == "nodes":
        return kept_nodes(before, part("touched", keys), part("lost", StructType([StructField("id", StringType())]))).unionByName(new)
    return kept_edges(before, part("replaced", keys)).unionByName(new)
