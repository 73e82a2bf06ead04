"""Package graph: packages from manifests, their files and symbols, dependencies between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import norm_path
from .query import Graph


def packages(manifests: DataFrame) -> DataFrame:
    """``name, path, prefix`` of the manifests (path, content) with a package section; manifests of build
    output do not count. The name is the first ``name`` line's value of the section, else the folder's name."""
    lines = F.transform(F.split("content", "\r?\n"), lambda x: F.trim(x))  # trim itself would take the place as what to trim
    at = F.array_position("lines", "[package]")
    rest = F.slice("lines", (at + 1).cast("int"), F.greatest(F.size("lines"), F.lit(1)))
    end = F.array_position(F.transform(rest, lambda x: x.startswith("[")), True)
    own = F.when(end > 0, F.slice(rest, 1, F.greatest((end - 1).cast("int"), F.lit(0)))).otherwise(rest)
    line = F.get(F.filter(own, lambda x: x.startswith("name") & x.contains("=")), F.lit(0))
    folder = F.regexp_replace(F.translate("path", "\\", "/"), "/[^/]*$", "")
    name = F.coalesce(F.btrim(F.trim(F.regexp_extract(line, "=(.*)$", 1)), F.lit('"')), F.element_at(F.split(folder, "/"), -1))
    m = manifests.where(~norm_path(F.col("path")).contains("/target/")).withColumn("lines", lines).where(at > 0)
    return m.select(name.alias("name"), folder.alias("path"), norm_path(folder).alias("prefix"))



def owners(paths: DataFrame, found: DataFrame) -> DataFrame:
    """``path, package``: the package with the longest prefix; no join but on equal prefixes, of the
    lengths that packages have."""
    lengths = F.broadcast(found.select(F.length("prefix").alias("n")).distinct())  # path lengths: a few hundred at most
    tried = paths.select("path", norm_path(F.col("path")).alias("key")).distinct().join(lengths, F.length("key") >= F.col("n")).select("path", F.substring("key", F.lit(1), F.col("n")).alias("prefix"))
    own = tried.join(found.groupBy("prefix").agg(F.max("name").alias("package")), "prefix")
    return own.groupBy("path").agg(F.max_by("package", F.length("prefix")).alias("package"))


def package_graph(g: Graph, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``name, path, file_count, symbol_count`` and edges ``src, dst, evidence_count`` between packages."""
    found = packages(manifests)
    nodes = g.nodes.where("path IS NOT NULL AND kind IN ('File', 'Symbol')").select("id", "kind", "path")
    owned = nodes.join(owners(nodes.select("path"), found), "path").select("id", "kind", "package")
    counts = owned.groupBy("package").agg(F.count_if(F.col("kind") == "File").alias("file_count"), F.count_if(F.col("kind") == "Symbol").alias("symbol_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = found.join(counts, F.col("name") == F.col("package"), "left").select("name", "path", zero("file_count"), zero("symbol_count"))
    e = g.edges.where("kind = 'DependsOn'").select("src", "dst")
    for end in ("src", "dst"):
        e = e.join(owned.select(F.col("id").alias(end), F.col("package").alias(f"{end}_package")), end)
    e = e.where("src_package <> dst_package").groupBy(F.col("src_package").alias("src"), F.col("dst_package").alias("dst"))
    return rows, e.agg(F.count("*").alias("evidence_count"))
