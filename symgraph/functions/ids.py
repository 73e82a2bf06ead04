"""Column functions for paths, names and identities of the code graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Language of each file extension.
LANGUAGES = {
    "javascript": "js jsx mjs cjs", "typescript": "ts tsx", "python": "py", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt kts",
    "csharp": "cs", "cpp": "cpp cc cxx hpp", "c": "c h", "swift": "swift", "objc": "m mm", "ruby": "rb", "php": "php", "scala": "scala",
    "elixir": "ex exs", "erlang": "erl hrl", "dart": "dart", "lua": "lua", "r": "r", "julia": "jl", "haskell": "hs", "ocaml": "ml mli",
    "clojure": "clj cljs cljc", "bash": "sh bash", "html": "html htm", "css": "css", "yaml": "yaml yml",
}
EXTENSIONS = {e: lang for lang, es in LANGUAGES.items() for e in es.split()}


def ascii_lower(x: Column) -> Column:
    """Lower-case A-Z only; other letters stay (``lower`` would change them too)."""
    return F.translate(x, UPPER, LOWER)


def norm_path(path: Column) -> Column:
    return ascii_lower(F.translate(path, "\\", "/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def language_of(path: Column) -> Column:
    """Language by extension; null where the name has none (``.bashrc``) or it is unknown."""
    ext = ascii_lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))
    at = F.array_position(F.array(*[F.lit(k) for k in EXTENSIONS]), ext)
    return F.get(F.array(*[F.lit(v) for v in EXTENSIONS.values()]), (at - 1).cast("int"))


def file_id(doc_key: Column) -> Column:
    return F.concat(F.lit("file::"), doc_key)


def repo_id(path: Column) -> Column:
    return F.concat(F.lit("repo::"), norm_path(path))


def symbol_id(doc_key: Column, local_id: Column) -> Column:
    return F.concat(F.lit("symbol::"), doc_key, F.lit("::"), local_id)


def edge_id(kind: Column, src: Column, dst: Column, file_path: Column) -> Column:
    return F.concat(F.lit("edge::"), kind, F.lit("::"), src, F.lit("::"), dst, F.lit("::"), F.coalesce(norm_path(file_path), F.lit("")))
