"""Source files to documents, symbols and relations: one Arrow-batched pass, then plain projections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scanner import extract, extractors

_SYMBOL = [("local_id", pa.string()), ("name", pa.string()), ("fq_name", pa.string()), ("kind", pa.string()), ("parent_local_id", pa.string()), *[(c, pa.int32()) for c in ("start_line", "start_column", "end_line", "end_column")]]
_RELATION = [("kind", pa.string()), ("source_local_id", pa.string()), ("target_name", pa.string()), ("reason", pa.string()), ("start_line", pa.int32()), ("start_column", pa.int32())]
_DDL = {pa.string(): "string", pa.int32(): "int"}
_SCHEMA = pa.schema([("doc_key", pa.string()), ("path", pa.string()), ("language", pa.string()), ("content_hash", pa.string()), ("symbols", pa.list_(pa.struct(_SYMBOL))), ("relations", pa.list_(pa.struct(_RELATION)))])


def _struct(fields) -> str:
    return "array<struct<" + ", ".join(f"{n}: {_DDL[t]}" for n, t in fields) + ">>"


def extract_documents(files: DataFrame) -> DataFrame:
    """``doc_key, path, language, content_hash, symbols, relations`` of ``files`` (doc_key, path, language, source)."""
    own = extractors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                rows = []
                for r in b.slice(i, 100).to_pylist():
                    symbols, relations = extract(r["language"], r.pop("source"), own)
                    rows.append(r | {"symbols": symbols, "relations": relations})
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    rows = files.select("doc_key", "path", "language", F.sha2("source", 256).alias("content_hash"), "source")
    return rows.mapInArrow(run, f"doc_key string, path string, language string, content_hash string, symbols {_struct(_SYMBOL)}, relations {_struct(_RELATION)}")


def tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, symbols and relations as the graph's build takes them; ``ordinal`` is the place in the file."""
    s = documents.select("doc_key", F.posexplode("symbols").alias("ordinal", "s")).select("doc_key", F.col("ordinal").cast("long"), "s.*")
    r = documents.select("doc_key", F.posexplode("relations").alias("ordinal", "r")).select("doc_key", F.col("ordinal").cast("long"), "r.*")
    return documents.select("doc_key", "path", "language", "content_hash"), s, r
