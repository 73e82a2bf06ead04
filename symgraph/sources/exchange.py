"""A graph as JSON, written and read by executors: each part is one valid document, a manifest tells of all."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ExchangeError(ValueError):
    """What is read is not what the manifest tells of."""


def _document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a JSON array: each row but the first after a comma, and the closing bracket."""
    begun = False
    for b in batches:
        lines = [("," if begun or i else "[") + x for i, x in enumerate(b.column(0).to_pylist())]
        begun |= bool(lines)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"], pa.string())], names=["value"])


def export_graph(tables: dict[str, DataFrame], path: str) -> dict:
    """Write each table to ``path/name``, in parts, and the manifest to ``path/manifest``; returns the manifest. No row
    comes to the driver."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {}
    for name, df in tables.items():
        df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(_document, "value string").write.mode("errorifexists").text(f"{path}/{name}")
        manifest[name] = {"schema": df.schema.jsonValue(), "rows": _rows(spark, f"{path}/{name}").count()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value NOT IN (']', '[]')")


def import_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export, by name. A line that is no row of its table, or a table with other than the manifest's rows,
    is an error."""
    text = [r[0] for r in spark.read.text(f"{path}/manifest").collect()]  # one line
    if len(text) != 1:
        raise ExchangeError(f"no manifest at {path}")
    out = {}
    for name, about in json.loads(text[0]).items():
        schema = StructType.fromJson(about["schema"])
        rows = _rows(spark, f"{path}/{name}")
        if rows.count() != about["rows"]:
            raise ExchangeError(f"{name} has other than {about['rows']} rows")
        out[name] = rows.select(F.from_json(F.substring("value", 2, 1 << 30), schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    return out
