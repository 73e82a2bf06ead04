"""Tables written to the folder that the driver and all executors share, to cut a lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one, if all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Keeper:
    """Writes tables to the shared folder (they outlive lost executors) and marks those of ``BROADCAST_ROWS`` rows at most
    for broadcasting; larger ones are joined by shuffles. ``release`` deletes them, at the latest when Python ends."""

    BROADCAST_ROWS = 100_000

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        atexit.register(self.release)

    def write(self, df: DataFrame, **options) -> DataFrame:
        path = f"{shared_folder(self.spark)}/kept-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __call__(self, df: DataFrame) -> DataFrame:
        df = self.write(df)
        return F.broadcast(df) if df.limit(self.BROADCAST_ROWS + 1).count() <= self.BROADCAST_ROWS else df

    def release(self) -> None:
        try:
            while self.paths:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone at exit
            self.paths.clear()
