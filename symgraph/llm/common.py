"""Helpers shared by the training-data operators: shared-folder tables, checked joins, word kernels."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
#: A side is broadcast only below this many rows (counted) and bytes of its Parquet files; beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 4 << 20
#: Bytes of text that the numpy kernels work on at once (a longer single document is one slice).
SLICE_BYTES = 1 << 18

#: Bytes of an Arrow batch on its way to a Python worker and back; by rows alone, 10,000 long texts would be one.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_tables: list[str] = []


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless that is set already."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one, if all tasks run in
    this process (tests); on a cluster executors would not see one another's files."""
    bounded_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(drop_tables)
    _tables.append(path)
    return path


#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; it outlives lost executors."""
    spark = df.sparkSession
    path, before = new_folder(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written and that nothing reads any more."""
    for df in tables:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            name = folder.rpartition("/")[2]
            for path in [x for x in _tables if x.endswith(f"/{name}")]:
                _tables.remove(path)
                _delete(df.sparkSession, path)


def drop_tables() -> None:
    """Delete the tables that ``materialize`` has written in this process (also run at exit)."""
    spark = SparkSession.getActiveSession()
    try:
        while spark is not None and _tables:
            _delete(spark, _tables.pop())
    except Exception:  # the JVM may be gone at exit
        _tables.clear()


def checked(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (of materialized tables) with a broadcast hint if it has at most ``limit`` rows and its files
    at most ``size`` bytes for its columns; else unchanged: then the join shuffles both sides, and AQE
    splits hot keys."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > size:
        return df
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda x: x != "")


# ---- numpy word kernels over Arrow string buffers ----

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_T = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_cache.get("p", ())) < n:
        base = int(_P)
        _cache["p"], _cache["q"] = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        if n > 4 * SLICE_BYTES:
            return _cache.pop("p"), _cache.pop("q")
    return _cache["p"], _cache["q"]


def text_slices(texts: pa.Array) -> "list[tuple[int, int, np.ndarray, np.ndarray]]":
    """Cut an Arrow string array to runs of whole texts: (first row, end row, bytes, offsets)."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, lo = [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        out.append((lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        lo = hi
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of the texts, and how many words each text has before it (len + 1). ``gap``
    tells of each byte whether it stands between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, q = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_T[_LOWER[data] if lower else data] * p[:n], out=sums[1:])
    hashes = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64) * _M1)
    return hashes, np.searchsorted(s, offsets).astype(np.int64)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (n - k + 1 of them), whatever texts they cross."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, q = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * q[:n] + np.uint64(k))
