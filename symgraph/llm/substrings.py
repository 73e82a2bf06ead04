"""Substring dedup by seed and extend.

A window is ``window`` consecutive words; what is removed are the words of windows whose sequence
starts anywhere else too.

1. Seeds. Each window's anchor is its winnowed 16-word shingle: the one with the least hash (the first
   of equals), which depends on the window alone, so equal windows have equal anchors at equal places.
   Consecutive windows with the same anchor form a run.
2. Extend. A run's extent both ways from its anchor is hashed; runs with equal anchor and extent repeat
   as a whole, and consecutive ones make maximal repeats. Documents meet on anchors by counts, which are
   summed before the shuffle, and by joins, of which Spark splits hot keys: no pairs of a group are made,
   and no anchor or passage that a third of all documents have is one task's.
3. Ends. Where runs share the anchor but not the extent (the ends of passages), one run of each extent is
   taken apart to windows, and those are counted one by one.

Hashes are 64 bits. Defined cases: null text has no words; texts shorter than a window keep all words;
equal rows repeat each other; rows with the same id and other text are told apart; null ids are allowed;
an empty table gives no rows; other columns are ignored (kept by ``remove_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, materialize, mix, powers, release, text_slices, window_hashes, word_hashes

WINDOW, SHINGLE = 35, 16


def _minima(x: np.ndarray, k: int) -> np.ndarray:
    """Least of each ``k`` consecutive values."""
    have = 1
    while have < k:
        step = min(have, k - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def text_runs(words: np.ndarray, firsts: np.ndarray, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """Runs of the texts whose words are ``words`` (each text's first word in ``firsts``, one more at the
    end): row, first window, windows, anchor, extent."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    seeds = window_hashes(words, shingle)
    bits = max(22, int(len(seeds)).bit_length())
    place = np.arange(len(seeds), dtype=np.uint64)
    low = np.uint64((1 << bits) - 1)
    least = _minima(seeds & ~low | place, window - shingle + 1) & low
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    starts = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    anchor = least[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(anchor) != 0)
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    anchor = anchor[at]
    p, q = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[: len(words)], out=sums[1:])
    shape = ((anchor - first) * 4096 + last - first).astype(np.uint64)
    extent = mix((sums[last + window] - sums[first]) * q[first] ^ mix(shape))
    return row[first], first - firsts[row[first]], last - first + 1, seeds[anchor], extent


def _runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["rid", "first", "n", "anchor", "extent"]
    for b in batches:
        rid = b.column("rid").to_numpy()
        for lo, hi, data, offsets in text_slices(b.column("text")):
            words, firsts = word_hashes(data, offsets, lower=False)
            row, first, n, anchor, extent = text_runs(words, firsts, window)
            yield pa.RecordBatch.from_arrays([pa.array(rid[lo:hi][row]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(extent.view(np.int64))], names=names)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid, runs = b.column("rid").to_numpy(), b.column("runs").to_pylist()
        for lo, hi, data, offsets in text_slices(b.column("text")):
            words, firsts = word_hashes(data, offsets, lower=False)
            hashes = window_hashes(words, window)
            parts = [(i, np.arange(r["first"], r["first"] + r["n"]), r["whole"]) for i in range(lo, hi) for r in runs[i]]
            if not parts:
                continue
            count = [len(p[1]) for p in parts]
            row, start = np.repeat([p[0] for p in parts], count), np.concatenate([p[1] for p in parts])
            whole = np.repeat([p[2] for p in parts], count)
            h = hashes[firsts[row - lo] + start]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rid[row]), pa.array(start.astype(np.int32)), pa.array(whole)], names=["h", "rid", "first", "whole"])


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rid, spans`` (array of first word and end) of rows (``rid, text``) with repeats."""
    runs = docs.mapInArrow(lambda b: _runs(b, window), "rid long, first int, n int, anchor long, extent long")
    often = materialize(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "frequent-anchors")
    runs = materialize(runs.join(often, "anchor", "left_semi"), "runs")
    one = F.min(F.struct("rid", "first", "n"))
    extents = materialize(runs.groupBy("anchor", "extent").agg(F.count("*").alias("times"), one.alias("one")), "extents")
    twice = runs.join(extents.where("times > 1").select("anchor", "extent"), ["anchor", "extent"], "left_semi").select("rid", "first", "n")
    # The ends of passages: one run of each extent, where an anchor has several and some of them once only.
    mixed = extents.groupBy("anchor").agg(F.count("*").alias("extents"), F.min("times").alias("least")).where("extents > 1 AND least = 1").select("anchor")
    ends = extents.join(materialize(mixed, "mixed-anchors"), "anchor", "left_semi").select("one.*", (F.col("times") > 1).alias("whole"))
    ends = materialize(ends.groupBy("rid").agg(F.collect_list(F.struct("first", "n", "whole")).alias("runs")), "ends")  # of one document
    single = docs.join(checked(ends), "rid").select("rid", "text", "runs").mapInArrow(lambda b: _windows(b, window), "h long, rid long, first int, whole boolean")
    single = materialize(single, "windows")
    equal = materialize(single.groupBy("h").agg(F.count("*").alias("times"), F.min("whole").alias("whole")).where("times > 1 AND NOT whole").select("h"), "equal-windows")
    more = single.where("NOT whole").join(equal, "h", "left_semi").select("rid", "first", F.lit(1).alias("n"))
    found = materialize(twice.unionByName(more).distinct(), "found")
    release(often, runs, extents, ends, single, equal)
    # Maximal repeats: runs that go on without a gap.
    order = Window.partitionBy("rid").orderBy("first")
    gap = F.coalesce(F.col("first") > F.lag(F.col("first") + F.col("n")).over(order), F.lit(True))
    found = found.withColumn("part", F.sum(gap.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("rid", "part").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("n") + (window - 1)).alias("end"))
    return materialize(found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans")), "repeats")


def _kept(text: str, spans: list | None) -> tuple[int, int, bytes]:
    words = text.encode("utf-8", "surrogatepass").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    out, at = [], 0
    for s in spans:
        out += words[at : max(at, s["first"])]
        at = max(at, s["end"])
    out += words[at:]
    return len(words), len(words) - len(out), b" ".join(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_kept(t.as_py() or "", s) for t, s in zip(b.column("text"), b.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [_kept(t.as_py() or "", s)[2].decode("utf-8", "surrogatepass") if s else t.as_py() for t, s in zip(b.column("text"), b.column("spans").to_pylist(), strict=True)]
        names = [x for x in b.schema.names if x != "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else b.column(x) for x in names], names=names)


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """Rows of ``docs`` with ``spans``. Rows are told apart by a hash of id and text."""
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_intervals(docs.select("rid", F.coalesce("text", F.lit("")).alias("text")), window)
    return docs.join(checked(spans), "rid", "left").drop("rid")


def digest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(docs, window).select("doc_id", "text", "spans").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows' words taken out of ``text`` (texts without any are unchanged)."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = docs.withColumnsRenamed(names) if names else docs
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = _with_spans(rows, window).select(*rows.columns, "spans").mapInArrow(_rewritten, kind)
    return out.withColumnsRenamed({v: k for k, v in names.items()}) if names else out


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digest_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM p) WHERE n > 1),
x AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM r),
g AS (SELECT rid, list(i) AS gone FROM x GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string([x[1] FOR x IN list_zip(w, list_transform(range(1, len(w) + 1), lambda j: list_contains(gone, j))) IF NOT x[2]], ' ') END) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""
