"""Document fingerprints by spot signatures.

Words are runs of letters and digits, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A common
word (``COMMON``) is an anchor; so is a word with no common word among the ``GAP`` words before it, so that
texts of other languages and of a few words have anchors too. A spot signature is an anchor with the chain of
the next ``CHAIN`` content words (words that aren't common), each ``DISTANCE`` content words from the one
before; at the end of a text the chain is shorter. The k-th occurrence of a signature counts as an element of
its own, so the Jaccard likeness of two sets is that of the multisets.

A fingerprint is the sorted set of elements, 32 bits each, in base64. Likeness needs the two sets only.

``spot_classes`` finds near duplicates (likeness ``0.75`` or more): sets are partitioned by their length, so
that only sets within 4/3 of each other meet; in a partition they meet on the first quarter of their
signatures, rare ones first, since sets that share none of those cannot be alike; lengths and bit sketches
then bound the likeness before whole sets are compared. Equal sets are one node; a node meets the least one
of a signature and nodes drawn by hash, and only nodes that are still apart after that meet one another.

``compare_neighbours`` sets every document beside the next one (descending id; null is the least id, and ties
go by a hash of the text). Rows are dealt to ranges of ids, and each range gets a copy of the first row of the
next one; a range is walked once, in order.

Defined cases: null text is empty, with an empty fingerprint, which is like another empty one (1) and no other
(0); a text without words has the hash of the whole text as its only signature; equal texts have equal
fingerprints; repeated rows stand beside each other; a document alone is its own next; an empty table gives no
rows; other columns are ignored. A text is hashed in one task, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize, mix, text_slices, word_hashes
from .components import tested_pairs
from .jaccard import Join, bands_of, bit_sketch, linked

GAP, CHAIN, DISTANCE = 8, 2, 1
#: Signatures in more than one of so many occurrences are met last; there are fewer than this number.
FREQUENT = 50_000

# Common words of English, French, German and Spanish.
COMMON = """
a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in
into is it its just like may me more most my no not now of on one only or other our out over said she should so some such than that
the their them then there these they this those to up upon was we were what when where which who will with would you your
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou où par pas plus pour qu
que qui sa sans se ses son sont sur tout très un une vous à été
aber als am auch auf aus bei bis da das dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist kann mit
nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn wie wird wir zu zum zur
al como con cuando de del el ella en entre era es esta este está fue ha hay la las le lo los más me muy no nos o para pero por
porque que se ser si sin sobre son su sus también todo un una y ya
""".split()  # fmt: skip

_GAPS = np.ones(256, bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_cache: dict[str, np.ndarray] = {}


def _common() -> np.ndarray:
    if "common" not in _cache:
        words = [w.encode() for w in sorted(set(COMMON))]
        offsets = np.append(0, np.cumsum([len(w) for w in words]))
        _cache["common"] = np.sort(word_hashes(np.frombuffer(b"".join(words), np.uint8), offsets, lower=True, gap=_GAPS)[0])
    return _cache["common"]


def spot_signatures(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and signature of every anchor of the texts whose words are ``words`` (each text's first in ``firsts``)."""
    n, table = len(words), _common()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    common = table[np.minimum(np.searchsorted(table, words), len(table) - 1)] == words
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(common, place, -1))
    before = np.maximum(np.append(-1, last[:-1]), firsts[row] - 1)  # the common word before, or the text's start
    spaced = ~common & ((before < firsts[row]) | (place - before > GAP))
    anchors = np.flatnonzero(common | spaced)
    content = np.flatnonzero(~common)
    at = np.searchsorted(content, anchors, "right") + DISTANCE - 1
    out, sig = row[anchors], mix(words[anchors])
    ends = np.searchsorted(content, firsts)[1:][out]  # content words of the text and those before it
    for k in range(CHAIN):
        i = at + k * DISTANCE
        there = i < ends
        word = words[content[np.minimum(i, len(content) - 1)]] if len(content) else np.zeros(len(at), np.uint64)
        sig = mix(sig + np.where(there, mix(word + np.uint64(k + 1)), np.uint64(0)))
    return out, sig


def _numbered(row: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row and value: repeated signatures of a row become different ones."""
    order = np.lexsort((sig, row))
    row, sig = row[order], sig[order]
    new = np.ones(len(sig), bool)
    new[1:] = (row[1:] != row[:-1]) | (sig[1:] != sig[:-1])
    start = np.flatnonzero(new)
    times = np.arange(len(sig)) - np.repeat(start, np.diff(np.append(start, len(sig))))
    sig = np.where(times > 0, mix(sig + times.astype(np.uint64)), sig)
    order = np.lexsort((sig, row))
    return row[order], sig[order]


def spot_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit elements of each text."""
    out = []
    for lo, hi, data, offsets in text_slices(texts):
        words, firsts = word_hashes(data, offsets, lower=True, gap=_GAPS)
        row, sig = _numbered(*spot_signatures(words, firsts))
        ends = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            own = sig[ends[i] : ends[i + 1]]
            if not len(own) and offsets[i + 1] > offsets[i]:
                whole = hashlib.sha256(data[offsets[i] : offsets[i + 1]].tobytes()).digest()
                own = np.frombuffer(whole[:8], np.uint64)
            out.append(own)
    return out


def short_set(elements: np.ndarray) -> np.ndarray:
    """The set as it stands in a fingerprint."""
    return np.unique((elements >> np.uint64(32)).astype(np.uint32))


def fingerprint(short: np.ndarray) -> str:
    return base64.b64encode(short.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


# ---- every document beside the next one ----


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row, whose next one is still to come
    ended = False
    for b in batches:
        if ended or not b.num_rows:
            continue
        ids, guests = b.column("doc_id").to_pylist(), b.column("guest").to_numpy(zero_copy_only=False)
        stop = int(guests.argmax()) + 1 if guests.any() else len(ids)  # the first guest is the next of the last row
        ended = stop < len(ids) or bool(guests[: stop].any())
        column = b.column("text").slice(0, stop)
        rows = list(zip(ids[:stop], column.to_pylist(), [short_set(x) for x in spot_sets(column)], strict=True))
        rows = ([held] if held else []) + rows
        held = rows[-1]
        edited = [_edited(r[1], s[1]) for r, s in zip(rows, rows[1:], strict=False)]
        if not edited:
            continue
        other = [short_set(x) for x in spot_sets(pa.array(edited, pa.large_string()))]
        sets = [r[2] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows[:-1]], pa.int64()),
                pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]),
                pa.array([fingerprint(s) for s in sets[:-1]]),
                pa.array([fingerprint(x) for x in other]),
                pa.array([likeness(s, x) for s, x in zip(sets, other, strict=False)]),
                pa.array([likeness(s, t) for s, t in zip(sets, sets[1:], strict=False)]),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def range_bounds(keyed: DataFrame, parts: int) -> np.ndarray:
    """About even cuts of ``o``, ``parts - 1`` of them at most; a value that takes several is cut by ``h``."""
    found = keyed.agg(F.percentile_approx("o", [i / parts for i in range(1, parts)], 10 * parts).alias("x")).first()["x"] if parts > 1 else None
    return np.array(found or [], np.int64)


def range_of(bounds: np.ndarray, o: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The range of each (o, h), in their order."""
    lo, hi = np.searchsorted(bounds, o, "left"), np.searchsorted(bounds, o, "right")
    m = hi - lo
    share = np.minimum(np.floor((h.astype(float) + 2.0**63) / 2.0**64 * m), m - 1).astype(np.int64)
    return np.where(m > 0, lo + share + 1, lo)


def beside_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, guest``: partitions in order of (o, h); the guest, last, is the first row of the next one."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("o")
    keyed = docs.select("doc_id", "text", order, F.xxhash64("text").alias("h"))
    bounds = range_bounds(keyed, parts)

    @F.pandas_udf("int")
    def part(o: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(bounds, o.to_numpy(), h.to_numpy()).astype(np.int32))

    keyed = keyed.withColumn("part", part("o", "h"))
    firsts = sorted((r["part"], r["x"]["o"], r["x"]["h"]) for r in keyed.groupBy("part").agg(F.min(F.struct("o", "h")).alias("x")).collect())  # a row a part
    to = [(firsts[i][0], *firsts[(i + 1) % len(firsts)][1:]) for i in range(len(firsts))]
    guests = spark.createDataFrame(to, "to int, o long, h long")
    rows = keyed.join(F.broadcast(guests), ["o", "h"], "left")  # as many rows as there are parts
    own, more = F.struct(F.col("part").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("at"), F.lit(True).alias("guest"))
    rows = rows.select("doc_id", "text", "o", "h", F.inline(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, more))))
    return rows.repartitionById(parts, F.col("at")).sortWithinPartitions("guest", "o", "h").select("doc_id", "text", "guest")


# ---- near duplicates ----


def node_of(elements: np.ndarray) -> int:
    """A hash of the set (0: empty)."""
    return int(mix(np.bitwise_xor.reduce(mix(elements))[None] + np.uint64(len(elements)))[0].astype(np.int64)) if len(elements) else 0


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = spot_sets(b.column("text"))
        columns = [b.column("doc_id"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bit_sketch(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "bits"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *spot_sets(b.column("text"))]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(times)], names=["element", "times"])


def _keys(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Partition by length and element, for the elements by which a set can be found: a quarter of them, and one."""
    for b in batches:
        keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in spot_sets(b.column("text")):
            if len(s):
                late = np.isin(s, frequent, kind="sort")
                first = np.concatenate([s[~late], s[late]])[: len(s) // 4 + 1]
                for band in bands_of(len(s)):
                    keys.append(mix(first ^ mix(np.array([band + 1], np.uint64))))
                    nodes.append(np.full(len(first), node_of(s)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [s for s in spot_sets(b.column("text")) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "value"])


class SpotJoin(Join):
    """The similarity join over spot signatures in place of shingles, met on rare signatures by length."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.rows = materialize(docs.mapInArrow(_nodes, "doc_id long, node long, n long, bits array<long>"), "spot-rows")
        named = self.rows.where("node <> 0 AND doc_id IS NOT NULL")
        self.nodes = materialize(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "spot-nodes")

    def frequent(self) -> np.ndarray:
        """Elements that are more than one in ``FREQUENT`` occurrences: fewer than that number."""
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        counts = self.docs.mapInArrow(_elements, "element long, times long").groupBy("element").agg(F.sum("times").alias("times"))
        return np.sort(np.array([r[0] for r in counts.where(F.col("times") * FREQUENT > max(total, FREQUENT)).select("element").collect()], np.int64).view(np.uint64))

    def buckets(self) -> DataFrame:
        frequent = self.frequent()
        rows = materialize(self.docs.where("doc_id IS NOT NULL").mapInArrow(lambda b: _keys(b, frequent), "key long, node long").distinct(), "spot-keys")
        heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("nodes")).where("nodes > 1").select("key", "head")
        return materialize(rows.join(heads, "key"), "spot-buckets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        need = materialize(need.join(self.nodes.select("node", "doc_id"), "node"), "spot-needed")
        texts = self.docs.join(checked(need.select("doc_id").distinct()), "doc_id", "left_semi")
        sets = texts.mapInArrow(_whole_sets, "node long, value array<long>")
        sets = materialize(sets.join(checked(need.select("node")), "node", "left_semi").dropDuplicates(["node"]), "spot-sets")
        return tested_pairs(pairs, sets, linked)

    def classes(self) -> DataFrame:
        """``node, class_id`` of the nodes that share their class with another node or document; written."""
        labels = self.components()
        member = self.rows.where("node <> 0 AND doc_id IS NOT NULL").select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
        return materialize(member.select("node", "label").distinct().join(least, "label").select("node", "class_id"), "spot-classes")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def spot_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_spots, class_id`` of every row: the least id of those that chains of near duplicates reach (its own, if
    it has none; null for null ids)."""
    join = SpotJoin(_plain(docs))
    out = join.rows.join(checked(join.classes()), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_spots"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(_plain(docs)).mapInArrow(_compared, kind)


def op11_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
