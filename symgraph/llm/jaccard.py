"""N-gram Jaccard join by parity sketches.

A document's set: its distinct 5-word shingles (all its words as one, if fewer), as 64-bit hashes. Two
documents link when 100 * intersection >= 75 * union.

1. Documents with equal sets are one node (a third of all rows may be one).
2. Sketch. The shingles are dealt to G groups by hash, and each group's hashes are XORed to a word. A
   shingle that only one of two sets has changes one word, so the number of words that differ is at most
   the symmetric difference; so is the Hamming distance of bit sketches with one parity bit per hash. Bit
   sketches grow with the set (``sketch_bits``), at least four times the most that linked sets may differ
   in, so that they tell long texts apart as well; a sketch of twice the length folds to the shorter.
3. Pigeonhole join per size band (sets within 4/3 of each other meet in a band). Linked sets of n and m
   shingles differ in at most (n + m) / 7, so some words stay equal; those are the join keys, and empty
   words are none. A band has as many words that a pair at the threshold misses all of them with a
   chance under ``MISS``; small sets are dealt several times for that.
4. Candidates of a key meet its least node, then nodes drawn by hash, not one another. Only keys whose
   nodes are still in several components after that give further pairs, all those across components; of a
   key's largest component no two nodes are compared, however many it has.
5. Verify. Bit sketches' Hamming distance first (a lower bound, so nothing is lost), then whole sets. A
   set goes once to each of its pairs' tasks, and that of a node with many pairs once for a thousand of them.

Defined cases: null and wordless texts have no shingles and link with nothing; null ids stay alone, with
null component; repeated rows with the same id are one document; ties take the least id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize, mix, release, text_slices, window_hashes, word_hashes
from .components import components, tested_pairs

SHINGLE = 5
#: Sizes of a band's sets are within this ratio; shingles per group at its upper end; chance to miss a pair.
BAND_RATIO, GROUP_LOAD, MISS = 1.5, 5, 1e-9
#: Bits of the shortest sketches.
SKETCH_BITS = 1024
HEADS = 3
#: Rounds of drawn nodes end with one that finds at most this part of the links that the heads gave.
FEW = 0.25


@lru_cache(None)
def band_plan(band: int) -> tuple[int, int]:
    """Groups per deal, and words to use in all (over several deals, if more than one has)."""
    most = math.ceil(BAND_RATIO ** (band + 1))
    d = 2 * most // 7
    if not d:
        return 1, 0  # such sets link only when equal
    groups = max(4, math.ceil(most / GROUP_LOAD))
    same = (1 - 1 / groups) ** d * (1 - (1 - 1 / groups) ** (3 * d))
    return groups, math.ceil(math.log(MISS) / math.log(1 - same))


def bands_of(n: int) -> set[int]:
    """The band of the size, and that of the largest set that may link with it."""
    band = lambda x: int(math.log(x) / math.log(BAND_RATIO) + 1e-9)
    return {band(n), band(max(n, 4 * n // 3))}


def sketch_words(shingles: np.ndarray) -> np.ndarray:
    """Join keys of a set: the words of its bands, each mixed with its band, deal and group."""
    out = [np.zeros(0, np.uint64)]
    for band in bands_of(len(shingles)):
        groups, words = band_plan(band)
        for deal in range(-(-words // groups)):
            to = (mix(shingles + np.uint64(1 + deal)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to = to[order]
            at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            xor, to = np.bitwise_xor.reduceat(shingles[order], at), to[at]
            use = deal * groups + to < words
            out.append(mix(xor[use] ^ mix((to[use] + (band * 1000 + deal) * 100_000_000).astype(np.uint64))))
    return np.concatenate(out)


def sketch_bits(n: int) -> int:
    """Bits of the sketch of ``n`` shingles, a power of 2: linked sets of n and at most 4 n / 3 shingles
    differ in at most n / 3 of them, and their sketches' lengths are equal or one is twice the other."""
    return max(SKETCH_BITS, 1 << (2 * n - 1).bit_length())


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes at each bit, as 64-bit words."""
    bits = sketch_bits(len(shingles))
    odd = np.bincount((shingles >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int]]:
    """Row, sorted distinct shingle hashes and node of each text (node 0: no words)."""
    for lo, hi, data, offsets in text_slices(batch.column("text")):
        words, firsts = word_hashes(data, offsets, lower=True)
        grams = window_hashes(words, SHINGLE)
        for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True), lo):
            if b - a >= SHINGLE:
                s = np.unique(grams[a : b - SHINGLE + 1])
            else:
                s = window_hashes(words[a:b], b - a) if b > a else grams[:0]
            yield i, s, int(mix(np.bitwise_xor.reduce(mix(s))[None] + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else 0


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, size, bits = [], [], []
        for _, s, x in _sets(b):
            node.append(x)
            size.append(len(s))
            bits.append(bit_sketch(s))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "bits"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen, keys, nodes, rows = set(), [], [], 0
        for _, s, x in _sets(b):
            if x and x not in seen:
                seen.add(x)
                keys.append(sketch_words(s))
                nodes.append(np.full(len(keys[-1]), x))
                rows += len(keys[-1])
            if rows > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])
                keys, nodes, rows = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes).astype(np.int64))], names=["key", "node"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, sets, total = [], [], 0
        for _, s, x in _sets(b):
            if x:
                nodes.append(x)
                sets.append(s.view(np.int64))
                total += len(s)
            if total > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "value"])
                nodes, sets, total = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "value"])


def may_link(na: str, nb: str, xa: str, xb: str):
    """Whether the sizes, and the bit sketches' Hamming distance as the least symmetric difference, let
    two sets be linked. Short sketches are compared in generated code."""
    a, b, words = F.col(xa), F.col(xb), SKETCH_BITS // 64

    def folded(x, to):  # the halves of a longer sketch, XORed
        half = lambda k: F.slice(x, F.size(to) * k + 1, F.size(to))
        return F.when(F.size(x) > F.size(to), F.zip_with(half(F.lit(0)), half(F.lit(1)), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    short = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)), F.lit(0))
    long = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    apart = F.when((F.size(a) == words) & (F.size(b) == words), short).otherwise(long)
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (7 * apart <= F.col(na) + F.col(nb))


def linked(a: pa.ListScalar, b: pa.ListScalar) -> bool:
    """Whether two sets (sorted as unsigned numbers) have a similarity of 0.75 or more."""
    x, y = (s.values.to_numpy().view(np.uint64) for s in (a, b))
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * common >= 75 * (len(x) + len(y) - common)


class Join:
    """The join over one table of documents; nodes and whatever comes of them are written tables."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.rows = materialize(self.docs.mapInArrow(_nodes, "doc_id long, node long, n long, bits array<long>"), "rows")
        named = self.rows.where("node <> 0 AND doc_id IS NOT NULL")
        self.nodes = materialize(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes")

    def buckets(self) -> DataFrame:
        """``key, node, head`` of keys with several nodes; head is the least of them. A key's nodes are counted before
        the shuffle, and then met by a join, which Spark splits where a key has very many: no task has all of them."""
        keys = self.docs.where("doc_id IS NOT NULL").mapInArrow(_keys, "key long, node long")
        ends = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head")
        rows = keys.join(materialize(ends, "heads"), "key").select("key", "node", "head")
        return materialize(rows.dropDuplicates(["node", "key"]), "buckets")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` that sizes and bit sketches let be linked."""
        x = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
        y = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
        return pairs.join(x, "a").join(y, "b").where(may_link("na", "nb", "xa", "xb")).select(*pairs.columns)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (materialized) that link, by their whole sets."""
        need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        need = materialize(need.join(self.nodes.select("node", "doc_id"), "node"), "needed")
        texts = self.docs.join(checked(need.select("doc_id").distinct()), "doc_id", "left_semi")
        sets = texts.mapInArrow(_whole_sets, "node long, value array<long>")
        sets = materialize(sets.join(checked(need.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")
        return tested_pairs(pairs, sets, linked)

    def components(self) -> DataFrame:
        """``node, label``: nodes with links to others, and their components."""
        buckets = self.buckets()
        # Each node is tested against those heads that may link with it, of the HEADS that it shares most keys
        # with: this joins families early. Pairs left out here are met across components below.
        shared = buckets.where("node <> head").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).count()
        top = F.slice(F.sort_array(F.collect_list(F.struct("count", "a")), asc=False), 1, HEADS)  # a node has as many heads as keys at most
        shared = shared.groupBy("b").agg(top.alias("top")).select("b", F.inline("top")).select("a", "b")
        tested = materialize(self.near(shared), "tested")
        links = self.verified(tested)
        labels = components(links)
        # Families that are still apart meet one another through other nodes of their keys, drawn by hash, a
        # round at a time, as long as that finds many links; what is left, all pairs below join.
        few = links.count() * FEW
        for draw in itertools.count():
            pairs = self._drawn(buckets, labels, tested, draw)
            joined = self.verified(pairs)
            tested = tested.unionByName(pairs.select("a", "b"))
            found = joined.count()
            if found:
                labels = self._contracted(labels, joined)
            if found <= few:
                break
        # Keys whose nodes are still apart: all pairs across components that may link and have not been tested.
        # A pair comes from the least of its common keys only: nodes carry their lesser keys along. One node of
        # each pair is outside the key's largest component.
        rest = self._open(buckets, labels)
        lesser = rest.groupBy("node").agg(F.collect_set("key").alias("keys"))
        rest = rest.join(self.nodes.select("node", "n", "bits").join(lesser, "node"), "node").withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
        x, y = (rest.select(F.col("key").alias(f"q{k}"), F.col("node").alias(k), F.col("label").alias(f"l{k}"), F.col("inside").alias(f"i{k}"), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}"), F.col("keys").alias(f"k{k}")) for k in "ab")
        pairs = x.where("NOT ia").join(y, (F.col("qa") == F.col("qb")) & (F.col("la") != F.col("lb")) & (F.col("ib") | (F.col("a") < F.col("b"))) & may_link("na", "nb", "xa", "xb") & ~F.arrays_overlap("ka", "kb"))
        turned = F.col("a") > F.col("b")
        ordered = [F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("la", "lb"), ("lb", "la"))]
        pairs = materialize(pairs.select(*ordered).distinct().join(tested, ["a", "b"], "left_anti"), "across")
        labels = self._contracted(labels, self.verified(pairs))
        release(buckets)
        return labels

    def _drawn(self, buckets: DataFrame, labels: DataFrame, tested: DataFrame, draw: int) -> DataFrame:
        """``a, b, la, lb``: untested pairs of a key's drawn node with its nodes of other components that may
        link; of a node's pairs with one component, one."""
        rest = self._open(buckets, labels)
        heads = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(draw)), F.col("node").alias("h"), F.col("label").alias("lh"))).alias("x")).select("key", "x.h", "x.lh")
        # Of the nodes drawn for its keys, a node meets that one it shares most keys with; the others come in
        # later rounds or in the join across components.
        shared = rest.join(heads, "key").where("label <> lh").groupBy("node", "label", "h", "lh").count()
        pairs = shared.groupBy("node", "label").agg(F.max(F.struct("count", "h", "lh")).alias("x")).select("node", "label", "x.h", "x.lh")
        turned = F.col("node") < F.col("h")
        ordered = {"a": F.least("node", "h"), "b": F.greatest("node", "h"), "la": F.when(turned, F.col("label")).otherwise(F.col("lh")), "lb": F.when(turned, F.col("lh")).otherwise(F.col("label"))}
        pairs = pairs.select("node", "lh", *[c.alias(k) for k, c in ordered.items()]).distinct().join(tested, ["a", "b"], "left_anti")
        one = self.near(pairs).groupBy("node", "lh").agg(F.min(F.struct("a", "b", "la", "lb")).alias("x"))
        return materialize(one.select("x.*").distinct(), "drawn")

    def _contracted(self, labels: DataFrame, joined: DataFrame) -> DataFrame:
        """``labels`` after the links ``la, lb`` between their components."""
        higher = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()).select(F.col("node").alias("first"), F.col("label").alias("last"))
        names = labels.unionByName(higher.select(F.col("first").alias("node"), F.col("first").alias("label"))).distinct()
        found = names.join(higher, names["label"] == higher["first"], "left").select("node", F.coalesce("last", "label").alias("label"))
        return materialize(found.groupBy("node").agg(F.min("label").alias("label")), "contracted")

    def _open(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """``key, node, label, inside`` of the keys whose nodes are in several components; ``inside``: the
        node is in the key's largest one."""
        rest = materialize(buckets.select("key", "node").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        sums = rest.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label"))["label"].alias("largest"), F.count("*").alias("labels"))
        keys = sums.where("labels > 1").select("key", "largest")
        return materialize(rest.join(keys, "key").select("key", "node", "label", (F.col("label") == F.col("largest")).alias("inside")), "open")

    def result(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` per document."""
        labels = self.components()
        member = self.nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = member.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = materialize(member.join(least, "label").select("node", "component_id"), "components")
        rows = self.rows.select("doc_id", "node", F.col("n").alias("n_shingles"))
        out = rows.join(checked(named), "node", "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return out.select("doc_id", "n_shingles", own.alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    return Join(docs).result()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with exactly one of each component: that with the smallest id (null ids last).

    Rows go by a 64-bit hash of id and text, so null and repeated ids are joined like others, and equal rows
    are one; rows without words link with nothing and all stay."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    row = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = jaccard_components(docs.select(row.alias("doc_id"), "text")).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("row"), "component_id").agg(F.count("*").alias("rows"))
    ids = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id")).distinct()
    found = materialize(found.join(ids, "row"), "row-components")
    first = found.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    first = materialize(first.where("n > 1").select("component_id", F.col("first.row").alias("first")), "first-rows")
    gone = materialize(found.join(checked(first), "component_id").where("row <> first").select("row"), "copies")
    again = materialize(found.where("rows > 1").select("row"), "repeated-rows")
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()], row.alias("row"))
    kept = rows.join(checked(gone), "row", "left_anti")
    if again.limit(1).count():
        once = kept.join(checked(again), "row", "left_semi").dropDuplicates(["row"])
        kept = kept.join(checked(again), "row", "left_anti").unionByName(once)
    return kept.select(*[F.col(x).alias(c) for c, x in names.items()])


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
