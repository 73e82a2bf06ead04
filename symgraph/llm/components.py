"""Tests of candidate pairs, and connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize, release

#: Pairs of a node that are tested by one task.
HUB_PAIRS = 1000


def _passing(batches: Iterator[pa.RecordBatch], test: Callable) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (hub, part, place), with a hub's value at the start of each part, the places of the
    pairs that pass."""
    at, hub = None, None
    for batch in batches:
        keys = list(zip(batch.column("hub").to_pylist(), batch.column("part").to_pylist(), strict=True))
        values, out = batch.column("value"), []
        for i, place in enumerate(batch.column("place").to_pylist()):
            if place < 0:
                at, hub = keys[i], values[i]
            elif keys[i] != at:
                raise ValueError("a pair without its hub's value")
            elif test(hub, values[i]):
                out.append(place)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["place"])


def tested_pairs(pairs: DataFrame, values: DataFrame, test: Callable, hub_pairs: int | None = None) -> DataFrame:
    """Those of the pairs (materialized; ``a, b`` and more) for which ``test`` of the two nodes' values
    (``node, value``; Arrow scalars) is true.

    The node of a pair that has more pairs is its hub. A hub's pairs are dealt to parts; its value goes once
    to each part, and the other node's value once to each of its pairs."""
    many = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("many"))
    many = checked(materialize(many, "degrees"))
    dealt = pairs
    for k in "ab":
        dealt = dealt.join(many.select(F.col("node").alias(k), F.col("many").alias(f"m{k}")), k)
    first = F.col("ma") >= F.col("mb")
    dealt = dealt.withColumns({"hub": F.when(first, F.col("a")).otherwise(F.col("b")), "other": F.when(first, F.col("b")).otherwise(F.col("a"))})
    parts = F.ceil(F.greatest("ma", "mb") / (hub_pairs or HUB_PAIRS))
    dealt = materialize(dealt.withColumns({"part": F.pmod(F.xxhash64("other"), parts), "place": F.monotonically_increasing_id()}).drop("ma", "mb"), "dealt")
    own = dealt.select("hub", "part").distinct().withColumnRenamed("hub", "node").join(values, "node").select(F.col("node").alias("hub"), "part", F.lit(-1).cast("long").alias("place"), "value")
    each = dealt.select("hub", "part", "place", F.col("other").alias("node")).join(values, "node").select("hub", "part", "place", "value")
    rows = own.unionByName(each).repartition("hub", "part").sortWithinPartitions("hub", "part", "place")
    found = rows.mapInArrow(lambda batches: _passing(batches, test), "place long")
    passed = materialize(dealt.join(found, "place", "left_semi").select(*pairs.columns), "passed")
    release(dealt)
    return passed


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (the least node of its component) of links ``a, b``.

    Each round a node takes the least label among its neighbours' and its own, and then that label's
    label; labels are written to the shared folder each round. No component is collected anywhere:
    a node's labels are pre-aggregated before the shuffle.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label").unionByName(labels)
        best = seen.groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("over"), F.col("label").alias("higher"))
        best = best.join(up, best.label == up.over, "left").select("node", F.least("label", "higher").alias("label"))
        best = materialize(best, "labels")
        changed = best.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        release(labels)
        if not changed:
            release(both)
            return best
        labels = best
