"""Mixing sources to target weights (native).

Rows get hash-random keys and are range-sorted within their source; distributed prefix sums of the
token counts cut each source at its exact budget, repeating whole epochs first where needed.

The keys are uniform, so the ranges are known beforehand: the key's leading bits. Sums per (source,
range) are pre-aggregated, their running totals are tiny, and each range is sorted on its own, so a
source with a third of all rows spreads over as many tasks as it has ranges.

Defined cases: null text has size 0; null source is a source, after all others; sources of size 0 have
target 0; ties of the key break by id, then size; equal rows are exchangeable; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, checked, materialize, words_of

WEIGHTS = (1, 2, 3)
LIMIT = 3
#: Rows of a source that share a range, on average, up to 2^MAX_BITS ranges a source.
RANGE_ROWS = 256
MAX_BITS = 16
KEY_BITS = 60


def size_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS))).cast("long")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """``source, source_size, rows, target`` from ``source, source_size, rows`` (one row per source).

    Sources in order of ratio limit * size / weight stop at the limit as long as their share of what
    the ones before leave is above it; the rest get weight * level.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("place") % len(weights) + 1)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("place", (F.row_number().over(by_name) - 1).cast("int")).withColumn("weight", w)
    s = s.withColumn("ratio", F.lit(float(limit)) * F.col("source_size") / F.col("weight"))
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    left = total - F.lit(limit) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    s = s.withColumn("stops", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("stops"), F.struct("ratio", "place", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    target = F.when(F.col("stops"), F.lit(float(limit)) * F.col("source_size")).otherwise(F.col("weight") * level)
    return s.select("source", "source_size", "rows", target.cast("double").alias("target"))


def random_key(row_id: Column, seed: int) -> Column:
    """60 bits of an MD5 hash, so that other SQL engines can compute the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, limit: int = LIMIT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, epochs, part, taken``.

    ``epochs`` whole copies are taken and ``part`` words of one more; taken = epochs * size + part.
    The words taken of a source are its target rounded down.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    rows = materialize(rows.withColumn("key", random_key(F.col("doc_id"), seed)), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(totals, weights, limit)
    # Of the 60 bits of the key, as many leading ones as make ranges of about range_rows rows.
    bits = F.least(F.lit(MAX_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / F.lit(range_rows))))).cast("int")
    plan = materialize(
        targets.withColumn("shift", F.lit(KEY_BITS) - bits)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "mix-plan",
    )
    p = checked(plan.withColumnRenamed("source", "p_source"))
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source", "rows")
    rows = rows.withColumn("range", F.call_function("shiftright", F.col("key"), F.col("shift")))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offset = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = materialize(sums.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(offset, F.lit(0)).alias("offset")), "mix-sums")
    rows = rows.join(checked(sums), F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range"))).drop("o_source", "o_range")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: rows repeated once per epoch, and the row at each source's budget
    cut to the words that still fit. Equal rows are taken together. Other columns may have any names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    ids = [F.col(names[c]) for c in ("doc_id", "text", "source")]
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]).withColumn("rid", F.xxhash64(*ids))
    equal = materialize(rows.groupBy("rid").count().where("count > 1").select("rid"), "equal-rows")
    mix = mix_sources(rows.select(F.struct(ids[0].alias("doc_id"), "rid").alias("doc_id"), ids[1].alias("text"), ids[2].alias("source")), **options)
    parts = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part"))
    whole = F.col("epochs") + ((F.col("part") == F.col("size")) & (F.col("size") > 0)).cast("long")
    cuts = F.collect_list(parts)  # of equal rows, one a source is cut
    mix = mix.groupBy(F.col("doc_id.rid").alias("rid")).agg(F.sum(whole).alias("whole"), cuts.alias("parts"))
    mix = materialize(mix.where((F.col("whole") > 0) | (F.size("parts") > 0)), "mix")
    if equal.limit(1).count():
        once = rows.join(checked(equal), "rid", "left_semi").dropDuplicates(["rid"])
        rows = rows.join(checked(equal), "rid", "left_anti").unionByName(once)
    takes = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")), F.col("parts"))
    out = rows.join(checked(mix), "rid").withColumn("take", F.explode(takes))
    cut = F.array_join(F.slice(words_of(ids[1]), 1, F.greatest(F.lit(0), F.col("take")).cast("int")), " ")
    out = out.withColumn(names["text"], F.when(F.col("take") < 0, ids[1]).otherwise(cut))
    return out.select(*[F.col(x).alias(c) for c, x in names.items()])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0
    ELSE len(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5('0:' || doc_id), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size / (place % 3 + 1)::DOUBLE AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN 3.0::DOUBLE * source_size
    ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target
  FROM l),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM r
"""
