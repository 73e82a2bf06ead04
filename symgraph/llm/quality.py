"""Quality rules with host-level verdicts (native).

Each document is measured on its own. Rule failures are then summed per host (the ``source``), rates
are shrunk with a beta prior fitted to all hosts by moments, and the verdicts are joined back: a host's
verdict is how many points of soft failure it takes to lose a document there, ``LIMIT`` at the odds of the
corpus, fewer on hosts whose odds of failure are greater and more where they are less. A document has a
point for each soft rule that it fails, and ``JUNK_POINTS`` more with more than one symbol a word. So plain
junk goes on ordinary hosts, a text with a table in it on bad hosts only, and clean documents on none.

Sums per host are pre-aggregated before the shuffle; only the hosts' totals are shuffled, and only hosts
whose verdict is not the usual one are joined back.

Defined cases: null text has no words and fails; null source is a host; repeated rows count each;
texts with fewer than 8 words have no repeated window; an empty table gives no rows; other columns
are ignored (or, with ``keep_columns``, kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, let, materialize, words_of

WINDOW = 8
MIN_WORDS = 20
#: Percent of words in repeated windows, above which a document fails.
MAX_REPEAT = 30
#: Soft rules: percent of symbols per word, percent of duplicate lines, mean word length.
MAX_SYMBOLS, MAX_DUP_LINES, MIN_MEAN, MAX_MEAN = 10, 30, 2, 12
#: Points that it takes at the odds of the corpus, points of plain junk, and bounds of the prior's weight.
LIMIT, JUNK_POINTS, PRIOR_MIN, PRIOR_MAX = 2.7, 2, 2, 10_000
#: Points that it takes on most hosts: whole ones at the odds of the corpus.
USUAL = 3


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that the text has twice or more, all places counted."""

    def cover(starts: Column) -> Column:  # starts in order; each covers up to the next start
        steps = F.transform(starts, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(pairs: Column) -> Column:  # sorted (hash, start)
        twice = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), cover)

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, places))

    return let(words, lambda w: F.when(F.size(w) < window, F.lit(0)).otherwise(let(hashes(w), count)))


def measures(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return {
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_lines": let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))),
        "n_words_repeat": let(words_of(text), lambda w: F.struct(F.size(w).alias("words"), repeated_words(w).alias("repeat"))),
    }


def _measured(docs: DataFrame) -> DataFrame:
    d = docs.withColumns({f"__{k}": v for k, v in measures(F.col("text")).items()})
    d = d.withColumns({
        "__n_words": F.col("__n_words_repeat.words").cast("long"), "__n_repeat_words": F.col("__n_words_repeat.repeat").cast("long"),
        "__n_dup_lines": (F.col("__n_lines.all") - F.col("__n_lines.distinct")).cast("long"), "__lines": F.col("__n_lines.all").cast("long"),
    })
    n = F.col("__n_words")
    base = (n < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT * n)
    rules = [100 * F.col("__n_symbols") > MAX_SYMBOLS * n, 100 * F.col("__n_dup_lines") > MAX_DUP_LINES * F.col("__lines")]
    rules.append((F.col("__word_chars") < MIN_MEAN * n) | (F.col("__word_chars") > MAX_MEAN * n))
    points = sum((r.cast("int") for r in rules), JUNK_POINTS * (F.col("__n_symbols") > n).cast("int"))
    host = F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit(""))
    return d.withColumns({"__base": base, "__points": points, "__host": host}).drop("__n_words_repeat", "__n_lines")


def host_verdicts(counts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``__host, __need``: the points that a document is lost with, of hosts where those aren't ``USUAL``, from
    ``__host, n, f``.

    Rates are millionths and sums are whole numbers, so the verdicts don't depend on the order of sums.
    Prior: mean m and weight k = m(1-m)/v - 1 of the hosts' rates; shrunk rate s = (f + k m) / (n + k). It takes
    ``limit`` points at odds of the mean, m / (1-m), and in inverse proportion at other odds, s / (1-s).
    """
    r = counts.withColumn("r", F.expr("(1000000 * f) div n"))
    fit = r.agg(F.count("*").alias("hosts"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    m = F.col("s") / F.col("hosts")
    v = F.greatest(F.col("ss") / F.col("hosts") - m * m, F.lit(1.0))
    k = F.least(F.lit(float(PRIOR_MAX)), F.greatest(F.lit(float(PRIOR_MIN)), m * (F.lit(1e6) - m) / v - F.lit(1.0)))
    mean, weight = fit.select(m, k).first()  # two numbers, whatever the number of hosts
    if not mean or mean >= 1e6:
        return counts.select("__host", F.lit(float(USUAL)).alias("__need")).limit(0)
    shrunk = (F.lit(1e6) * F.col("f") + F.lit(weight) * F.lit(mean)) / (F.col("n") + F.lit(weight))
    need = F.ceil(F.lit(limit) * F.lit(mean) * (F.lit(1e6) - F.col("shrunk")) / (F.lit(1e6 - mean) * F.col("shrunk")))
    return counts.select("__host", shrunk.alias("shrunk")).select("__host", need.cast("double").alias("__need")).where(F.col("__need") != USUAL)


def quality_rules(docs: DataFrame, limit: float = LIMIT, keep_columns: bool = False) -> DataFrame:
    """``doc_id`` and the measures, ``base_failed`` and ``kept``; with ``keep_columns`` instead the
    rows of ``docs`` that are kept, with their own columns, whatever their names. Texts are measured once,
    and the narrow table of verdicts meets them by a 64-bit hash of text and source."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    measured = _measured(own)
    if keep_columns:  # one row for each text and source, by a hash of them; the measures follow from those
        row = F.xxhash64(F.col("text").isNull(), F.col("text").cast("string"), F.col("source").isNull(), F.col("source").cast("string"))
        measured = measured.select("__host", "__base", "__points", row.alias("__row"))
    measured = materialize(measured.drop("text"), "quality")
    fails = F.sum((F.col("__base") | (F.col("__points") > 0)).cast("long"))
    hosts = materialize(measured.groupBy("__host").agg(F.count("*").alias("n"), fails.alias("f")), "hosts")
    out = measured.join(checked(materialize(host_verdicts(hosts, limit), "host-verdicts")), "__host", "left")
    kept = ~F.col("__base") & (F.col("__points") < F.greatest(F.coalesce("__need", F.lit(float(USUAL))), F.lit(1.0)))
    if keep_columns:
        gone = materialize(out.where(~kept).select("__row").distinct(), "rejected")
        names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()], row.alias("row"))
        left = rows.join(checked(gone.withColumnRenamed("__row", "row")), "row", "left_anti")
        return left.select(*[F.col(x).alias(c) for c, x in names.items()])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"__{x}").alias(x) for x in names], F.col("__base").alias("base_failed"), kept.alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM p),
c AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS step FROM t WHERE n > 1),
r AS (SELECT rid, sum(step) AS n FROM c GROUP BY rid),
m AS (
  SELECT doc_id, source, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
f AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
g AS (
  SELECT *, (100 * n_symbols > 10 * n_words)::INT + (100 * n_dup_lines > 30 * len(lines))::INT + (word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT + 2 * (n_symbols > n_words)::INT AS points FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR points > 0) AS f FROM g GROUP BY source),
q AS (SELECT count(*) AS hosts, sum((1000000 * f) // n)::DOUBLE AS s, sum(((1000000 * f) // n) ** 2)::DOUBLE AS ss FROM h),
k AS (
  SELECT s / hosts AS m, least(10000.0, greatest(2.0, (s / hosts) * (1e6 - s / hosts) / greatest(ss / hosts - (s / hosts) ** 2, 1.0) - 1.0)) AS k FROM q),
b AS (SELECT source, m, (1e6 * f + k * m) / (n + k) AS s FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND points < CASE WHEN m > 0 AND m < 1e6 THEN greatest(1, ceil(2.7 * m * (1e6 - s) / ((1e6 - m) * s))) ELSE 3 END AS kept
FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
"""
