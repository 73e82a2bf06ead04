"""Inverted trigram index: which rows contain a text, without reading the texts of all.

A posting (gram, nid, text) stands for each distinct run of three characters of a lower-cased text. Postings are
range-sorted by gram and written in short pages, whose least and greatest gram Parquet keeps, so a gram's postings
are read and hardly others; a frequent gram has as many rows as it needs and spreads over several files, for no
list is gathered in one row. A pattern reads the postings of its rarest gram only (a table of counts tells which),
and as they carry the text, candidates are verified there. Patterns of fewer than three characters are scanned for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import ascii_lower

GRAM = 3
#: Rows of a page of postings; a lookup reads whole pages.
PAGE_ROWS = 1000


def grams_of(text: Column) -> Column:
    """Distinct runs of three characters of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


class TrigramIndex:
    """An index over the text ``column`` of ``rows`` with a key ``nid``; ``keep`` writes its tables."""

    def __init__(self, rows: DataFrame, column: str, keep):
        self.texts = keep.write(rows.select("nid", ascii_lower(F.col(column)).alias("text")).where("text IS NOT NULL"))
        postings = self.texts.select(F.explode(grams_of(F.col("text"))).alias("gram"), "nid", "text")
        pages = {"parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "false"}
        self.postings = keep.write(postings.repartitionByRange("gram", "nid").sortWithinPartitions("gram", "nid"), **pages)
        counts = self.postings.groupBy("gram").agg(F.count("*").alias("n"))
        self.counts = keep.write(counts.repartitionByRange("gram").sortWithinPartitions("gram"), **pages)

    def rarest(self, pattern: str) -> str | None:
        """The gram of a pattern that has the fewest postings; none, if the pattern is too short to have one."""
        p = lower(pattern)
        grams = sorted({p[i : i + GRAM] for i in range(len(p) - GRAM + 1)})
        known = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(grams)).collect()} if grams else {}  # a row a gram of the pattern
        return min(grams, key=lambda g: (known.get(g, 0), g), default=None)

    def containing(self, pattern: str) -> DataFrame:
        """``nid`` of the rows whose text contains the pattern, in any case of A-Z."""
        gram = self.rarest(pattern)
        some = self.texts if gram is None else self.postings.where(F.col("gram") == gram)
        return some.where(F.col("text").contains(lower(pattern))).select("nid")
