"""Source snippets of many nodes at once, as a join of their places with the files' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_offsets(files: DataFrame) -> DataFrame:
    """``doc_key, source, starts``: a file's text and the characters before each of its lines (a line ends with ``\\n``)."""
    sizes = F.transform(F.split("source", "\n"), lambda x: F.length(x) + 1)
    zero = F.array(F.lit(0))
    starts = F.aggregate(sizes, zero, lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    return files.where("source IS NOT NULL").select("doc_key", "source", starts.alias("starts"))


def snippets(places: DataFrame, files: DataFrame, lines: int = 40) -> DataFrame:
    """``id, snippet`` of ``places`` (id, doc_key, start_line, end_line; lines from 1): the lines of each, ``lines`` at
    most, without carriage returns before line ends, null where there is no such text.

    A file's lines are found once. Its places come to it as one array (of places only, not of texts), so its text is
    not repeated for each of them in the join."""
    own = places.where("start_line IS NOT NULL").groupBy("doc_key").agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("places"))
    some = line_offsets(files).join(own, "doc_key").select("source", "starts", F.explode("places").alias("p"))
    first = F.greatest(F.col("p.start_line"), F.lit(1))
    end = F.least(F.col("p.end_line"), first + (lines - 1), F.size("starts") - 1)  # the last line that is shown
    at = F.get("starts", first - 1)
    text = F.expr("substring(source, at + 1, till - at)")
    cut = some.select("p.id", "source", at.alias("at"), (F.get("starts", end) - 1).alias("till"), (first <= end).alias("there")).where("there").select("id", text.alias("snippet"))
    found = cut.select("id", F.nullif(F.regexp_replace(F.regexp_replace("snippet", "\r\n", "\n"), "\r$", ""), F.lit("")).alias("snippet"))
    return places.select("id").join(found, "id", "left")
