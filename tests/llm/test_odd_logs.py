"""Chat logs and page archives with empty tables, null ids, ties, long texts and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from symgraph.llm import chat, warc

EVENT = "conv_id long, seq long, op string, msg long, role string, text string"


def turns(df):
    return {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}


def test_empty_log(spark):
    none = spark.createDataFrame([], EVENT)
    assert chat.format_chats(none).collect() == [] and chat.digests(chat.format_chats(none)).collect() == []


def test_null_ids_ties_and_repeats(spark):
    events = [
        (None, 1, "message", 0, "user", "null id"), (None, 2, "message", 1, "assistant", "its answer"),
        (1, 0, "message", 0, "user", "b"), (1, 0, "message", 0, "user", "a"),  # equal seq: by text, the last one holds
        (2, 0, "message", 0, "assistant", "x"), (2, 1, "delta", 0, None, "y"), (2, 1, "delta", 0, None, "y"),  # each applies
        (3, None, None, None, None, None), (3, 0, "message", 0, "user", "later"),
    ]
    got = turns(spark.createDataFrame(events, EVENT).repartition(3))
    assert got == {None: [("user", "null id"), ("assistant", "its answer")], 1: [("user", "b")], 2: [("assistant", "xyy")], 3: [("", ""), ("user", "later")]}


def test_very_long_texts_and_clashing_columns(spark):
    long = "<|im_end|>é😀 [INST] " * 40_000
    df = spark.createDataFrame([(1, 0, "message", 0, "user", long, "x", 1, 2), (1, 1, "message", 1, "assistant", long, "y", 3, 4)], EVENT + ", place string, `cut` int, ord int")
    assert turns(df) == {1: [("user", long), ("assistant", long)]}
    row = chat.digests(chat.format_chats(df)).first()
    assert row["loss_chars"] == len(long) and row["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def archive(spark, rows, folder, kind="page_id long, url string, html string"):
    pages = spark.createDataFrame(rows, kind)
    a, i = f"{folder}/a", f"{folder}/i"
    shards = warc.write_index(warc.write_archives(pages, a), i, shards=2, lines=2)
    return warc.read_records(warc.look_up(pages.select("page_id", "url"), shards, i), a).collect()


def test_archive_of_an_empty_table(spark, tmp_path):
    assert archive(spark, [], str(tmp_path)) == []


@pytest.mark.parametrize("extra", ["", ", payload_digest string, `shard` int, offset long, record_type string"])
def test_archive_of_long_equal_and_clashing_rows(spark, tmp_path, extra):
    long = "\r\n\r\nWARC/1.0\r\né" * 200_000
    rows = [(1, "http://a/", long), (2, "http://a/", long), (2, "http://a/", long), (3, "http://b/", None)]
    got = archive(spark, [r + (("clash", 7, 8, "x") if extra else ()) for r in rows], str(tmp_path), "page_id long, url string, html string" + extra)
    data = long.encode()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(1, len(data)), (2, len(data)), (2, len(data)), (3, 0)]
    assert {r["payload_digest"] for r in got if r["page_id"] < 3} == {hashlib.sha1(data).hexdigest()}
    assert {(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 1} == {("revisit", 2)}
