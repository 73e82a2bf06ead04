"""Collocations against a count of all phrases, on texts with odd rows, and under every way of dealing."""

import random
import re
from collections import Counter

import pytest

from symgraph.llm import collocations as c

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def brute(rows, max_n=3, least=10, top=2000, cover=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split("".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")):
            w = WORD.findall(piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    wide = {x: v for x, v in f.items() if len(x[1]) > 1 and v >= least}
    gone = {(g, w[i : i + k]) for (g, w), v in wide.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * v >= cover * f[g, w[i : i + k]]}
    out = {}
    for (g, w), a in wide.items():
        if (g, w) not in gone:
            s, k = min((1_000_000 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(g, []).append((-s, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
    return sorted((g, i, p.decode(), -a, x, y, n[g], -s) for g, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = ["the", "of", "New", "york", "city", "São", "a\x01", "a", "\x00", "x\\n", "b-c", "É"] + [f"w{i}" for i in range(30)]
    make = lambda n: "".join(rnd.choices(words, [20, 9] + [3] * (len(words) - 2))[0] + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", "! "]) for _ in range(n))
    langs = ["en", "en", "de", None, "", "und", "a\nb", "a\\nb", "\\"]
    out = [(rnd.choice(langs), make(rnd.randint(0, 120))) for _ in range(300)]
    return [*out, *out[:40], ("en", None), (None, ""), ("en", " .,;\n"), ("en", "new york city " * 3000), ("fr", "one two")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "clash") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, key string")


@pytest.mark.parametrize("flush, sample, hot", [(c.FLUSH_BYTES, c.SAMPLE_DOCS, c.HOT), (500, 20, 7), (20_000, 100, 10**9)])
def test_collocations(spark, rows, monkeypatch, flush, sample, hot):
    monkeypatch.setattr(c, "FLUSH_BYTES", flush)
    monkeypatch.setattr(c.hot_words, "__defaults__", (3, sample, hot))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64" if flush == 500 else "10000")
    got = sorted(tuple(r) for r in c.collocations(frame(spark, rows)).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows) and len(got) > 50


def test_longer_phrases_and_limits(spark, rows):
    got = sorted(tuple(r) for r in c.collocations(frame(spark, rows), max_n=4, min_count=5, top=7, cover=80).collect())
    assert got == brute(rows, 4, 5, 7, 80)


def test_hot_words_are_those_of_many_suffixes(spark, rows):
    found = c.hot_words(frame(spark, rows).select("lang", "text"), hot=100)
    assert "the\ten" in found and all(v > 1 for v in found.values()) and len(found) <= 100


def test_empty(spark):
    assert c.collocations(frame(spark, [])).collect() == [] and c.collocations(frame(spark, [("en", None), (None, "...")])).collect() == []


def test_products_beyond_64_bits(spark):
    counts = [("a\ten\n", 1, 4 * 10**12), ("b\ten\n", 1, 3 * 10**12), ("a\ten\nb\n", 2, 2 * 10**12), ("\ten\n", 0, 10**14)]
    done = spark.createDataFrame(counts, "key string, words int, f long")
    before, c.phrase_counts = c.phrase_counts, lambda *a: done
    try:
        row = c.collocations(frame(spark, [("en", "x")])).collect()
    finally:
        c.phrase_counts = before
    assert [tuple(r) for r in row] == [("en", 1, "a b", 2 * 10**12, 4 * 10**12, 3 * 10**12, 10**14, 333_333)]
