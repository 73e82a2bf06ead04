"""Spot signatures against a plain count of chains, neighbours and classes against brute force, on odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from symgraph.llm import spots

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COMMON = set(spots.COMMON)


def chains(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    out = Counter()
    for i, x in enumerate(w):
        if x in COMMON or not any(y in COMMON for y in w[max(0, i - spots.GAP) : i]):
            content = [y for y in w[i + 1 :] if y not in COMMON]
            out[x, *content[: spots.CHAIN]] += 1
    return out if w or not text else Counter({text: 1})


def alike(a, b):
    if not a or not b:
        return float(not a and not b)
    return (a & b).total() / (a | b).total()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    words = ["the", "of", "a", "der", "que", "et"] * 6 + [f"w{i}" for i in range(200)] + ["É", "x7", "the", "THE"]
    make = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", ", ", ".\n"]) for _ in range(n))
    rare = lambda n: " ".join(f"z{rnd.randint(0, 500)}" for _ in range(n))
    base, other = make(200), rare(90)
    texts = [None, "", "!!! ...", "?!", "one", "the", "one two", "日本語のテキスト", base, base, base.replace("w1", "q", 2), base + " tail end", base.upper(), "the w1 w2 " * 300, other, other + " z1 more"]
    texts += [make(rnd.randint(1, 150)) for _ in range(30)] + [make(6000), "😀é" * 50]
    out = [(i * 3 % 101 - 20, t) for i, t in enumerate(texts)]
    return [*out, out[8], out[8], (5, "the other text of an id"), (5, None), (None, base), (None, "no id"), (-(1 << 63), make(9))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], "doc_id long, text string, node int, guest string, part int")


def test_sets_are_multisets_of_chains(rows):
    texts = [t or "" for _, t in rows]
    sets = spots.spot_sets(pa.array(texts))
    want = [chains(t) for t in texts]
    for (a, x), (b, y) in itertools.combinations(zip(sets, want, strict=True), 2):
        assert abs(spots.likeness(a, b) - alike(x, y)) < 1e-12
    assert [len(s) for s in sets] == [c.total() for c in want]


@pytest.mark.parametrize("parts, batch", [(4, 10_000), (1, 3), (23, 1)])
def test_neighbours(spark, rows, parts, batch):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spots._plain(frame(spark, rows))
        got = spots.compare_neighbours(frame(spark, rows)).collect()
        keys = {(r["doc_id"], r["text"]): r["h"] for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = [(i, t or "") for i, t in rows]
    order = sorted(plain, key=lambda r: (-(-(1 << 63) if r[0] is None else r[0]), keys[r]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(chains(t), chains(e)), 9), round(alike(chains(t), chains(n)), 9)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    prints = {}
    for r in got:
        prints.setdefault(r["edited_sha256"], set()).add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in prints.values())


def test_ranges_keep_the_order():
    rng = np.random.default_rng(2)
    o, h = rng.integers(-3, 3, 5000), rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    bounds = np.sort(np.array([-2, 0, 0, 0, 0, 1, 1]))
    part = spots.range_of(bounds, o, h)
    at = np.lexsort((h, o))
    assert (np.diff(part[at]) >= 0).all() and len(set(part.tolist())) == 8  # one value fills several ranges


def test_classes(spark, rows):
    rnd = random.Random(1)
    family = [" ".join(f"the f{i}" if i != k else f"the g{k}" for i in range(60)) for k in rnd.sample(range(60), 25)]  # near to one another
    rows = [*[(i, t) for i, t in rows if i is None or i != 5], *[(1000 + i, t) for i, t in enumerate(family)], (2000, "the lone w1 of w2")]
    got = {(r["doc_id"], r["n_spots"]): r["class_id"] for r in spots.spot_classes(frame(spark, rows)).collect()}
    sets = [(i, chains(t or "")) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and alike(a, b) >= 0.75 and label[i] != label[j]:
            x, y = sorted((label[i], label[j]))
            label = {k: x if v == y else v for k, v in label.items()}
    assert {k: v for k, v in got.items() if k[0] is not None} == {(i, c.total()): label[i] for i, c in sets}
    assert {v for k, v in got.items() if k[0] is None} == {None} and sum(v == 1000 for v in got.values()) == 25


def test_query_columns_and_small_tables(spark):
    got = spots.compare_neighbours(frame(spark, [(1, "the only one")])).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1.0
    empty = spots.compare_neighbours(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
