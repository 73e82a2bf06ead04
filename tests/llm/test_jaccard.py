"""The sketches of the n-gram Jaccard join: what they reject, what they miss, hubs and components in one key."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import common, components, jaccard


def pair(rnd, n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of n hashes each with at least that Jaccard similarity, about."""
    apart = int(n * (1 - similarity) / (1 + similarity))
    x = rnd.integers(0, 1 << 64, n + apart, np.uint64, endpoint=False)
    return np.sort(x[:n]), np.sort(x[apart:])


@pytest.mark.parametrize("n", [20, 60, 300, 1000, 1800, 2000, 5000, 20000])
def test_sketches_reject_sets_that_are_far(spark, n):
    rnd = np.random.default_rng(n)
    rows = []
    for similarity in [0.5] * 100 + [0.76] * 30:
        a, b = pair(rnd, n, similarity)
        b = b[: max(1, int(n * 0.99))] if similarity < 0.6 else b  # lengths of sketches may differ
        rows.append((similarity > 0.6, len(a), len(b), jaccard.bit_sketch(a).tolist(), jaccard.bit_sketch(b).tolist()))
    found = spark.createDataFrame(rows, "linked boolean, na long, nb long, xa array<long>, xb array<long>").withColumn("may", jaccard.may_link("na", "nb", "xa", "xb"))
    got = [(r["linked"], r["may"]) for r in found.select("linked", "may").collect()]
    assert all(may for linked, may in got if linked)
    assert sum(may for linked, may in got if not linked) <= (1 if n > 20 else 5)


def test_sketches_of_two_lengths(spark):
    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 1 << 64, 560, np.uint64, endpoint=False)
    a, b = np.sort(x[:500]), np.sort(x)
    sa, sb = jaccard.bit_sketch(a), jaccard.bit_sketch(b)
    assert (len(sa), len(sb)) == (16, 32)
    apart = int(np.bitwise_count((sb[:16] ^ sb[16:] ^ sa).view(np.uint64)).sum())
    assert 40 < apart <= 60  # at most the symmetric difference
    df = spark.createDataFrame([(500, 560, sa.tolist(), sb.tolist()), (500, 340, sa.tolist(), sb.tolist())], "na long, nb long, xa array<long>, xb array<long>")
    assert [r[0] for r in df.select(jaccard.may_link("na", "nb", "xa", "xb")).collect()] == [True, False]


@pytest.mark.parametrize("n", [8, 30, 100, 400, 3000, 19000])
def test_words_find_linked_pairs(n):
    rnd = np.random.default_rng(n)
    missed = 0
    for k in range(170 if n < 1000 else 40):
        a, b = pair(rnd, n, 0.75 + 0.05 * (k % 2))
        i = len(np.intersect1d(a, b))
        if 100 * i >= 75 * (len(a) + len(b) - i):
            missed += not len(np.intersect1d(jaccard.sketch_words(a), jaccard.sketch_words(b)))
    assert missed == 0


def test_hubs_chains_and_mixed_keys(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_PAIRS", 3)
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(5000)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts, base = [], make(120)
    for k in range(25):  # a family around one text, near-linked ones among them
        w = list(base)
        for i in rnd.sample(range(120), 1 + k % 6):
            w[i] = f"e{k}_{i}"
        texts.append(w)
    w = make(150)
    for _ in range(20):  # a chain of edits: its ends are far apart
        w = [*w[6:], *make(6)]
        texts.append(w)
    long = make(6000)
    texts += [long, [*long[:5900], *make(90)], [*long[:4000], *make(2000)], make(6000)]
    texts += [make(rnd.randint(5, 60)) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(label[:], 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(set(label)) > 20


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    t = common.materialize(spark.range(1000).withColumn("x", F.repeat(F.md5(F.col("id").cast("string")), 20)), "checked")
    hinted = lambda df: "isBroadcast" in str(df._jdf.queryExecution().logical().toString()) or "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.checked(t)) and not hinted(common.checked(t, limit=999)) and not hinted(common.checked(t, size=1000))
