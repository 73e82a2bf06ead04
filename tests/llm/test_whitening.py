"""Whitening against whole-number arithmetic and a decomposition of the same matrix, on vectors with odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from symgraph.llm import whitening as w

KIND = "vec_id long, embedding array<float>, x string, component int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", 3) for i, v in vectors], KIND).repartition(3)


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    d = 12
    spread = rng.normal(size=(d, d)) * np.linspace(3, 0.2, d)
    rows = [(i, [float(c) for c in rng.normal(size=d) @ spread + 5]) for i in range(400)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0] * 11 + [None], [nan] + [1.0] * 11, [1.0] * 11 + [inf], [-inf] + [0.0] * 11, [1.0] * 5]
    return rows, [(1000 + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), (7, rows[7][1])]


def test_whitening(spark, vectors):
    rows, odd = vectors
    used = rows + odd[-2:]
    got = w.whiten(frame(spark, rows + odd)).collect()
    x = [whole(v) for _, v in used]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    y = np.array([[n * r[i] - sums[i] for i in range(d)] for r in x], object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in y.T @ y])
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(got) == n * d and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert abs(r["explained"] - e[r["component"] - 1] / v.trace()) < 1e-9
    assert {(i, int((q * q).sum())) for (i, _), q in zip(used, y, strict=True)} == set(by)
    # The projections give back all inner products by the inverse of V, whatever their signs.
    white = np.array([[by[i, int((q * q).sum())][k + 1][0] for k in range(d)] for (i, _), q in zip(used, y, strict=True)])
    z = y.astype(float) / n
    assert np.allclose(white @ white.T, z @ np.linalg.inv(v) @ z.T, atol=1e-6)
    assert np.allclose(white.T @ white / n, np.eye(d), atol=1e-9)
    # The result's error is that of a recount from the rows.
    assert abs(np.abs(white.T @ white / n - np.eye(d)).max() - got[0]["identity_error"]) < 1e-12


def test_pairs_in_several_aggregations(spark, vectors):
    df = w.whole_vectors(frame(spark, vectors[0]))
    cols = df.selectExpr(*[f"x[{i}] - 1000300 AS `z {i}`" for i in range(12)])
    names = [f"z {i}" for i in range(12)]
    assert (w.pair_sums(cols, names, 10) == w.pair_sums(cols, names)).all()


def test_few_components_and_no_variance(spark):
    rows = [(i, [float(i % 5), 2.0, -float(i % 5)]) for i in range(50)]  # rank 1
    got = w.whiten(frame(spark, rows)).collect()
    assert len(got) == 50 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-9
    assert w.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == [] and w.whiten(frame(spark, rows[:1] * 9)).collect() == []
    many = [(i, [float((i * (k + 3) * 7919) % 101) for k in range(40)]) for i in range(300)]
    assert {r["component"] for r in w.whiten(frame(spark, many)).collect()} == set(range(1, 33))


def test_empty(spark):
    got = w.whiten(frame(spark, []))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_are_exact_or_an_error(spark):
    rows = [(i, [float(2**20 * (i - 2)), float(i)]) for i in range(5)]
    got = w.whiten(frame(spark, rows)).where("component = 1").collect()
    x = [whole(v) for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: sum((5 * c - t) ** 2 for c, t in zip(r, s, strict=True)) for i, r in enumerate(x)}
    with pytest.raises(Exception, match="(?i)overflow|64 bits"):
        w.whiten(frame(spark, [(i, [float(2.0**50 * i), 1.0]) for i in range(5)])).collect()
