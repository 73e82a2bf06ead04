"""Media copies: recall by kind of edit against a comparison of all pairs, and components of frequent words."""

import itertools

import numpy as np
import pytest

from symgraph.llm import components, media


def image(rnd) -> np.ndarray:
    return np.clip(128 + 300 * np.kron(rnd.normal(0, 0.125, (8, 8)), np.ones((8, 8))), 0, 255).astype(np.uint8)


def resized(x, scale):
    return np.clip(np.rint(media._resized(x.astype(np.float32), scale)), 0, 255).astype(np.uint8)


def turned(x, degrees):
    a, (h, w) = np.deg2rad(degrees), x.shape
    yy, xx = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    sx, sy = np.cos(a) * xx + np.sin(a) * yy + (w - 1) / 2, -np.sin(a) * xx + np.cos(a) * yy + (h - 1) / 2
    x0, y0 = np.clip(np.floor(sx).astype(int), 0, w - 2), np.clip(np.floor(sy).astype(int), 0, h - 2)
    fx, fy, f = np.clip(sx - x0, 0, 1), np.clip(sy - y0, 0, 1), x.astype(np.float32)
    out = (f[y0, x0] * (1 - fx) + f[y0, x0 + 1] * fx) * (1 - fy) + (f[y0 + 1, x0] * (1 - fx) + f[y0 + 1, x0 + 1] * fx) * fy
    out[(sx < 0) | (sy < 0) | (sx > w - 1) | (sy > h - 1)] = 128
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def noisy(x, rnd, sigma):
    return np.clip(x + rnd.normal(0, sigma, x.shape), 0, 255).astype(np.uint8)


EDITS = {
    "crop": lambda x, rnd: x[5:, 7:], "crop, dimmed": lambda x, rnd: (x[5:, 7:] * 0.75 + 20).astype(np.uint8), "crop to 40 x 44": lambda x, rnd: x[:40, :44],
    "noise 8": lambda x, rnd: noisy(x, rnd, 8), "noise 15": lambda x, rnd: noisy(x, rnd, 15), "gain 0.5": lambda x, rnd: (x * 0.5 + 10).astype(np.uint8),
    "size 0.9": lambda x, rnd: resized(x, 0.9), "size 0.8": lambda x, rnd: resized(x, 0.8), "size 0.71": lambda x, rnd: resized(x, 0.7071), "size 0.5": lambda x, rnd: resized(x, 0.5),
    "size 1.3": lambda x, rnd: resized(x, 1.3), "turn 90": lambda x, rnd: np.rot90(x), "turn 10": lambda x, rnd: turned(x, 10), "turn 45": lambda x, rnd: turned(x, 45),
}


def rows_of(images: dict) -> list:
    return [(k, x.shape[1], x.shape[0], np.ascontiguousarray(x).tobytes()) for k, x in images.items()]


def recall(spark, n: int) -> dict:
    """Of n images, by kind of edit: the share whose edit gets the image's component; the same by all pairs."""
    rnd = np.random.default_rng(11)
    images = {i: image(rnd) for i in range(n)}
    edited = {1000 * (k + 1) + i: edit(images[i], rnd) for k, edit in enumerate(EDITS.values()) for i in range(n)}
    got = {r["image_id"]: r["component_id"] for r in media.image_copies(spark.createDataFrame(rows_of(images | edited), media.IMAGE)).collect()}
    assert all(got[k] % 1000 == k % 1000 for k in got)  # nothing else is joined
    f = {k: media.features(x) for k, x in (images | edited).items()}
    pair = lambda a, b: media.inliers(f[a], f[b]) >= max(media.INLIERS, media.SHARE * min(len(f[a]), len(f[b])))
    return {name: (sum(got[1000 * (k + 1) + i] == i for i in range(n)) / n, sum(pair(i, 1000 * (k + 1) + i) for i in range(n)) / n) for k, name in enumerate(EDITS)}


def test_recall_by_edit(spark):
    found = recall(spark, 30)
    print(found)
    assert all(mine >= 0.9 for mine, _ in found.values())


def test_far_images_do_not_link():
    rnd = np.random.default_rng(2)
    f = [media.features(image(rnd)) for _ in range(60)]
    assert not any(media.inliers(a, b) >= max(media.INLIERS, media.SHARE * min(len(a), len(b))) for a, b in itertools.combinations(f, 2))


def test_families_and_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_PAIRS", 4)
    monkeypatch.setattr(media, "HEADS", 1)
    rnd = np.random.default_rng(3)
    base = image(rnd)
    left, right = base.copy(), base.copy()
    left[:, 32:], right[:, :32] = image(rnd)[:, 32:], image(rnd)[:, :32]  # halves of one image: common words, no link between them
    images = {0: left, 1: right, 2: base}
    images |= {10 + i: noisy((left, right)[i % 2], rnd, 4) for i in range(12)} | {30 + i: image(rnd) for i in range(5)}
    got = {r["image_id"]: r["component_id"] for r in media.image_copies(spark.createDataFrame(rows_of(images), media.IMAGE)).collect()}
    f = {k: media.features(x) for k, x in images.items()}
    label = {k: k for k in images}
    for a, b in itertools.combinations(images, 2):
        if media.inliers(f[a], f[b]) >= max(media.INLIERS, media.SHARE * min(len(f[a]), len(f[b]))):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    assert got == label


@pytest.mark.parametrize("shape", [(1, 1), (5, 200), (16, 16), (20, 20), (17, 300)])
def test_small_and_narrow_images(shape):
    assert media.features(np.arange(shape[0] * shape[1]).reshape(shape).astype(np.uint8)).dtype == media.FEATURE
