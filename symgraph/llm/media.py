"""Media columns: cropped and edited copies of images, by local descriptors.

1. Images with equal size and pixels are one node (a third of all rows may be one).
2. Corners. Harris corners of each image at ``LEVELS`` scales, a factor of 2^(1/4) apart (small images are
   enlarged first), all that stand out, without a limit, but for a margin where patches would be mostly
   outside the image.
3. Descriptors. Each corner is turned to the direction of its patch's intensity centroid; 256 tests of two
   smoothed pixels, whether one is brighter by a part of the patch's contrast, give 256 bits, which gain,
   offset and turning leave alone.
4. Hamming tables. The bits are cut into ``BANDS`` words of 42 bits; descriptors that share a word
   at its place meet, and match if of the 48 bits after it at most ``NEAR`` differ. Two images are candidates
   if ``VOTES`` matches agree in their turn and scale. Nodes meet the head of each word first, which joins families
   early; then, of the words whose nodes are still in several components, all nodes meet that are in
   different ones. Matches are found inside the join and summed before any descriptor is sent.
5. Consensus. Of each candidate pair, mutually nearest descriptors propose a turn, a scale and a shift; the
   pair links when ``INLIERS`` matches, and a ``SHARE`` of the smaller image's corners, agree with one.

A pair without ``VOTES`` common words is no candidate; the tests measure what that costs by kind of edit,
against a comparison of all pairs.

Output: ``image_id, n_features, n_links, component_id``; links are those found between its node and others.

Defined cases: images that are null, empty, flat or not of the stated size have no corners and link only
with equal ones (null pixels with nothing); null ids have a null component; repeated rows give a row each;
ties take the least id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize, release
from .components import components, tested_pairs

#: Scales below the first one and that; images are enlarged by whole steps until this side at least.
LEVELS, STEP, LEAST_SIDE = 5, 2**-0.25, 48
#: Of each word's bits, 5 bytes follow one another, and two are from the last 16 bits.
PATCH, TESTS, BANDS, BYTES, REST = 16, 256, 6, 5, 2
#: A test's two pixels are this part of PATCH apart at least, and its bit needs this part of the patch's deviation.
APART, CONTRAST = 0.6, 0.4
#: Of some seeds of the tests' places, the one whose words unrelated images share least.
SEED = 3
#: Corners are this many pixels, or at least this part of the smaller side, inside the image.
MARGIN, MARGIN_SHARE = 9, 0.2
#: Of the 48 bits after a common word, most that differ; words of a candidate pair that agree in turn; heads of a node.
NEAR, VOTES, HEADS = 6, 2, 3
#: Most bits that matched descriptors differ in; pixels that an agreeing match may be off; what a link needs.
BITS, OFF, INLIERS, SHARE = 40, 3.0, 6, 0.2
#: A corner's response is at least this, and this part of the image's strongest.
LEAST, RELATIVE = 50.0, 0.005
IMAGE = "image_id long, width int, height int, pixels binary"
FEATURE = np.dtype([("x", "f4"), ("y", "f4"), ("angle", "f4"), ("scale", "f4"), ("bits", "u8", TESTS // 64)])


@lru_cache(None)
def _pattern() -> tuple[np.ndarray, np.ndarray]:
    """Places of the tests (TESTS x 2 points x (x, y)) and of the centroid's disc. The tests are dealt to the
    words by the direction of their middle, so that each word covers the whole patch."""
    rnd, tests = np.random.Generator(np.random.PCG64(SEED)), []
    while len(tests) < TESTS:
        r, a = (PATCH - 1) * np.sqrt(rnd.random(2)), 2 * np.pi * rnd.random(2)
        if abs(r[0] * np.exp(1j * a[0]) - r[1] * np.exp(1j * a[1])) >= APART * PATCH:
            tests.append(np.stack([r * np.cos(a), r * np.sin(a)], -1))
    tests = np.stack(tests)
    order = np.argsort(np.arctan2(*tests.mean(1).T[::-1]), kind="stable")
    dealt = np.concatenate([order[k::BANDS][: 8 * BYTES] for k in range(BANDS)])
    grid = np.mgrid[-PATCH + 1 : PATCH, -PATCH + 1 : PATCH].reshape(2, -1).T
    return tests[np.append(dealt, np.setdiff1d(order, dealt))], grid[(grid**2).sum(1) < PATCH**2]


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 r + 1 pixels, edges repeated."""
    p = np.pad(x, r, mode="edge")
    rows = sum(p[i : i + x.shape[0]] for i in range(2 * r + 1))
    return sum(rows[:, i : i + x.shape[1]] for i in range(2 * r + 1))


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    out = x
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(int(n * scale)) + 0.5) / scale - 0.5, 0, n - 1)
        lo = at.astype(np.int64)
        w = (at - lo).astype(np.float32)
        w = w[:, None] if axis == 0 else w
        out = np.take(out, lo, axis) * (1 - w) + np.take(out, np.minimum(lo + 1, n - 1), axis) * w
    return out


def _corners(x: np.ndarray) -> np.ndarray:
    """Rows and columns of local maxima of the Harris response."""
    p = np.pad(x, 1, mode="edge")
    gy, gx = (p[2:, 1:-1] - p[:-2, 1:-1]) / 2, (p[1:-1, 2:] - p[1:-1, :-2]) / 2
    a, b, c = _box(gx * gx, 1) / 9, _box(gy * gy, 1) / 9, _box(gx * gy, 1) / 9
    r = a * b - c * c - 0.05 * (a + b) ** 2
    most = np.pad(r, 2, constant_values=-np.inf)
    keep = r >= max(LEAST, RELATIVE * r.max())
    h, w = r.shape
    for i in range(5):
        for j in range(5):
            other = most[i : i + h, j : j + w]
            keep &= (r > other) if (i, j) < (2, 2) else (r >= other)
    return np.argwhere(keep)


def features(pixels: np.ndarray) -> np.ndarray:
    """The corners of a grey image at all scales, as ``FEATURE`` records."""
    tests, disc = _pattern()
    out, up = [np.zeros(0, FEATURE)], 0
    while 0 < min(pixels.shape) * STEP**up < LEAST_SIDE and up > -8:
        up -= 1
    for level in range(up, LEVELS):
        scale = STEP**level
        x = _resized(pixels.astype(np.float32), scale)
        if min(x.shape) < PATCH:
            continue
        at = _corners(x)
        inside = min(MARGIN, MARGIN_SHARE * min(x.shape))
        at = at[np.minimum(at, np.array(x.shape) - 1 - at).min(1, initial=1 << 30) + 0.5 >= inside]
        found = np.zeros(len(at), FEATURE)
        smooth = np.pad(_box(x, 2), 2 * PATCH, mode="edge")
        centre = at + 2 * PATCH
        for lo in range(0, len(at), 1024):
            c = centre[lo : lo + 1024]
            patch = smooth[c[:, :1] + disc[:, 0], c[:, 1:] + disc[:, 1]]
            least = 1 + CONTRAST * patch.std(1, keepdims=True)
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2(patch @ disc[:, 0].astype(np.float32), patch @ disc[:, 1].astype(np.float32))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            dx = np.rint(cos * tests[..., 0] - sin * tests[..., 1]).astype(np.int64)
            dy = np.rint(sin * tests[..., 0] + cos * tests[..., 1]).astype(np.int64)
            v = smooth[c[:, :1, None] + dy, c[:, 1:, None] + dx]
            f = found[lo : lo + 1024]
            f["bits"] = np.packbits(v[..., 0] > v[..., 1] + least, axis=1).view(np.uint64)
            f["angle"], f["scale"] = angle, scale
        found["y"], found["x"] = ((at + 0.5) / scale - 0.5).T
        out.append(found)
    return np.concatenate(out)


def words_of(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the Hamming tables, each with its place; and of each word the 48 bits after it, above
    the descriptor's level (4 bits) and its angle in 256 steps."""
    raw = np.ascontiguousarray(f["bits"]).view(np.uint8).reshape(len(f), TESTS // 8).astype(np.int64)
    number = lambda first, n: sum(raw[:, (first + i) % (BANDS * BYTES)] << (8 * i) for i in range(n))
    angle = np.floor(f["angle"] * (128 / np.pi)).astype(np.int64) & 255
    level = np.rint(np.log(f["scale"]) / np.log(STEP)).astype(np.int64) + 8
    rest = raw[:, -2] | raw[:, -1] << 8
    keys = [number(k * BYTES, BYTES) | (rest >> REST * k & (1 << REST) - 1) << 8 * BYTES | k << 8 * BYTES + REST for k in range(BANDS)]
    return np.concatenate(keys), np.concatenate([number((k + 1) * BYTES, 6) << 12 | level << 8 | angle for k in range(BANDS)])


def inliers(a: np.ndarray, b: np.ndarray) -> int:
    """The most mutually nearest matches that agree on one turn, scale and shift."""
    if not len(a) or not len(b):
        return 0
    of_a, far_a = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    of_b, far_b = np.zeros(len(b), np.int64), np.full(len(b), TESTS + 1)
    for lo in range(0, len(a), 256):
        d = sum(np.bitwise_count(a["bits"][lo : lo + 256, None, k] ^ b["bits"][None, :, k]).astype(np.int16) for k in range(TESTS // 64))
        of_a[lo : lo + 256], far_a[lo : lo + 256] = d.argmin(1), d.min(1)
        near = d.min(0)
        of_b = np.where(near < far_b, d.argmin(0) + lo, of_b)
        far_b = np.minimum(near, far_b)
    i = np.flatnonzero((far_a <= BITS) & (of_b[of_a] == np.arange(len(a))))
    a, b = a[i], b[of_a[i]]
    turn, scale = b["angle"] - a["angle"], a["scale"] / b["scale"]
    z, w = a["x"] + 1j * a["y"], b["x"] + 1j * b["y"]
    best = 0
    for lo in range(0, len(a), 256):
        part = slice(lo, lo + 256)
        m = (scale[part] * np.exp(1j * turn[part]))[:, None]
        best = max(best, int((np.abs(w[part, None] + m * (z[None] - z[part, None]) - w[None]) <= OFF).sum(1).max()))
    return best


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        nodes, counts, blobs = [], [], []
        for i, (node, w, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "width", "height")), strict=True)):
            if node is None or node in seen:
                continue
            seen.add(node)
            data = batch.column("pixels")[i].as_py()
            fits = w and h and w > 0 and h > 0 and w * h == len(data)
            f = features(np.frombuffer(data, np.uint8).reshape(h, w)) if fits else np.zeros(0, FEATURE)
            nodes.append(node)
            counts.append(len(f))
            blobs.append(f.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "n", "value"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = [np.frombuffer(x.as_py(), FEATURE) for x in part.column("value")]
            keys, at = words_of(np.concatenate([np.zeros(0, FEATURE), *found]))
            place = np.tile(np.repeat(np.arange(len(found)), list(map(len, found))), BANDS)
            order = np.lexsort((at, keys, place))  # a node has each word once
            first = np.append(True, (keys[order][1:] != keys[order][:-1]) | (place[order][1:] != place[order][:-1]))[: len(order)]
            keys, at, nodes = keys[order][first], at[order][first], part.column("node").to_numpy()[place[order][first]]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes, pa.int64()), pa.array(at)], names=["key", "node", "at"])


def linked(a: pa.BinaryScalar, b: pa.BinaryScalar) -> bool:
    x, y = (np.frombuffer(v.as_py(), FEATURE) for v in (a, b))
    return inliers(x, y) >= max(INLIERS, SHARE * min(len(x), len(y)))


def match(x: str, y: str):
    """Whether the bits after two descriptors' common word are near."""
    return F.bit_count(F.call_function("shiftrightunsigned", F.col(x).bitwiseXOR(F.col(y)), F.lit(12))) <= NEAR


def candidates(matches: DataFrame) -> DataFrame:
    """``a, b, votes`` of the pairs of which ``VOTES`` matches (``a, b, x, y``; x and y are the descriptors'
    bits, levels and angles) agree in scale and in turn: a sixteenth of a turn, or the next."""
    part = lambda c, at, n: F.shiftright(F.col(c), at).bitwiseAND(F.lit(n - 1))
    turn = F.shiftright(F.pmod(part("y", 0, 256) - part("x", 0, 256), F.lit(256)), 4)
    sums = matches.groupBy("a", "b", (part("y", 8, 16) - part("x", 8, 16)).alias("steps")).agg(*[F.count(F.when(turn == i, 1)).alias(f"t{i}") for i in range(16)])
    votes = F.greatest(*[F.col(f"t{i}") + F.col(f"t{(i + 1) % 16}") for i in range(16)])
    return sums.withColumn("votes", votes).where(F.col("votes") >= VOTES).groupBy("a", "b").agg(F.max("votes").alias("votes"))


class Copies:
    """The search over one table of images; what comes of it are written tables."""

    def __init__(self, images: DataFrame):
        x = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("pixels").cast("binary").alias("pixels"))
        x = x.withColumn("node", F.when(F.col("pixels").isNotNull(), F.xxhash64("width", "height", "pixels")))
        self.rows = materialize(x.select("image_id", "node"), "images")
        found = x.where("image_id IS NOT NULL").mapInArrow(_features, "node long, n long, value binary")
        self.nodes = materialize(found.dropDuplicates(["node"]), "features")

    def shared(self) -> DataFrame:
        """``key, node, at`` of the words of several nodes."""
        words = self.nodes.select("node", "value").mapInArrow(_words, "key long, node long, at long")
        keys = materialize(words.groupBy("key").count().where("count > 1").select("key"), "frequent")
        found = materialize(words.join(keys, "key", "left_semi"), "shared")
        release(keys)
        return found

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links ``a, b`` between nodes, and ``node, label`` of the nodes that have any."""
        words, values = self.shared(), self.nodes.select("node", "value")
        heads = words.groupBy("key").agg(F.min(F.struct("node", "at")).alias("head")).select("key", F.col("head.node").alias("b"), F.col("head.at").alias("y"))
        near = words.select("key", F.col("node").alias("a"), F.col("at").alias("x")).join(heads, "key").where((F.col("a") != F.col("b")) & match("x", "y"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("votes", "b")), asc=False), 1, HEADS)  # a node has as many heads as words at most
        first = candidates(near).groupBy("a").agg(best.alias("best")).select("a", F.inline("best")).select("a", "b")
        first = materialize(first, "first")
        links = tested_pairs(first, values, linked)
        labels = components(links)
        # What the heads have not joined: all pairs of different components that share words. One node of each
        # pair is outside the word's largest component.
        rest = words.join(checked(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
        row = F.struct("label", "node", "at")
        xor = [F.bit_xor(c).alias(f"x{c}") for c in ("label", "node", "at")]
        keys = rest.groupBy("key").agg(F.count("*").alias("n"), F.min(row).alias("lo"), F.max(row).alias("hi"), *xor).where("lo.label <> hi.label")
        keys = materialize(keys, "open-words")
        # Words of two or three nodes give their pairs as they are (the third is what the XOR of all has besides
        # the least and the largest); the others' nodes join.
        third = F.struct(*[F.col(f"x{c}").bitwiseXOR(F.col(f"lo.{c}")).bitwiseXOR(F.col(f"hi.{c}")).alias(c) for c in ("label", "node", "at")])
        ends, both = F.struct("lo", "hi"), lambda p, q: F.struct(p.alias("lo"), q.alias("hi"))
        some = F.when(F.col("n") == 2, F.array(ends)).otherwise(F.array(ends, both(F.col("lo"), third), both(third, F.col("hi"))))
        few = keys.where("n <= 3").select(F.explode(some).alias("p")).where("p.lo.label <> p.hi.label")
        few = few.select(*[F.col(f"p.{k}").alias(c) for k, c in (("lo.node", "a"), ("hi.node", "b"), ("lo.at", "x"), ("hi.at", "y"))]).where(match("x", "y"))
        rest = materialize(rest.join(keys.where("n > 3").select("key"), "key", "left_semi"), "open")
        largest = rest.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label"))["label"].alias("largest"))
        rest = rest.join(largest, "key").withColumn("inside", F.col("label") == F.col("largest"))
        x, y = (rest.select(F.col("key").alias(f"q{k}"), F.col("node").alias(k), F.col("at").alias(c), F.col("label").alias(f"l{k}"), F.col("inside").alias(f"i{k}")) for k, c in ("ax", "by"))
        near = x.where("NOT ia").join(y, (F.col("qa") == F.col("qb")) & (F.col("la") != F.col("lb")) & (F.col("ib") | (F.col("a") < F.col("b"))) & match("x", "y")).select("a", "b", "x", "y").unionByName(few)
        # The same two nodes may meet either way round, at words of different largest components.
        turned = F.col("a") > F.col("b")
        near = near.select(*[F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"))])
        tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        across = materialize(candidates(near).select("a", "b").join(tested, ["a", "b"], "left_anti"), "across")
        release(words, keys, rest)
        links = links.select("a", "b").unionByName(tested_pairs(across, values, linked))
        return links, components(links)

    def result(self) -> DataFrame:
        links, labels = self.links()
        n = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
        least = self.rows.where("node IS NOT NULL AND image_id IS NOT NULL").groupBy("node").agg(F.min("image_id").alias("least"))
        member = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        of = member.groupBy("label").agg(F.min("least").alias("component_id"))
        named = member.join(of, "label").join(n, "node", "left").join(self.nodes.select("node", "n"), "node", "left")
        named = materialize(named.select("node", F.col("n").alias("n_features"), "n_links", "component_id"), "classes")
        own = F.when(F.col("image_id").isNotNull(), F.coalesce("component_id", "image_id"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return self.rows.join(checked(named), "node", "left").select("image_id", zero("n_features"), zero("n_links"), own.alias("component_id"))


def image_copies(images: DataFrame) -> DataFrame:
    return Copies(images).result()


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            side = int(len(v or ()) ** 0.5)
            if not side:
                rows.append((i, 0, 0, None))
                continue
            grey = np.nan_to_num(np.array(v[: side * side], np.float32)).reshape(side, side)
            image = np.clip(128 + 300 * np.kron(grey, np.ones((8, 8), np.float32)), 0, 255).astype(np.uint8)
            rows.append((i, image.shape[1], image.shape[0], image.tobytes()))
            if i is not None and i % 10 == 0:
                cut = (image[5:, 7:].astype(np.float32) * 0.75 + 20).astype(np.uint8)
                rows.append((-1 - i, cut.shape[1], cut.shape[0], cut.tobytes()))
        yield pa.RecordBatch.from_pylist([dict(zip(("image_id", "width", "height", "pixels"), r, strict=True)) for r in rows], pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))


def rendered(embeddings: DataFrame) -> DataFrame:
    """No table holds images, so this makes one of each vector (squares of eight grey pixels a value), and a
    cropped, dimmed copy, with id -1 - vec_id, of those whose id is divisible by 10."""
    return embeddings.select("vec_id", "embedding").mapInArrow(_rendered, IMAGE)


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    return image_copies(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
