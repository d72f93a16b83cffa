"""Copies of images by local descriptors.

Corners are found at several scales; each has the direction of its patch's centre of mass, and a
descriptor of binary brightness tests turned to it, so that shifts, turns and changes of brightness
or contrast leave it as it is. Descriptors that are equal in one of several bit tables meet; near
ones vote for the similarity transform they imply, and images are copies where enough agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

RADIUS = 7  #: of a patch, in pixels of its scale
LEAST_SIDE = 2 * RADIUS + 9  #: smaller scales have no corners
STRENGTH = 0.02  #: of a corner against its scale's strongest
TURNS = 32  #: directions that tests are turned to
BITS = 256
TABLES, TABLE_BITS = 10, 25
MAX_DISTANCE = 40  #: bits that near descriptors may differ in
BLOCK = 32  #: features of a bucket that meet in one group; larger buckets are dealt out as pairs of blocks
HOT, ROUNDS = 64, 3  #: larger buckets are first compared with one of their images, in so many rounds
PLACE, ANGLES = 8.0, 12  #: pixels and parts of a turn within which votes agree
CONSENSUS = 4  #: agreeing features that make a copy

_random = np.random.default_rng(5)
_TESTS = np.clip(np.rint(_random.normal(0, RADIUS / 2.5, (BITS, 4))), -RADIUS + 2, RADIUS - 2)
_ANGLES = np.arange(TURNS) * 2 * np.pi / TURNS
_TURNED = np.stack([np.rint(np.stack([_TESTS[:, a] * np.cos(t) - _TESTS[:, a + 1] * np.sin(t) if p == 0 else _TESTS[:, a] * np.sin(t) + _TESTS[:, a + 1] * np.cos(t) for a in (0, 2) for p in (0, 1)], 1)) for t in _ANGLES]).astype(np.int64)
_DISC = np.array([(x, y) for x in range(-RADIUS, RADIUS + 1) for y in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])


def _box(image: np.ndarray, r: int) -> np.ndarray:
    """Mean of each pixel's square of radius r, edges repeated."""
    padded = np.pad(image, r, mode="edge")
    sums = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return (sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n]) / (n * n)


def _corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of local maxima of the smaller-eigenvalue response, a patch away from the edge."""
    gy, gx = np.gradient(image)
    xx, yy, xy = (_box(g, 2) for g in (gx * gx, gy * gy, gx * gy))
    response = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2
    around = np.lib.stride_tricks.sliding_window_view(np.pad(response, 2, constant_values=-np.inf), (5, 5)).max((2, 3))
    inner = np.zeros(image.shape, bool)
    edge = RADIUS + 2
    inner[edge:-edge, edge:-edge] = True
    y, x = np.nonzero(inner & (response >= around) & (response > STRENGTH * max(response.max(), 1e-12)))
    return x, y


def describe(image: np.ndarray) -> tuple[np.ndarray, ...]:
    """(x, y, scale, angle in turns, 256-bit descriptors as 4 x 64) of an image's features, in its own pixels."""
    out, scale = [], 1
    while min(image.shape) >= LEAST_SIDE:
        x, y = _corners(image)
        if len(x):
            patch = image[y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2(patch @ _DISC[:, 1], patch @ _DISC[:, 0]) / (2 * np.pi) % 1
            tests = _TURNED[np.rint(angle * TURNS).astype(np.int64) % TURNS]
            soft = _box(image, 1)
            bits = soft[y[:, None] + tests[:, :, 1], x[:, None] + tests[:, :, 0]] < soft[y[:, None] + tests[:, :, 3], x[:, None] + tests[:, :, 2]]
            out.append(((x + 0.5) * scale, (y + 0.5) * scale, np.full(len(x), float(scale)), angle, np.packbits(bits, axis=1).view(np.int64)))
        h, w = (s // 2 * 2 for s in image.shape)
        image = image[:h, :w].reshape(h // 2, 2, w // 2, 2).mean((1, 3))
        scale *= 2
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (*(np.zeros(0),) * 4, np.zeros((0, 4), np.int64))


def features(images: DataFrame, id_col: str = "image_id", width_col: str = "width", pixels_col: str = "pixels") -> DataFrame:
    """(id, x, y, scale, angle, d0..d3) of images, rows of floats by lines.

    An image that is null, empty, no multiple of its width or smaller than a patch has no features;
    a null or non-finite pixel counts as 0.
    """
    kept = images.select(F.col(id_col).alias("id"), F.col(width_col).cast("int").alias("width"), F.col(pixels_col).cast("array<double>").alias("pixels"))
    names = ["id", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                width, pixels = batch.column(1)[k].as_py(), batch.column(2)[k]
                values = np.nan_to_num(np.asarray(pixels.values.to_numpy(zero_copy_only=False), float), nan=0, posinf=0, neginf=0) if pixels.is_valid else np.zeros(0)
                if width and width > 0 and len(values) and len(values) % width == 0:
                    x, y, scale, angle, bits = describe(values.reshape(-1, width))
                    if len(x):
                        ids = batch.column(0).take(pa.array(np.full(len(x), k)))
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in (x, y, scale, angle, *(np.ascontiguousarray(c) for c in bits.T)))], names)

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, x double, y double, scale double, angle double, d0 long, d1 long, d2 long, d3 long")


def _table_key(t: int):
    """The t-th run of TABLE_BITS bits, with t itself."""
    low = t * TABLE_BITS
    word, shift = divmod(low, 64)
    bits = F.shiftrightunsigned(F.col(f"d{word}"), shift)
    if shift + TABLE_BITS > 64:
        bits = bits.bitwiseOR(F.shiftleft(F.col(f"d{word + 1}"), 64 - shift))
    return bits.bitwiseAND(F.lit((1 << TABLE_BITS) - 1)) * TABLES + t


def _copies(pairs: DataFrame) -> DataFrame:
    """(a, b), ids with a < b: the images of which enough pairs (a, b) of features are near and imply one transform."""
    first = F.col("a.id") < F.col("b.id")
    pairs = pairs.where("a.id <> b.id").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))
    distance = sum((F.bit_count(F.col(f"a.d{w}").bitwiseXOR(F.col(f"b.d{w}"))) for w in range(4)), F.lit(0))
    near = pairs.where(distance <= MAX_DISTANCE).distinct()
    turn = F.pmod(F.col("b.angle") - F.col("a.angle"), F.lit(1.0))
    ratio = F.col("b.scale") / F.col("a.scale")
    angle = F.floor(turn * ANGLES + 0.5) % ANGLES
    exact = angle / ANGLES * 2 * 3.141592653589793
    dx = F.col("b.x") - ratio * (F.col("a.x") * F.cos(exact) - F.col("a.y") * F.sin(exact))
    dy = F.col("b.y") - ratio * (F.col("a.x") * F.sin(exact) + F.col("a.y") * F.cos(exact))
    cell = lambda v, k: F.floor(v / PLACE + k / 2)  # noqa: E731  two grids, half a cell apart, each way
    grids = F.explode(F.array(*(F.struct(F.lit(2 * i + j).alias("grid"), cell(dx, i).alias("cx"), cell(dy, j).alias("cy")) for i in (0, 1) for j in (0, 1))))
    votes = near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), angle.alias("angle"), F.log2(ratio).cast("int").alias("ratio"), F.struct("a.x", "a.y", "a.scale").alias("at"), grids.alias("g"))
    agreed = votes.groupBy("a", "b", "angle", "ratio", "g").agg(F.count_distinct("at").alias("n")).where(F.col("n") >= CONSENSUS)
    return agreed.select("a", "b").distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, f, n) with each feature's image's component so far, ``comp``."""
    return rows.join(labels.select(F.col("node").alias("_node"), "comp"), F.col("f.id") == F.col("_node"), "left").select("key", "f", "n", F.coalesce("comp", "f.id").alias("comp"))


def find_copies(images: DataFrame, id_col: str = "image_id", width_col: str = "width", pixels_col: str = "pixels") -> DataFrame:
    """``id_col``, ``n_features``, ``class_id`` (smallest id among the copies, its own included), one row per image.

    Images with the same id are one. Without features an image is in a class of its own. Images with
    the same features (by 128 bits of hash), if these are enough for a copy, are compared as one. In
    a large bucket all features first meet those of one of its images, round by round, so that a
    family of copies is linked without its pairs; then every two features of a bucket whose images
    aren't linked so far are compared, a large bucket's dealt out as pairs of blocks, so that no task
    has all of it. Classes are those of comparing all pairs. Null ids take no part.
    """
    spark = images.sparkSession
    scratch = Scratch(spark, "media")
    images = images.where(F.col(id_col).isNotNull())
    found = scratch.save(features(images, id_col, width_col, pixels_col), "features")
    body = F.struct("id", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3")
    whole = ("x", "y", "scale", "angle", "d0", "d1", "d2", "d3")
    marks = found.select("id", *whole).distinct().select("id", F.struct("x", "y", "scale").alias("at"), *(F.xxhash64(F.lit(salt), *whole).alias(f"h{salt}") for salt in (0, 1)))
    spots = marks.groupBy("id", "at").agg(*(F.bit_xor(f"h{salt}").alias(f"h{salt}") for salt in (0, 1)))
    alike = spots.groupBy("id").agg(F.count(F.lit(1)).alias("places"), *(F.bit_xor(f"h{salt}").alias(f"h{salt}") for salt in (0, 1))).where(F.col("places") >= CONSENSUS)
    alike = scratch.save(alike, "alike")
    same = ["places", "h0", "h1"]
    firsts = alike.groupBy(*same).agg(F.min("id").alias("a"))
    links = scratch.save(alike.join(firsts, same).where("a < id").select("a", F.col("id").alias("b")), "twins")
    keyed = found.join(links.select(F.col("b").alias("id")), "id", "left_anti").select(body.alias("f"), F.explode(F.array(*(_table_key(t) for t in range(TABLES)))).alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("f.id").alias("low"), F.max("f.id").alias("high")).where("low < high")
    met = scratch.save(keyed.join(buckets.select("key", "n"), "key"), "met")

    labels = connected_components(scratch, links, "labels-0")
    hot, spread = met.where(F.col("n") > HOT), {"low": F.min("comp"), "high": F.max("comp"), "n": F.count(F.lit(1))}
    for turn in range(1, ROUNDS + 1):
        if not hot.limit(1).count():
            break
        rows = _labelled(hot, labels)
        heads = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(F.xxhash64("f.id", F.lit(turn)).alias("h"), "f.id", "comp")).alias("head")).where("low < high")
        rows = scratch.save(rows.join(heads.select("key", "head"), "key"), f"open-{turn}")
        head = rows.where("f.id = head.id").select("key", F.col("f").alias("b"))
        links = links.unionByName(scratch.save(_copies(rows.where("comp <> head.comp").select("key", F.col("f").alias("a")).join(head, "key").select("a", "b")), f"links-{turn}"))
        labels = connected_components(scratch, links, f"labels-{turn}")
    rows = scratch.save(_labelled(met, labels), "labelled")
    still = rows.groupBy("key").agg(*(v.alias(k) for k, v in spread.items())).where("low < high").select("key", F.floor((F.col("n") - 1) / BLOCK).cast("int").alias("last"))
    rows = scratch.save(rows.drop("n").join(still, "key").withColumn("block", F.pmod(F.xxhash64("f"), F.col("last") + 1).cast("int")), "open")
    left = rows.select("key", F.col("f").alias("a"), F.col("comp").alias("comp_a"), F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"))
    right = rows.select("key", F.col("f").alias("b"), F.col("comp").alias("comp_b"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    pairs = left.join(right, ["key", "i", "j"]).where("comp_a <> comp_b AND (i < j OR a.id < b.id)").select("a", "b")
    links = links.unionByName(scratch.save(_copies(pairs), "links"))
    labels = connected_components(scratch, links, "labels")
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("n_features"))
    classes = images.select(F.col(id_col).alias("id")).distinct().join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    return classes.select(F.col("id").alias(id_col), F.coalesce("n_features", F.lit(0)).alias("n_features"), F.coalesce("comp", "id").alias("class_id"))
