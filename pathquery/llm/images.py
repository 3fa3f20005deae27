"""Copies of images, whole, cropped, turned, resized or edited, by local descriptors.

Images are rasters (binary PGM or PPM, read as grey).  For each scale of a small pyramid the strongest corners (Harris
measure, local maxima) are found; a corner's patch is turned to its intensity centroid, in STEPS directions, and BITS
comparisons of smoothed pixels give its descriptor.  Descriptors are cut into BANDS words and meet in a table for each
word, whatever their scales (two descriptors with fewer than BANDS differing bits share one for certain).  Two images
whose corners meet MEET times within CLOSE bits are compared in full, all corners of one with all of the other.  A match within
NEAR bits tells how the copy is turned, resized and moved, by the directions, scales and places of its two corners;
matches that agree are fitted with one such transform, and CONSENSUS distinct corners within OFFSET of it make two images
copies.  Links give classes.

Skew.  Equal images are collapsed by their hash before anything meets (one of each goes on).  Within a table word all
corners of different images meet, however many there are, so that a large group of edited copies meets in pairs.

Defined results: a null or unreadable image has no corner and is a class of its own; equal images are one class; rows
that repeat an id are taken as one image (the least by hash); a null id has a null class and no link; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, written
from .components import components

SCALES = (1.0, 0.7)
#: Places are told in units that make the longer side this many at most.
SIDE = 4095
CORNERS, RADIUS, MOMENT, STEPS, BITS, BANDS = 24, 11, 9, 64, 128, 4
NEAR, CONSENSUS, OFFSET, AGREE = 12, 4, 2.5, 0.25
#: Words that make two images candidates, and the differing bits that corners with a common word may have for that.
MEET, CLOSE = 2, 10
_rng = np.random.Generator(np.random.PCG64(5))
_tests = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS / 1.5, RADIUS / 1.5)
_turned = np.stack([np.rint(_tests @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])).astype(np.int64) for t in np.arange(STEPS) * 2 * np.pi / STEPS])


_head = re.compile(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return f"P5 {w} {h} 255\n".encode() + pixels.astype(np.uint8).tobytes()


def raster(data: bytes | None) -> np.ndarray | None:
    """The grey pixels of a binary PGM or PPM of 8 bits, or None."""
    m = _head.match(data or b"")
    if not m or int(m[4]) > 255:
        return None
    w, h, bands = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    body = np.frombuffer(data, np.uint8, offset=m.end())
    if not w or not h or len(body) < w * h * bands:
        return None
    x = body[: w * h * bands].reshape(h, w, bands)
    return x[:, :, 0] if bands == 1 else np.rint(x @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def boxed(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1)^2 windows of the last two axes, edges padded."""
    p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(r + 1, r), (r + 1, r)], mode="edge")
    c = p.cumsum(-1).cumsum(-2)
    n = 2 * r + 1
    return c[..., n:, n:] - c[..., :-n, n:] - c[..., n:, :-n] + c[..., :-n, :-n]


def resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, of a stack of images."""
    if scale == 1.0:
        return x
    h, w = x.shape[1:]
    ys, xs = (np.arange(max(1, int(n * scale))) / scale for n in (h, w))
    y0, x0 = np.minimum(ys.astype(int), h - 1), np.minimum(xs.astype(int), w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    top = x[:, y0][:, :, x0] * (1 - fx) + x[:, y0][:, :, x1] * fx
    low = x[:, y1][:, :, x0] * (1 - fx) + x[:, y1][:, :, x1] * fx
    return top * (1 - fy) + low * fy


def described(stack: np.ndarray):
    """Of a stack of equal-sized images: (image number, scale, direction, x, y, descriptor as four 32-bit words) arrays; places are those of the whole image."""
    out = []
    for s, scale in enumerate(SCALES):
        x = boxed(resized(stack.astype(np.float64), scale), 1) / 9
        n, h, w = x.shape
        m = RADIUS
        if h <= 2 * m + 2 or w <= 2 * m + 2:
            continue
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = boxed(gx * gx, 2), boxed(gy * gy, 2), boxed(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[:, m : h - m, m : w - m]
        peak = np.ones(inner.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner >= r[:, m + dy : h - m + dy, m + dx : w - m + dx]
        strength = np.where(peak & (inner > 1e-3), inner, -1).reshape(n, -1)
        k = min(CORNERS, strength.shape[1])
        at = np.argsort(-strength, axis=1, kind="stable")[:, :k]
        good = np.take_along_axis(strength, at, 1) > 0
        img = np.repeat(np.arange(n), k).reshape(n, k)[good]
        ys, xs = (v[good] + m for v in np.divmod(at, w - 2 * m))
        if not len(img):
            continue
        g = np.arange(-MOMENT, MOMENT + 1)
        disc = (g[:, None] ** 2 + g[None, :] ** 2 <= MOMENT**2).astype(float)
        patch = x[img[:, None, None], ys[:, None, None] + g[None, :, None], xs[:, None, None] + g[None, None, :]] * disc
        angle = np.arctan2((patch * g[None, :, None]).sum((1, 2)), (patch * g[None, None, :]).sum((1, 2)))
        smooth = boxed(x, 2)
        turn = np.rint(angle / (2 * np.pi) * STEPS).astype(int) % STEPS
        t = _turned[turn]
        one = smooth[img[:, None], ys[:, None] + t[:, :, 0, 1], xs[:, None] + t[:, :, 0, 0]]
        two = smooth[img[:, None], ys[:, None] + t[:, :, 1, 1], xs[:, None] + t[:, :, 1, 0]]
        code = np.packbits(one > two, axis=1).view(">u4").astype(np.int64)
        unit = min(1.0, SIDE / max(stack.shape[1:])) / scale
        out.append((img, np.full(len(img), s), turn, np.rint(xs * unit).astype(np.int64), np.rint(ys * unit).astype(np.int64), code))
    if not out:
        return [np.zeros(0, np.int64)] * 5 + [np.zeros((0, BANDS), np.int64)]
    return [np.concatenate(v) for v in zip(*out)]


#: A corner in a blob: its place (scale, direction, x, y: 2, 6, 12 and 12 bits) and the descriptor as four 32-bit words.
CORNER = np.dtype([("place", "<u4"), ("code", "<u4", (BANDS,))])
KNOWN = "id long, sha string, corners binary"
WORD = "word long, image long, rest long, last int"


def corners(images: DataFrame) -> DataFrame:
    """(id, sha, corners) of (id, data, sha) rows: each image's corners as one blob, null where there is none.  Copies in a slice are described once."""
    kinds = arrow_schema(KNOWN)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                shas, by, blobs = part.column(2).to_pylist(), {}, {}
                for sha, data in zip(shas, part.column(1).to_pylist()):
                    if sha not in blobs:
                        blobs[sha] = None
                        if (x := raster(data)) is not None:
                            by.setdefault(x.shape, []).append((sha, x))
                for got in by.values():
                    img, scale, turn, x, y, code = described(np.stack([p for _, p in got]))
                    order = np.argsort(img, kind="stable")
                    rows = np.empty(len(img), CORNER)
                    rows["place"], rows["code"] = scale << 30 | turn << 24 | x << 12 | y, code
                    ends = np.cumsum(np.bincount(img, minlength=len(got)))
                    for (sha, _), own in zip(got, np.split(rows[order], ends[:-1])):
                        blobs[sha] = own.tobytes() or None
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([blobs[s] for s in shas], pa.binary())], schema=kinds)

    return images.select("id", "data", "sha").mapInArrow(run, KNOWN)


def table_words(found: DataFrame) -> DataFrame:
    """A row for each corner of (image, corners) and each of its table words: `word` is the word with its band; `rest` and `last` hold the other words."""
    kinds = arrow_schema(WORD)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                blobs = part.column(1).to_pylist()
                rows = np.frombuffer(b"".join(blobs), CORNER)
                image = np.repeat(part.column(0).to_numpy(), [len(b) // CORNER.itemsize for b in blobs])
                code = rows["code"].astype(np.int64)
                for band in range(BANDS):
                    a, b, c = (code[:, k] for k in range(BANDS) if k != band)
                    word = band << 32 | code[:, band]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (word, image, (a << 32) | b, c.astype(np.uint32).view(np.int32))], schema=kinds)

    return found.select("image", "corners").filter("corners is not null and image is not null").mapInArrow(run, WORD)


def candidates(words: DataFrame) -> DataFrame:
    """(a, b) of images whose corners share MEET table words, one pair of corners or several, with at most CLOSE differing bits each."""
    far = F.bit_count(F.col("a.rest").bitwiseXOR(F.col("b.rest"))) + F.bit_count(F.col("a.last").bitwiseXOR(F.col("b.last")))
    near = (F.col("a.image") < F.col("b.image")) & (far <= CLOSE)
    pairs = words.alias("a").join(words.alias("b"), (F.col("a.word") == F.col("b.word")) & near)
    return pairs.select(F.col("a.image").alias("a"), F.col("b.image").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MEET).select("a", "b")


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x + iy, scale, direction in radians) of packed places."""
    return (at >> 12 & 4095) + 1j * (at & 4095), np.array(SCALES)[at >> 30], (at >> 24 & 63) * (2 * np.pi / STEPS)


def transform(at: np.ndarray, bt: np.ndarray) -> tuple[complex, complex] | None:
    """(z, t) of b = z a + t, the similarity that CONSENSUS distinct corners agree on within OFFSET, or None."""
    (a, sa, da), (b, sb, db) = places(at), places(bt)
    step = sa / sb * np.exp(1j * (db - da))  # what each match says of turn and size
    _, kind = np.unique(step.round(6), return_inverse=True)
    for i in np.argsort(-np.bincount(kind)[kind], kind="stable").tolist():  # what most say first
        alike = np.abs(step / step[i] - 1) < 2 * AGREE
        away = np.abs(b - b[i] - step[i] * (a - a[i]))
        own = np.flatnonzero(alike & (away <= OFFSET + 0.3 * np.abs(b - b[i])))
        for _ in range(3):
            if not enough(a[own], b[own]):
                break
            x, y = a[own] - a[own].mean(), b[own] - b[own].mean()
            z = complex((x.conj() * y).sum() / (np.abs(x) ** 2).sum())
            t = complex(b[own].mean() - z * a[own].mean())
            fit = np.flatnonzero((np.abs(step / z - 1) < AGREE) & (np.abs(z * a + t - b) <= OFFSET))
            if len(fit) == len(own) and (fit == own).all():
                return z, t
            own = fit
        else:
            if enough(a[own], b[own]):
                return z, t
    return None


def enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether CONSENSUS corners are at distinct places of both images."""
    return all(len(np.unique((np.rint(x.real / 3) * 4096 + np.rint(x.imag / 3)))) >= CONSENSUS for x in (a, b))


def agreed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b) of candidate pairs of which corners agree on a transform: all corners of one with all of the other, as an image has at most CORNERS of a scale.  known: (image, corners)."""
    kinds = arrow_schema("a long, b long")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, p, q in zip(*(batch.column(k).to_pylist() for k in range(4))):
                p, q = np.frombuffer(p, CORNER), np.frombuffer(q, CORNER)
                u, v = np.nonzero(np.bitwise_count(p["code"][:, None] ^ q["code"][None]).sum(axis=2, dtype=np.int64) <= NEAR)
                if len(u) >= CONSENSUS and transform(p["place"][u].astype(np.int64), q["place"][v].astype(np.int64)) is not None:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=kinds)

    for c in ("b", "a"):
        pairs = pairs.join(known.select(F.col("image").alias(c), F.col("corners").alias(f"of_{c}")), c)
    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def copies(images: DataFrame, id_col: str = "image_id", data_col: str = "data") -> DataFrame:
    """(image_id, class_id, n_links) of every image: the least id of its copies, and to how many different images it is linked."""
    rows = images.select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).withColumn("sha", F.coalesce(F.sha2("data", 256), F.concat(F.lit("null "), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    found = written(corners(rows), "corners")
    ids = written(found.groupBy("id").agg(F.min("sha").alias("sha")), "images")
    reps = written(ids.groupBy("sha").agg(F.min("id").alias("image")), "images")
    one = written(found.groupBy("sha").agg(F.first("corners").alias("corners")).join(reps, "sha").select("image", "corners"), "different")
    edges = written(agreed(candidates(table_words(one)), one.select("image", "corners")), "copies")
    roots = components(edges)
    degree = edges.select(F.col("a").alias("image")).union(edges.select("b")).groupBy("image").agg(F.count(F.lit(1)).alias("links"))
    of = reps.join(roots, reps["image"] == roots["node"], "left").join(degree, "image", "left").select("sha", F.coalesce("root", "image").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return ids.join(of, "sha").select(F.col("id").alias(id_col), "class_id", "n_links")


def edited(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A crop of an image that is brighter, has a line drawn over, and is turned by quarters as often as not."""
    side = len(x)
    cut = rng.integers(0, 9, 2)
    y = np.clip(x[cut[0] : side - 8 + cut[0], cut[1] : side - 8 + cut[1]] * 1.05 + 8, 0, 255)
    y[3] = 255
    return np.rot90(y, int(rng.integers(0, 4)) if rng.integers(0, 2) else 0)


def texture(rng: np.random.Generator, side: int, cell: int) -> np.ndarray:
    return boxed(np.kron(rng.integers(20, 220, (side // cell, side // cell)), np.ones((cell, cell)))[None], 1)[0] / 9


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 64, cell: int = 4) -> DataFrame:
    """Two images for each vector, as stand-ins for a media column: a texture seeded by the vector (image 2 id) and an edited crop of it (image 2 id + 1); a null id gives null ids."""
    schema = "image_id long, data binary"
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            ids, datas = [], []
            for key, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = np.random.Generator(np.random.PCG64(seed & (2**63 - 1)))
                x = texture(rng, side, cell)
                ids += [None, None] if key is None else [2 * key, 2 * key + 1]
                datas += [pgm(np.rint(x)), pgm(np.rint(edited(x, rng)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(datas, pa.binary())], schema=kinds)

    return vectors.select(id_col, F.xxhash64(vector_col).alias("seed")).mapInArrow(run, schema)
