"""Copies of images, cropped, turned, scaled or edited otherwise, by local descriptors.

Corners are the strongest maxima of a Harris response in each cell of CELL pixels a side, at each level of a pyramid that
goes on (by STEP) until the picture is too small for a patch. So their number follows the picture's area, and a part of a
large picture has the corners that it has in the whole. Around each, the direction from the corner to its patch's centre
of brightness gives an orientation, and 128 tests, each whether one point of the turned patch is darker than another,
give a binary descriptor. The tests compare points across that direction, for along it brightness grows anyway.

Descriptors meet in Hamming tables: TABLES tables have 16 bits each for their key, so that descriptors which differ in
few bits share a key in some table. One corner's 16 bits say little; a key joins those of a corner and of one of its
NEIGHBOURS nearest corners, with their distance, the direction of one from the other and the difference of orientations
in coarse steps, all of which survive turns and shifts. Images with a key in common are a group, and its smallest image
is its pivot; groups with one pivot are merged. In a merged group all pairs that have a key in common are checked, in
blocks, whatever their number (``groups``). The check takes whole descriptors: each one's nearest is matched, each match
proposes a shift, turn and scale, and the pair is a copy if at least INLIERS places agree with one proposal. Components
of those pairs are groups of copies.

Copies without a key in common are missed; the tests measure the share against the check of all pairs. Images with equal
bytes are one from the start (a digest and the smallest id, pre-aggregated), so exact copies in any number cost one
image. Media are binary PGM (P5) images of any size with up to 256 levels; large ones are looked at in tiles. Null, empty
or undecodable media have no corners and are a group of their own, together with media of the same bytes (null media:
alone). Rows that share an id are one node (with the smallest group of its media); a null id stays out. An empty table
gives an empty result. Extra columns are not returned, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import components, discard, fmix, parts_for, settle, trim_memory, tuned
from granary.llm.groups import linked_in_groups

STEP, CELL, RADIUS = 0.87, 16, 11
TABLES, BITS, NEIGHBOURS = 8, 128, 3
NEAR, INLIERS, FEW = 36, 5, 8
#: Response of the weakest corner; pixels a side of a tile (a multiple of CELL); steps of directions.
WEAKEST, TILE, TURNS = 1.0, 1024, 8
MARGIN = RADIUS + 2
_HEAD = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The pixels of a binary PGM image as bytes, or None."""
    m = _HEAD.match(data or b"")
    if not m:
        return None
    w, h, top = map(int, m.groups())
    if not (w > 0 and h > 0 and 0 < top < 256) or len(data) < m.end() + w * h:
        return None
    return np.frombuffer(data, np.uint8, w * h, m.end()).reshape(h, w)


def write_pgm(pixels: np.ndarray) -> bytes:
    p = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (p.shape[1], p.shape[0]) + p.tobytes()


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, in bands of rows."""
    h, w = (max(1, int(x * scale)) for x in image.shape)
    x = np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, image.shape[1] - 1)
    x0 = x.astype(int)
    x1, fx = np.minimum(x0 + 1, image.shape[1] - 1), (x - x0).astype(np.float32)[None]
    out = np.empty((h, w), np.uint8)
    for at in range(0, h, TILE):
        y = np.clip((np.arange(at, min(h, at + TILE)) + 0.5) / scale - 0.5, 0, image.shape[0] - 1)
        y0 = y.astype(int)
        fy = (y - y0).astype(np.float32)[:, None]
        rows = image[y0] * (1 - fy) + image[np.minimum(y0 + 1, image.shape[0] - 1)] * fy
        out[at : at + TILE] = np.rint(rows[:, x0] * (1 - fx) + rows[:, x1] * fx)
    return out


def smooth(a: np.ndarray) -> np.ndarray:
    """Mean over squares of 3, edges repeated."""
    p = np.pad(a, 1, mode="edge").astype(np.float32)
    p = p[:-2] + p[1:-1] + p[2:]
    return (p[:, :-2] + p[:, 1:-1] + p[:, 2:]) / 9


@functools.cache
def _tests() -> np.ndarray:
    """Pairs of points of the patch, (BITS, 2, 2): at much the same place along the orientation, apart across it."""
    rng, out = np.random.default_rng(11), []
    while len(out) < BITS:
        x, y, z = rng.uniform(1 - RADIUS, RADIUS - 1, 3)
        other = x + rng.uniform(-1.5, 1.5)
        if abs(y - z) >= 2.5 and max(np.hypot(x, y), np.hypot(other, z)) <= RADIUS - 0.5:
            out.append(((x, y), (other, z)))
    return np.array(out)


@functools.cache
def _disc() -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    keep = x**2 + y**2 <= RADIUS**2
    return y[keep], x[keep]


@functools.cache
def _shuffled() -> np.ndarray:
    """The order in which bits go into tables."""
    return np.random.default_rng(5).permutation(BITS)


def _tile(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, angle and descriptor of the corners of a tile, MARGIN pixels and more from its edges; x and y from there."""
    s = smooth(a)
    gy, gx = np.gradient(s)
    xx, yy, xy = smooth(gx * gx), smooth(gy * gy), smooth(gx * gy)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    m, (h, w) = MARGIN, a.shape
    inner = r[m : h - m, m : w - m]
    high = functools.reduce(np.maximum, (r[m + i : h - m + i, m + j : w - m + j] for i in (-1, 0, 1) for j in (-1, 0, 1)))
    at = np.flatnonzero((inner >= high) & (inner > WEAKEST))
    y, x = at // inner.shape[1], at % inner.shape[1]
    cell = (y // CELL) * (1 + inner.shape[1] // CELL) + x // CELL
    order = np.lexsort((at, -inner.ravel()[at], cell))
    order = order[np.concatenate([[True], cell[order][1:] != cell[order][:-1]])] if len(at) else order
    y, x = y[order], x[order]
    dy, dx = _disc()
    patch = s[y[:, None] + m + dy, x[:, None] + m + dx]
    angle = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
    c, n, t = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None], _tests()
    px = np.rint(x[:, None, None] + m + c * t[None, :, :, 0] - n * t[None, :, :, 1]).astype(int)
    py = np.rint(y[:, None, None] + m + n * t[None, :, :, 0] + c * t[None, :, :, 1]).astype(int)
    v = s[py, px]
    return x, y, angle, np.packbits(v[:, :, 0] < v[:, :, 1], axis=1)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (n, 4): x, y in the image's pixels, scale, angle; and their descriptors (n, BITS / 8) of bytes."""
    places, bits = [], []
    scale, a = 1.0, image
    while min(a.shape) >= 2 * MARGIN + 1:
        h, w = a.shape[0] - 2 * MARGIN, a.shape[1] - 2 * MARGIN
        for y0 in range(0, h, TILE):
            for x0 in range(0, w, TILE):
                # maxima at the tile's edge need a pixel more to compare with
                lo_y, lo_x = max(0, y0 - CELL), max(0, x0 - CELL)
                x, y, angle, found = _tile(a[lo_y : min(h, y0 + TILE + CELL) + 2 * MARGIN, lo_x : min(w, x0 + TILE + CELL) + 2 * MARGIN])
                x, y = x + lo_x, y + lo_y
                own = (y0 <= y) & (y < y0 + TILE) & (x0 <= x) & (x < x0 + TILE)
                places.append(np.stack([(x[own] + MARGIN + 0.5) / scale, (y[own] + MARGIN + 0.5) / scale, np.full(own.sum(), scale), angle[own]], axis=1))
                bits.append(found[own])
        scale, a = scale * STEP, resized(a, STEP)
    if not bits:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(places).astype(np.float32), np.concatenate(bits)


def _neighbours(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corner, neighbour) for the NEIGHBOURS nearest of each, among those at most two cells away."""
    cx, cy = (x // CELL).astype(int), (y // CELL).astype(int)
    grid = np.full((cy.max() + 5, cx.max() + 5), -1)
    grid[cy + 2, cx + 2] = np.arange(len(x))
    near = np.stack([grid[cy + 2 + i, cx + 2 + j] for i in range(-2, 3) for j in range(-2, 3) if i or j], axis=1)
    far = np.where(near >= 0, (x[near] - x[:, None]) ** 2 + (y[near] - y[:, None]) ** 2, np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, :NEIGHBOURS]
    rows = np.arange(len(x))[:, None]
    ok = near[rows, order] >= 0
    return np.broadcast_to(rows, order.shape)[ok], near[rows, order][ok]


def table_keys(places: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The distinct keys of an image in the Hamming tables: 16 bits of a corner, 16 of its neighbour, how they lie to each
    other, and the table."""
    if not len(bits):
        return np.zeros(0, np.uint64)
    part = np.ascontiguousarray(np.packbits(np.unpackbits(bits, axis=1)[:, _shuffled()], axis=1)).view(np.uint16).astype(np.uint64)
    level = np.unique(places[:, 2], return_inverse=True)[1].ravel()
    x, y = (np.rint(places[:, c] * places[:, 2] - 0.5 - MARGIN) for c in (0, 1))
    # levels stand below each other, out of each other's reach
    height = np.zeros(level.max() + 1)
    np.maximum.at(height, level, y // CELL + 4)
    i, j = _neighbours(x, y + (np.cumsum(height) - height)[level] * CELL)
    angle, turn = places[:, 3], 2 * np.pi / TURNS
    far = np.minimum(15, np.log2(np.maximum(np.hypot(x[j] - x[i], y[j] - y[i]), 1)).astype(int))

    def lie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        between = ((angle[a] - angle[b]) % (2 * np.pi) // turn).astype(int) % TURNS
        towards = ((np.arctan2(y[b] - y[a], x[b] - x[a]) - angle[a]) % (2 * np.pi) // turn).astype(int) % TURNS
        return ((between * TURNS + towards) * 16 + far).astype(np.uint64)

    there, back = lie(i, j)[:, None], lie(j, i)[:, None]
    # the corner with the lesser bits comes first, so it doesn't matter which of the two is near to which
    a, b = part[i], part[j]
    key = np.minimum(a, b) | np.maximum(a, b) << np.uint64(16) | np.where(a <= b, there, back) << np.uint64(32) | np.arange(TABLES, dtype=np.uint64) << np.uint64(44)
    return np.unique(key)


def consensus(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray, slack: float = 3.0) -> int:
    """The most places whose matches agree with the shift, turn and scale of one of them."""
    if not len(da) or not len(db):
        return 0
    x, y = np.unpackbits(da, axis=1).astype(np.float32), np.unpackbits(db, axis=1).astype(np.float32)
    far = x.sum(1)[:, None] + y.sum(1)[None] - 2 * x @ y.T
    i = np.arange(len(da))
    j = far.argmin(1)
    ok = far[i, j] <= NEAR
    i, j = i[ok], j[ok]
    if len(i) < INLIERS:
        return 0
    a, b = pa_[i], pb[j]
    ratio, turn = a[:, 2] / b[:, 2], b[:, 3] - a[:, 3]
    c, s = ratio * np.cos(turn), ratio * np.sin(turn)
    tx, ty = b[:, 0] - (c * a[:, 0] - s * a[:, 1]), b[:, 1] - (s * a[:, 0] + c * a[:, 1])
    # matches at one place count once
    spots = np.unique(np.rint(a[:, :2] / 2), axis=0, return_inverse=True)[1].ravel()
    most = 0
    for at in range(0, len(i), 512):
        k = slice(at, at + 512)
        ex = c[k, None] * a[None, :, 0] - s[k, None] * a[None, :, 1] + tx[k, None] - b[None, :, 0]
        ey = s[k, None] * a[None, :, 0] + c[k, None] * a[None, :, 1] + ty[k, None] - b[None, :, 1]
        good = ex**2 + ey**2 <= slack**2
        for g in good[good.sum(1) >= max(INLIERS, most)]:
            most = max(most, len(np.unique(spots[g])))
    return most


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, known = [], {}
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            digest = f"null-{i}" if data is None else hashlib.sha256(data).hexdigest()
            if digest not in known:  # equal bytes in a batch are looked at once
                image = read_pgm(data)
                p, d = describe(image) if image is not None else (np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8))
                known[digest] = (len(p), p.tobytes(), d.tobytes())
            rows.append((i, digest, *known[digest]))
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "digest", "n_corners", "places", "bits"])


def _features(places: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, np.float32).reshape(-1, 4), np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)


_KEYED = "part int, keys binary, owner binary, ids binary"


def _keyed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The keys of a batch of images, dealt out by key: 32 bits of each, for the part holds others, and two bytes for the
    image. A key that only seems to be shared makes a pair more to look at, no copy."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        each = [table_keys(*_features(p, b)) for p, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        key, owner = np.concatenate([np.zeros(0, np.uint64), *each]), np.repeat(np.arange(len(ids), dtype=np.uint16), [len(x) for x in each])
        with np.errstate(over="ignore"):
            key = fmix(key)
        part = (key >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        key = key.astype(np.uint32)
        rows = [(int(part[x[0]]), key[x].tobytes(), owner[x].tobytes(), ids.tobytes()) for x in np.split(order, cuts) if len(x)]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "keys", "owner", "ids"])


_PAIRS = "part int, pairs binary"


def _pivots(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(pivot, image) of the images with a key in common, as arrays dealt out by pivot: two copies share many keys, and
    so meet in many parts."""
    keys, ids = [], []
    for batch in batches:
        for _, k, o, i in zip(*(c.to_pylist() for c in batch.columns)):
            keys.append(np.frombuffer(k, np.uint32))
            ids.append(np.frombuffer(i, np.int64)[np.frombuffer(o, np.uint16)])
    if not keys:
        return
    # several parts may be in one partition
    key, image = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((image, key))
    key, image = key[order], image[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(first, len(key)))
    pivot, many = np.repeat(image[first], sizes), np.repeat(sizes > 1, sizes)
    rows = np.unique(np.stack([pivot[many], image[many]]), axis=1)
    with np.errstate(over="ignore"):
        part = (fmix(rows[0].view(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    each = [x for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)]
    trim_memory()
    yield pa.RecordBatch.from_arrays([pa.array([int(part[x[0]]) for x in each], pa.int32()), pa.array([np.ascontiguousarray(rows[:, x]).tobytes() for x in each], pa.binary())], names=["part", "pairs"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (pivot, image) of a partition's arrays."""
    found = [np.frombuffer(x, np.int64).reshape(2, -1) for batch in batches for x in batch.column(1).to_pylist()]
    if found:
        rows = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0].copy()), pa.array(rows[1].copy())], names=["cluster", "doc_id"])


def _copies(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which images are copies, of all pairs with a key in common (in groups of FEW images, of all pairs); pairs
    that others connect are left out."""
    ids = table.column("doc_id").to_numpy()
    features = [_features(p, b) for p, b in zip(table.column("places").to_pylist(), table.column("bits").to_pylist())]
    common = np.ones((len(ids), len(ids)), np.float32)
    if len(ids) > FEW:
        common = _keys_in_common([table_keys(*f) for f in features])
    i, j = np.nonzero(np.triu(common, 1))
    order = np.argsort(-common[i, j], kind="stable")
    root, linked = np.arange(len(ids)), np.zeros((len(ids), len(ids)), bool)
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if root[a] != root[b] and consensus(*features[a], *features[b]) >= INLIERS:
            linked[a, b] = linked[b, a] = True
            root[root == root[b]] = root[a]
    return ids, linked


def _keys_in_common(each: list[np.ndarray]) -> np.ndarray:
    key, owner = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
    col, n = np.unique(key, return_inverse=True, return_counts=True)[1:]
    shared = n[col] > 1
    col, owner = np.unique(col[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    common = np.zeros((len(each), len(each)), np.float32)
    for c in range(0, int(col.max()) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(each), 4096), np.float32)
        m[owner[a:b], col[a:b] - c] = 1
        common += m @ m.T
    return common


def copy_groups(df: DataFrame, id_col: str = "media_id", media: str = "media") -> DataFrame:
    """media_id, n_corners, group_id (smallest id of the copies, itself included), one row per distinct id."""
    tuned(df.sparkSession)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(media).alias("media")).filter("id is not null")
    all_ = settle(slim.mapInArrow(_described, "id long, digest string, n_corners int, places binary, bits binary"))
    least = all_.groupBy("digest").agg(F.min("id").alias("rep"), F.max("n_corners").alias("n_corners"))
    told = settle(all_.select("id", "digest").join(least, "digest").groupBy("id").agg(F.min_by("rep", F.struct("rep", "n_corners")).alias("rep"), F.min_by("n_corners", F.struct("rep", "n_corners")).alias("n_corners")))
    described = all_.join(told.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    described = settle(described.filter("n_corners > 0").select(F.col("id").alias("doc_id"), "places", "bits"))
    discard(all_)
    parts = parts_for(described, 8 << 20)
    keyed = described.mapInArrow(functools.partial(_keyed, parts=parts), _KEYED).repartition(parts, "part")
    pairs = keyed.mapInArrow(functools.partial(_pivots, parts=parts), _PAIRS).repartition(parts, "part")
    members = settle(pairs.mapInArrow(_distinct, "cluster long, doc_id long"))
    roots = components(linked_in_groups(members, described, _copies, parts)).toDF("rep", "root")
    return told.join(roots, "rep", "left").select(F.col("id").alias("media_id"), "n_corners", F.coalesce("root", "rep").alias("group_id"))


def drawn(vector: list[float], side: int = 80) -> np.ndarray:
    """A picture that a vector stands for: a texture and translucent rectangles and discs, placed by its numbers."""
    v = np.asarray(vector, np.float32)
    rng = np.random.default_rng(zlib.crc32(v.tobytes()))
    a = np.full((side, side), 90.0, np.float32)
    for n in (5, 9, 17, 33):
        noise = rng.normal(0, 30, (n, n)).astype(np.float32)
        at = np.linspace(0, n - 1.001, side)
        i, f = at.astype(int), (at % 1).astype(np.float32)
        rows = noise[i] * (1 - f)[:, None] + noise[i + 1] * f[:, None]
        a += rows[:, i] * (1 - f) + rows[:, i + 1] * f
    y, x = np.mgrid[:side, :side]
    for _ in range(14):
        cy, cx, h, w = rng.uniform(2, side - 2, 2).tolist() + rng.uniform(3, side / 6, 2).tolist()
        shape = (np.abs(y - cy) < h) & (np.abs(x - cx) < w) if rng.random() < 0.7 else (y - cy) ** 2 + (x - cx) ** 2 < h * w / 2
        a[shape] = a[shape] / 2 + rng.uniform(0, 128)
    return np.clip(smooth(a), 0, 255)


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre, bilinear, edges repeated."""
    t, (h, w) = np.deg2rad(degrees), image.shape
    y, x = np.mgrid[:h, :w] - np.array([h - 1, w - 1]).reshape(2, 1, 1) / 2
    sx = np.clip(np.cos(t) * x + np.sin(t) * y + (w - 1) / 2, 0, w - 1.001)
    sy = np.clip(np.cos(t) * y - np.sin(t) * x + (h - 1) / 2, 0, h - 1.001)
    x0, y0 = sx.astype(int), sy.astype(int)
    fx, fy = sx - x0, sy - y0
    return (image[y0, x0] * (1 - fx) + image[y0, x0 + 1] * fx) * (1 - fy) + (image[y0 + 1, x0] * (1 - fx) + image[y0 + 1, x0 + 1] * fx) * fy


EDITS = ("crop", "small crop", "brightness", "noise", "quarter turn", "turn", "scale")


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """A copy, edited as EDITS says."""
    side = image.shape[0]
    if kind == 0:
        return image[side // 5 :, side // 6 :]
    if kind == 1:
        return image[: side * 3 // 4, : side * 3 // 4]
    if kind == 2:
        return image * 0.7 + 30
    if kind == 3:
        return image + np.random.default_rng(int(image.sum()) & 0xFFFF).normal(0, 4, image.shape)
    if kind == 4:
        return np.rot90(image)
    if kind == 5:
        return turned(image, 20)
    return resized(np.rint(image), 0.75)


def drawn_media(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The media table: each vector's picture (media_id twice the id) and an edited copy of it (one more)."""
    tuned(embeddings.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None:
                    continue
                image = drawn(v or [])
                ids += [2 * i, 2 * i + 1]
                media += [write_pgm(image), write_pgm(edited(image, i % len(EDITS)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["media_id", "media"])

    return embeddings.select(F.col(id_col).cast("long"), F.col(vector)).mapInArrow(work, "media_id long, media binary")
