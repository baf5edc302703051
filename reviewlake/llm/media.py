"""Copies of images by local descriptors: multiscale corners, orientation-
normalised binary tests, Hamming-table joins and geometric consensus.

Images with the same pixels are one class first.  In each class's grey image,
corners (Harris) are found on three scales; each has an orientation from its
patch's intensity centroid and a descriptor of 256 comparisons of smoothed pixels
at positions turned by that orientation.  Corners that share a key and differ in
few enough bits vote for a similarity transform (turn, scale and shift); a pair
of classes is linked if enough corners agree on one.  Links make components.

The eight 32-bit halves of a descriptor are its keys in eight tables.  Two
descriptors within 7 differing bits share at least one key, those further apart
often do; a pair of classes needs only AGREE near corners that share a key and
agree on a transform, then all corners of the two are compared.  So a copy with
twenty corners in common is found even if each is as likely lost as not.

Near corners also have to agree in what is around them, as far as both images show
it: unlike images share small patches by chance far more often than their
surroundings, and so such pairs are not made at all.  The comparison of all corners
doesn't ask for that.

Members of a bucket are compared with each other if it is small.  In large ones,
dense groups of copies are joined first with a pair a member: in each bucket the
members near one of its classes (a star) are paired with it, in a few rounds with
other centres.  That only saves work: afterwards members of a bucket of which the
components differ are all compared.  In a large bucket those outside its largest
component are dealt over blocks for that, each of which meets all members.
Of the class pairs that come of it, one a component is compared whole first, and then
all whose components still differ.
Unlike images seldom share two such corners, so few pairs read corners at all.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, stored, union
from .components import components

SCALES = (1.0, 0.7071, 0.5)
RADIUS = 7
TURNS = 32
#: Corners match up to so many differing bits; buckets above LARGE are dealt over blocks.
MOST_BITS, LARGE = 36, 64
#: Words after the descriptor: half are tests around its patch, within about REACH pixels, half tell which of
#: them count.  Of those that count in both of two corners this share, and two more, may differ.
AROUND, REACH, MOST_AROUND = 4, 16, 0.3
#: Class pairs of which so many near corners that share a key agree on a transform are compared whole.
AGREE = 2
#: A link needs this share of the places of the image that has fewer, and bins of a shift are so many pixels wide.
SHARE, BIN = 0.1, 12
WORDS = 4
#: Tables, and how many of them one shuffle holds.
TABLES, AT_ONCE = 2 * WORDS, 2
#: Columns of a corner in a bucket: key, class, number, descriptor, geometry.
MEMBER = ("k", "c", "n", "words", "g")
#: Each square of CELL pixels of a scale keeps its strongest corners.
CELL = 64
PNG = b"\x89PNG\r\n\x1a\n"


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a PNG (8 bits a sample, not interlaced) or of a binary PGM
    or PPM; None for anything else and for broken files."""
    try:
        if not data:
            return None
        if data[:8] == PNG:
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            kind, width, height, most = data.split(maxsplit=4)[:4]
            planes = 3 if kind == b"P6" else 1
            size = int(width) * int(height) * planes
            if int(most) > 255 or len(data) < size:
                return None
            return _grey(np.frombuffer(data[-size:], np.uint8).reshape(int(height), int(width), planes))
    except (ValueError, struct.error, zlib.error, IndexError, KeyError):
        return None
    return None


def _grey(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x[..., 0] if x.shape[2] < 3 else x[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)


def _png(data: bytes) -> np.ndarray | None:
    at, body, palette = 8, b"", None
    width = height = planes = 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if depth != 8 or interlace:
                return None
            planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * planes)
    out = np.zeros((height, width * planes), np.uint8)
    above = np.zeros(width * planes, np.uint8)
    for y in range(height):
        line, filt = raw[y, 1:], raw[y, 0]
        if filt == 1:
            above_y = line.reshape(-1, planes).cumsum(axis=0, dtype=np.uint8).ravel()
        elif filt == 2:
            above_y = line + above
        elif filt in (3, 4):
            above_y = line.copy()
            for x in range(len(line)):
                left = int(above_y[x - planes]) if x >= planes else 0
                up, corner = int(above[x]), int(above[x - planes]) if x >= planes else 0
                near = (left + up) // 2 if filt == 3 else min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
                above_y[x] = (int(line[x]) + near) & 255
        else:
            above_y = line
        out[y] = above = above_y
    pixels = out.reshape(height, width, planes)
    return _grey(palette[pixels[..., 0]] if palette is not None else pixels)


def encode_png(grey: np.ndarray) -> bytes:
    """A grey 8-bit PNG."""
    height, width = grey.shape
    raw = np.zeros((height, width + 1), np.uint8)
    raw[:, 1:] = grey

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 1)) + part(b"IEND", b"")


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r+1)-wide squares of the last two axes, edges repeated."""
    for axis in (-1, -2):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        hi, lo = [slice(None)] * x.ndim, [slice(None)] * x.ndim
        hi[axis], lo[axis] = slice(2 * r + 1, None), slice(None, -2 * r - 1)
        x = (s[tuple(hi)] - s[tuple(lo)]) / (2 * r + 1)
    return x


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, of (image, height, width)."""
    if scale == 1:
        return x
    h, w = (max(1, int(round(n * scale))) for n in x.shape[1:])
    smooth = _box(x, 1)
    ys, xs = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(ys.astype(int), 0, x.shape[1] - 1), np.clip(xs.astype(int), 0, x.shape[2] - 1)
    y1, x1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(x0 + 1, x.shape[2] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None].astype(np.float32), np.clip(xs - x0, 0, 1).astype(np.float32)
    top = smooth[:, y0][:, :, x0] * (1 - fx) + smooth[:, y0][:, :, x1] * fx
    low = smooth[:, y1][:, :, x0] * (1 - fx) + smooth[:, y1][:, :, x1] * fx
    return top * (1 - fy) + low * fy


def _tests() -> np.ndarray:
    """Offsets (turn, test, end, xy) of the binary tests, from a fixed draw."""
    rng = np.random.default_rng(256)
    ends = np.clip(rng.normal(0, RADIUS / 2, (256, 2, 2)), -RADIUS + 1, RADIUS - 1)
    turn = np.arange(TURNS) * 2 * np.pi / TURNS
    c, s = np.cos(turn), np.sin(turn)
    x = ends[None, ..., 0] * c[:, None, None] - ends[None, ..., 1] * s[:, None, None]
    y = ends[None, ..., 0] * s[:, None, None] + ends[None, ..., 1] * c[:, None, None]
    return np.clip(np.rint(np.stack([x, y], axis=-1)), -RADIUS, RADIUS).astype(np.int64)


def _around() -> np.ndarray:
    """Offsets (turn, test, end, xy) of the tests around a patch, from a fixed draw."""
    rng, n = np.random.default_rng(64), 32 * AROUND
    r, angle = rng.uniform(RADIUS + 1, REACH - 2, n), rng.uniform(0, 2 * np.pi, n)
    first = np.stack([r * np.cos(angle), r * np.sin(angle)], axis=-1)
    way, far = rng.uniform(0, 2 * np.pi, n), rng.uniform(5, 9, n)
    second = first + np.stack([far * np.cos(way), far * np.sin(way)], axis=-1)
    ends = np.stack([first, second], axis=1)
    turn = np.arange(TURNS) * 2 * np.pi / TURNS
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    return np.rint(np.stack([ends[None, ..., 0] * c - ends[None, ..., 1] * s, ends[None, ..., 0] * s + ends[None, ..., 1] * c], axis=-1)).astype(np.int64)


_TESTS, _AROUND = _tests(), _around()


def _context(smooth: np.ndarray, owner: np.ndarray, yy: np.ndarray, xx: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """AROUND words a corner: tests around its patch, then which of them count: those
    with both ends in the image and a contrast that noise doesn't turn."""
    place = _AROUND[turn]
    y, x = yy[:, None, None] + place[..., 1], xx[:, None, None] + place[..., 0]
    inside = ((y >= 0) & (y < smooth.shape[1]) & (x >= 0) & (x < smooth.shape[2])).all(axis=-1)
    seen = smooth[owner[:, None, None], np.clip(y, 0, smooth.shape[1] - 1), np.clip(x, 0, smooth.shape[2] - 1)]
    more = seen[..., 1] - seen[..., 0]
    bits = np.stack([more > 0, inside & (np.abs(more) >= 6)], axis=1)
    return np.packbits(bits, axis=2, bitorder="little").view("<i8").reshape(len(owner), AROUND)


def corners(images: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Up to `most` corners in each cell of each scale of each of (image, height,
    width), so that their number grows with the image: image number, x, y (of
    the full image), turn, scale number, the words of the descriptor and those of what is around."""
    found: list[list[np.ndarray]] = []
    for k, scale in enumerate(SCALES):
        x = _resized(images, scale)
        if min(x.shape[1:]) < 2 * RADIUS + 3:
            continue
        gx, gy = np.zeros_like(x), np.zeros_like(x)
        gx[:, :, 1:-1], gy[:, 1:-1] = x[:, :, 2:] - x[:, :, :-2], x[:, 2:] - x[:, :-2]
        a, b, c = _box(gx * gx, 1), _box(gy * gy, 1), _box(gx * gy, 1)
        score = a * b - c * c - 0.05 * (a + b) ** 2
        inner = np.zeros_like(score)
        m = RADIUS + 1
        inner[:, m:-m, m:-m] = score[:, m:-m, m:-m]
        top = inner.copy()
        for axis in (1, 2):
            for way in (-1, 1):
                top = np.maximum(top, np.roll(top, way, axis=axis))
        # A corner also stands out from the flat noise of its image.
        inner[(inner < top) | (inner < 0.01 * inner.max(axis=(1, 2), keepdims=True)) | (inner < 1e3)] = 0
        owner, yy, xx = np.nonzero(inner > 0)
        cell = (owner * (x.shape[1] // CELL + 1) + yy // CELL) * (x.shape[2] // CELL + 1) + xx // CELL
        order = np.lexsort((-inner[owner, yy, xx], cell))
        cell = cell[order]
        kept = order[np.arange(len(cell)) - np.searchsorted(cell, cell) < most]
        owner, yy, xx = owner[kept], yy[kept], xx[kept]
        if not len(owner):
            continue
        r = np.arange(-RADIUS, RADIUS + 1)
        disc = (r[:, None] ** 2 + r**2 <= RADIUS**2).astype(np.float32)
        patch = x[owner[:, None, None], yy[:, None, None] + r[:, None], xx[:, None, None] + r] * disc
        angle = np.arctan2((patch * r[:, None]).sum(axis=(1, 2)), (patch * r).sum(axis=(1, 2)))
        turn = np.rint(angle * TURNS / 2 / np.pi).astype(np.int64) % TURNS
        smooth = _box(x, 1)
        place = _TESTS[turn]
        seen = smooth[owner[:, None, None], yy[:, None, None] + place[..., 1], xx[:, None, None] + place[..., 0]]
        bits = seen[..., 0] < seen[..., 1]
        words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
        around = _context(_box(x, 2), owner, yy, xx, turn)
        found.append([owner, (xx + 0.5) / scale, (yy + 0.5) / scale, turn, np.full(len(owner), k), words, around])
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, np.zeros((0, WORDS), np.int64), np.zeros((0, AROUND), np.int64)
    return tuple(np.concatenate(parts) for parts in zip(*found))


CORNER = T.StructType([T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType()), T.StructField("turn", T.IntegerType()), T.StructField("scale", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType()))])


def _corner_lists(own: list[tuple[np.ndarray, ...] | None]) -> pa.Array:
    """An Arrow array of CORNER lists; None stays null."""
    own = [None if c is None else (*c[:4], np.concatenate(c[4:], axis=1)) for c in own]
    real = [c for c in own if c is not None]
    x, y, turn, scale, words = (np.concatenate([c[k] for c in real]) if real else np.zeros((0, WORDS + AROUND)[: 1 + (k == 4)]) for k in range(5))
    offsets = np.concatenate(([0], np.cumsum([0 if c is None else len(c[0]) for c in own])))
    missing = np.array([c is None for c in own] + [False])
    word_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (WORDS + AROUND), pa.int32()), pa.array(words.astype(np.int64).ravel()))
    values = pa.StructArray.from_arrays([pa.array(x.astype(np.float32)), pa.array(y.astype(np.float32)), pa.array(turn.astype(np.int32)), pa.array(scale.astype(np.int32)), word_lists], [f.name for f in CORNER])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=missing), values)


def described(df: DataFrame, image: str, most: int) -> DataFrame:
    """Adds `corners` (array of CORNER; null where the image can't be decoded)."""

    @F.arrow_udf(T.ArrayType(CORNER))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # Columns of numbers, not objects: a batch may hold thousands of images.
            own: list[tuple[np.ndarray, ...] | None] = [None] * len(batch)
            for a in range(0, len(batch), 128):
                shapes: dict[tuple, list[tuple[int, np.ndarray]]] = {}
                for i in range(a, min(a + 128, len(batch))):
                    grey = decode(batch[i].as_py())
                    if grey is not None:
                        shapes.setdefault(grey.shape, []).append((i, grey))
                for group in shapes.values():
                    owner, *columns = corners(np.stack([g for _, g in group]), most)
                    order = np.argsort(owner, kind="stable")
                    ends = np.searchsorted(owner[order], np.arange(len(group) + 1))
                    for k, (i, _) in enumerate(group):
                        at = order[ends[k] : ends[k + 1]]
                        own[i] = tuple(c[at] for c in columns)
            yield _corner_lists(own)

    return df.withColumn("corners", find(F.col(image)))


def _distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(WORDS)), F.lit(0))


def _meet(a: Column, b: Column) -> Column:
    """Whether two descriptors are near and what is around them doesn't say otherwise."""
    # Corners without the words of what is around them have nothing that counts.
    word = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0).cast("long"))
    counts = [word(a, i + AROUND // 2).bitwiseAND(word(b, i + AROUND // 2)) for i in range(WORDS, WORDS + AROUND // 2)]
    differ = sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i)).bitwiseAND(c)) for i, c in enumerate(counts, WORDS)), F.lit(0))
    return (_distance(a, b) <= MOST_BITS) & (differ <= sum(map(F.bit_count, counts), F.lit(0)) * MOST_AROUND + 2)


def table_keys(words: Column, tables: range = range(TABLES)) -> Column:
    """The keys of tables: the halves of the words, with their table's number above."""
    return F.array(*(F.shiftrightunsigned(words[i // 2], 32 * (i % 2)).bitwiseAND(F.lit((1 << 32) - 1)).bitwiseOR(F.lit(i << 32)) for i in tables))


def _first_table(a: Column, b: Column) -> Column:
    """Number of the first table in which two descriptors share a key."""
    out = F.lit(None).cast("long")
    for i in reversed(range(TABLES)):
        half = a[i // 2].bitwiseXOR(b[i // 2]).bitwiseAND(F.lit((1 << 32) - 1 if i % 2 == 0 else -1 << 32))
        out = F.when(half == 0, F.lit(i).cast("long")).otherwise(out)
    return out


def _packed(t: Column) -> Column:
    """x, y (quarters of a pixel), turn and scale number of a corner in one bigint."""
    at = F.floor(t["x"] * 4) * (1 << 20) + F.floor(t["y"] * 4)
    return (at * 128 + t["turn"] * 4 + t["scale"]).cast("long")


def _unpacked(g: Column) -> dict[str, Column]:
    bits = lambda low, n: F.shiftrightunsigned(g, low).bitwiseAND(F.lit((1 << n) - 1))
    return {"x": bits(27, 20) / 4, "y": bits(7, 20) / 4, "turn": bits(2, 5), "scale": bits(0, 2)}


def _transform(p: dict[str, Column], q: dict[str, Column]) -> dict[str, Column]:
    """The scale, turn and shift that take corner p to corner q."""
    turn, scale = F.pmod(q["turn"] - p["turn"], F.lit(TURNS)), q["scale"] - p["scale"]
    ratio, angle = F.pow(F.lit(2.0), scale / 2), turn * (2 * np.pi / TURNS)
    dx = q["x"] - ratio * (p["x"] * F.cos(angle) - p["y"] * F.sin(angle))
    dy = q["y"] - ratio * (p["x"] * F.sin(angle) + p["y"] * F.cos(angle))
    return {"scale": scale.cast("int"), "turn": turn.cast("int"), "dx": F.floor(dx).cast("int"), "dy": F.floor(dy).cast("int")}


def _bins(v: Column) -> Column:
    """A row for each bin of a transform.  Bins of the turn and the shift overlap
    by half, so none splits a group of votes."""
    each = [
        F.struct(
            v["scale"].alias("s"),
            F.pmod(F.floor((v["turn"] + h) / 2), F.lit(TURNS // 2)).alias("r"),
            F.floor((v["dx"] + i * BIN / 2) / BIN).alias("x"),
            F.floor((v["dy"] + j * BIN / 2) / BIN).alias("y"),
            F.lit(4 * h + 2 * i + j).alias("k"),
        )
        for h in (0, 1)
        for i in (0, 1)
        for j in (0, 1)
    ]
    return F.explode(F.array(*each))


def _meeting() -> list[Column]:
    """a, b and the transform v of a joined pair of members, sides 1 and 2."""
    p, q = (_unpacked(F.when(F.col("c1") < F.col("c2"), F.col(x)).otherwise(F.col(y))) for x, y in (("g1", "g2"), ("g2", "g1")))
    return [F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"), F.struct(*(x.alias(k) for k, x in _transform(p, q).items())).alias("v")]


def _side(df: DataFrame, i: int) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}{i}") for c in df.columns))


def shared_buckets(each: DataFrame) -> list[DataFrame]:
    """members(k, c, n, words, g, size) of the buckets, of `size` corners, that
    hold several classes, stored by groups of tables: no shuffle holds them all."""
    out = []
    for first in range(0, TABLES, AT_ONCE):
        keyed = each.select("c", "n", "words", _packed(F.col("t")).alias("g"), F.explode(table_keys(F.col("words"), range(first, first + AT_ONCE))).alias("k"))
        several = keyed.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).filter(F.col("lo") != F.col("hi")).select("k", "size")
        out.append(stored(keyed.join(several, "k").select(*MEMBER, "size")))
    return out


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "c", "left").withColumn("r", F.coalesce("root", "c")).drop("root")


def star_pairs(members: DataFrame, seed: int) -> DataFrame:
    """(a, b, v, p): members(k, c, n, words, g, r) near the centre of their bucket
    but of another component; p tells corner pairs apart.  The centre is the class
    of the least hash by `seed`, so buckets of one dense group agree on theirs."""
    h = F.xxhash64("c", F.lit(seed))
    centre = members.groupBy("k").agg(F.min(h).alias("h"), F.min("r").alias("lo"), F.max("r").alias("hi")).filter(F.col("lo") != F.col("hi")).select("k", "h")
    centres = _side(members.join(centre, "k").filter(h == F.col("h")).select(*MEMBER, "r"), 2)
    found = _side(members, 1).join(centres, (F.col("k1") == F.col("k2")) & (F.col("r1") != F.col("r2")) & _meet(F.col("words1"), F.col("words2")))
    first = F.col("c1") < F.col("c2")
    return found.select(*_meeting(), F.struct(F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("x"), F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("y")).alias("p"))


def across(members: DataFrame, large: int, hot: bool = True) -> DataFrame:
    """(a, b, v), a row for each pair of corners near each other, of different
    components r, that share a key k in members(k, c, n, words, g, size, r), given
    only by the first table in which the two meet; hot tells whether any bucket
    is larger than `large`."""
    near = _meet(F.col("words1"), F.col("words2")) & (_first_table(F.col("words1"), F.col("words2")) == F.shiftright("k1", 32))
    small = members.filter(F.col("size") <= large).select(*MEMBER, "r")
    pairs = _side(small, 1).join(_side(small, 2), (F.col("k1") == F.col("k2")) & (F.col("c1") < F.col("c2")) & (F.col("r1") != F.col("r2")) & near).select(*_meeting())
    if not hot:
        return stored(pairs)
    # Of a large bucket, the members outside its largest component are dealt over blocks; every member meets all blocks.
    mine = members.filter(F.col("size") > large)
    by = mine.groupBy("k", "r").agg(F.count(F.lit(1)).alias("m"))
    mixed = by.groupBy("k").agg(F.count(F.lit(1)).alias("_r"), F.max(F.struct("m", "r")).alias("most")).filter(F.col("_r") > 1)
    mine = stored(mine.join(mixed, "k").select(*MEMBER, "r", (F.col("r") == F.col("most.r")).alias("top"), F.ceil((F.col("size") - F.col("most.m")) / (16 * large)).cast("int").alias("parts")))
    one = mine.filter(~F.col("top")).withColumn("part", F.pmod(F.xxhash64("c", "n"), F.col("parts")).cast("int"))
    dealt = mine.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    more = _side(one, 1).join(_side(dealt, 2), (F.col("k1") == F.col("k2")) & (F.col("part1") == F.col("part2")) & (F.col("r1") != F.col("r2")) & (F.col("top2") | (F.col("r1") < F.col("r2"))) & near)
    found = stored(pairs.unionAll(more.select(*_meeting())))
    forget(mine)
    return found


def agreeing(found: DataFrame) -> DataFrame:
    """(a, b, m) of which m corner pairs of found(a, b, v), AGREE or more, agree on a
    transform.  Most class pairs that meet by chance meet once and go first."""
    several = stored(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= AGREE).select("a", "b"))
    votes = found.join(several, ["a", "b"]).select("a", "b", _bins(F.col("v")).alias("bin"))
    return votes.groupBy("a", "b", "bin").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= AGREE).groupBy("a", "b").agg(F.max("m").alias("m"))


def verified(pairs: DataFrame, each: DataFrame, least: int, share: float = SHARE) -> DataFrame:
    """The class pairs(a, b) that agree on geometry, all corners of the one
    compared with all of the other."""
    a = each.select(F.col("c").alias("a"), F.col("words").alias("aw"), F.col("t").alias("at"))
    b = each.select(F.col("c").alias("b"), F.col("words").alias("bw"), F.col("t").alias("bt"))
    near = pairs.join(a, "a").join(b, (pairs["b"] == b["b"]) & (_distance(F.col("aw"), F.col("bw")) <= MOST_BITS)).select("a", pairs["b"], "at", "bt")
    # Dealt anew, so that Spark may split the join of a class that meets many: else votes are counted where its corners are.
    both = consensus(near.repartition("a", "b"))
    places = each.select("c", _place(F.col("t")).alias("place")).distinct().groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    enough = F.greatest(F.lit(float(least)), F.least("am", "bm") * share)
    return both.filter(F.col("votes") >= least).join(places.select(F.col("c").alias("a"), F.col("m").alias("am")), "a").join(places.select(F.col("c").alias("b"), F.col("m").alias("bm")), "b").filter(F.col("votes") >= enough).select("a", "b")


def _place(t: Column) -> Column:
    return F.floor(t["x"] / 6) * 65536 + F.floor(t["y"] / 6)


def consensus(found: DataFrame) -> DataFrame:
    """(a, b, votes) of class pairs of found(a, b, at, bt), pairs of corners: at
    how many places, on both sides, they agree on one transform.  Corners that
    several scales find at one place count once."""
    at, bt = ({k: F.col(f"{side}.{k}") for k in ("x", "y", "turn", "scale")} for side in ("at", "bt"))
    v = F.struct(*(x.alias(k) for k, x in _transform(at, bt).items()))
    votes = found.select("a", "b", _place(F.col("at")).alias("an"), _place(F.col("bt")).alias("bn"), v.alias("v")).distinct().select("a", "b", "an", "bn", _bins(F.col("v")).alias("bin"))
    # A bin of one pair holds at most the places of the two images.
    counted = votes.groupBy("a", "b", "bin").agg(F.size(F.collect_set("an")).alias("m"), F.size(F.collect_set("bn")).alias("n"))
    return counted.groupBy("a", "b").agg(F.max(F.least("m", "n")).alias("votes"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots(c, root) after links(a, b) of classes have joined their components."""
    up = roots.select("c", "root")
    edges = links.join(up.withColumnsRenamed({"c": "a", "root": "ra"}), "a", "left").join(up.withColumnsRenamed({"c": "b", "root": "rb"}), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    second = cut(components(edges)).select(F.col("node").alias("c"), F.col("root").alias("top"))
    lifted = up.join(second.withColumnRenamed("c", "root"), "root", "left").select("c", F.coalesce("top", "root").alias("root"))
    return cut(lifted.unionAll(second.join(up.select("c"), "c", "left_anti").withColumnRenamed("top", "root")))


def picked(apart: DataFrame, least: int, seed: int) -> DataFrame:
    """(a, b): for each component of apart(a, b, m, ra, rb) one of its pairs.  Of those
    with `least` votes, or else with most, it is the one to the class of the least hash
    by `seed`, so that the classes of a group choose the same one."""
    ends = F.array(*(F.struct(F.col(r).alias("r"), F.col(c).alias("to")) for r, c in (("ra", "b"), ("rb", "a"))))
    each = apart.select("a", "b", "m", F.explode(ends).alias("end"))
    rank = F.struct(-F.least("m", F.lit(least)), F.xxhash64("end.to", F.lit(seed)), "a", "b")
    return each.groupBy("end.r").agg(F.min(rank).alias("one")).select("one.a", "one.b").distinct()


def merged(roots: DataFrame, pairs: DataFrame, each: DataFrame, least: int, seed: int = 0) -> DataFrame:
    """roots(c, root) after those of pairs(a, b, m) that agree on geometry have joined
    their components.  Links inside of a component change nothing, so each component
    has one pair compared first, and then all pairs between different components are."""
    for last in (False, True):
        up = roots.select("c", "root")
        named = pairs.join(up.withColumnsRenamed({"c": "a", "root": "ra"}), "a", "left").join(up.withColumnsRenamed({"c": "b", "root": "rb"}), "b", "left")
        apart = stored(named.select("a", "b", "m", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).filter(F.col("ra") != F.col("rb")))
        if apart.isEmpty():
            break
        some = apart.select("a", "b") if last else stored(picked(apart, least, seed))
        links = stored(verified(some, each, least))
        if not links.isEmpty():
            roots = joined(roots, links)
        pairs = apart.select("a", "b", "m").join(some, ["a", "b"], "left_anti")
    return roots


def class_roots(each: DataFrame, least: int, large: int = LARGE, rounds: int = 2) -> DataFrame:
    """(c, root) for the classes of each(c, n, words, t), a row a corner, that
    hang together; those without a link are left out."""
    roots = cut(each.select("c", F.col("c").alias("root")).limit(0))
    groups = shared_buckets(each)
    crowded = stored(union(groups).filter(F.col("size") > large))
    hot = not crowded.isEmpty()
    for i in range(rounds if hot else 0):
        # Components that stars have joined need no more pairs; a bucket's centre is another one in each round.
        found = stored(star_pairs(_named(crowded, roots), i))
        pairs = stored(agreeing(found.distinct().drop("p")))
        forget(found)
        if pairs.isEmpty():
            break  # what other centres might join is left to the comparison of all
        roots = merged(roots, pairs, each, least, i)
    found = []
    for m in groups:
        found.append(across(_named(m, roots), large, hot))
        forget(m)
    pairs = stored(agreeing(union(found)))
    forget(crowded, *found)
    return merged(roots, pairs, each, least)


def image_copies(df: DataFrame, image: str = "image", id_col: str = "id", most: int = 12, least: int = 5) -> DataFrame:
    """(id, class_id, n_corners, component_id) for each row of df.

    class_id is the least id with the same bytes; component_id the least id
    reachable over links, pairs of classes that share enough geometry: `least`
    places, and a tenth of those of the image that has fewer.  Each cell of CELL x CELL pixels of a scale gives its `most`
    strongest corners, so their number grows with the image.  Null,
    empty and undecodable images are classed by their bytes (null as empty) and
    have 0 corners and no link.  Repeated rows are kept; null ids count only
    where a class has no other.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(image), F.lit(b"")).alias("image")).withColumn("sha", F.sha2("image", 256))
    classes = rows.groupBy("sha").agg(F.min("id").alias("class_id"), F.first("image").alias("image"))
    seen = stored(described(classes, "image", most).select("sha", F.monotonically_increasing_id().alias("c"), "class_id", "corners"))
    each = seen.select("c", F.posexplode("corners").alias("n", "k")).select("c", "n", "k.words", F.struct("k.x", "k.y", "k.turn", "k.scale").alias("t"))
    roots = class_roots(each, least)
    sizes = F.greatest(F.coalesce(F.size("corners"), F.lit(0)), F.lit(0)).cast("long")
    named = seen.select("sha", "c", "class_id", sizes.alias("n_corners")).join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    tops = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    return rows.drop("image").join(named.join(tops, "root").select("sha", "class_id", "n_corners", "component_id"), "sha").select("id", "class_id", "n_corners", "component_id")


def drawn(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", side: int = 16, cell: int = 4) -> DataFrame:
    """(id, image): each vector as a PNG of side x side cells whose greys are
    products of two of its values.  Of every 50th id there is a copy with the id
    -1 - id, cropped by 5 and 3 pixels and made brighter.  A null or empty vector
    gives a null image."""

    @F.arrow_udf(T.BinaryType())
    def draw(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, edits in batches:
            out = []
            for v, edit in zip(vectors, edits):
                x = np.array([0.0 if a is None else a for a in v.as_py() or []])
                if not len(x):
                    out.append(None)
                    continue
                y, z = np.divmod(np.arange(side * side), side)
                grid = x[(7 * y + 13 * z) % len(x)] * x[(11 * y + 3 * z + 5) % len(x)]
                grid = np.clip(110 + 70 * grid / max(grid.std(), 1e-9), 0, 220)
                grey = np.kron(grid.reshape(side, side), np.ones((cell, cell))).astype(np.uint8)
                out.append(encode_png(grey[5:, 3:] + np.uint8(20) if edit.as_py() else grey))
            yield pa.array(out, pa.binary())

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(False).alias("edit"))
    edited = rows.filter(F.col("id") % 50 == 0).select((-1 - F.col("id")).alias("id"), "v", F.lit(True).alias("edit"))
    return rows.unionAll(edited).select("id", draw("v", "edit").alias("image"))
