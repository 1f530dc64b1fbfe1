"""Operator 6: Netpbm and BMP images as numpy arrays, area-resized and cut into NPY tiles.

Netpbm P1 to P6 (8 and 16 bits) and uncompressed BMP of 8, 24 and 32 bits are decoded.  A resize
averages the exact area below each target sample from an integral image, with fractional edges
by linear interpolation between its rows and columns.  A difference hash has a bit for each
neighbour to the right that is brighter, on 9 x 8 samples.

Defined results: bytes that are no such image give no array, hash or tiles (null columns); a
null column counts as no bytes.  Tiles at the right and lower edge may be smaller.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import parts

#: Side of a tile, and bytes of a square tile: payloads are padded to a multiple of it.
TILE = 24
UNIT = TILE * TILE

HEADER = re.compile(rb"(P[1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 2)
LAST = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def decode_netpbm(raw: bytes) -> np.ndarray:
    """Height x width, or height x width x 3."""
    head = HEADER.match(raw)
    if not head:
        raise ValueError("not Netpbm")
    kind, width, height = head[1], int(head[2]), int(head[3])
    at, top = head.end(), 1
    if kind not in (b"P1", b"P4"):
        m = LAST.match(raw, at)
        if not m or not 0 < int(m[1]) < 65536:
            raise ValueError("no largest value")
        at, top = m.end(), int(m[1])
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = int(np.prod(shape))
    wide = np.uint8 if top < 256 else np.uint16
    if kind == b"P1":
        digits = re.sub(rb"#[^\n]*|[^01]", b"", raw[at:])
        out = 1 - (np.frombuffer(digits, np.uint8) - 48)
        out = (out * 255).astype(np.uint8)
    elif kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        out = ((1 - np.unpackbits(rows, axis=1)[:, :width]) * 255).ravel()
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n]*", b"", raw[at:]).split(), np.int64).astype(wide)
    else:
        out = np.frombuffer(raw, ">u2" if wide is np.uint16 else np.uint8, n, at + 1).astype(wide)
    if len(out) < n:
        raise ValueError("too few samples")
    return out[:n].reshape(shape)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Height x width x 3, or height x width if all of the palette is grey."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not BMP")
    (start,) = struct.unpack_from("<I", raw, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32) or width <= 0:
        raise ValueError("a kind of BMP that isn't handled")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits != 8:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    palette = np.frombuffer(raw, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if len(palette) == 256 and (palette == palette[:, :1]).all():
        return palette[:, 0][rows[:, :width]]
    return palette[rows[:, :width]]


def decode(raw: bytes) -> np.ndarray | None:
    """None for bytes that are no such image."""
    try:
        return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)
    except (ValueError, struct.error, IndexError):
        return None


def encode_pgm(payload: bytes, width: int = TILE) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey image with a palette; lines from the lowest up."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1078 + rows.size, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def area_resize(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the area below each target sample; images: any number of leading axes, then rows and columns.

    Of the integral image only the rows, and of those the columns, are made that samples begin or end
    at, so that a large image takes no table of its size.
    """

    def cut(t: np.ndarray, to: int, axis: int) -> np.ndarray:
        n = t.shape[axis]
        at = np.arange(to + 1) * (n / to)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low).reshape((-1, 1) if axis == -2 else (-1,))
        places = np.unique(np.concatenate([low, low + 1]))
        # The first place is 0 and the last n; sums from the start up to each.
        between = np.add.reduceat(t, places[:-1], axis, dtype=np.float64)
        sums = np.concatenate([np.zeros_like(np.take(between, [0], axis)), np.cumsum(between, axis)], axis)
        value = lambda k: np.take(sums, np.searchsorted(places, k), axis)
        return np.diff(value(low) * (1 - part) + value(low + 1) * part, axis=axis)

    h, w = images.shape[-2:]
    return cut(cut(images, height, -2), width, -1) * ((height / h) * (width / w))


def difference_hash(images: np.ndarray) -> np.ndarray:
    """64 bits for each grey image; the top left is the highest bit."""
    small = area_resize(images, 8, 9)
    bits = (np.diff(small, axis=-1) > 1e-9).reshape(*images.shape[:-2], 64)
    return np.packbits(bits, axis=-1).view(">u8")[..., 0].astype(np.uint64)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int = TILE) -> Iterator[tuple[int, int, np.ndarray]]:
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            yield y, x, image[y : y + side, x : x + side]


def npy_tiles(media: DataFrame, key: str, column: str, side: int = TILE, size: tuple[int, int] | None = None) -> DataFrame:
    """A row for each tile of each image, after an area-resize to ``size`` (height, width) if given: key, y, x, npy, dhash.  Write it where the cluster can share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "y", "x", "npy", "dhash"]
        for b in parts(batches, 2048):
            rows: list[list] = [[] for _ in names]
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                image = None if raw is None else decode(raw)
                if image is None or not image.size:
                    continue
                if size:
                    planes = np.moveaxis(image, -1, 0) if image.ndim == 3 else image
                    planes = np.rint(area_resize(planes, *size)).astype(image.dtype)
                    image = np.moveaxis(planes, 0, -1) if image.ndim == 3 else planes
                for y, x, t in tiles(image, side):
                    for out, v in zip(rows, (k, y, x, npy(t), f"{int(difference_hash(grey(t))):016x}"), strict=True):
                        out.append(v)
                if len(rows[0]) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field(0).type), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.string())], names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field(0).type), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.string())], names)

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, y int, x int, npy binary, dhash string")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload that is stored for it."""
    raw = b"" if text is None else text.encode("utf-8")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text's bytes as the samples of a PGM image, decodes it again, and takes the features from the decoded array.

    feature: the difference hash of the whole image, and a digest of those of its NPY tiles.  The same
    samples are stored as a BMP too, which must decode to the same array; bmp_sha256 is its digest.
    """
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles", "tiles_sha256", "bmp_sha256"]

    def one(value: str | None) -> tuple:
        n, payload = payload_of(value)
        stored = encode_pgm(payload)
        image = decode_netpbm(stored)
        bmp = encode_bmp(image)
        if not np.array_equal(decode_bmp(bmp), image):
            raise ValueError("the BMP form gave other samples")
        back = image.tobytes()
        cut = image.reshape(-1, TILE, TILE)
        hashes = difference_hash(cut).astype(">u8").tobytes()
        shown = hashlib.sha256()
        for t in cut:
            shown.update(npy(t))
        feature = f"{int(difference_hash(image)):016x}-{hashlib.sha256(hashes).hexdigest()[:16]}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(cut), shown.hexdigest(), hashlib.sha256(bmp).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for b in parts(batches, 2048):
            columns = list(zip(*map(one, b.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long, tiles_sha256 string, bmp_sha256 string")


def op6_media(spark, sf_dir: str) -> DataFrame:
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
