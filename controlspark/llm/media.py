"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, passes, prepare, tidy

UNIT = 576  #: bytes of a payload: 24 rows of 24 grey samples
WIDTH = 24
TILE = 16
PAD = b"\xff"


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """A raw grey Netpbm image of 8-bit samples; the payload fills whole rows."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("a Netpbm header ends early")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 as (height, width) or (height, width, 3) samples, and the largest sample value; bitmaps as 0 and 1, 1 black."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    colour = 3 if kind in (b"P3", b"P6") else 1
    bitmap = kind in (b"P1", b"P4")
    (width, height, *most), at = _numbers(data, 2, 2 if bitmap else 3)
    most = most[0] if most else 1
    if not 0 < most < 65536:
        raise ValueError("a Netpbm image has 1 to 65535 levels")
    n = width * height * colour
    if kind == b"P1":
        digits = np.frombuffer(re.sub(rb"#[^\n]*", b"", data[at:]), dtype=np.uint8)
        out = digits[(digits == 48) | (digits == 49)][:n] - 48
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.uint16 if most > 255 else np.uint8)
    elif kind == b"P4":
        row = (width + 7) // 8
        bits = np.frombuffer(data, dtype=np.uint8, offset=at + 1, count=row * height).reshape(height, row)
        out = np.unpackbits(bits, axis=1)[:, :width].reshape(-1)
    else:
        out = np.frombuffer(data, dtype=">u2" if most > 255 else np.uint8, offset=at + 1, count=n)
    if len(out) < n:
        raise ValueError("a Netpbm image ends early")
    return out.reshape((height, width, 3) if colour == 3 else (height, width)), most


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The 8-bit samples that a bit mask selects."""
    if not mask:
        return np.zeros(pixels.shape, dtype=np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return (((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * np.uint64(255) // np.uint64(most)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits a pixel, with bit masks if it has them, as (height, width, 3) red, green, blue."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    number = lambda at, size, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    offset, head, width, height, bits, packing = number(10, 4), number(14, 4), number(18, 4, True), number(22, 4, True), number(28, 2), number(30, 4)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or head < 40 or width < 0 or (packing == 3 and bits not in (16, 32)):
        raise ValueError("a kind of BMP image that is not read")
    row = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, dtype=np.uint8, offset=offset, count=row * abs(height)).reshape(abs(height), row)
    if bits <= 8:
        colours = np.frombuffer(data, dtype=np.uint8, offset=14 + head, count=4 * (number(46, 4) or 1 << bits)).reshape(-1, 4)
        if bits == 8:
            places = rows[:, :width]
        else:
            each = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
            places = (each @ (1 << np.arange(bits - 1, -1, -1)))[:, :width]
        out = colours[places][:, :, 2::-1]
    elif packing == 3 or bits == 16:
        masks = [number(54 + 4 * i, 4) for i in range(3)] if packing == 3 else [0x7C00, 0x3E0, 0x1F]
        pixels = np.ascontiguousarray(rows[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
        out = np.stack([_masked(pixels, m) for m in masks], axis=2)
    else:
        step = bits // 8
        out = rows[:, : width * step].reshape(abs(height), width, step)[:, :, 2::-1]
    return out[::-1] if height > 0 else out


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The samples of an image and the largest value that they can have."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image @ np.array([299, 587, 114])) // 1000


def area_resize(image: np.ndarray, height: int, width: int, strip: int = 1 << 16) -> np.ndarray:
    """Exact means over areas of a grey image, from its integral image at fractional corners.

    The integral image is made in strips of rows, and only rows beside a corner
    are kept, so memory doesn't grow with the image.
    """
    h, w = image.shape
    ys = np.arange(height + 1) * h / height
    low = np.minimum(np.floor(ys).astype(np.int64), h)
    need = np.unique(np.concatenate((low, np.minimum(low + 1, h))))
    kept = np.zeros((len(need), w + 1))
    total = np.zeros(w, dtype=np.int64)
    rows = max(1, strip // max(1, w))
    for top in range(0, h, rows):
        part = np.cumsum(image[top : top + rows].astype(np.int64), axis=0) + total
        inside = (need > top) & (need <= top + len(part))
        kept[inside, 1:] = np.cumsum(part[need[inside] - top - 1], axis=1)
        total = part[-1]
    at = lambda y: kept[np.searchsorted(need, y)]
    lines = at(low) + (at(np.minimum(low + 1, h)) - at(low)) * (ys - low)[:, None]
    xs = np.arange(width + 1) * w / width
    left = np.minimum(np.floor(xs).astype(np.int64), w)
    corners = lines[:, left] + (lines[:, np.minimum(left + 1, w)] - lines[:, left]) * (xs - left)
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (h / height) / (w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 by 8 areas is darker than the next on its right."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, most: int = 255, side: int = TILE) -> bytes:
    """The image, resized to a square and scaled so that ``most`` becomes 255, as the bytes of an NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.round(area_resize(grey(image), side, side) * (255 / most)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 as a grey image, padded with bytes 255 to a multiple of UNIT (once at least)."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    @tidy
    def encode(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in passes(batch):
                media = [encode_pgm(t + PAD * (max(1, -(-len(t) // UNIT)) * UNIT - len(t))) for t in texts]
                yield batch_of(schema, (ids[first : first + len(texts)], map(len, texts), media))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, "doc_id bigint, n_bytes bigint, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """Adds what the stored bytes hold to (doc_id, n_bytes, media): the payload's and the media's digests, the tile and the hash.

    Media that are null or cannot be read get nulls; an image without pixels has
    digests, but no tile and no hash. Equal media, equal values.
    """
    prepare(media.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())])

    def one(data: bytes) -> tuple:
        try:
            image, most = decode(data)
        except (ValueError, IndexError, OverflowError, MemoryError):
            return (None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None)
        payload = np.ascontiguousarray(image).tobytes()
        seen = (difference_hash(image), npy_tile(image, most)) if image.size else (None, None)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), *seen)

    @tidy
    def describe(batches):
        for batch in batches:
            ids, sizes = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist()
            for first, media in passes(batch, "media"):
                rows = [(ids[first + i], sizes[first + i], *(one(m) if m else (None,) * 7)) for i, m in enumerate(media)]
                yield batch_of(schema, zip(*rows, strict=True))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(describe, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary")


def text_media(docs: DataFrame) -> DataFrame:
    """Each row's text as media, read back: the digests, the feature (difference hash) and the tile's digest.

    A null text is empty. Repeated and null doc_ids keep a row each. An empty
    table gives an empty one.
    """
    return describe_media(encode_texts(docs)).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")
