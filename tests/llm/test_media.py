"""Media: every format that is read, broken ones, tiles, hashes and digests."""

import hashlib
import io

import numpy as np
import pytest

from controlspark.llm import media

GREY = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
COLOUR = np.arange(36, dtype=np.uint8).reshape(3, 4, 3) * 7
BITS = (GREY // 20) % 2


def plain(kind, a, most):
    return f"{kind} # said\n4 3\n{'' if kind == 'P1' else most}\n".encode() + b"\n".join(b" ".join(b"%d" % x for x in row.reshape(-1)) for row in a)


@pytest.mark.parametrize(
    ("data", "want", "most"),
    [
        (plain("P1", BITS, 1), BITS, 1),
        (plain("P2", GREY, 255), GREY, 255),
        (plain("P3", COLOUR, 255), COLOUR, 255),
        (b"P4\n4 3\n" + np.packbits(BITS, axis=1).tobytes(), BITS, 1),
        (b"P5\n4 3\n255\n" + GREY.tobytes(), GREY, 255),
        (b"P5 4 3 1000\n" + (GREY.astype(int) * 4).astype(">u2").tobytes(), GREY.astype(int) * 4, 1000),
        (b"P6\n4 3\n255\n" + COLOUR.tobytes(), COLOUR, 255),
    ],
)
def test_netpbm(data, want, most):
    got, top = media.decode(data)
    assert np.array_equal(got, want) and top == most


def bmp(bits, rows, height=3, extra=b"", packing=0, colours=0):
    offset = 54 + len(extra)
    number = lambda x, n: int(x).to_bytes(n, "little", signed=x < 0)
    return b"BM" + number(0, 4) + number(0, 4) + number(offset, 4) + number(40, 4) + number(4, 4) + number(height, 4) + number(1, 2) + number(bits, 2) + number(packing, 4) + number(0, 4) + number(0, 8) + number(colours, 4) + number(0, 4) + extra + rows


def padded(rows):
    return b"".join(r + b"\0" * (-len(r) % 4) for r in rows)


def test_bmp():
    palette = b"".join(bytes((b, g, r, 0)) for r, g, b in ((10, 20, 30), (40, 50, 60)))
    flipped = COLOUR[::-1, :, ::-1]
    assert np.array_equal(media.decode(bmp(24, padded(r.tobytes() for r in flipped)))[0], COLOUR)
    assert np.array_equal(media.decode(bmp(24, padded(r.tobytes() for r in COLOUR[:, :, ::-1]), height=-3))[0], COLOUR)
    assert np.array_equal(media.decode(bmp(32, np.dstack((flipped, flipped[:, :, 0])).tobytes()))[0], COLOUR)
    want = np.array([[10, 20, 30], [40, 50, 60]], dtype=np.uint8)[BITS]
    assert np.array_equal(media.decode(bmp(8, BITS[::-1].tobytes(), extra=palette, colours=2))[0], want)
    assert np.array_equal(media.decode(bmp(1, padded(np.packbits(BITS[::-1], axis=1).tobytes()[i : i + 1] for i in range(3)), extra=palette, colours=2))[0], want)
    nibbles = padded(bytes((r[0] << 4 | r[1], r[2] << 4 | r[3])) for r in BITS[::-1])
    assert np.array_equal(media.decode(bmp(4, nibbles, extra=palette, colours=2))[0], want)
    five = np.array([[31 << 11 | 63 << 5 | 31, 0, 31 << 11, 63 << 5]] * 3, dtype="<u2")  # 5, 6 and 5 bits
    masks = b"".join(x.to_bytes(4, "little") for x in (0xF800, 0x7E0, 0x1F))
    assert np.array_equal(media.decode(bmp(16, five.tobytes(), extra=masks, packing=3))[0][0], [[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 255, 0]])
    swapped = b"".join(x.to_bytes(4, "little") for x in (0xFF, 0xFF00, 0xFF0000))  # red first
    assert np.array_equal(media.decode(bmp(32, np.dstack((COLOUR[::-1], COLOUR[::-1, :, 0])).tobytes(), extra=swapped, packing=3))[0], COLOUR)


def test_tiles_are_scaled():
    tile = lambda data: np.load(io.BytesIO(media.npy_tile(*media.decode(data))))
    white = b"P5 2 2 1000\n" + np.full(4, 1000, dtype=">u2").tobytes()
    assert (tile(white) == 255).all() and tile(white).shape == (16, 16)
    assert (tile(b"P1 2 2 1111") == 255).all()
    assert (tile(b"P5 2 2 1000\n" + np.full(4, 300, dtype=">u2").tobytes()) == 76).all()


def test_difference_hash_equals_means():
    image = np.random.default_rng(1).integers(0, 256, (16, 18))
    means = image.reshape(8, 2, 9, 2).mean(axis=(1, 3))
    assert media.difference_hash(image) == np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()


def test_rows(spark):
    good = b"P5\n4 3\n255\n" + GREY.tobytes()
    rows = [(1, 12, good), (1, 12, good), (2, 0, None), (3, 1, b"P9 nothing"), (4, 1, b"P5\n4 3\n255\nx"), (5, 0, b"P5\n0 0\n255\n"), (6, 1, b"BM"), (7, 1, b"")]
    got = {r.doc_id: r for r in media.describe_media(spark.createDataFrame([(a, b, bytearray(c) if c is not None else None) for a, b, c in rows], "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(GREY.tobytes()).hexdigest() and got[1].media_sha256 == hashlib.sha256(good).hexdigest()
    assert got[1].feature == media.difference_hash(GREY) and np.array_equal(np.load(io.BytesIO(got[1].tile)), np.round(media.area_resize(GREY, 16, 16)))
    assert got[2].media_sha256 is None and got[2].feature is None
    for bad in (3, 4, 6):
        assert got[bad].payload_bytes is None and got[bad].feature is None and got[bad].media_sha256
    assert (got[5].payload_bytes, got[5].feature, got[5].tile) == (0, None, None)


def test_feature_of_texts_equals_brute_force(spark):
    texts = [None, "", "x" * 575, "y" * 576, "zé" * 700, "w" * 2_000_000]
    for r in media.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 24)
        stored = b"P5\n24 %d\n255\n" % len(image) + payload
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.difference_hash(image))
        assert r.tile_sha256 == hashlib.sha256(media.npy_tile(image)).hexdigest()
