import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from test_masks import flood

from lodestrata.functions import images as I
from lodestrata.functions import masks as M

shapes = st.tuples(st.integers(1, 9), st.integers(1, 9))


def filled(mask):
    """A mask with its holes filled: all that a flood from outside does not reach."""
    free, _ = flood(~np.pad(mask, 1), False)
    return (free != free[0, 0])[1:-1, 1:-1]


@given(hnp.arrays(bool, shapes))
@settings(max_examples=300, deadline=None)
def test_outlines_hold_their_pieces(m):
    """Filling each outline gives its piece back, holes filled."""
    labels, n = flood(m, True)
    lines = I.outlines(m)
    assert len(lines) == n
    for k, line in enumerate(lines, 1):
        got = I.polygon_mask([c for p in line for c in p], m.shape)
        assert (got == filled(labels == k)).all()


def test_polygons_and_coco():
    assert I.polygon_mask([1, 1, 4, 1, 4, 3, 1, 3], (6, 6)).sum() == 12
    assert I.polygon_mask([0.5, 0.5, 2.5, 0.5, 2.5, 2.5, 0.5, 2.5], (4, 4)).sum() == 4
    m = np.zeros((8, 9), bool)
    m[2:5, 3:7] = True
    assert I.coco(m, 2.0) == {"segmentation": [[6.0, 4.0, 12.0, 4.0, 12.0, 8.0, 6.0, 8.0]], "bbox": [6.0, 4.0, 8.0, 6.0], "area": 48.0}
    assert I.coco(m & False)["segmentation"] == []


@given(hnp.arrays(np.uint8, st.one_of(shapes, shapes.map(lambda s: (*s, 3)))))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(image):
    assert (I.decode_png(I.encode_png(image)) == image).all()


def png(rows, w, bits, colour, extra=b""):
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return I.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, len(rows), bits, colour, 0, 0, 0)) + extra + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


def filtered(image, kind):
    """Rows of an 8-bit grey image, each predicted by one filter, straight from its definition."""
    out = []
    for y, row in enumerate(image.astype(int)):
        line = bytearray([kind])
        for x, v in enumerate(row):
            a, b, c = (int(row[x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            near = {abs(a + b - c - t): t for t in (c, b, a)}
            line.append((v - (0, a, b, (a + b) // 2, near[min(near)])[kind]) % 256)
        out.append(bytes(line))
    return out


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (7, 11)).astype(np.uint8)
    assert (I.decode_png(png(filtered(image, kind), 11, 8, 0)) == image).all()


def test_png_kinds_and_faults():
    assert I.decode_png(png([b"\x00\xa0", b"\x00\x40"], 3, 1, 0)).tolist() == [[255, 0, 255], [0, 255, 0]]
    colours = b"\x00\x00\x00\x06PLTE" + b"\x01\x02\x03\x07\x08\x09"
    colours += struct.pack(">I", zlib.crc32(colours[4:]))
    colours = struct.pack(">I", 6) + colours[4:]
    assert I.decode_png(png([b"\x00\x40"], 2, 1, 3, colours)).tolist() == [[[1, 2, 3], [7, 8, 9]]]
    good = I.encode_png(np.ones((3, 3), np.uint8))
    for bad in (b"", b"GIF", good[:20], good[:-20] + b"x" * 20, png([b"\x09\x01"], 1, 8, 0), png([], 1, 16, 0)):
        with pytest.raises(I.Unreadable):
            I.decode_png(bad)


def test_input_is_square_and_normalised():
    x = I.to_input(np.full((4, 8), 255, np.uint8), 16)
    assert x.shape == (3, 16, 16) and x[0, 8, 8] == 1.0 and x[0, 0, 0] == -1.0


def test_tables(spark):
    m = np.zeros((5, 6), bool)
    m[1:3, 2:5] = True
    files = spark.createDataFrame([(1, 0, bytearray(I.encode_png(m * 255))), (2, 0, bytearray(b"no image")), (3, 0, None)], "image long, instance int, content binary")
    assert sorted((r["y"], r["x"]) for r in I.mask_pixels(files).collect()) == [(y, x) for y in (1, 2) for x in (2, 3, 4)]
    packed = spark.createDataFrame([(1, 0, M.pack(m))], f"image long, instance int, mask {M.PACKED}")
    r = I.coco_of_packed(packed).first()
    assert (r["bbox"], r["area"], r["segmentation"]) == ([2.0, 1.0, 3.0, 2.0], 6.0, [[2.0, 1.0, 4.0, 1.0, 4.0, 2.0, 2.0, 2.0]])
