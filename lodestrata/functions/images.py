"""Images and outlines without an image library: PNG files, polygons, and outlines of masks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .masks import label, unpack

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class Unreadable(ValueError):
    """Bytes that are no PNG file of the kinds read here."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise Unreadable("a damaged chunk")
        yield kind, body
        at += 12 + n


def decode_png(data: bytes) -> np.ndarray:
    """(H, W) or (H, W, channels) of a PNG file with up to 8 bits a sample, not interlaced; a palette
    gives its colours."""
    if not data.startswith(SIGNATURE):
        raise Unreadable("not a PNG file")
    head, palette, packed = None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] > 8 or head[3] not in CHANNELS or head[6]:
        raise Unreadable("a kind of PNG that is not read here")
    w, h, bits, colour = head[:4]
    per_pixel = CHANNELS[colour]
    width = (w * per_pixel * bits + 7) // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise Unreadable(str(e)) from e
    if len(raw) < h * (width + 1):
        raise Unreadable("too few rows")
    rows = _unfiltered(raw[: h * (width + 1)].reshape(h, width + 1), max(1, per_pixel * bits // 8))
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
        rows = each[:, : w * per_pixel].astype(np.uint8) * (1 if colour == 3 else 255 // ((1 << bits) - 1))
    if colour == 3:
        if palette is None or rows.max(initial=0) >= len(palette):
            raise Unreadable("no palette")
        return palette[rows]
    return rows.reshape(h, w) if per_pixel == 1 else rows.reshape(h, w, per_pixel)


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo each row's prediction from the pixel to the left, the one above, and the one between."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for y, row in enumerate(rows):
        kind, line, up = row[0], row[1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + up
        elif kind == 1:
            for s in range(step):
                out[y + 1, s::step] = np.cumsum(line[s::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            now, above, line = [0] * (step + len(line)), [0] * step + up.tolist(), line.tolist()
            for x, v in enumerate(line):
                a, b, c = now[x], above[x + step], above[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x + step] = (v + guess) & 255
            out[y + 1] = now[step:]
        else:
            raise Unreadable(f"row filter {kind}")
    return out[1:]


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of an 8-bit image, grey (H, W) or colour (H, W, 3)."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = np.hstack([np.zeros((h, 1), np.uint8), image.reshape(h, -1)])
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def mask_of(data: bytes) -> np.ndarray:
    """The mask that a PNG file holds: whatever is not black."""
    image = decode_png(data)
    return image > 0 if image.ndim == 2 else (image[..., :3] > 0).any(axis=2)


def polygon_mask(points: list[float], shape: tuple[int, int]) -> np.ndarray:
    """The pixels whose centre lies in a polygon [x0, y0, x1, y1, ...] (even-odd) or on its outline."""
    p = np.asarray(points, float).reshape(-1, 2)
    y, x = np.indices(shape)
    inside, on = np.zeros(shape, bool), np.zeros(shape, bool)
    for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0), strict=True):
        side = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        on |= (np.abs(side) < 1e-9) & (x >= min(x0, x1)) & (x <= max(x0, x1)) & (y >= min(y0, y1)) & (y <= max(y0, y1))
        if y0 != y1:
            inside ^= ((y0 <= y) != (y1 <= y)) & ((side > 0) == (y1 > y0))
    return inside | on


#: The eight neighbours, clockwise from the one above.
_TURN = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def outlines(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """The outer outline (x, y) of each piece, clockwise through the centres of its border pixels
    from the first in reading order; points on a straight line between others are left out."""
    labels, n = label(mask)
    out = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        piece = np.zeros((np.ptp(ys) + 3, np.ptp(xs) + 3), bool)
        piece[ys - ys.min() + 1, xs - xs.min() + 1] = True
        start = (1, int(xs[0] - xs.min() + 1))
        path, (y, x), came = [], start, 6  # the pixel to the left of the first is free
        begun = None
        while True:
            for i in range(1, 9):
                d = (came + i) % 8
                if piece[y + _TURN[d][0], x + _TURN[d][1]]:
                    break
            else:
                path.append((x, y))  # a single pixel
                break
            if (y, x, d) == begun:
                break
            begun = begun or (y, x, d)
            path.append((x, y))
            y, x = y + _TURN[d][0], x + _TURN[d][1]
            came = (d + 5) % 8 if d % 2 else (d + 6) % 8  # the free pixel seen last before this one
        out.append([(int(a + xs.min() - 1), int(b + ys.min() - 1)) for a, b in _corners(path)])
    return out


def _corners(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if len(path) < 3:
        return path
    step = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(path, path[1:] + path[:1], strict=True)]
    return [p for p, before, after in zip(path, step[-1:] + step[:-1], step, strict=True) if before != after]


def coco(mask: np.ndarray, scale: float = 1.0) -> dict:
    """{segmentation, bbox, area} of a mask, in pixels of an image `scale` times as large, to one
    decimal; outlines of fewer than three points are left out."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return {"segmentation": [], "bbox": [0.0, 0.0, 0.0, 0.0], "area": 0.0}
    to = lambda *v: [round(float(x) * scale, 1) for x in v]
    lines = [to(*[c for point in line for c in point]) for line in outlines(mask) if len(line) >= 3]
    return {"segmentation": lines, "bbox": to(xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1), "area": round(len(ys) * scale * scale, 1)}


def to_input(image: np.ndarray, side: int, mean: float = 0.5, spread: float = 0.5) -> np.ndarray:
    """An image padded to a square, scaled to `side` by the nearest pixel, and normalised: (3, side,
    side)."""
    rgb = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]
    n = max(rgb.shape[:2])
    square = np.zeros((n, n, 3), np.float64)
    top, left = (n - rgb.shape[0]) // 2, (n - rgb.shape[1]) // 2
    square[top : top + rgb.shape[0], left : left + rgb.shape[1]] = rgb
    at = ((np.arange(side) + 0.5) * n / side).astype(int)
    return ((square[at][:, at] / 255 - mean) / spread).transpose(2, 0, 1)


def mask_pixels(files: DataFrame) -> DataFrame:
    """(image, instance, y, x) of PNG masks (image, instance, content); files that cannot be read have
    none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, instance, content in zip(*(b.column(c).to_pylist() for c in ("image", "instance", "content")), strict=True):
                try:
                    y, x = np.nonzero(mask_of(content or b""))
                except Unreadable:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), image, np.int64)), pa.array(np.full(len(y), instance, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32))], names=["image", "instance", "y", "x"])

    return files.select("image", "instance", "content").mapInArrow(run, "image long, instance int, y int, x int")


def coco_of_packed(rows: DataFrame, mask: str = "mask", scale: float = 1.0) -> DataFrame:
    """(image, instance, segmentation, bbox, area) of packed masks (image, instance, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [coco(unpack(m["h"], m["w"], m["bits"]), scale) for m in b.column(mask).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("image"), b.column("instance"), pa.array([f["segmentation"] for f in found], pa.list_(pa.list_(pa.float64()))), pa.array([f["bbox"] for f in found], pa.list_(pa.float64())), pa.array([f["area"] for f in found], pa.float64())], names=["image", "instance", "segmentation", "bbox", "area"])

    return rows.select("image", "instance", mask).mapInArrow(run, "image long, instance int, segmentation array<array<double>>, bbox array<double>, area double")
