"""Pictures as numpy arrays: checks, orientation, size, margins, regions, quads, PNG; regions by rows of ink as columns too."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as ink, frame lines and padding of the margin crop; rows of a region at least; the tag of orientation.
INK, REGION_INK, LINE_SHARE, OUTER, LINE_SIDE, PAD, LEAST_SIDE, MOST_SHARE, LEAST_ROWS = 215, 160, 0.60, 0.08, 10, 24, 64, 0.60, 64
ORIENTATION = 274
LUMA = (0.299, 0.587, 0.114)


def region_cuts(ink: Column, count: int = 3) -> Column:
    """Rows at which a page is cut into count regions, with 0 and the height: the emptiest row near each even cut, the nearest on
    ties. ink: array<int>, dark pixels of each row. Null for pages too low."""
    height = F.size(ink)

    def step(cuts: Column, i: Column) -> Column:
        last, center = F.element_at(cuts, -1), F.floor(height * i / count).cast("int")
        radius = F.greatest(F.lit(1), F.floor(height / 20).cast("int"))
        start, end = F.greatest(last + 1, center - radius), F.least(height - 1, center + radius)
        rows = F.transform(F.sequence(start, end - 1), lambda y: F.struct(F.get(ink, y).alias("ink"), F.abs(y - center).alias("far"), y.alias("y")))
        best = F.when(end <= start, center).otherwise(F.array_min(rows)["y"])
        return F.concat(cuts, F.array(F.least(height - 1, F.greatest(last + 1, best))))

    cuts = F.aggregate(F.sequence(F.lit(1), F.lit(count - 1)), F.array(F.lit(0)), step)
    return F.when(height >= count * LEAST_ROWS, F.concat(cuts, F.array(height)))


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.round(image[:, :, :3] @ np.array(LUMA)).astype(np.uint8)


def margin_crop(image: np.ndarray) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) around the ink of a sparse page, long lines near the edges not counted; the whole page if it is
    blank, the crop small, or little is won by it."""
    dark = gray(image) < INK
    height, width = dark.shape
    columns, rows = dark.sum(axis=0) > height * LINE_SHARE, dark.sum(axis=1) > width * LINE_SHARE
    for long_, area in ((columns, dark.T), (rows, dark)):
        n = len(long_)
        for at in np.flatnonzero(long_):
            if at < n * OUTER or at > n * (1 - OUTER):
                area[max(0, at - LINE_SIDE) : at + LINE_SIDE + 1] = False
    ys, xs = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
    if not len(xs):
        return 0, 0, width, height
    box = max(0, int(xs[0]) - PAD), max(0, int(ys[0]) - PAD), min(width, int(xs[-1]) + PAD + 1), min(height, int(ys[-1]) + PAD + 1)
    w, h = box[2] - box[0], box[3] - box[1]
    return (0, 0, width, height) if w < LEAST_SIDE or h < LEAST_SIDE or w * h > width * height * MOST_SHARE else box


def row_ink(image: np.ndarray) -> np.ndarray:
    """Dark pixels of each row, a strip at either side left out."""
    g = gray(image)
    side = min(g.shape[1] // 12, max(0, g.shape[1] // 4))
    return (g[:, side : max(side + 1, g.shape[1] - side)] < REGION_INK).sum(axis=1)


def exif_orientation(jpeg: bytes) -> int:
    """The orientation that a JPEG's EXIF block states, 1 to 8; 1 without one."""
    at = 2
    while at + 4 <= len(jpeg) and jpeg[:2] == b"\xff\xd8" and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        block = jpeg[at + 4 : at + 2 + size]
        if jpeg[at + 1] == 0xE1 and block[:6] == b"Exif\0\0" and block[6:8] in (b"II", b"MM"):
            e, tiff = "<" if block[6:8] == b"II" else ">", block[6:]
            try:
                first = struct.unpack_from(e + "I", tiff, 4)[0]
                for i in range(struct.unpack_from(e + "H", tiff, first)[0]):
                    tag, _, _, value = struct.unpack_from(e + "HHIH", tiff, first + 2 + 12 * i)
                    if tag == ORIENTATION:
                        return value if 1 <= value <= 8 else 1
            except struct.error:
                return 1
        at += 2 + size
    return 1


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it is meant to be seen."""
    turned = np.swapaxes(image, 0, 1) if orientation >= 5 else image
    flip_rows, flip_columns = orientation in (3, 4, 7, 8), orientation in (2, 3, 6, 7)
    return turned[:: -1 if flip_rows else 1, :: -1 if flip_columns else 1]


def image_verdict(data: bytes | None, most_bytes: int, most_pixels: int) -> str:
    """ok, or why the bytes are refused, told by their header."""
    if not data:
        return "empty"
    if len(data) > most_bytes:
        return "too large"
    size = png_size(data) or jpeg_size(data)
    if not size:
        return "corrupted or unsupported"
    return "dimensions" if min(size) <= 0 else "too many pixels" if size[0] * size[1] > most_pixels else "ok"


def png_size(data: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", data[16:24]) if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24 else None


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def write_png(image: np.ndarray) -> bytes:
    """An 8-bit grey or RGB picture as PNG."""
    a = np.ascontiguousarray(image, dtype=np.uint8)
    rows = np.concatenate([np.zeros((a.shape[0], 1), dtype=np.uint8), a.reshape(a.shape[0], -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def resized(image: np.ndarray, edge: int) -> np.ndarray:
    """The picture with its longer side bounded by edge, areas averaged; sizes round half to even, a pixel at least."""
    h, w = image.shape[:2]
    if max(h, w) <= edge:
        return image
    new_h, new_w = (max(1, round(x * edge / max(h, w))) for x in (h, w))

    def along(a: np.ndarray, n: int) -> np.ndarray:
        ends = np.linspace(0, a.shape[0], n + 1)
        whole = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=float)])
        low = np.minimum(ends.astype(int), a.shape[0] - 1)
        at = whole[low] + (ends - low).reshape(-1, *[1] * (a.ndim - 1)) * a[low]
        return np.diff(at, axis=0) * n / a.shape[0]

    out = np.swapaxes(along(np.swapaxes(along(image, new_h), 0, 1), new_w), 0, 1)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def rectified(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """What stands in a quad (top left, top right, bottom right, bottom left), seen from the front, nearest pixels; turned
    clockwise if it is much higher than wide."""
    span = lambda a, b: round(float(np.hypot(*(quad[a] - quad[b]))))
    w, h = max(span(1, 0), span(2, 3)), max(span(3, 0), span(2, 1))
    if w < 2 or h < 2:
        raise ValueError("the quad is empty")
    target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], dtype=float)
    rows, said = [], []
    for (u, v), (x, y) in zip(target, np.asarray(quad, dtype=float), strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        said += [x, y]
    m = np.append(np.linalg.solve(np.array(rows), np.array(said)), 1.0).reshape(3, 3)
    v, u = np.mgrid[0:h, 0:w]
    p = m @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
    x, y = (np.clip(np.rint(c / p[2]), 0, size - 1).astype(int) for c, size in ((p[0], image.shape[1]), (p[1], image.shape[0])))
    out = image[y, x].reshape(h, w, *image.shape[2:])
    return np.rot90(out, -1) if h > 1.5 * w else out
