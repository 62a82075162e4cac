"""Media columns: a TIFF reader and writer over binary columns, one row per page.

The reader walks the chain of image directories, decodes PackBits, LZW and deflate strips or tiles, undoes horizontal
differencing, and gives one row per page. Samples have 1, 8 or 16 bits, interleaved or in planes. The writer makes 8-bit
images the reader (or any other) can open. Damaged files give one row with an error and no pixels after the pages read till
then; a page of more than MOST_SAMPLES samples is an error too, before memory is taken; null and empty files give "empty".
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the format: compressions and field types (bytes each).
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
UNIT = 576
ROWS_PER_PAGE = 256
#: Samples of one page that the reader takes on.
MOST_SAMPLES = 1 << 28
PAGE_SCHEMA = "doc_id long, page long, width long, height long, samples long, bits long, compression long, predictor long, pixels binary, error string"


# ---------------------------------------------------------------- codecs
def packbits_encode(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        run = 1
        while run < 128 and i + run < n and raw[i + run] == raw[i]:
            run += 1
        if run >= 2:
            out += bytes((257 - run, raw[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and raw[j] == raw[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + raw[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the reader, one code behind, widens one code early as the format asks."""
    bits = acc = 0
    out, width, known = bytearray(), 9, {bytes((i,)): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    put(256)
    following, have = 258, b""
    for i in range(len(raw)):
        longer = have + raw[i : i + 1]
        if longer in known:
            have = longer
            continue
        put(known[have])
        known[longer] = following
        following += 1
        if following >= 4094:
            put(256)
            following, width, known = 258, 9, {bytes((i,)): i for i in range(256)}
        elif following >= 1 << width:
            width += 1
        have = raw[i : i + 1]
    if have:
        put(known[have])
        if following >= (1 << width) - 1 and width < 12:  # the reader has caught up by one code
            width += 1
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table, width, last = bytearray(), [], 9, b""
    acc = bits = at = 0
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            acc, bits, at = acc << 8 | data[at], bits + 8, at + 1
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("no clear code")
        if not last:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out += piece
        last = piece
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


_ENCODE = {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda b: zlib.compress(b, 1)}
_DECODE = {NONE: bytes, LZW: lzw_decode, PACKBITS: packbits_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


# ---------------------------------------------------------------- writer
def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit pages, (height, width) or (height, width, samples); tile: side of tiles, 0 for strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        a = page[:, :, None] if page.ndim == 2 else page
        h, w, s = a.shape
        blocks = [a[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, s), dtype=np.uint8)
            full[:h, :w] = a
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            packed = _ENCODE[compression](b.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        fields = [(256, [w]), (257, [h]), (258, [8] * s), (259, [compression]), (262, [2 if s >= 3 else 1]), (277, [s]), (317, [predictor])]
        fields += [(322, [tile]), (323, [tile]), (324, offsets), (325, counts)] if tile else [(273, offsets), (278, [rows_per_strip]), (279, counts)]
        entries = bytearray()
        for tag, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                entries += struct.pack("<HHII", tag, 4, len(values), len(out))
                out += raw
            else:
                entries += struct.pack("<HHI", tag, 4, len(values)) + raw
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---------------------------------------------------------------- reader
def _fields(data: bytes, at: int, e: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(e + "H", data, at)
    out: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
        size = TYPE_BYTES.get(kind, 0) * count
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(e + "I", data, at + 10 + 12 * i)[0]
        if kind in (1, 3, 4):
            out[tag] = list(struct.unpack_from(f"{e}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place))
    return out, struct.unpack_from(e + "I", data, at + 2 + 12 * n)[0]


def read_tiff(data: bytes) -> Iterator[tuple[np.ndarray, dict[str, int]]]:
    """Pages in directory order: pixels (height, width, samples) and the page's compression and predictor."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    e = "<" if data[:2] == b"II" else ">"
    (at,), seen = struct.unpack_from(e + "I", data, 4), set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        f, following = _fields(data, at, e)
        w, h, s = f[256][0], f[257][0], f.get(277, [1])[0]
        how, predictor, planes = f.get(259, [NONE])[0], f.get(317, [1])[0], s if f.get(284, [1])[0] == 2 else 1
        (bits,) = set(f.get(258, [1])) if len(set(f.get(258, [1]))) == 1 else (0,)
        if bits not in (1, 8, 16) or how not in _DECODE or predictor not in (1, 2) or (predictor == 2 and bits == 1):
            raise ValueError(f"{bits}-bit samples in compression {how} with predictor {predictor} are not read")
        if 324 in f:
            tw, th, offsets, counts = f[322][0], f[323][0], f[324], f[325]
        else:
            tw, th, offsets, counts = w, min(f.get(278, [h])[0], h), f[273], f[279]
        if min(w, h, s, tw, th) < 1 or (w + tw) * (h + th) * s > MOST_SAMPLES:
            raise ValueError(f"page of {w} x {h} x {s} samples in blocks of {tw} x {th}")
        across, down, each = -(-w // tw), -(-h // th), s // planes
        if len(offsets) != len(counts) or len(offsets) < across * down * planes:
            raise ValueError("blocks are missing")
        kind = np.dtype(e + "u2") if bits == 16 else np.dtype(np.uint8)
        page = np.zeros((down * th, across * tw, s), dtype=kind.newbyteorder("="))
        for i in range(across * down * planes):
            plane, at_block = divmod(i, across * down)
            y, x = at_block // across * th, at_block % across * tw
            rows = th if 324 in f else min(th, h - y)
            line = -(-tw * each // 8) if bits == 1 else tw * each * kind.itemsize
            raw = _DECODE[how](data[offsets[i] : offsets[i] + counts[i]])[: rows * line]
            if len(raw) < rows * line:
                raise ValueError("a block is too short")
            if bits == 1:
                block = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(rows, line), axis=1)[:, : tw * each].reshape(rows, tw, each)
            else:
                block = np.frombuffer(raw, dtype=kind).reshape(rows, tw, each)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=page.dtype)
            page[y : y + rows, x : x + tw, plane * each : (plane + 1) * each] = block
        yield page[:h, :w], {"bits": bits, "compression": how, "predictor": predictor}
        at = following


def tiff_pages(files: DataFrame, id_col: str = "doc_id", data_col: str = "media") -> DataFrame:
    """One row per page of each file: (doc_id, page, width, height, samples, bits, compression, predictor, pixels, error).

    pixels: a byte a sample, two (little-endian) for 16 bits. Files are read one by one; repeated files each give their rows.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, data in zip(pdf["k"], pdf["m"], strict=True):
                n = 0
                try:
                    if not data:
                        raise ValueError("empty")
                    for n, (px, how) in enumerate(read_tiff(bytes(data))):
                        rows.append((key, n, px.shape[1], px.shape[0], px.shape[2], how["bits"], how["compression"], how["predictor"], px.tobytes(), None))
                except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as err:
                    rows.append((key, n, None, None, None, None, None, None, None, str(err) or type(err).__name__))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")], dtype=object)
            yield out

    return files.selectExpr(f"`{id_col}` AS k", f"`{data_col}` AS m").mapInPandas(pages, PAGE_SCHEMA)


# ---------------------------------------------------------------- texts as media
def text_payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT), len(raw)


def payload_tiff(payload: bytes) -> bytes:
    """The payload as grey pages of UNIT pixels a row and at most ROWS_PER_PAGE rows.

    Its checksum chooses how: LZW and PackBits for one payload in 16 each, else deflate with differencing, in tiles for one in 16.
    """
    a = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    how, tile = {0: (LZW, 0), 1: (PACKBITS, 0), 2: (DEFLATE, 64)}.get(zlib.crc32(payload) % 16, (DEFLATE, 0))
    return write_tiff([a[y : y + ROWS_PER_PAGE] for y in range(0, len(a), ROWS_PER_PAGE)], how, 1 if how == PACKBITS else 2, tile=tile)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a TIFF and read back: sizes, digests and features of what was read.

    Null and empty texts are one row of 255s. Repeated rows each get their row; equal texts get equal values; other
    columns are not read; a row is handled at a time, so memory follows the longest text.
    feature: pages, width, height, sum, least, greatest and number of distinct sample values, read back.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                payload, n = text_payload(text)
                media = payload_tiff(payload)
                got = [px for px, _ in read_tiff(media)]
                back = b"".join(px.tobytes() for px in got)
                hist = np.bincount(np.frombuffer(back, dtype=np.uint8), minlength=256)
                used = np.flatnonzero(hist)
                feature = f"p{len(got)};w{got[0].shape[1]};h{sum(p.shape[0] for p in got)};sum{int(hist @ np.arange(256))};min{used[0]};max{used[-1]};distinct{len(used)}"
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(got)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])
            out["doc_id"] = pdf["doc_id"].astype("Int64").to_numpy(dtype=object) if len(rows) else []
            yield out

    return docs.select("doc_id", "text").mapInPandas(digest, DIGEST_SCHEMA)
