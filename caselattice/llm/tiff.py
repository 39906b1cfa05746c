"""Media columns: TIFF.

``decode`` walks a file's image directories, undoes PackBits, LZW or deflate in strips or tiles and the horizontal
predictor, and gives one image a page. ``encode`` writes such files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .quality_rules import pieces

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Bytes of each field type, and its struct code.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
CLEAR, END, FIRST, FULL = 256, 257, 258, 4094
#: The largest page that is decoded, in bytes; a larger one is an error of its file (it would not fit a worker).
MOST_BYTES = 1 << 28


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(stop: int) -> None:
        for k in range(at, stop, 128):
            part = data[k:min(k + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literal(m.start())
        out += bytes([257 - len(m[0]), m[1][0]])
        at = m.end()
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """At least ``most`` bytes of what data holds, or all of it."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1:i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1:i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def code_widths(since: np.ndarray) -> np.ndarray:
    """Bits of the codes at these places after the last clear code (the code after it is 0): one more as soon as the table needs it."""
    free = since + FIRST
    return 9 + (free >= 512) + (free >= 1024) + (free >= 2048)


def lzw_encode(data: bytes) -> bytes:
    codes: list[int] = [CLEAR]
    add, table, free = codes.append, {}, FIRST
    get, it = table.get, iter(data)
    w = next(it, None)
    for c in it:  # a known string is its code; a longer one is keyed by code and next byte
        key = w << 8 | c
        n = get(key)
        if n is not None:
            w = n
            continue
        add(w)
        table[key] = free
        free += 1
        w = c
        if free == FULL:
            add(CLEAR)
            table.clear()
            free = FIRST
    if w is not None:
        add(w)
        if free + 1 == FULL:
            add(CLEAR)
    add(END)
    found = np.array(codes, np.int64)
    at = np.arange(len(found))
    clears = np.maximum.accumulate(np.where(found == CLEAR, at, 0))
    widths = code_widths(at - np.concatenate(([0], clears[:-1])) - 1)
    place = np.arange(12)
    bits = found[:, None] >> np.maximum(widths[:, None] - 1 - place, 0) & 1
    return np.packbits(bits[place < widths[:, None]].astype(np.uint8)).tobytes()


_START = [bytes([i]) for i in range(256)] + [b"", b""]
_WIDTHS = code_widths(np.arange(FULL))
_PLACES = np.concatenate(([0], np.cumsum(_WIDTHS)))


def lzw_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """At least ``most`` bytes of what data holds, or all of it. Codes are cut out a table's length at a time."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    window, n_bits = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:], 8 * len(data)
    out: list[bytes] = []
    table, last, pos, since, size = list(_START), None, 0, 0, 0
    while pos < n_bits and size < most:
        if since < FULL:
            places, widths = _PLACES[since:-1] - _PLACES[since] + pos, _WIDTHS[since:]
        else:  # a full table that was not cleared
            places, widths = pos + 12 * np.arange(FULL), np.full(FULL, 12)
        whole = int(np.searchsorted(places + widths, n_bits, side="right"))
        if not whole:
            break
        places, widths = places[:whole], widths[:whole]
        codes = window[places >> 3] >> (24 - (places & 7) - widths) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stops[0]) if len(stops) else whole
        begin = len(out)
        for code in codes[:n].tolist():
            if last is None:
                piece = _START[code]
            else:
                if code < len(table):
                    piece = table[code]
                elif code == len(table):
                    piece = last + last[:1]
                else:
                    raise ValueError(f"code {code} in a table of {len(table)}")
                if len(table) < 4096:
                    table.append(last + piece[:1])
            out.append(piece)
            last = piece
        size += sum(map(len, out[begin:]))
        since += n
        if len(stops):
            if codes[n] == END:
                break
            table, last, since = list(_START), None, 0
            n += 1
        pos = int(places[n - 1] + widths[n - 1])
    return b"".join(out)


def inflate(data: bytes, most: int = MOST_BYTES) -> bytes:
    return zlib.decompressobj().decompress(data, most)


PACK = {NONE: lambda d: d, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}
UNPACK = {NONE: lambda d, most: d, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}


def encode(pages: list[np.ndarray], compression: int = DEFLATE, tile: int | tuple[int, int] = 0, predictor: int = 1, strip_bytes: int = 1 << 16) -> bytes:
    """A TIFF of 8-bit images (height, width, samples); strips of about strip_bytes, or tiles of tile pixels (rows and columns, multiples of 16)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    th, tw = tile if isinstance(tile, tuple) else (tile, tile)
    for image in pages:
        h, w, s = image.shape
        rows = th or max(1, strip_bytes // (w * s))
        if th:
            padded = np.pad(image, ((0, -h % th), (0, -w % tw), (0, 0)), mode="edge")
            parts = [padded[y:y + th, x:x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            parts = [image[y:y + rows] for y in range(0, h, rows)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = part.copy()
                part[:, 1:] -= part[:, :-1].copy()
            data = PACK[compression](part.tobytes())
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * s), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if s == 3 else 1]), SAMPLES: (3, [s]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILES: (4, offsets), TILE_BYTES: (4, sizes)} if th else {STRIPS: (4, offsets), ROWS: (4, [rows]), STRIP_BYTES: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
            if len(data) > 4:
                where = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory, classic or of 64-bit offsets. Fields that reach beyond the file are an error."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version not in (42, 43):
        raise ValueError(f"not a TIFF: version {version}")
    big = version == 43
    at, seen = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        if n * (20 if big else 12) > len(data) - at:
            raise ValueError(f"a directory of {n} fields reaches beyond the file")
        fields = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at)
            count = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
            where, inline = (at + 12, 8) if big else (at + 8, 4)
            size, code = TYPES.get(kind, (1, "B"))
            if size * count > inline:
                where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
            if where + size * count > len(data):
                raise ValueError(f"field {tag} reaches beyond the file")
            if kind != 2:
                fields[tag] = struct.unpack_from(f"{order}{count}{code}" if len(code) == 1 else order + code * count, data, where)
            at += 20 if big else 12
        yield order, fields
        at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _samples(raw: bytes, rows: int, across: int, deep: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """A strip's or tile's samples (rows, across, deep). Rows of samples under a byte end at a byte."""
    row_bytes = -(-across * deep * bits // 8)
    if len(raw) < rows * row_bytes:
        raise ValueError(f"{len(raw)} bytes where {rows * row_bytes} are needed")
    flat = np.frombuffer(raw, np.uint8, rows * row_bytes).reshape(rows, row_bytes)
    if bits == 16:
        part = flat.view(order + "u2").astype(np.uint16).reshape(rows, across, deep)
    elif bits == 8:
        part = flat.reshape(rows, across, deep)
    else:
        part = np.unpackbits(flat, axis=1)
        if bits > 1:
            part = np.packbits(part.reshape(rows, -1, bits), axis=2)[:, :, 0] >> (8 - bits)
        part = part[:, : across * deep].reshape(rows, across, deep)
    return np.cumsum(part, axis=1, dtype=part.dtype) if predictor == 2 else part


def decode(data: bytes, most_bytes: int = MOST_BYTES) -> Iterator[tuple[dict[int, tuple], np.ndarray]]:
    """Fields and image (height, width, samples) of each page: of bytes, or of 16-bit numbers where samples have 16 bits.

    Samples of 1, 2, 4, 8 or 16 bits. A page of more than most_bytes, without extent, with missing or short strips, or
    with a coding or predictor that isn't known is an error.
    """
    for order, f in directories(data):
        one = lambda tag, default=None, f=f: (f.get(tag) or (default,))[0]
        w, h, s, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PREDICTOR, 1)
        depths = set(f.get(BITS, (1,)))
        bits = next(iter(depths), 0)
        if len(depths) != 1 or bits not in (1, 2, 4, 8, 16):
            raise ValueError(f"{f.get(BITS)} bits a sample; 1, 2, 4, 8 and 16 are supported")
        if predictor not in (1, 2) or predictor == 2 and bits < 8:
            raise ValueError(f"predictor {predictor} at {bits} bits is not supported")
        undo = UNPACK.get(one(COMPRESSION, 1))
        if undo is None:
            raise ValueError(f"compression {one(COMPRESSION)} is not supported")
        planes = s if one(PLANAR, 1) == 2 else 1
        tiled = TILES in f
        tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS, h), h))
        if min(w, h, s, tw, th) < 1:
            raise ValueError(f"no extent: {w} x {h} pixels of {s} samples, {tw} x {th} a part")
        wide = 2 if bits == 16 else 1
        across, down = -(-w // tw), -(-h // th)
        if w * h * s * wide > most_bytes or across * tw * th * s * wide > most_bytes:
            raise ValueError(f"{w} x {h} pixels of {s} samples are more than {most_bytes} bytes")
        deep = s // planes
        offsets, sizes = (f[TILES], f[TILE_BYTES]) if tiled else (f[STRIPS], f[STRIP_BYTES])
        if min(len(offsets), len(sizes)) < planes * across * down:
            raise ValueError(f"{len(offsets)} parts where {planes * across * down} are needed")
        image = np.zeros((h, w, s), np.uint16 if bits == 16 else np.uint8)
        for k, (at, size) in enumerate(zip(offsets[: planes * across * down], sizes)):
            plane, rest = divmod(k, across * down)
            y, x = rest // across * th, rest % across * tw
            rows = th if tiled else min(th, h - y)
            raw = data[at:at + size]
            if one(FILL_ORDER, 1) == 2:
                raw = raw.translate(_REVERSED)
            raw = undo(raw, rows * -(-tw * deep * bits // 8))
            image[y:y + rows, x:x + tw, plane * deep:(plane + 1) * deep] = _samples(raw, rows, tw, deep, bits, order, predictor)[: h - y, : w - x]
        yield f, image


def features(image: np.ndarray) -> str:
    """Size, mean and deviation of each sample, entropy, and an 8 x 8 average hash of brightness. 16-bit samples count by their high bytes."""
    if image.dtype == np.uint16:
        image = (image >> 8).astype(np.uint8)
    h, w, s = image.shape
    flat = image.reshape(-1, s).astype(np.float32)
    counts = np.bincount(image.ravel(), minlength=256)
    share = counts[counts > 0] / image.size
    grey = image.mean(axis=2, dtype=np.float64)
    cells = np.add.reduceat(np.add.reduceat(grey, np.arange(8) * h // 8 if h >= 8 else np.arange(h), axis=0), np.arange(8) * w // 8 if w >= 8 else np.arange(w), axis=1)
    bits = "".join("1" if c else "0" for c in (cells > cells.mean()).ravel())
    numbers = lambda v: ",".join(f"{x:.3f}" for x in v)
    mean = flat.mean(axis=0, dtype=np.float64)
    dev = np.sqrt(np.maximum((flat * flat).mean(axis=0, dtype=np.float64) - mean**2, 0))
    return f"{w}x{h}x{s} mean {numbers(mean)} dev {numbers(dev)} entropy {float(-(share * np.log2(share)).sum()):.4f} ahash {int(bits, 2):x}"


PAGE = "page int, width int, height int, samples int, compression int, pixels binary, feature string, error string"
#: Pixels that are held before rows are passed on.
HELD_BYTES = 4 << 20


def tiff_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row a page: the columns of df, then page (from 0), width, height, samples, compression, pixels, feature and error.

    pixels: rows from the top, samples side by side, a byte each, or two (little-endian) of 16 bits. A null or empty file
    gives one row with page null and no error; a damaged or unsupported file the pages before the damage, then one row
    with page null and the error, whatever is wrong with it. Pages are passed on as they are decoded, so that a file of
    any number of pages needs the memory of a few. Rows are independent, so repeated ones give equal pages. An
    empty table gives an empty result. Columns of df with a page column's name are left out.
    """
    names = [c.split()[0] for c in PAGE.split(", ")]
    df = df.drop(*names)
    cols = df.columns
    types = [pa.int32()] * 5 + [pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, media_col):
                row, found, held = [], [], 0

                def batch(b=b) -> pa.RecordBatch:
                    page = [pa.array([x[j] for x in found], t) for j, t in enumerate(types)]
                    return pa.RecordBatch.from_arrays([*b.take(pa.array(row, pa.int64())).columns, *page], names=[*cols, *names])

                for i in range(b.num_rows):
                    data, k, bad = b[media_col][i].as_py(), 0, None
                    images = decode(data) if data else iter(())
                    while True:
                        try:
                            f, image = next(images)
                            h, w, s = image.shape
                            pixels = image.astype("<u2").tobytes() if image.dtype == np.uint16 else image.tobytes()
                            new = (k, w, h, s, int(f.get(COMPRESSION, (1,))[0]), pixels, features(image), None)
                        except StopIteration:
                            break
                        except Exception as e:  # one file's fault is a row, never the job's
                            bad = f"{type(e).__name__}: {e}"[:200]
                            break
                        row.append(i)
                        found.append(new)
                        k, held = k + 1, held + len(pixels)
                        if held > HELD_BYTES:
                            yield batch()
                            row, found, held = [], [], 0
                    if bad or not k:
                        row.append(i)
                        found.append((None,) * 7 + (bad,))
                if row:
                    yield batch()

    schema = df.select(*cols, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in PAGE.split(", ")]).schema
    return df.mapInArrow(run, schema)


def text_image(text: str | None) -> bytes:
    """A text's bytes, padded with spaces to a positive multiple of 192, as rows of 64 pixels of 3 samples in a TIFF.

    The checksum of these bytes decides, at every size alike, between the four codings, between strips and tiles, and
    whether the predictor is used. A null text counts as empty.
    """
    data = (text or "").encode()
    data += b" " * (-len(data) % 192 if data else 192)
    image, dice = np.frombuffer(data, np.uint8).reshape(-1, 64, 3), crc32(data)
    return encode([image], (NONE, PACKBITS, LZW, DEFLATE)[dice % 4], tile=(16, 64) if dice >> 2 & 1 else 0, predictor=1 + (dice >> 3 & 1))


def with_images(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``media`` (its text_image, replacing a column of that name) in place of the text.

    Null and empty texts are an image of spaces, texts of any length are taken whole, repeated rows give equal images and an
    empty table an empty one.
    """
    docs = docs.drop("media")
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, text_col):
                yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array([text_image(t) for t in b[text_col].to_pylist()], pa.binary())], names=[*keep, "media"])

    return docs.mapInArrow(run, docs.select(*keep, F.lit(b"").alias("media")).schema)


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    pages = tiff_pages(with_images(docs))
    return pages.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES = {"op7_tiff": op7_tiff}
ORACLE: dict[str, str] = {}
