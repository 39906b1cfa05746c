"""Damaged, hostile and unusual TIFF files."""

import random
import struct
import zlib

import numpy as np
import pytest

from caselattice.llm import tiff


def one_page(fields, body=b""):
    """A little-endian file: body from byte 8, then one directory of fields {tag: (type, value)}."""
    entries = b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<H" if k == 3 else "<I", v).ljust(4, b"\0") for t, (k, v) in sorted(fields.items()))
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"


BODY = bytes(range(24))
GOOD = {256: (4, 4), 257: (4, 2), 258: (3, 8), 259: (3, 1), 273: (4, 8), 277: (3, 3), 278: (4, 2), 279: (4, 24)}


@pytest.mark.parametrize("change", [
    {278: (4, 0)}, {256: (4, 0)}, {257: (4, 0)}, {277: (3, 0)}, {256: (4, 1 << 31), 257: (4, 1 << 31)}, {256: (4, 60_000), 257: (4, 60_000)}, {317: (3, 3)}, {258: (3, 12)},
    {259: (3, 7)}, {279: (4, 5)}, {273: (4, 1 << 30)}, {259: (3, 5)}, {259: (3, 8)}, {322: (4, 0), 323: (4, 16), 324: (4, 8), 325: (4, 24)}, {257: (4, 200)},
])
def test_bad_fields_are_an_error_of_the_row(spark, change):
    df = spark.createDataFrame([(1, one_page(GOOD | change, BODY)), (2, one_page(GOOD, BODY))], "doc_id long, media binary")
    rows = {r.doc_id: r for r in tiff.tiff_pages(df).collect()}
    assert rows[1].error and rows[1].page is None
    assert rows[2].error is None and rows[2].pixels == BODY


def test_any_damage_gives_rows_and_no_crash():
    rng = random.Random(4)
    good = tiff.encode([np.full((40, 64, 3), 7, np.uint8)] * 2, tiff.LZW, tile=16)
    for _ in range(400):
        bad = bytearray(good[: rng.choice([len(good), rng.randrange(len(good))])])
        for _ in range(rng.randint(1, 6)):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            for _, image in tiff.decode(bytes(bad), most_bytes=1 << 22):
                assert image.nbytes <= 1 << 22
        except Exception as e:
            assert not isinstance(e, MemoryError)


def test_bombs_are_not_inflated_beyond_their_strip():
    bomb = zlib.compress(b"\0" * 50_000_000)
    image = next(tiff.decode(one_page(GOOD | {259: (3, 8), 279: (4, len(bomb))}, bomb)))[1]
    assert image.nbytes == 24 and len(tiff.inflate(bomb, 24)) == 24
    assert len(tiff.packbits_decode(b"\x81a" * 1000, 300)) < 600 and len(tiff.lzw_decode(tiff.lzw_encode(b"a" * 12_000_000), 1000)) < 8_000_000


@pytest.mark.parametrize("bits,width", [(1, 13), (2, 7), (4, 5), (16, 4)])
@pytest.mark.parametrize("kind", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_other_depths(bits, width, kind):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (6, width, 1))
    if bits == 16:
        raw = image.astype("<u2").tobytes()
    else:
        each = ((image[:, :, 0, None] >> np.arange(bits - 1, -1, -1)) & 1).reshape(6, -1).astype(np.uint8)
        raw = np.packbits(each, axis=1).tobytes()
    body = tiff.PACK[kind](raw)
    f = {256: (4, width), 257: (4, 6), 258: (3, bits), 259: (3, kind), 273: (4, 8), 277: (3, 1), 278: (4, 6), 279: (4, len(body))}
    got = next(tiff.decode(one_page(f, body)))[1]
    assert (got == image).all() and tiff.features(got).startswith(f"{width}x6x1")


def test_long_texts_meet_every_coding():
    rng, seen = random.Random(9), set()
    for n in range(60):
        text = " ".join(rng.choices(["alpha", "beta", "gamma", "é"], k=2000 + n))
        (fields, image), = tiff.decode(tiff.text_image(text))
        seen.add((fields[tiff.COMPRESSION][0], tiff.TILES in fields, fields[tiff.PREDICTOR][0]))
        data = text.encode()
        assert image.tobytes() == data + b" " * (-len(data) % 192)
    assert {k for k, _, _ in seen} == {tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE} and len(seen) > 10


def test_lzw_without_clear_codes_and_over_many_tables():
    data = bytes(random.Random(2).choices(range(256), k=200_000))
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)[:5000]) == data[: len(tiff.lzw_decode(tiff.lzw_encode(data)[:5000]))]


def test_many_pages_come_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(tiff, "HELD_BYTES", 100)
    pages = [np.full((8, 8, 1), k, np.uint8) for k in range(20)]
    df = spark.createDataFrame([(1, tiff.encode(pages)), (2, tiff.encode(pages)[:-30])], "doc_id long, media binary")
    rows = tiff.tiff_pages(df).collect()
    assert [r.page for r in rows if r.doc_id == 1] == list(range(20)) and rows[5].pixels == bytes([5]) * 64
    assert any(r.error for r in rows if r.doc_id == 2)
