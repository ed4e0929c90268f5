import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import tiff
from trawl.llm.common import table


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([b"aaaa", b"ab", b"\0" * 200, b"xyz"]), max_size=60).map(b"".join)))
def test_codecs_round_trip(data):
    assert tiff.packbits(tiff.pack_packbits(data), len(data)) == data
    assert tiff.lzw(tiff.pack_lzw(data), len(data)) == data


def test_lzw_beyond_one_dictionary():
    data = np.random.default_rng(0).integers(0, 256, 60000).astype(np.uint8).tobytes()
    assert tiff.lzw(tiff.pack_lzw(data), len(data)) == data


def slow_lzw(data, size):
    """Code by code, with a table of strings."""
    bits = "".join(f"{b:08b}" for b in data)
    out, table_, width, prev, at = b"", None, 9, None, 0
    table_ = [bytes([b]) for b in range(256)] + [b"", b""]
    while at + width <= len(bits) and len(out) < size:
        code = int(bits[at : at + width], 2)
        at += width
        if code == 257:
            break
        if code == 256:
            table_, width, prev = table_[:258], 9, None
            continue
        own = table_[code] if code < len(table_) else prev + prev[:1]
        out += own
        if prev is not None and len(table_) < 4096:
            table_.append(prev + own[:1])
            width = 9 if len(table_) + 1 < 512 else 10 if len(table_) + 1 < 1024 else 11 if len(table_) + 1 < 2048 else 12
        prev = own
    return out[:size]


def test_lzw_same_as_code_by_code():
    rng = np.random.default_rng(3)
    for n, top in ((0, 2), (1, 2), (300, 2), (5000, 3), (20_000, 256), (40_000, 12)):
        data = rng.integers(0, top, n).astype(np.uint8).tobytes()
        packed = tiff.pack_lzw(data)
        assert tiff.lzw(packed, n) == slow_lzw(packed, n) == data
        assert tiff.lzw(packed, n // 2) == data[: n // 2]
    # a table that is full and never cleared: 12 bits go on
    codes = [256, *([65] + [66, 67] * 3000)]
    width, bits, entries = 9, "", 257
    for k, c in enumerate(codes):
        bits += f"{c:0{width}b}"
        if k >= 1:
            entries = min(entries + 1, 4096)
            width = 9 if entries + 1 < 512 else 10 if entries + 1 < 1024 else 11 if entries + 1 < 2048 else 12
    packed = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.lzw(packed, 6001) == slow_lzw(packed, 6001) == bytes(codes[1:])
    with pytest.raises(ValueError):
        tiff.lzw(bytes([0x80, 0x7F, 0xFF, 0xFF]), 9)


def test_known_lzw_and_packbits():
    assert tiff.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 10) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    # the worked example of the TIFF specification
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", [1, 5, 8, 32773])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("dtype,predictor", [("u1", 1), ("u1", 2), ("u2", 2), ("i2", 1), ("u4", 2), ("f4", 3), ("f8", 3), ("f4", 1)])
def test_pages_round_trip(order, kind, tile, dtype, predictor):
    rng = np.random.default_rng(1)
    for shape in ((5, 7, 3), (33, 20, 1), (1, 1, 1)):
        img = (rng.normal(size=shape) * 50).astype(dtype)
        (row,) = tiff.pages_of(tiff.encode([(img, kind, predictor, tile)], order))
        assert row.get("error") is None
        assert row["pixels"] == img.astype(img.dtype.newbyteorder("<")).tobytes()
        assert (row["width"], row["height"], row["samples"], row["tiled"]) == (shape[1], shape[0], shape[2], bool(tile))


def ifd(tags, data=b"", big=False, order="<"):
    """A file of one directory whose values are all inline or in data, which follows the header."""
    head = struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16 + len(data)) if big else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8 + len(data))
    out = head + data + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags))
    for tag, (kind, count, value) in sorted(tags.items()):
        fmt = {1: "B", 3: "H", 4: "I"}[kind]
        raw = struct.pack(f"{order}{len(value)}{fmt}", *value).ljust(8 if big else 4, b"\0")
        out += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, kind, count) + raw
    return out + b"\0" * (8 if big else 4)


@pytest.mark.parametrize("big", [False, True])
def test_bits_planes_and_bigtiff(big):
    at = 16 if big else 8
    base = {256: (3, 1, [10]), 257: (3, 1, [2]), 273: (4, 1, [at]), 278: (3, 1, [2])}
    (one,) = tiff.pages_of(ifd(base | {279: (4, 1, [4])}, bytes([0b10110011, 0b01000000, 0b11111111, 0b10000000]), big))
    assert list(one["pixels"]) == [1, 0, 1, 1, 0, 0, 1, 1, 0, 1] + [1] * 9 + [0] and one["bits"] == 1
    flipped = bytes(int(f"{b:08b}"[::-1], 2) for b in [0b10110011, 0b01000000, 0b11111111, 0b10000000])
    assert tiff.pages_of(ifd(base | {279: (4, 1, [4]), 266: (3, 1, [2])}, flipped, big))[0]["pixels"] == one["pixels"]
    apart = {256: (3, 1, [2]), 257: (3, 1, [1]), 258: (3, 2, [8, 8]), 277: (3, 1, [2]), 284: (3, 1, [2]), 273: (3, 2, [at, at + 2]), 279: (3, 2, [2, 2]), 278: (3, 1, [1])}
    assert list(tiff.pages_of(ifd(apart, bytes([1, 2, 3, 4]), big))[0]["pixels"]) == [1, 3, 2, 4]


def test_bad_files():
    img = np.arange(100, dtype=np.uint8).reshape(10, 10, 1)
    good = tiff.encode([(img, 5, 2, None), (img, 8, 1, 16)])
    assert [r.get("error") for r in tiff.pages_of(good)] == [None, None]
    for k in range(0, len(good), 3):
        rows = tiff.pages_of(good[:k])
        assert rows and any(r.get("error") for r in rows)
        broken = bytearray(good)
        broken[k] ^= 0xFF
        tiff.pages_of(bytes(broken))
    loop = bytearray(tiff.encode([(img, 1, 1, None)]))
    loop[-4:] = loop[4:8]
    rows = tiff.pages_of(bytes(loop))
    assert rows[0].get("error") is None and "cycle" in rows[1]["error"]
    assert "not supported" in tiff.pages_of(good.replace(struct.pack("<HHII", 259, 4, 1, 5), struct.pack("<HHII", 259, 4, 1, 7)))[0]["error"]
    assert tiff.pages_of(b"")[0]["error"] == "not a TIFF file"


def test_table(spark):
    img = np.zeros((2000, 2000, 1), np.uint8)
    big = tiff.encode([(img, 8, 1, None), (img, 32773, 1, 512)])
    df = spark.createDataFrame([("a", big, 1), ("a", big, 1), (None, big, 1), ("b", None, 1), ("c", b"", 1), ("d", b"junk", 1)], "path string, content binary, width int")
    got = tiff.decode(df).collect()
    assert sorted((str(r.path), r.page_no, r.error) for r in got if r.error) == [("c", 0, "not a TIFF file"), ("d", 0, "not a TIFF file")]
    assert sorted(str(r.path) for r in got if not r.error) == ["None", "None", "a", "a", "a", "a"] and all(len(r.pixels) == 4_000_000 for r in got if not r.error)
    assert tiff.decode(df.limit(0)).count() == 0


def test_query_against_the_vectors(spark, sf_dir):
    want = {}
    for r in table(spark, sf_dir, "embeddings").collect():
        raw = np.array(r.embedding, "<f4").tobytes()
        n = len(r.embedding)
        want |= {(r.vec_id, 0): (raw, n, 1), (r.vec_id, 1): (raw, n, 1), (r.vec_id, 2): (raw, n, 4)}
    got = tiff.query(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        raw, width, height = want[r.vec_id, r.page_no]
        assert r.error is None and bytes.fromhex(r.pixels) == raw and (r.width, r.height) == (width, height)
        assert r.pixels_md5 == hashlib.md5(raw).hexdigest()
        assert r.pixel_sum == pytest.approx(float(np.frombuffer(raw, "<f4").astype(float).sum()) if r.page_no == 0 else sum(raw), rel=1e-9, abs=1e-6)
    assert {r.compression for r in got} == {"none", "lzw", "deflate", "packbits"} and {r.predictor for r in got} == {1, 2, 3}
