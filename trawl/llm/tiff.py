"""TIFF images in a binary column: one row per page, decoded."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import table

#: Bytes per value of the field types 1 to 18.
_SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4, 0, 0, 8, 8, 8)
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 13: "I", 18: "Q"}
NAMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
#: What a binary value of Spark can hold: samples of more bytes can't be a column, so such a page has an error instead.
VALUE_BYTES = (1 << 31) - 1


def packbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def _lzw_places() -> tuple[np.ndarray, np.ndarray]:
    """The width of the k-th code after a clear, and the bits before it: the table grows with each code, so both follow from k."""
    k = np.arange(4096)
    width = np.clip(np.floor(np.log2(258 + k)).astype(np.int64) + 1, 9, 12)
    width[0] = 9
    return width, np.concatenate([[0], np.cumsum(width)[:-1]])


_WIDTHS, _BEFORE = _lzw_places()


def _lzw_codes(data: np.ndarray, n_bits: int, at: int, k: int) -> np.ndarray:
    """Codes from bit `at` on, the first being the k-th after a clear, as if no clear came; data is followed by three bytes."""
    most = (n_bits - at) // 9 + 1
    width, before = (_WIDTHS[k : k + most], at + _BEFORE[k : k + most] - _BEFORE[k]) if k < 4096 else (np.full(min(most, 4096), 12), at + 12 * np.arange(min(most, 4096)))
    n = int(np.searchsorted(before + width, n_bits, "right"))
    width, before = width[:n], before[:n]
    i = before >> 3
    held = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
    return held >> (24 - (before & 7) - width) & ((1 << width) - 1)


def lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first, wider one code early; 256 clears, 257 ends.

    All codes up to the next clear are cut out at once. A code of the table stands for what an earlier code wrote and the byte after it, so it
    is copied from there, and no table is kept.
    """
    bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    out, at, n_bits = bytearray(), 0, len(data) * 8
    starts: list[int] = []
    while True:
        k = len(starts)
        codes = _lzw_codes(bits, n_bits, at, k)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        for c in codes[:n].tolist():
            here = len(out)
            starts.append(here)
            if c < 256:
                out.append(c)
            elif c - 257 < k:
                out += out[starts[c - 258] : starts[c - 257] + 1]
            elif c - 257 == k and k:
                first = starts[c - 258]
                out += out[first:here]
                out.append(out[first])
            else:
                raise ValueError("bad LZW code")
            if len(out) >= size:
                return bytes(out[:size])
            k += 1
        if not len(codes) or (len(stop) and codes[n] == 257):
            return bytes(out)
        if len(stop):
            at, starts = _after(at, k - n, k), []
        else:
            at = _after(at, k - n, k - 1)


def _after(at: int, first: int, last: int) -> int:
    """The bit after the last code, if the first one (both counted from a clear) begins at bit at."""
    own = min(last + 1, 4096) - min(first, 4096)
    return at + int(_WIDTHS[min(first, 4096) : min(first, 4096) + own].sum()) + 12 * (last + 1 - first - own)


def _decode(kind: int, data: bytes, size: int) -> bytes:
    if kind == 1:
        return data[:size]
    if kind == 5:
        return lzw(data, size)
    if kind == 32773:
        return packbits(data, size)
    if kind in (8, 32946):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {kind} is not supported")


def _rows(raw: bytes, height: int, width: int, planes: int, bits: int, form: int, order: str, predictor: int) -> np.ndarray:
    """height x width x planes samples of one strip or tile, its predictor undone."""
    per_row = (width * planes * bits + 7) // 8
    if len(raw) < per_row * height:
        raise ValueError("strip or tile ends early")
    data = np.frombuffer(raw, np.uint8, per_row * height).reshape(height, per_row)
    if predictor == 3:
        if form != 3 or bits not in (16, 32, 64):
            raise ValueError("predictor 3 needs floating point")
        n = bits // 8
        # bytes are differenced over the whole row, then stored by significance, the highest first
        flat = data.reshape(height, -1, planes)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(height, n, width * planes)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">f{n}").reshape(height, width, planes)
    if bits < 8:
        if bits not in (1, 2, 4):
            raise ValueError(f"{bits} bits per sample are not supported")
        all_bits = np.unpackbits(data, axis=1)[:, : width * planes * bits].reshape(height, width * planes, bits)
        out = (all_bits * (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)).sum(axis=2, dtype=np.uint8).reshape(height, width, planes)
    else:
        if bits not in (8, 16, 32, 64) or (form == 3 and bits == 8):
            raise ValueError(f"{bits} bits per sample are not supported")
        out = data.view(f"{order}{'f' if form == 3 else 'i' if form == 2 else 'u'}{bits // 8}").reshape(height, width, planes)
    if predictor == 2:
        if form == 3 or bits < 8:
            raise ValueError("predictor 2 needs whole bytes")
        return np.cumsum(out, axis=1, dtype=out.dtype.newbyteorder("="))
    return out


def _value(data: bytes, order: str, kind: int, count: int, at: int) -> tuple:
    if kind not in _CODES:
        return (data[at : at + count],)
    got = data[at : at + count * _SIZES[kind]]
    return struct.unpack(f"{order}{len(got) // _SIZES[kind]}{_CODES[kind]}", got[: len(got) // _SIZES[kind] * _SIZES[kind]])


def directories(data: bytes):
    """(offset, {tag: values}) of each image directory, in the order of the chain; raises ValueError where it breaks."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    magic = struct.unpack(f"{order}H", data[2:4])[0]
    if magic not in (42, 43) or (magic == 43 and len(data) < 16):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", data[8:16])[0] if big else struct.unpack(f"{order}I", data[4:8])[0]
    count_size, entry, inline, ptr = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a cycle")
        seen.add(at)
        if at + count_size > len(data):
            raise ValueError("directory beyond the end of the file")
        n = int.from_bytes(data[at : at + count_size], "little" if order == "<" else "big")
        end = at + count_size + n * entry
        if end + inline > len(data):
            raise ValueError("directory beyond the end of the file")
        tags = {}
        for k in range(n):
            p = at + count_size + k * entry
            tag, kind = struct.unpack(f"{order}HH", data[p : p + 4])
            count = struct.unpack(f"{order}{ptr}", data[p + 4 : p + 4 + inline])[0]
            size = count * (_SIZES[kind] if kind < len(_SIZES) else 0)
            place = p + 4 + inline
            if size > inline:
                place = struct.unpack(f"{order}{ptr}", data[place : place + inline])[0]
            if size and place + size <= len(data):
                tags[tag] = _value(data, order, kind, count, place)
        yield at, order, tags
        at = struct.unpack(f"{order}{ptr}", data[end : end + inline])[0]


def decode_page(data: bytes, order: str, tags: dict) -> np.ndarray:
    """height x width x samples of the page of one directory."""
    get = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height = get(256), get(257)
    if not width or not height:
        raise ValueError("no width or height")
    planes, kind, predictor = get(277, 1), get(259, 1), get(317, 1)
    bits, form = tags.get(258, (1,)), get(339, 1)
    if len(set(bits)) != 1:
        raise ValueError("samples of different bits are not supported")
    bits = bits[0]
    if width * height * planes * max(bits, 8) // 8 > VALUE_BYTES:
        raise ValueError("page is too large for one value")
    if predictor not in (1, 2, 3):
        raise ValueError(f"predictor {predictor} is not supported")
    apart = get(284, 1) == 2 and planes > 1
    tiled = 322 in tags
    tile_w, tile_h = (get(322), get(323, 0)) if tiled else (width, min(get(278, height), height))
    offsets, sizes = tags.get(324 if tiled else 273), tags.get(325 if tiled else 279)
    if not offsets or not tile_w or not tile_h:
        raise ValueError("no strips or tiles")
    sizes = sizes or (len(data),) * len(offsets)
    across, down = -(-width // tile_w), -(-height // tile_h)
    own = 1 if apart else planes
    if len(offsets) < across * down * (planes if apart else 1) or len(sizes) < len(offsets):
        raise ValueError("strips or tiles are missing")
    out = None
    for k in range(across * down * (planes if apart else 1)):
        plane, place = divmod(k, across * down)
        y, x = divmod(place, across)
        rows = tile_h if tiled else min(tile_h, height - y * tile_h)
        raw = data[offsets[k] : offsets[k] + sizes[k]]
        if get(266, 1) == 2 and kind == 1:
            raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 1), axis=1)[:, ::-1], axis=1).tobytes()
        raw = _decode(kind, raw, (tile_w * own * bits + 7) // 8 * rows)
        part = _rows(raw, rows, tile_w, own, bits, form, order, predictor)
        if out is None:
            out = np.zeros((height, width, planes), part.dtype.newbyteorder("="))
        here = part[: height - y * tile_h, : width - x * tile_w]
        out[y * tile_h : y * tile_h + here.shape[0], x * tile_w : x * tile_w + here.shape[1], plane if apart else slice(None)] = here[:, :, 0] if apart else here
    return out


_SCHEMA = [
    ("page_no", "int"), ("width", "int"), ("height", "int"), ("samples", "int"), ("bits", "int"), ("sample_format", "string"), ("compression", "string"),
    ("predictor", "int"), ("tiled", "boolean"), ("pixel_sum", "double"), ("pixels_md5", "string"), ("pixels", "binary"), ("error", "string"),
]
_ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}


def pages_of(data: bytes) -> list[dict]:
    """A row for each page, decoded or with an error; never raises."""
    out: list[dict] = []
    try:
        for _, order, tags in directories(data):
            get = lambda tag, default=None, tags=tags: tags[tag][0] if tag in tags else default
            row = {
                "page_no": len(out), "width": get(256), "height": get(257), "samples": get(277, 1), "bits": get(258, 1), "sample_format": {1: "uint", 2: "int", 3: "float"}.get(get(339, 1), "other"),
                "compression": NAMES.get(get(259, 1), str(get(259, 1))), "predictor": get(317, 1), "tiled": 322 in tags,
            }
            try:
                img = decode_page(data, order, tags)
                raw = img.astype(img.dtype.newbyteorder("<")).tobytes()
                row |= {"pixels": raw, "pixels_md5": hashlib.md5(raw).hexdigest(), "pixel_sum": float(img.sum(dtype=np.float64))}
            except (ValueError, TypeError, IndexError, zlib.error, struct.error, MemoryError, OverflowError) as e:
                row["error"] = str(e) or type(e).__name__
            out.append(row)
    except (ValueError, struct.error) as e:
        out.append({"page_no": len(out), "error": str(e)})
    for row in out:
        for name in ("width", "height"):
            if not isinstance(row.get(name), int) or row[name] >= 1 << 31:
                row[name] = None
    return out


def decode(images: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per page of the TIFF files in content (binary), with their key.

    Both byte orders, classic and BigTIFF; strips and tiles, planes together or apart; 1, 2, 4, 8, 16, 32 and 64 bits as unsigned,
    signed or floating point; no compression, PackBits, LZW and deflate; predictors 2 (differences) and 3 (floating point).
    pixels holds the samples row by row, low byte first, samples of under 8 bits in a byte each; pixels_md5 and pixel_sum are over them.

    A page that can't be decoded, or whose samples are more than one binary value can hold (2 GB), has its tags and an error, and the pages after it go on. A chain of directories that breaks, or content
    that is no TIFF, ends with a row of page_no and error. Null content gives no rows, empty content an error row; repeated rows are decoded
    each; a null key stays null; other columns are ignored; an empty table gives an empty table.
    """
    own = images.where(F.col(content).isNotNull()).select(F.col(key).alias("__key"), F.col(content).alias("__content"))
    kind = own.schema["__key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, rows, held = [], [], 0
            for i, data in enumerate(batch.column(1)):
                for r in pages_of(data.as_py()):
                    at.append(i)
                    rows.append(r)
                    held += len(r.get("pixels") or b"")
                    if held > 1 << 26:  # what is sent at once stays small
                        yield out(batch, at, rows)
                        at, rows, held = [], [], 0
            yield out(batch, at, rows)

    def out(batch, at, rows):
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in _SCHEMA)], [key, *(n for n, _ in _SCHEMA)])

    return own.mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{n} {t}" for n, t in _SCHEMA)]))


# what follows writes TIFF files, for tables that hold none


def pack_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while i + run < len(data) and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i
        while j < len(data) and j - i < 128 and not (j + 2 < len(data) and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    codes, widths, width, next_code = [256], [9], 9, 258
    known: dict[int, int] = {}
    own = data[0] if data else None
    for b in data[1:]:
        pair = own << 8 | b
        if (more := known.get(pair)) is not None:
            own = more
            continue
        codes.append(own)
        widths.append(width)
        known[pair] = next_code
        next_code += 1
        if next_code == 4094:
            codes.append(256)
            widths.append(width)
            known, width, next_code = {}, 9, 258
        elif next_code >= 1 << width:
            width += 1
        own = b
    if own is not None:
        codes.append(own)
        widths.append(width)
        if next_code + 1 >= 1 << width and width < 12:
            width += 1
    spelled = np.unpackbits(np.array([*codes, 257], ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(spelled[np.arange(16) >= 16 - np.array([*widths, width])[:, None]]).tobytes()


def encode(images: list[tuple], order: str = "<") -> bytes:
    """A TIFF file of pages (array of height x width x samples, compression, predictor, tile size or None)."""
    body, last = bytearray(b"II*\0\0\0\0\0" if order == "<" else b"MM\0*\0\0\0\0"), 4
    pack = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_packbits}
    for img, kind, predictor, tile in images:
        height, width, planes = img.shape
        bits, form = img.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[img.dtype.kind]
        th, tw = (tile, tile) if tile else (max(1, height // 2), width)
        offsets, sizes = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                part = img[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=part.dtype.type(0))
                if predictor == 3:
                    split = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(part.shape[0], -1, part.dtype.itemsize)
                    flat = np.ascontiguousarray(split.transpose(0, 2, 1)).reshape(part.shape[0], -1, planes)
                    raw = np.diff(flat, axis=1, prepend=np.uint8(0)).tobytes()
                else:
                    raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                packed = pack[kind](raw)
                offsets.append(len(body))
                sizes.append(len(packed))
                body += packed + b"\0" * (len(packed) % 2)
        tags = {256: [width], 257: [height], 258: [bits] * planes, 259: [kind], 262: [1], 277: [planes], 284: [1], 317: [predictor], 339: [form] * planes}
        tags |= {322: [tw], 323: [th], 324: offsets, 325: sizes} if tile else {273: offsets, 278: [th], 279: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}I", *values)
            if len(raw) > 4:
                at = len(body)
                body += raw
                raw = struct.pack(f"{order}I", at)
            entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + raw
        body[last : last + 4] = struct.pack(f"{order}I", len(body))
        body += struct.pack(f"{order}H", len(tags)) + entries
        last = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def tiff_of_embeddings(embeddings: DataFrame) -> DataFrame:
    """(vec_id, content): each vector as a TIFF of three pages: the floats, and their bytes in one row and as a square of tiles.

    Byte order, compression and predictor go by vec_id. A null vector has no image; nulls in it are 0.
    """
    own = embeddings.where("embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", "embedding")

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for i, v in zip(ids.to_pylist(), batch.column(1).to_pylist()):
                x, k = np.array([0 if y is None else y for y in v], "<f4"), i or 0
                kinds = (1, 5, 8, 32773)
                raw = np.frombuffer(x.tobytes(), np.uint8)
                images = [(x.reshape(1, -1, 1), kinds[k % 4], 3 if k % 2 else 1, None), (raw.reshape(1, -1, 4), kinds[(k + 1) % 4], 2, None), (raw.reshape(4, -1, 1), kinds[(k + 2) % 4], 1 + k % 2, 16)]
                out.append(encode(images, "<>"[k // 2 % 2]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["vec_id", "content"])

    return own.mapInArrow(run, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, content binary")


def query(spark, sf_dir):
    found = decode(tiff_of_embeddings(table(spark, sf_dir, "embeddings")), key="vec_id")
    # the samples as text: pages of one file hold the same bytes in three shapes
    return found.withColumn("pixels", F.lower(F.hex("pixels")))
