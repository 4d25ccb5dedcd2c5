"""Media columns: TIFF images, walked and decoded to one row per page.

:func:`read_pages` follows the chain of image directories, decodes uncompressed, PackBits, LZW and deflate strips
and tiles, undoes horizontal and floating-point predictors and returns arrays of height x width x samples.
:func:`write_tiff` writes the same choices. Both byte orders are read.

Edge cases: null media gives no page; bytes that are not a readable TIFF give one row with ``page`` null and the
reason in ``error``, so a broken file never fails the job; a cyclic chain of directories is an error; for
:func:`store_texts` a null text is empty, a null ``doc_id`` stays null, repeated rows are stored each, and
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
#: Samples an image directory may claim; a page beyond that is an error, not an allocation.
MAX_SAMPLES = 1 << 30
STRIP = 1 << 16


class TiffError(ValueError):
    """The bytes are not a TIFF that can be decoded."""


@dataclass
class Page:
    pixels: np.ndarray  # height x width x samples
    compression: int
    predictor: int
    tiled: bool


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n, plain = bytearray(), 0, len(data), 0
    def flush(a: int, z: int) -> None:
        for k in range(a, z, 128):
            part = data[k : min(z, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush(plain, i)
            out += bytes([257 - (j - i), data[i]])
            plain = j
        i = j
    flush(plain, n)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """The variant of TIFF 6: most significant bit first, widths grow one code early."""
    out, bits, held, width, last = [], 0, 0, 9, None
    table: list[bytes] = []
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        if not table:
            raise TiffError("LZW data begins without a clear code")
        if last is None:
            if code > 255:
                raise TiffError("LZW code out of range")
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1
    put(256)
    table = {bytes([k]): k for k in range(256)}
    size, now = 258, b""
    for k in range(len(data)):
        more = data[k : k + 1]
        if now + more in table:
            now += more
            continue
        put(table[now])
        table[now + more] = size
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        now = more
    if now:
        put(table[now])
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _unpacked(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    if kind == LZW:
        return lzw_decode(data)
    if kind in (DEFLATE, 32946):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    if kind == PACKBITS:
        return packbits_decode(data)
    raise TiffError(f"compression {kind}")


def _samples(raw: bytes, rows: int, cols: int, spp: int, bits: int, fmt: int, order: str, predictor: int) -> np.ndarray:
    """One decoded strip or tile as rows x cols x samples, predictor undone; missing bytes are an error."""
    line = cols * spp
    if bits < 8:
        per = -(-line * bits // 8)
        b = np.frombuffer(raw, np.uint8, rows * per).reshape(rows, per)
        b = np.unpackbits(b, axis=1)[:, : line * bits].reshape(rows, line, bits)
        return (b @ (1 << np.arange(bits)[::-1])).astype(np.uint8).reshape(rows, cols, spp)
    kind = np.dtype({1: "u", 2: "i", 3: "f"}.get(fmt, "u") + str(bits // 8))
    if predictor == 3:
        b = np.frombuffer(raw, np.uint8, rows * line * bits // 8).reshape(rows, line * bits // 8)
        b = np.cumsum(b.reshape(rows, -1, spp), axis=1, dtype=np.uint8).reshape(rows, bits // 8, line)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(kind.newbyteorder(">")).astype(kind).reshape(rows, cols, spp)
    out = np.frombuffer(raw, kind.newbyteorder(order), rows * line).astype(kind).reshape(rows, cols, spp)
    if predictor == 2:
        whole = out.view(f"u{bits // 8}")
        out = np.cumsum(whole, axis=1, dtype=whole.dtype).view(kind)
    elif predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return out


def read_pages(data: bytes) -> list[Page]:
    """All pages of a TIFF; raises :class:`TiffError` if it cannot be decoded."""
    try:
        return _read(data)
    except (struct.error, IndexError, KeyError, TypeError, MemoryError) as e:
        raise TiffError(f"damaged: {e}") from e
    except ValueError as e:
        raise e if isinstance(e, TiffError) else TiffError(f"damaged: {e}") from e


def _read(data: bytes) -> list[Page]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    pages, seen, at = [], set(), struct.unpack_from(order + "I", data, 4)[0]
    while at:
        if at in seen:
            raise TiffError("the directories form a cycle")
        seen.add(at)
        n, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = SIZES.get(kind, 1) * count
            where = at + 10 + 12 * k
            if size > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if kind in CODES:
                tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", data, where)
        pages.append(_page(data, order, tags))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return pages


def _page(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, spp = tags[256][0], tags[257][0], one(277, 1)
    bits, kind, planar, predictor, fmt = one(258, 1), one(259, 1), one(284, 1), one(317, 1), one(339, 1)
    if len(set(tags.get(258, (1,)))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError("bits of samples")
    if width * height * spp > MAX_SAMPLES:
        raise TiffError("more samples than allowed")
    tiled = 324 in tags
    if tiled:
        cw, ch, offsets, counts = tags[322][0], tags[323][0], tags[324], tags[325]
    else:
        cw, ch, offsets, counts = width, min(one(278, height), height), tags[273], tags[279]
    across, down = -(-width // max(1, cw)), -(-height // max(1, ch))
    planes = spp if planar == 2 else 1
    if len(offsets) < across * down * planes:
        raise TiffError("too few strips or tiles")
    out = None
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * ch, rest % across * cw
        rows = ch if tiled else min(ch, height - y)
        raw = _unpacked(kind, data[offsets[k] : offsets[k] + counts[k]])
        part = _samples(raw, rows, cw, 1 if planar == 2 else spp, bits, fmt, order, predictor)
        if out is None:
            out = np.zeros((height, width, spp), part.dtype)
        h, w = min(rows, height - y), min(cw, width - x)
        if planar == 2:
            out[y : y + h, x : x + w, plane] = part[:h, :w, 0]
        else:
            out[y : y + h, x : x + w] = part[:h, :w]
    return Page(np.zeros((height, width, spp), np.uint8) if out is None else out, kind, predictor, tiled)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows: int = 0, level: int = 1) -> bytes:
    """A little-endian TIFF of unsigned 8- or 16-bit pages (height x width or height x width x samples)."""
    coded = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, level), PACKBITS: packbits_encode}[compression]
    out, link = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for px in pages:
        px = px[:, :, None] if px.ndim == 2 else px
        h, w, spp = px.shape
        ch, cw = (tile, tile) if tile else (rows or max(1, STRIP // max(1, w * spp * px.itemsize)), w)
        offsets, counts = [], []
        for y in range(0, h, ch):
            for x in range(0, w, cw):
                part = px[y : y + ch, x : x + cw]
                if tile:
                    part = np.pad(part, ((0, ch - part.shape[0]), (0, cw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                data = coded(np.ascontiguousarray(part, part.dtype.newbyteorder("<")).tobytes())
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        out += b"\0" * (len(out) % 2)
        short, long = 3, 4
        tags = [(256, long, [w]), (257, long, [h]), (258, short, [8 * px.itemsize] * spp), (259, short, [compression]), (262, short, [2 if spp == 3 else 1]), (277, short, [spp]), (317, short, [predictor])]
        tags += [(322, long, [cw]), (323, long, [ch]), (324, long, offsets), (325, long, counts)] if tile else [(273, long, offsets), (278, long, [ch]), (279, long, counts)]
        entries, more = [], bytearray()
        at = len(out)
        tail = at + 2 + 12 * len(tags) + 4
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{CODES[kind]}", *values)
            if len(raw) > 4:
                entries.append(struct.pack("<HHII", tag, kind, len(values), tail + len(more)))
                more += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, at)
        out += struct.pack("<H", len(tags)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0" + more
    return bytes(out)


WIDTH = 64
STORED = "doc_id long, n_bytes long, media binary"
PAGES = "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def store_texts(docs: DataFrame, compression: int = DEFLATE) -> DataFrame:
    """Every whole text as an image 64 samples wide: ``doc_id, n_bytes`` (of the text), ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [write_tiff([np.frombuffer(r + b"\0" * (-len(r) % WIDTH or (WIDTH if not r else 0)), np.uint8).reshape(-1, WIDTH)], compression) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def decode_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of every non-null TIFF in a column; ``pixels`` are its samples in rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
        names = ["doc_id", "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels", "error"]
        for batch in sliced(batches):
            rows = []
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    for k, p in enumerate(read_pages(data)):
                        h, w, spp = p.pixels.shape
                        rows.append((own, k, w, h, spp, 8 * p.pixels.itemsize, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None))
                except TiffError as e:
                    rows.append((own, *[None] * 9, str(e)))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return media.select(id_col, media_col).mapInArrow(run, PAGES)


def media_features(stored: DataFrame) -> DataFrame:
    """What the stored bytes decode to, as digests: see ``op9_media_columns``. ``feature`` is the page layout, the mean
    sample and the 16 shares of equal ranges of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in sliced(batches):
            rows = []
            for doc_id, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                pages = read_pages(data)
                payload = b"".join(p.pixels.tobytes() for p in pages)
                px = np.frombuffer(payload, np.uint8)
                hist = np.bincount(px >> 4, minlength=16) / max(1, len(px))
                shape = "+".join("x".join(map(str, p.pixels.shape)) for p in pages)
                feature = f"{shape} mean={px.mean() if len(px) else 0:.4f} hist={','.join(f'{x:.4f}' for x in hist)}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows)) or [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
