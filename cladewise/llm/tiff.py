"""Media columns: TIFF files as binary values, one row per page.

The reader walks the chain of image directories of either byte order, decodes
stored, PackBits, LZW and deflate strips and tiles, undoes the horizontal
predictor, and gives the samples of each page. The writer makes files that use
all of these: a page's content alone decides, so equal texts give equal files.

Files travel as values of a DataFrame column and are written by Spark; nothing
opens a path. One file is decoded at a time, page by page.

Defined results: null text counts as empty and is padded like any other. A
value that is not a TIFF file, is cut short, or claims a page that its strips do
not fill or of more than ``MOST_PAGE_BYTES`` gives a row with ``error`` set and
no pixels after the pages before it, and its digest has an error and no payload;
a null value gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.llm import textnp as tn
from cladewise.session import bounded_batches, written

# Fixed values of the format: tags, field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: A written page: 64 RGB samples a row, at most this many rows.
PAGE_WIDTH, PAGE_SAMPLES, PAGE_ROWS = 64, 3, 1024
#: A page of more samples is not read.
MOST_PAGE_BYTES = 1 << 28
ROW_BYTES = PAGE_WIDTH * PAGE_SAMPLES


def packbits_encode(raw: bytes) -> bytes:
    """Runs of three or more bytes are packed, the rest is literal."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return b""
    heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    sizes = np.diff(np.r_[heads, len(a)])
    out, at = bytearray(), 0

    def literal(to: int) -> None:
        nonlocal at
        while at < to:
            n = min(128, to - at)
            out.append(n - 1)
            out.extend(raw[at : at + n])
            at += n

    for h, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        literal(h)
        while n > 1:
            k = min(128, n)
            out += bytes((257 - k, raw[h]))
            n -= k
            at += k
    literal(len(raw))
    return bytes(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out[:size])


_CLEAR, _STOP, _FIRST, _FULL = 256, 257, 258, 4094


def lzw_encode(raw: bytes) -> bytes:
    codes, bits, total = {}, 0, 0
    out, width, nxt = bytearray(), 9, _FIRST

    def put(code: int) -> None:
        nonlocal bits, total
        bits, total = bits << width | code, total + width
        while total >= 8:
            total -= 8
            out.append(bits >> total & 255)
        bits &= (1 << total) - 1

    put(_CLEAR)
    cur = -1
    for b in raw:
        if cur < 0:
            cur = b
            continue
        got = codes.get((cur, b))
        if got is not None:
            cur = got
            continue
        put(cur)
        codes[cur, b] = nxt
        nxt += 1
        if nxt == 1 << width and width < 12:
            width += 1
        if nxt >= _FULL:
            put(_CLEAR)
            codes, width, nxt = {}, 9, _FIRST
        cur = b
    if cur >= 0:
        put(cur)
        nxt += 1
        if nxt == 1 << width and width < 12:
            width += 1
    put(_STOP)
    if total:
        out.append(bits << (8 - total) & 255)
    return bytes(out)


def lzw_decode(raw: bytes, size: int) -> bytes:
    out, table, width = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""], 9
    bits = total = 0
    last = None
    for byte in raw:
        bits, total = bits << 8 | byte, total + 8
        if total < width:
            continue
        total -= width
        code = bits >> total
        bits &= (1 << total) - 1
        if code == _STOP:
            break
        if code == _CLEAR:
            del table[_FIRST:]
            width, last = 9, None
            continue
        if last is None:
            cur = table[code]
        else:
            cur = table[code] if code < len(table) else last + last[:1]
            table.append(last + cur[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out += cur
        last = cur
    return bytes(out[:size])


def _differenced(a: np.ndarray) -> np.ndarray:
    """Rows x columns x samples: each sample less its left neighbour."""
    out = a.copy()
    out[:, 1:] -= a[:, :-1]
    return out


#: Schemes of written pages, and rows of a strip and of a tile.
SCHEMES = (LZW, PACKBITS, PACKBITS, DEFLATE, DEFLATE, DEFLATE, DEFLATE, DEFLATE)
STRIP_ROWS, TILE_ROWS = 32, 16
ENCODERS = {LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda raw: zlib.compress(raw, 1)}


def write_tiff(payload: bytes) -> bytes:
    """A file whose pages hold the payload, a multiple of 192 bytes, row by row."""
    parts, at, last_link = [b"II*\0\0\0\0\0"], 8, 4
    links: list[tuple[int, int]] = []
    for start in range(0, len(payload), PAGE_ROWS * ROW_BYTES):
        raw = payload[start : start + PAGE_ROWS * ROW_BYTES]
        rows = len(raw) // ROW_BYTES
        a = np.frombuffer(raw, np.uint8).reshape(rows, PAGE_WIDTH, PAGE_SAMPLES)
        tags: dict[int, list[int]] = {WIDTH: [PAGE_WIDTH], HEIGHT: [rows], BITS: [8] * PAGE_SAMPLES, PHOTOMETRIC: [2], SAMPLES: [PAGE_SAMPLES], PLANAR: [1]}
        # The content decides, so that pages of every length use every scheme and both layouts.
        choice = zlib.crc32(raw)
        scheme, tiled = SCHEMES[choice % len(SCHEMES)], bool(choice >> 8 & 1)
        tall = TILE_ROWS if tiled else STRIP_ROWS
        if tiled:
            full = np.zeros((-(-rows // TILE_ROWS) * TILE_ROWS, PAGE_WIDTH, PAGE_SAMPLES), np.uint8)
            full[:rows] = a
            a = full
        if scheme == DEFLATE:
            tags[PREDICTOR] = [2]
            a = _differenced(a)
        segments = [ENCODERS[scheme](a[r : r + tall].tobytes()) for r in range(0, rows, tall)]
        tags[COMPRESSION] = [scheme]
        offsets = []
        for s in segments:
            offsets.append(at)
            parts.append(s)
            at += len(s)
        sizes = [len(s) for s in segments]
        if tiled:
            tags |= {TILE_WIDTH: [PAGE_WIDTH], TILE_HEIGHT: [TILE_ROWS], TILE_OFFSETS: offsets, TILE_COUNTS: sizes}
        else:
            tags |= {STRIP_OFFSETS: offsets, STRIP_COUNTS: sizes, ROWS_PER_STRIP: [STRIP_ROWS]}
        if at % 2:
            parts.append(b"\0")
            at += 1
        fields, extra, base = [], [], at + 2 + 12 * len(tags) + 4
        for tag, values in sorted(tags.items()):
            kind = 4 if tag in (STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS) else 3
            data = struct.pack(f"<{len(values)}{TYPES[kind][0]}", *values)
            if len(data) > 4:
                fields.append(struct.pack("<HHII", tag, kind, len(values), base + sum(map(len, extra))))
                extra.append(data)
            else:
                fields.append(struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        links.append((last_link, at))
        last_link = at + 2 + 12 * len(tags)
        parts += [struct.pack("<H", len(tags)), *fields, b"\0\0\0\0", *extra]
        at = base + sum(map(len, extra))
    out = bytearray(b"".join(parts))
    for where, to in links:
        struct.pack_into("<I", out, where, to)
    return bytes(out)


def read_pages(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Tags and samples (rows x columns x samples) of each page."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags = {}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            p = at + 2 + 12 * i
            tag, kind, n = struct.unpack_from(order + "HHI", data, p)
            if kind in TYPES:
                code, width = TYPES[kind]
                place = p + 8 if n * width <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
        yield tags, _page(data, tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]


def _page(data: bytes, tags: dict) -> np.ndarray:
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    if set(tags.get(BITS, (1,))) != {8} or tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("only 8-bit samples, stored together, are read")
    scheme, predictor = tags.get(COMPRESSION, (STORED,))[0], tags.get(PREDICTOR, (1,))[0]
    tiled = TILE_OFFSETS in tags
    wide = tags[TILE_WIDTH][0] if tiled else width
    tall = tags[TILE_HEIGHT][0] if tiled else min(tags.get(ROWS_PER_STRIP, (height,))[0], height)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if min(width, height, samples, wide, tall) < 1:
        raise ValueError("a side has no length")
    across = -(-width // wide)
    # Nothing is taken into memory on the word of the header alone.
    if len(offsets) != across * -(-height // tall) or len(counts) != len(offsets):
        raise ValueError("strips or tiles do not match the page")
    if max(width * height, wide * tall * len(offsets)) * samples > MOST_PAGE_BYTES:
        raise ValueError("the page is too large")
    out = np.empty((height, width, samples), np.uint8)
    for k, (o, n) in enumerate(zip(offsets, counts)):
        y, x = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - y)
        size, raw = rows * wide * samples, data[o : o + n]
        if scheme == PACKBITS:
            raw = packbits_decode(raw, size)
        elif scheme == LZW:
            raw = lzw_decode(raw, size)
        elif scheme in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompressobj().decompress(raw, size)
        elif scheme != STORED:
            raise ValueError(f"compression {scheme} is not read")
        if len(raw) < size:
            raise ValueError("a strip or tile is cut short")
        a = np.frombuffer(raw, np.uint8, size).reshape(rows, wide, samples)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + wide] = a[: height - y, : width - x]
    return out


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as TIFF files: doc_id, n_bytes, media (binary)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in tn.slices(batch):
                whole = buf.tobytes()
                texts = [whole[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                files = [write_tiff(t.ljust(max(1, -(-len(t) // ROW_BYTES)) * ROW_BYTES)) for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offs)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


_PAGE = ["doc_id", "page", "width", "height", "samples", "compression", "mean", "deviation", "pixels", "media_bytes", "media_sha256", "n_bytes", "error"]


def tiff_pages(media: DataFrame) -> DataFrame:
    """One row per page of each file in ``media`` (doc_id, n_bytes, media), pages in order.

    mean and deviation are those of the page's samples; pixels are its samples
    row by row.
    """
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size, id_kind = [], 0, batch.schema.field("doc_id").type
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                if data is None:
                    continue
                about = (len(data), hashlib.sha256(data).hexdigest(), n)
                try:
                    page = -1
                    for page, (tags, a) in enumerate(read_pages(data)):
                        # Sums of whole numbers, so that the figures do not depend on the machine.
                        s, q = int(a.sum(dtype=np.int64)), int((a.astype(np.int64) ** 2).sum())
                        mean = s / a.size
                        out.append((doc, page, a.shape[1], a.shape[0], a.shape[2], tags.get(COMPRESSION, (STORED,))[0], mean, (q * a.size - s * s) ** 0.5 / a.size, a.tobytes(), *about, None))
                        size += a.size
                        if size > 2 * tn.SLICE_BYTES:
                            yield made(out, id_kind)
                            out, size = [], 0
                except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                    out.append((doc, page + 1, None, None, None, None, None, None, None, *about, f"{type(e).__name__}: {e}"))
            if out:
                yield made(out, id_kind)

    def made(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [id_kind, *kinds])], names=_PAGE)

    id_type = media.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int32()] * 5 + [pa.float64()] * 2 + [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    schema = f"doc_id {id_type}, page int, width int, height int, samples int, compression int, mean double, deviation double, pixels binary, media_bytes bigint, media_sha256 string, n_bytes bigint, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a file follow each other in a partition: one row per file.

    A file with an error has no payload columns.
    """
    cur = None

    def row():
        doc, n, sha, tail, size, about, marks, error = cur
        read = (size, sha.hexdigest(), zlib.crc32(tail)) if error is None else (None, None, None)
        return doc, n, *read, *about, f"{len(marks)} page(s): " + "; ".join(marks), error

    for batch in batches:
        out, kind = [], batch.schema.field("doc_id").type
        for doc, page, w, h, _, scheme, mean, dev, px, mb, msha, n, error in zip(*(batch.column(c).to_pylist() for c in _PAGE)):
            if page == 0:
                if cur:
                    out.append(row())
                cur = [doc, n, hashlib.sha256(), b"", 0, (mb, msha), [], None]
            if error is not None:
                cur[7] = error
            else:
                cur[2].update(px)
                cur[3] = px[-16:]
                cur[4] += len(px)
                cur[6].append(f"{w}x{h} c{scheme} mean {mean:.6f} dev {dev:.6f}")
        if out:
            yield done(out, kind)
    if cur:
        yield done([row()], kind)


def done(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = [id_kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def file_digests(media: DataFrame) -> DataFrame:
    """One row per file of ``media`` (doc_id, n_bytes, media): its payload read back and summed up, or its error."""
    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"
    return tiff_pages(media).mapInArrow(_digests, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """Texts stored as TIFF files in the shared folder, read back and summed up: one row per document."""
    return file_digests(written(text_media(docs), "media"))
