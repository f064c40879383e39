"""TIFF media: a page reader for PackBits, LZW and deflate strips and tiles, and a writer of the same forms.

The reader walks the chain of image directories, decodes each strip or tile, undoes the horizontal predictor, and gives
one page at a time. 8- and 16-bit grey or chunky multi-sample images of both byte orders are read; a page that cannot
be read gives an error text in its row instead of samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.arrowtext import as_bytes, slices

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES = 322, 323, 324, 325
PLANAR = 284
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 16: 8}
CODES = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
CLEAR, END = 256, 257


def pack_bits(data: bytes) -> bytes:
    """Byte runs: a run of 2 to 128 equal bytes, or 1 to 128 literal ones. Runs are found with numpy."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    cut = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [len(raw)]]).tolist()
    out, plain = bytearray(), 0  # plain: where literals that wait begin
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a < 3:
            continue
        for s in range(plain, a, 128):
            e = min(s + 128, a)
            out.append(e - s - 1)
            out += data[s:e]
        for s in range(a, b, 128):
            n = min(128, b - s)
            out += bytes([257 - n if n > 1 else 0, data[s]])
        plain = b
    for s in range(plain, len(data), 128):
        e = min(s + 128, len(data))
        out.append(e - s - 1)
        out += data[s:e]
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
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


#: Code widths after a clear: codes of 9 to 12 bits, the width changing one entry early; 12 from then on.
LZW_WIDTHS = np.maximum(9, np.ceil(np.log2(np.arange(258, 4094) + 1)).astype(np.int64))


def lzw_pack(data: bytes) -> bytes:
    """LZW codes, most significant bit first; the table is cleared when it is full."""
    codes, places, table, free = [CLEAR], [0], {}, 258
    if data:
        run = data[0]
        for byte in memoryview(data)[1:]:
            longer = run << 8 | byte
            code = table.get(longer)
            if code is None:
                codes.append(run)
                table[longer] = free
                free += 1
                run = byte
                if free == 4094:
                    places.append(len(codes))
                    codes.append(CLEAR)
                    table, free = {}, 258
            else:
                run = code
        codes.append(run)
    codes.append(END)
    number = np.arange(len(codes))  # of each code since the clear before it
    starts = np.array(places)
    number -= np.concatenate([[0], starts[np.searchsorted(starts, number[1:] - 1, "right") - 1] + 1])
    width = np.where(number < len(LZW_WIDTHS), LZW_WIDTHS[np.minimum(number, len(LZW_WIDTHS) - 1)], 12)
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


def lzw_unpack(data: bytes, size: int, step: int = 512) -> bytes:
    """The first `size` bytes. A code that the table cannot have yet is an error."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(2, np.uint8)]).astype(np.uint32)
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, got, last, at, number, ended = [], 0, b"", 0, 0, False  # at: in bits; number: codes since the last clear
    while not ended and got < size:
        width = LZW_WIDTHS[number : number + step] if number < len(LZW_WIDTHS) else np.full(step, 12)
        ends = at + np.cumsum(width)
        width = width[: np.searchsorted(ends, 8 * len(data), "right")]
        if not len(width):
            break
        first = ends[: len(width)] - width
        byte = first >> 3
        codes = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - width - (first & 7)).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(marks[0]) if len(marks) else len(codes)
        for code in codes[:n].tolist():
            if not last:
                if code > 255:
                    raise ValueError(f"LZW code {code} after a clear")
                entry = table[code]
            else:
                if code > len(table) or code > 4095:
                    raise ValueError(f"LZW code {code} of a table of {len(table)}")
                entry = table[code] if code < len(table) else last + last[:1]
                if len(table) < 4096:
                    table.append(last + entry[:1])
            out.append(entry)
            got += len(entry)
            last = entry
            if got >= size:
                break
        if len(marks):
            ended = int(codes[n]) == END
            del table[258:]
            at, number, last = int(ends[n]), 0, b""
        else:
            at, number = int(ends[n - 1]), number + n
    return b"".join(out)[:size]


def compress(data: bytes, method: int) -> bytes:
    if method == PACKBITS:
        return pack_bits(data)
    if method == LZW:
        return lzw_pack(data)
    return zlib.compress(data, 1) if method in (DEFLATE, OLD_DEFLATE) else data


def expand(data: bytes, method: int, size: int) -> bytes:
    """Decoded bytes of one strip or tile, of the size that its pixels need."""
    if method == PACKBITS:
        out = unpack_bits(data, size)
    elif method == LZW:
        out = lzw_unpack(data, size)
    elif method in (DEFLATE, OLD_DEFLATE):
        inflater = zlib.decompressobj()
        out = inflater.decompress(data, size)
        if not inflater.eof:
            inflater.decompress(inflater.unconsumed_tail, 1)  # reads on to the checksum, which it verifies
    elif method == NONE:
        out = data[:size]
    else:
        raise ValueError(f"compression {method} is not supported")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out


def encode_pages(pages: list[np.ndarray], method: int = DEFLATE, predictor: bool = True, rows_per_strip: int = 256, tile: tuple[int, int] | None = None) -> bytes:
    """8-bit grey pages as a little-endian TIFF. tile: (rows, columns), multiples of 16, else strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, wide = page.shape
        if tile:
            rows, columns = tile
            padded = np.zeros((-(-height // rows) * rows, -(-wide // columns) * columns), np.uint8)
            padded[:height, :wide] = page
            parts = [padded[r : r + rows, c : c + columns] for r in range(0, padded.shape[0], rows) for c in range(0, padded.shape[1], columns)]
        else:
            parts = [page[r : r + rows_per_strip] for r in range(0, height, rows_per_strip)]
        at, size = [], []
        for part in parts:
            if predictor:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            data = compress(np.ascontiguousarray(part).tobytes(), method)
            at.append(len(out))
            size.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = {WIDTH: [wide], LENGTH: [height], BITS: [8], COMPRESSION: [method], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [2 if predictor else 1]}
        tags |= {TILE_WIDTH: [tile[1]], TILE_LENGTH: [tile[0]], TILES: at, TILE_BYTES: size} if tile else {STRIPS: at, ROWS_PER_STRIP: [rows_per_strip], STRIP_BYTES: size}
        fields = b""
        for tag, values in sorted(tags.items()):
            if len(values) == 1:
                place = values[0]
            else:
                place = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
            fields += struct.pack("<HHII", tag, 4, len(values), place)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    pixels: np.ndarray | None
    error: str | None = None


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if kind in SIZES:
            place = at + 10 + 12 * i
            if SIZES[kind] * count > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", data, place)
    (after,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return tags, after


def _pixels(data: bytes, tags: dict[int, tuple[int, ...]], order: str, most: int) -> np.ndarray:
    wide, height = tags[WIDTH][0], tags[LENGTH][0]
    samples, bits, method = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (1,))[0], tags.get(COMPRESSION, (NONE,))[0]
    predictor, planar = tags.get(PREDICTOR, (1,))[0], tags.get(PLANAR, (1,))[0]
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits a sample are not supported")
    if predictor not in (1, 2) or planar not in (1, 2):
        raise ValueError(f"predictor {predictor} with planar configuration {planar} is not supported")
    kind = np.dtype(np.uint8 if bits == 8 else f"{order}u2")
    if wide * height * samples * kind.itemsize > most:
        raise ValueError(f"{wide} x {height} x {samples} samples are more than {most} bytes")
    out = np.zeros((height, wide, samples), kind.newbyteorder("="))
    tiled = TILES in tags
    columns, rows = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (wide, min(tags.get(ROWS_PER_STRIP, (height,))[0], height))
    if rows < 1 or columns < 1 or rows * columns * samples * kind.itemsize > most:
        raise ValueError(f"strips or tiles of {columns} x {rows}")
    each = 1 if planar == 2 else samples  # samples of a pixel that lie together
    corners = [(s, r, c) for s in range(0, samples, each) for r in range(0, height, rows) for c in range(0, wide, columns)]
    for (s, r, c), place, size in zip(corners, tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True):
        n = rows if tiled else min(rows, height - r)
        raw = expand(data[place : place + size], method, n * columns * each * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(n, columns, each)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        out[r : r + n, c : c + columns, s : s + each] = part[: height - r, : wide - c]
    return out


#: Bytes that one value of a Spark row can hold, so the largest page that can be a row.
MOST_BYTES = (1 << 31) - (1 << 16)
#: Bytes of pixels, or of media, in the rows that are put out together.
GROUP_BYTES = 1 << 24


def directories(data: bytes) -> Iterator[tuple[Page, dict[int, tuple[int, ...]], str]]:
    """The image directories of a TIFF in their order, nothing decoded; a loop among them ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2]) if len(data) >= 8 else None
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        yield Page(0, 0, 0, 0, 0, "", 0, False, None, "not a TIFF"), {}, ""
        return
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        number = len(seen) - 1
        try:
            tags, at = _directory(data, at, order)
            one = lambda tag, default, tags=tags: tags.get(tag, (default,))[0]
            page = Page(number, one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1), NAMES.get(one(COMPRESSION, 1), str(one(COMPRESSION, 1))), one(PREDICTOR, 1), TILES in tags, None)
        except (struct.error, IndexError):
            yield Page(number, 0, 0, 0, 0, "", 0, False, None, "the directory is cut off"), {}, order
            return
        yield page, tags, order


def pages(data: bytes, most: int = MOST_BYTES) -> Iterator[Page]:
    """The pages of a TIFF, decoded one at a time; one of more than `most` bytes, or that cannot be read, has an error."""
    for page, tags, order in directories(data):
        if page.error is None:
            try:
                page.pixels = _pixels(data, tags, order, most)
            except (KeyError, ValueError, IndexError, zlib.error) as e:
                page.error = str(e) or "not readable"
        yield page


PAGE_SCHEMA = "page int, n_pages int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, mean double, deviation double, pixels binary, error string"


def _spread(pixels: np.ndarray | None) -> tuple[float | None, float | None]:
    """Mean and standard deviation of a page's samples, to three places, from whole-number sums."""
    if pixels is None or not pixels.size:
        return None, None
    flat, counts = pixels.reshape(-1), np.zeros(1 << 8 * pixels.itemsize, np.int64)
    for a in range(0, len(flat), 1 << 20):
        counts += np.bincount(flat[a : a + (1 << 20)], minlength=len(counts))
    value = np.arange(len(counts), dtype=np.int64)
    n, one, two = int(counts.sum()), int(counts @ value), int(counts @ (value * value))
    return round(one / n, 3), round(((two * n - one * one) / (n * n)) ** 0.5, 3)


def read_tiff(media: DataFrame, media_col: str = "media", most: int = MOST_BYTES) -> DataFrame:
    """One row for each page: all other columns of media, and those of PAGE_SCHEMA.

    Defined cases: a null or empty value gives no page; one that is no TIFF, or a page that cannot be decoded, gives a
    row whose pixels are null and whose error says why, as does a page of more than `most` bytes (by default, than a row
    can hold; set it lower for media from others); corrupt codes and checksums are errors, not other pixels. A page is
    decoded when its row is due, and rows go out in groups of bounded bytes, so a task holds a value, a page and a group; other columns named like a page's are dropped.
    """
    own = [x.split(" ")[0] for x in PAGE_SCHEMA.split(", ")]
    keep = [c for c in media.columns if c != media_col and c not in own]
    n_keep = len(keep)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 6 + [pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.binary(), pa.string()]

        def group(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in batch.columns[:n_keep]], *columns], [*[f"_c{i}" for i in range(n_keep)], *own])

        for batch in batches:
            at, rows, held = [], [], 0
            for i, cell in enumerate(batch.column(n_keep)):
                value = cell.as_py()
                n = sum(1 for _ in directories(value)) if value else 0
                for p in pages(value, most) if value else ():
                    at.append(i)
                    rows.append((p.number, n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, *_spread(p.pixels), None if p.pixels is None else p.pixels.tobytes(), p.error))
                    held += 200 + (0 if p.pixels is None else p.pixels.nbytes)
                    if held > GROUP_BYTES:
                        yield group(batch, at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield group(batch, at, rows)

    given = media.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col(f"`{media_col}`").alias("_media"))
    schema = ", ".join([*[f"_c{i} {media.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], PAGE_SCHEMA])
    return given.mapInArrow(decode, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *own)


PAGE_WIDTH = 576


def payload(text: str | bytes, unit: int = 576) -> bytes:
    """UTF-8 of a text, filled with bytes 255 up to a positive multiple of the unit."""
    raw = text.encode() if isinstance(text, str) else text
    return raw + b"\xff" * (unit * max(1, -(-len(raw) // unit)) - len(raw))


def store(data: bytes) -> bytes:
    """A payload as the first page of a TIFF of 8-bit grey samples, with a preview, every sixteenth sample of every
    sixteenth row, as the second. A checksum of the payload picks its form, whatever its size: LZW,
    PackBits, and deflate with the predictor in strips and in tiles."""
    page = np.frombuffer(data, np.uint8).reshape(-1, PAGE_WIDTH)
    method, predictor, tile = ((LZW, False, None), (PACKBITS, False, None), (DEFLATE, True, None), (DEFLATE, True, (256, PAGE_WIDTH)))[zlib.crc32(data) % 4]
    return encode_pages([page, page[::16, ::16]], method, predictor, tile=tile)


def text_to_tiff(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each whole text (null: empty) as a TIFF.

    Defined cases: equal texts give equal files; rows that repeat are written each; an empty table gives no rows; other
    columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = as_bytes(batch.column(1))
            padded = np.concatenate([[0], np.cumsum(np.diff(off) + PAGE_WIDTH)])  # a bound of the payloads
            for a, b in slices(padded, GROUP_BYTES):
                part = batch.slice(a, b - a)
                sizes, media = [], []
                for x in part.column(1):
                    raw = (x.as_py() or "").encode()
                    sizes.append(len(raw))
                    media.append(store(payload(raw)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["_id", "n_bytes", "media"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(write, f"_id {kind}, n_bytes long, media binary").withColumnRenamed("_id", id_col)
