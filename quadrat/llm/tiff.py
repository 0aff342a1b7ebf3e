"""TIFF media columns: a codec and one row per page.

The reader walks the chain of image directories of a classic TIFF in either
byte order, decodes strips or tiles (none, PackBits, LZW or deflate), undoes
the horizontal predictor, and yields the pixels of each page. The writer
produces the same family, for payloads that must come back byte for byte.
Samples are whole numbers of 8, 16 or 32 bits. BigTIFF, floating-point samples
and their predictor, other bit depths and the reversed fill order are reported
as errors, not read.

A NULL or unreadable value gives one row with page -1 and the reason, never a
failed job: whatever the bytes, the reader raises nothing but ``TiffError``,
and it allocates a page only when the stored bytes can hold that many samples
and the page stays within ``MAX_PAGE_BYTES`` (a row of a result holds a page).
An empty table gives an empty table; repeated rows repeat; extra columns are
ignored.
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
from pyspark.sql import functions as F

# Fixed values of the format: tags, compression schemes, and (struct code, bytes) of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SCHEMES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}
FILL_ORDER, SAMPLE_FORMAT = 266, 339
#: The most samples' bytes that one stored byte can stand for.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2_731, DEFLATE: 1_032, OLD_DEFLATE: 1_032}
MAX_PAGE_BYTES = 1 << 30
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4)}


class TiffError(ValueError):
    pass


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + run
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        j = min(j, i + 128)
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def _lzw_widths(start: int, n: int) -> np.ndarray:
    """Bits of the codes number ``start``, ``start`` + 1, ... since the table was cleared: widths switch one code early, as the format asks."""
    table = np.arange(start, start + n) + 259
    return 9 + (table > 512).astype(np.int64) + (table > 1024) + (table > 2048)


def lzw_encode(data: bytes) -> bytes:
    """Variable width, most significant bit first; the table is cleared when it is full."""
    codes, since, table, free = [256], [0], {}, 258
    for byte in data[:1]:
        word = byte
    for byte in data[1:]:
        key = word << 8 | byte
        if key in table:
            word = table[key]
            continue
        codes.append(word)
        table[key] = free
        free += 1
        if free == 4095:
            codes.append(256)
            since.append(len(codes) - 1)
            table, free = {}, 258
        word = byte
    codes += [word, 257] if data else [257]
    code, number = np.array(codes), np.arange(len(codes))
    starts = np.array(since)
    within = number - starts[np.searchsorted(starts, number, side="left") - 1] - 1
    within[0] = 0
    width = _lzw_widths(0, 4096)[within]
    bits = (code[:, None] >> np.maximum(width[:, None] - 1 - np.arange(12), 0)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(bool)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """At most a table entry more than ``size`` bytes; codes are cut out a table's worth at a time."""
    out, raw = bytearray(), np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    fresh: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, last, at, number = list(fresh), b"", 0, 0
    while len(out) < size:
        n = min(4096, (8 * len(data) - at) // 9)
        width = _lzw_widths(number, max(n, 0))
        spot = at + np.concatenate(([0], np.cumsum(width)))
        n = int(np.searchsorted(spot, 8 * len(data), side="right")) - 1
        if n <= 0:
            break
        first = spot[:n] >> 3
        code = ((raw[first] << 16 | raw[first + 1] << 8 | raw[first + 2]) >> (24 - (spot[:n] & 7) - width[:n])) & ((1 << width[:n]) - 1)
        marks = np.flatnonzero((code == 256) | (code == 257))
        read = int(marks[0]) if len(marks) else n
        for c in code[:read].tolist():
            if not last:
                entry = table[c] if c < len(table) else b""
            elif c < len(table):
                entry = table[c]
                if len(table) < 4096:
                    table.append(last + entry[:1])
            elif c == len(table) < 4096:
                entry = last + last[:1]
                table.append(entry)
            else:
                entry = b""
            if not entry:
                raise TiffError("bad LZW code")
            out += entry
            last = entry
            if len(out) >= size:
                return bytes(out)
        if not len(marks):
            at, number = int(spot[n]), number + n
        elif code[read] == 257:
            break
        else:
            at, number, table, last = int(spot[read + 1]), 0, list(fresh), b""
    return bytes(out)


def _pack(data: bytes, scheme: int) -> bytes:
    if scheme == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}[scheme](data)


def _unpack(data: bytes, scheme: int, size: int) -> bytes:
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if scheme == NONE:
        return data
    if scheme in (LZW, PACKBITS):
        return (lzw_decode if scheme == LZW else packbits_decode)(data, size)
    raise TiffError(f"compression {scheme}")


@dataclass(frozen=True)
class Layout:
    """How a page is stored: in strips, or in square tiles where ``tile`` isn't 0."""

    scheme: str = "deflate"
    predictor: int = 1
    rows_per_strip: int = 128
    tile: int = 0


def write_tiff(pages: list[np.ndarray], layouts: Layout | list[Layout]) -> bytes:
    """Little-endian TIFF of 8- or 16-bit arrays (height, width, samples), with one layout for all pages or one for each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page, layout in zip(pages, layouts if isinstance(layouts, list) else [layouts] * len(pages)):
        kind, predictor, rows_per_strip, tile = SCHEMES[layout.scheme], layout.predictor, layout.rows_per_strip, layout.tile
        page = np.ascontiguousarray(page)
        height, width, samples = page.shape
        cells = []
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, samples), page.dtype)
            padded[:height, :width] = page
            cells = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            cells = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.concatenate((cell[:, :1], cell[:, 1:] - cell[:, :-1]), axis=1)
            packed = _pack(cell.astype(cell.dtype.newbyteorder("<")).tobytes(), kind)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        bits = page.dtype.itemsize * 8
        tags = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [kind]),
            (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        if tile:
            tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, field, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{FIELD[field][0]}", *values)
            if len(raw) > 4:
                spot = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack("<I", spot)
            entries.append(struct.pack("<HHI", tag, field, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Each image directory as (byte order, tag -> values); a loop in the chain ends the walk with an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a classic TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        if at + 2 > len(data):
            raise TiffError("a directory starts beyond the file")
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise TiffError("a directory ends beyond the file")
        tags = {}
        for i in range(n):
            spot = at + 2 + 12 * i
            tag, field, count = struct.unpack_from(order + "HHI", data, spot)
            if field not in FIELD:
                continue
            code, size = FIELD[field]
            where = spot + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, spot + 8)[0]
            if where + size * count > len(data):
                raise TiffError(f"tag {tag} ends beyond the file")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, where))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, order: str, tags: dict[int, list], max_bytes: int) -> np.ndarray:
    def one(tag: int, default: int = 0) -> int:
        value = (tags.get(tag) or [default])[0]
        if not isinstance(value, int) or value < 0:
            raise TiffError(f"tag {tag} is {value!r}")
        return value

    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    scheme, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or not samples or bits not in (8, 16, 32) or len(set(tags.get(BITS, [1]))) > 1:
        raise TiffError(f"size {width} x {height} x {samples}, {tags.get(BITS)} bits")
    if predictor not in (1, 2) or planar not in (1, 2) or scheme not in EXPANSION:
        raise TiffError(f"predictor {predictor}, planes {planar}, compression {scheme}")
    if one(FILL_ORDER, 1) != 1 or one(SAMPLE_FORMAT, 1) not in (1, 2):
        raise TiffError(f"fill order {tags.get(FILL_ORDER)}, sample format {tags.get(SAMPLE_FORMAT)}")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        cw, ch, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags.get(TILE_COUNTS, [])
    else:
        cw, ch = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, [])
    if not cw or not ch:
        raise TiffError(f"strips or tiles of {cw} x {ch}")
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // cw), -(-height // ch)
    cells = across * down * planes
    if min(len(offsets), len(counts)) < cells:
        raise TiffError("too few strips or tiles")
    spans = list(zip(offsets[:cells], counts[:cells]))
    if not all(isinstance(x, int) and x >= 0 for span in spans for x in span):
        raise TiffError("offsets or byte counts are no sizes")
    cell_bytes = cw * ch * each * kind.itemsize
    if max(width * height * samples * kind.itemsize, cell_bytes) > max_bytes:
        raise TiffError(f"a page of {width} x {height} x {samples} is larger than {max_bytes} bytes")
    for i, (at, count) in enumerate(spans):
        rows = ch if tiled else min(ch, height - i % (across * down) // across * ch)
        if min(count, max(0, len(data) - at)) * EXPANSION[scheme] + 8 < rows * cw * each * kind.itemsize:
            raise TiffError("short strip or tile")
    out = np.empty((height, width, samples), kind.newbyteorder("="))
    for i, (at, count) in enumerate(spans):
        plane, cell = divmod(i, across * down)
        y, x = cell // across * ch, cell % across * cw
        rows = ch if tiled else min(ch, height - y)
        size = rows * cw * each * kind.itemsize
        raw = _unpack(data[at : at + count], scheme, size)
        if len(raw) < size:
            raise TiffError("short strip or tile")
        block = np.frombuffer(raw, kind, rows * cw * each).reshape(rows, cw, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        h, w = min(rows, height - y), min(cw, width - x)
        out[y : y + h, x : x + w, plane : plane + each] = block[:h, :w]
    return out


def read_tiff(data: bytes, max_bytes: int = MAX_PAGE_BYTES) -> Iterator[tuple[dict[int, list], np.ndarray]]:
    """(tags, pixels) of each page."""
    for order, tags in directories(data):
        try:
            pixels = _page(data, order, tags, max_bytes)
        except zlib.error as e:
            raise TiffError(f"page cannot be read: {e}") from e
        yield tags, pixels


def feature(pixels: np.ndarray) -> str:
    """Size, mean of each sample in thousandths, and a 64-bit average hash of an 8 x 8 grid, all from integers."""
    height, width, samples = pixels.shape
    means = pixels.reshape(-1, samples).sum(axis=0, dtype=np.int64) * 1000 // (height * width)
    grid = pixels[np.ix_(np.arange(8) * height // 8, np.arange(8) * width // 8)].sum(axis=2, dtype=np.int64).reshape(-1)
    bits = np.packbits(grid * 64 >= grid.sum()).tobytes().hex()
    return f"{width}x{height}x{samples}:{'/'.join(map(str, means))}:{bits}"


_PAGES = (
    "page int, width int, height int, samples int, bits int, compression int, predictor int, "
    "feature string, pixels binary, error string"
)


def tiff_pages(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page: the id, page number, its sizes and scheme, a feature, and the raw samples.

    An unreadable value gives the pages before the fault, then page -1 with ``error``.
    """

    def rows(ident, value):
        try:
            if value is None:
                raise TiffError("no value")
            for i, (tags, px) in enumerate(read_tiff(value)):
                yield (ident, i, px.shape[1], px.shape[0], px.shape[2], px.itemsize * 8, tags.get(COMPRESSION, [1])[0],
                       tags.get(PREDICTOR, [1])[0], feature(px), px.tobytes(), None)
        except TiffError as e:
            yield (ident, -1, None, None, None, None, None, None, None, None, str(e))

    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i in range(len(batch)):
                kinds = [ids.type, *[pa.int32()] * 7, pa.string(), pa.binary(), pa.string()]
                for row in rows(ids[i].as_py(), batch.column(1)[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=names)

    names = [id_col, *(c.split()[0] for c in _PAGES.split(", "))]
    return media.select(id_col, F.col(media_col).cast("binary")).mapInArrow(run, f"{id_col} {kind}, {_PAGES}")


ROW_BYTES, PAGE_ROWS = 192, 512
#: The ways in which pages are stored; a payload's checksum picks its first page's, and each page takes the next.
LAYOUTS = [Layout("deflate", 2), Layout("lzw", 1, tile=16), Layout("packbits", 1, rows_per_strip=32), Layout("deflate", 1, tile=64)]


def store_text(text: str | None) -> tuple[bytes, bytes]:
    """(payload, TIFF of it): UTF-8 padded with blanks to rows of 64 RGB pixels, in pages of at most ``PAGE_ROWS`` rows."""
    raw = (text or "").encode("utf-8")
    payload = raw + b" " * (max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES - len(raw))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    pages = [rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)]
    first = zlib.crc32(payload)
    return payload, write_tiff(pages, [LAYOUTS[(first + k) % len(LAYOUTS)] for k in range(len(pages))])


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a TIFF, read the stored bytes back page by page, and return digests and a feature of all pages."""

    def run(batches):
        for batch in batches:
            got = []
            for text in batch.column(1):
                text = text.as_py()
                media = store_text(text)[1]
                pixels = np.concatenate([px for _, px in read_tiff(media)])
                back = pixels.tobytes()
                got.append((len((text or "").encode("utf-8")), len(back), hashlib.sha256(back).hexdigest(),
                            zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
            columns = list(zip(*got)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run,
        f"{id_col} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string",
    )


def op9_tiff_media(spark, sf_dir: str) -> DataFrame:
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
