"""TIFF round trips through every scheme and layout, pages, and broken files."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from quadrat.llm import tiff


@pytest.mark.parametrize("scheme", list(tiff.SCHEMES))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_round_trip(scheme, predictor, tile, dtype):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 250, (37, 45, 3)).astype(dtype), np.full((5, 64, 1), 7, dtype), np.tile(np.arange(200, dtype=dtype)[:, None, None], (1, 30, 3))]
    data = tiff.write_tiff(pages, tiff.Layout(scheme, predictor, rows_per_strip=16, tile=tile))
    back = [p for _, p in tiff.read_tiff(data)]
    assert len(back) == 3 and all((a == b).all() and a.dtype == b.dtype for a, b in zip(pages, back))


def test_lzw_over_long_and_repetitive_data():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"ab" * 20_000, rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(), bytes(range(256)) * 40):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def test_big_endian_directory_is_walked():
    raw = bytes(range(12))
    ifd = struct.pack(">H", 9)
    for tag, field, value in ((256, 4, 4), (257, 4, 3), (258, 3, 8 << 16), (259, 3, 1 << 16), (262, 3, 1 << 16), (273, 4, 8), (277, 3, 1 << 16), (278, 4, 3), (279, 4, 12)):
        ifd += struct.pack(">HHII", tag, field, 1, value)
    data = b"MM\0*" + struct.pack(">I", 20) + raw + ifd + struct.pack(">I", 0)
    ((_, px),) = tiff.read_tiff(data)
    assert px.tobytes() == raw


def test_pages_and_faults(spark):
    two = tiff.write_tiff([np.zeros((2, 3, 1), np.uint8), np.ones((4, 5, 3), np.uint8)], tiff.Layout())
    loop = bytearray(tiff.write_tiff([np.zeros((2, 3, 1), np.uint8)], tiff.Layout()))
    (at,) = struct.unpack_from("<I", loop, 4)
    (n,) = struct.unpack_from("<H", loop, at)
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    rows = [(1, two, "p"), (2, None, "p"), (3, b"", "p"), (4, b"II*\0\xff\xff\0\0", "p"), (5, bytes(loop), "p"), (6, two[:40], "p"), (1, two, "p")]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "id int, media binary, page string"), "id", "media").collect()
    pages = {}
    for r in got:
        pages.setdefault(r.id, []).append((r.page, r.width, r.height, r.samples))
    assert sorted(pages[1]) == [(0, 3, 2, 1), (0, 3, 2, 1), (1, 5, 4, 3), (1, 5, 4, 3)]
    assert all(pages[k][-1][0] == -1 for k in (2, 3, 4, 5, 6)) and len(pages[5]) == 2
    assert tiff.tiff_pages(spark.createDataFrame([], "id int, media binary"), "id", "media").count() == 0


def with_tag(tag, value):
    """A file of one page in one strip with one of its numbers changed."""
    data = bytearray(tiff.write_tiff([np.arange(60, dtype=np.uint8).reshape(4, 5, 3)], tiff.Layout("none")))
    (at,) = struct.unpack_from("<I", data, 4)
    for i in range(struct.unpack_from("<H", data, at)[0]):
        spot = at + 2 + 12 * i
        if struct.unpack_from("<H", data, spot)[0] == tag:
            struct.pack_into("<HII", data, spot + 2, 4, 1, value)
    return bytes(data)


def test_hostile_numbers_are_errors(spark):
    bad = [with_tag(t, v) for t, v in ((278, 0), (256, 0), (257, 0), (277, 0), (256, 1 << 31), (257, 1 << 31), (277, 60_000), (273, 1 << 30), (279, 1), (259, 99), (317, 3), (284, 7), (258, 4))]
    tiled = bytearray(tiff.write_tiff([np.zeros((20, 20, 1), np.uint8)], tiff.Layout("lzw", tile=16)))
    (at,) = struct.unpack_from("<I", tiled, 4)
    for i in range(struct.unpack_from("<H", tiled, at)[0]):
        if struct.unpack_from("<H", tiled, at + 2 + 12 * i)[0] == 322:
            struct.pack_into("<I", tiled, at + 10 + 12 * i, 0)
    bad.append(bytes(tiled))
    for data in bad:
        with pytest.raises(tiff.TiffError):
            list(tiff.read_tiff(data))
    with pytest.raises(tiff.TiffError, match="larger"):
        list(tiff.read_tiff(with_tag(258, 8), max_bytes=59))
    got = tiff.tiff_pages(spark.createDataFrame(list(enumerate(bad)), "id int, media binary"), "id", "media").collect()
    assert len(got) == len(bad) and all(r.page == -1 and r.error for r in got)


def test_damaged_files_raise_nothing_else():
    rng = np.random.default_rng(11)
    whole = [
        tiff.write_tiff([rng.integers(0, 9, (20, 30, 3)).astype(np.uint8), np.ones((9, 9, 1), np.uint16)], tiff.Layout(scheme, predictor, rows_per_strip=7, tile=tile))
        for scheme in tiff.SCHEMES for predictor in (1, 2) for tile in (0, 16)
    ]
    for k in range(2_000):
        data = bytearray(whole[k % len(whole)])
        (at,) = struct.unpack_from("<I", data, 4)
        for _ in range(rng.integers(1, 6)):
            spot = int(rng.integers(at, min(len(data), at + 200)) if rng.random() < 0.7 else rng.integers(0, len(data)))
            data[spot] = int(rng.choice([0, 1, 2, 127, 128, 254, 255, rng.integers(256)]))
        if rng.random() < 0.3:
            del data[int(rng.integers(8, len(data))) :]
        try:
            for _, px in tiff.read_tiff(bytes(data)):
                tiff.feature(px)
        except tiff.TiffError:
            pass


def test_stored_texts_use_every_layout():
    used = set()
    for k in range(40):
        payload, media = tiff.store_text(f"text {k} " * (40 if k % 8 else 30_000))
        pages = list(tiff.read_tiff(media))
        assert b"".join(px.tobytes() for _, px in pages) == payload and len(pages) == -(-len(payload) // (192 * tiff.PAGE_ROWS))
        used |= {(tags[tiff.COMPRESSION][0], tags[tiff.PREDICTOR][0], tiff.TILE_WIDTH in tags) for tags, _ in pages}
    assert used == {(tiff.SCHEMES[x.scheme], x.predictor, bool(x.tile)) for x in tiff.LAYOUTS}


def test_stored_texts(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "long " * 30_000, "a"]
    got = tiff.store_and_read(spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, feature string")).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        media = tiff.store_text(texts[r.doc_id])[1]
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
    same = {r.doc_id: tuple(r)[1:] for r in got}
    assert same[2] == same[7] and same[0] == same[1]
