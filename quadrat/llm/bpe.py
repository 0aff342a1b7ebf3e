"""Byte-level BPE encoding and decoding by a rank file.

Each match of the split pattern is encoded for itself. A segment tree over the
byte positions of a piece holds, for every span, the smallest rank of a pair
of adjacent live tokens; ties go to the left child, so the root leads to the
leftmost minimum. A merge updates at most three leaves (the merged token, its
left neighbour, and the position that died) in logarithmic time, so a piece of
n bytes costs O(n log n) even where one piece is a whole document.

Distinct pieces are remembered for a bounded number of pieces; the rank file
is read once by the driver and broadcast (its size does not grow with data).

NULL text counts as empty: no tokens, digests of the empty string. Repeated
rows and ids give repeated result rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the rank files' pattern means it (Unicode White_Space; without U+001C..U+001F).
_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CACHE = 600_000
_DEAD = 1 << 60


def split_pattern(pattern: str) -> regex.Pattern:
    """Compile a tokenizer's pattern with White_Space as its meaning of ``\\s``."""
    inside = regex.sub(r"\[([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{_SPACE}{m[2]}]", pattern)
    return regex.compile(inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: merge the leftmost pair of least rank until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [_DEAD] * (2 * size)
    end = list(range(1, n + 1))  # where the live token that starts here ends
    before = list(range(-1, n - 1))  # start of the live token to the left
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], _DEAD)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(at: int, rank: int) -> None:
        at += size
        tree[at] = rank
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            low = a if a <= b else b
            if tree[at] == low:
                break
            tree[at] = low
            at >>= 1

    while (least := tree[1]) != _DEAD:
        at = 1
        while at < size:
            at *= 2
            if tree[at] != least:
                at += 1
        at -= size
        gone = end[at]
        end[at] = stop = end[gone]
        put(gone, _DEAD)
        if stop < n:
            before[stop] = at
            put(at, ranks.get(piece[at : end[stop]], _DEAD))
        else:
            put(at, _DEAD)
        if at:
            left = before[at]
            put(left, ranks.get(piece[left:stop], _DEAD))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Coder:
    """Encodes texts to packed little-endian 32-bit ids, and back to bytes."""

    class _Pieces(dict):
        def __init__(self, ranks):
            super().__init__()
            self.ranks = ranks

        def __missing__(self, piece: str) -> bytes:
            if len(self) >= _CACHE:
                self.clear()
            ids = merge_piece(piece.encode("utf-8"), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                self[piece] = packed
            return packed

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.find = split_pattern(pattern).findall
        self.pieces = self._Pieces(self.ranks)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text))) if text else b""

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODERS: dict = {}


def coder(raw: bytes, pattern: str) -> Coder:
    """The worker's coder for these ranks; it lives as long as the worker."""
    key = (hashlib.md5(raw).digest(), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(raw, pattern)
    return _CODERS[key]


def _shared(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: token ids of every whole text."""
    raw = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(raw.value, pattern)
        for batch in batches:
            ids = [np.frombuffer(code.encode(t.as_py()), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    plain = docs.select(id_col, F.col(text_col).cast("string"))
    return plain.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, bytes)``: the bytes that token ids stand for (NULL: empty; NULL ids in an array count for nothing)."""
    raw = _shared(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(raw.value, pattern).tokens
        for batch in batches:
            out = [b"".join(table[i] for i in ids.as_py() or () if i is not None) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one pass over the texts."""
    raw = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(raw.value, pattern)
        for batch in batches:
            count, ids, back = [], [], []
            for text in batch.column(1):
                packed = code.encode(text.as_py())
                count.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(code.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids), pa.array(back)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
