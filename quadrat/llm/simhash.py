"""SimHash near-duplicate detection by bit-sliced comparison.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a bit of a text's
64-bit fingerprint is 1 if it is set in over half of the XXH64 hashes (seed 42)
of its three-word shingles, repeats included (fewer words: the whole sequence
as one shingle). Fingerprints that differ in at most ``radius`` bits are linked.
The plan:

1. one pass over the whole texts gives a narrow table (id, fingerprint);
2. equal fingerprints collapse to one node (map-side combined, so a group of
   copies of any size is one row);
3. the 64 bits are cut in ``parts`` parts. A pair within the radius is equal in
   ``parts - radius`` of them, so it shares a bucket in one of C(parts, radius)
   tables; buckets with one fingerprint go;
4. a bucket of more than ``block`` fingerprints is laid out in tiles, every
   two of its chunks meet in one, so no task holds more than 2 x ``block`` rows
   of a bucket. A tile returns a spanning forest of its links, never its pairs;
5. union-find over the forests gives the components.

In a tile the 64 bits of all fingerprints stand vertically, one plane of lanes
for each bit. The fingerprints are compared with those ``d`` lanes on, for all
``d`` in turn: one XOR compares 64 pairs in one bit, carry-save bitwise counters
that overflow beyond the radius add the planes up, and words whose lanes have
all overflowed are abandoned. Comparisons within one bucket of m different
fingerprints grow as m squared / 64 words.

NULL and empty texts and those without words have fingerprint zero and are
linked like any other. Every input row gets a result row; repeated rows and ids
are rows like any other. A row with a NULL id has the smallest id that it leads
to, NULL if there is none. Texts of any length are read whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.memory import releasing
from quadrat.operators.components import connected_components
from quadrat.session import cut

WIDTH, SEED, RADIUS, PARTS = 3, 42, 3, 5
BLOCK, LANES, STEP = 8192, 65_536, 8
HOT, SALTS = 512, 64
_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text in UTF-8."""
    words = text.lower().split() if text else ()
    n = len(words)
    if not n:
        return 0
    k = min(n, width)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 16_384):
        spans = zip(starts[at : at + 16_384], ends[at : at + 16_384])
        h = np.array([hashed(line[a:b], seed) for a, b in spans], _U)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(_U)[0])


def _sketch(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], names=["id", "fp"])

    return run


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes (64, words): lane i is bit i % 64 of word i // 64; two empty words follow."""
    n = len(prints)
    lanes = np.zeros((64, (-(-n // 64) + 2) * 64), np.uint8)
    lanes[:, :n] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return np.packbits(lanes, axis=1, bitorder="little").view(_U)


def near_lanes(bits: np.ndarray, d: int, asked: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes among ``asked`` (words of lanes) that differ from the lane ``d`` on in at most ``radius`` bits."""
    q, r = divmod(d, 64)
    at = np.flatnonzero(asked)
    alive = asked[at]
    levels = max(1, int(radius).bit_length())
    start = (1 << levels) - 1 - radius  # one more than ``radius`` differing planes overflow
    counter = [np.full(len(at), _FULL if start >> i & 1 else 0, _U) for i in range(levels)]
    for plane in range(0, 64, STEP):
        if not len(at):
            break
        part = bits[plane : plane + STEP]
        beyond = part[:, at + q]
        if r:
            beyond = (beyond >> _U(r)) | (part[:, at + q + 1] << _U(64 - r))
        differ = part[:, at] ^ beyond
        over = np.zeros(len(at), _U)
        for i in range(0, STEP, 2):
            a, b, c = counter[0], differ[i], differ[i + 1]
            both = a ^ b
            counter[0], carry = both ^ c, (a & b) | (both & c)
            for level in range(1, levels):
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            over |= carry
        alive &= ~over
        going = alive != 0
        if not going.all():
            at, alive, counter = at[going], alive[going], [x[going] for x in counter]
    if not len(at):
        return np.empty(0, np.int64)
    word, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return at[word] * 64 + lane


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flat labels (smallest lane of a group) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def forest(prints: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest (row, smaller row) of the links within groups.

    Rows of side 0 and 1 are compared across; rows of side 2 with all.
    """
    _, code, size = np.unique(group, return_inverse=True, return_counts=True)
    order = np.lexsort((side, code, -size[code]))
    order = order[size[code[order]] > 1]
    n = len(order)
    if not n:
        return []
    code, side = code[order], side[order]
    first = np.concatenate(([True], code[1:] != code[:-1]))
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    left = size[code] - (np.arange(n) - begin)  # rows of the group from here on
    bits, label = planes(prints[order]), np.arange(n)
    whole = bool((side == 2).all())
    width = size[code]
    for d in range(1, int(width[0])):
        some = int(np.searchsorted(-width, -d))  # groups of more than d rows come first
        asked = left[:some] > d
        if not whole:
            here, there = side[:some], side[np.minimum(np.arange(some) + d, n - 1)]
            asked &= (here != there) | (here == 2)
        lanes = np.zeros((bits.shape[1] - 2) * 64, bool)
        lanes[:some] = asked
        near = near_lanes(bits, d, np.packbits(lanes, bitorder="little").view(_U), radius)
        if len(near):
            label = _joined(label, near, near + d)
    found = np.flatnonzero(label != np.arange(n))
    return list(zip(order[found].tolist(), order[label[found]].tolist()))


def _compare(radius: int):
    """Rows (tile, fp, side) come sorted by tile; whole tiles are compared together, about ``LANES`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(rows: np.ndarray) -> pa.RecordBatch | None:
            pairs = forest(rows[1].view(_U), rows[0], rows[2], radius) if rows.shape[1] else []
            if not pairs:
                return None
            i, j = np.array(pairs).T
            return pa.RecordBatch.from_arrays([pa.array(rows[1][i], pa.int64()), pa.array(rows[1][j], pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(h.shape[1] for h in held) >= LANES:
                rows = np.concatenate(held, axis=1)
                full = int(np.searchsorted(rows[0], rows[0, -1]))  # the last tile may go on
                held = [rows[:, full:]]
                if (found := linked(rows[:, :full])) is not None:
                    yield found
        if held and (found := linked(np.concatenate(held, axis=1))) is not None:
            yield found

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_keys(fp: Column, radius: int, parts: int) -> list[Column]:
    """One key for each choice of ``parts - radius`` parts that are equal."""
    edge = [64 * i // parts for i in range(parts + 1)]
    masks = [sum(((1 << edge[i + 1]) - (1 << edge[i])) for i in same) for same in combinations(range(parts), parts - radius)]
    return [F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)]


def _met(rows: DataFrame, one: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for each ``key`` and the number ``k`` of its rows.

    Keys with more than a 256th of all ``total`` rows (so at most 256 of them,
    which are broadcast) meet over ``SALTS`` keys, by the hash of ``spread``.
    """
    hot = F.col("k") > max(HOT, total // 256)
    few = F.broadcast(one.where(hot).select(key, F.lit(True).alias("hot")))
    salted = rows.join(few, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(one.withColumn("salt", F.explode(salts)), [key, "salt"]).drop("salt", "hot")


def _tiled(prints: DataFrame, radius: int, parts: int, block: int) -> DataFrame:
    """``(tile, fp, side)``: where each fingerprint is compared."""
    keys = bucket_keys(F.col("fp"), radius, parts)
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "buckets")
    met = _met(keyed, sizes, "key", "fp", prints.count() * len(keys))
    met = met.withColumn("g", F.ceil(F.col("k") / F.lit(block)).cast("int"))
    met = met.withColumn("i", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g")).cast("int"))
    i = F.col("i")
    at = F.transform(
        F.sequence(F.lit(0), F.col("g") - 1),
        lambda j: F.struct(
            F.xxhash64("key", F.least(i, j), F.greatest(i, j)).alias("tile"),
            F.when(i == j, 2).when(i < j, 0).otherwise(1).alias("side"),
        ),
    )
    return met.select("fp", F.explode(at).alias("at")).select("at.tile", "fp", "at.side")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = PARTS,
    width: int = WIDTH, seed: int = SEED, block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id, kept)`` for each row of ``docs``; more ``parts`` make more tables of smaller buckets."""
    if not 0 <= radius < parts <= 64:
        raise ValueError("radius must be less than parts")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sketch = cut(texts.mapInArrow(releasing(_sketch(width, seed)), "id bigint, fp bigint"), "fingerprints")
    prints = cut(sketch.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")), "prints")
    dealt = _tiled(prints.select("fp"), radius, parts, block).repartition(F.col("tile")).sortWithinPartitions("tile")
    links = dealt.mapInArrow(releasing(_compare(radius)), "a bigint, b bigint")
    groups = connected_components(links).withColumnRenamed("node", "fp")
    grouped = prints.join(groups, "fp")
    least = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    owner = prints.join(grouped.join(least, "root").select("fp", "component"), "fp", "left")
    owner = cut(owner.select("fp", F.coalesce("component", "rep").alias("component_id"), "k"), "owners")
    found = _met(sketch, owner, "fp", "id", sketch.count())
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def op13_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
