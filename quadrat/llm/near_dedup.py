"""MinHash near-duplicate detection with SuperMinHash signatures.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds
the 64-bit hashes of its distinct ``width``-word shingles (fewer words: the
whole sequence as one shingle; no words or NULL: the empty set, linked with
nothing). The plan:

1. one pass over the texts gives set size, 128-bit set fingerprint and the
   band keys of a SuperMinHash signature; only this narrow table is kept;
2. equal sets collapse to one node (map-side combined, so a group of copies
   of any size is one row);
3. nodes that share a band key meet in a star around the key's smallest node;
   the components of these stars are the candidate groups;
4. a candidate group is laid out in blocks by set size: linked sets lie in the
   same or in neighbouring size classes, and a large class is cut in chunks,
   so no task holds more than ``BLOCK_NODES`` x 2 sets. Each block compares
   full shingle sets (rebuilt from the texts) as matrix products and returns a
   spanning forest of its links, never its pairs;
5. union-find over the forests gives the components.

Nulls, empty texts, ties, repeated rows and repeated ids are rows like any
other: every input row gets a result row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.memory import releasing
from quadrat.operators.components import connected_components
from quadrat.session import cut

WIDTH = 5
THRESHOLD = 85  # per cent
BAND_ROWS, BANDS = 6, 24
SLOTS = BAND_ROWS * BANDS
BLOCK_NODES, BLOCK_SHINGLES = 1024, 2_000_000
_CACHE = 200_000
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    n = len(tokens)
    if not n:
        return np.empty(0, _U)
    w = np.fromiter(map(words.__getitem__, tokens), _U, n)
    k = min(n, width)
    s = np.full(n - k + 1, _U(k))
    for i in range(k):
        s = s * _U(0x100000001B3) + w[i : n - k + 1 + i]
        s ^= s >> _U(29)
    s = _mix(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row a set (empty sets: all ones).

    An element visits the slots in the order of a random permutation; its j-th
    visit offers j plus a fraction. All elements make their j-th visit
    together. A set stops as soon as no slot is empty or above level j, since
    later visits offer more; sets much larger than the signature stop at once.
    Values are fixed-point: level in the top 16 bits, fraction in the rest.
    """
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, _U)
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    at = 0
    while at < len(order):
        size, group = 0, []
        while at < len(order) and (not group or size + len(sets[order[at]]) <= 65_536):
            group.append(order[at])
            size += len(sets[order[at]])
            at += 1
        _visit(out, group, sets, slots)
    return out


def _visit(out: np.ndarray, group: list[int], sets: list[np.ndarray], slots: int) -> None:
    element = np.concatenate([sets[i] for i in group])
    owner = np.repeat(np.arange(len(group)), [len(sets[i]) for i in group])
    sig = np.full(len(group) * slots, np.iinfo(np.uint64).max, _U)
    perm = None
    for level in range(slots):
        r = _mix(element + _U(0x9E3779B97F4A7C15 * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF))
        slot = level + ((r >> _U(32)) * _U(slots - level) >> _U(32)).astype(np.int64)
        if perm is not None:
            rows = np.arange(len(element))
            taken = perm[rows, slot]
            perm[rows, slot] = perm[:, level]
            perm[:, level] = taken
            to = taken.astype(np.int64)
        else:
            first, to = slot, slot
        value = (_U(level) << _U(48)) | (_mix(r ^ _GOLD) >> _U(16))
        np.minimum.at(sig, owner * slots + to, value)
        worst = sig.reshape(-1, slots).max(axis=1) >> _U(48)
        going = (worst > level)[owner]
        if not going.any():
            break
        element, owner = element[going], owner[going]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(element), 1))
            rows, slot = np.arange(len(element)), first[going]
            perm[rows, slot], perm[:, 0] = 0, slot
        else:
            perm = perm[going]
    out[group] = sig.reshape(-1, slots)


def band_keys(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` slots."""
    bands = signatures.shape[1] // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _GOLD, (len(signatures), bands)).copy()
    parts = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        key = _mix(key * _U(0x100000001B3) + parts[:, :, i])
    return key


_SKETCH = "id bigint, n bigint, node binary, bands array<bigint>"


def _sketch(width: int, slots: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                sets, volume = [], 0
                start = at
                while at < len(texts) and volume < 1_000_000 and at - start < 2_000:
                    sets.append(shingle_set(texts[at].as_py(), words, width))
                    volume += len(sets[-1])
                    at += 1
                keys = band_keys(superminhash(sets, slots), band_rows).view(np.int64)
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, at - start).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if ok else None for s, ok in zip(sets, some)], pa.binary()),
                        pa.array([k if ok else None for k, ok in zip(keys, some)], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "node", "bands"],
                )

    return run


def _tallied(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of the sets of one block.

    Shingles of many sets go through matrix products, those of few through
    counted pairs, so the cost is bounded by the block's volume.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    allof = np.concatenate(sets)
    order = np.argsort(allof, kind="stable")
    allof, owner = allof[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], allof[1:] != allof[:-1])))
    df = np.diff(np.append(starts, len(allof)))
    inter = np.zeros((n, n), np.float32)
    dense = max(8, n // 12)
    wide = np.flatnonzero(df >= dense)
    for i in range(0, len(wide), 1024):
        cols = wide[i : i + 1024]
        m = np.zeros((n, len(cols)), np.float32)
        for c, k in enumerate(cols):
            m[owner[starts[k] : starts[k] + df[k]], c] = 1
        inter += m @ m.T
    flat = inter.reshape(-1)
    for d in range(2, dense):
        these = starts[df == d]
        step = max(1, 2_000_000 // (d * d))
        for i in range(0, len(these), step):
            rows = owner[these[i : i + step, None] + np.arange(d)]
            pair = (rows[:, :, None] * n + rows[:, None, :]).reshape(-1)
            if len(pair) * 4 < n * n:
                np.add.at(flat, pair, np.float32(1))
            else:
                flat += np.bincount(pair, minlength=n * n).astype(np.float32)
    return inter


def block_forest(sets: list[np.ndarray], sides: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links in a block: pairs (row, smaller row).

    Rows of side 0 and side 1 are compared across; side 2 marks a block whose
    rows are all compared with each other.
    """
    n = len(sets)
    if n < 2:
        return []
    inter = _tallied(sets).astype(np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    linked = (100 + threshold) * inter >= threshold * (size[:, None] + size[None, :])
    linked &= (sides[:, None] != sides[None, :]) | (sides[:, None] == 2)
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        low = np.minimum(label, low)[low]
        if (low == label).all():
            break
        label = low
    return [(i, int(label[i])) for i in range(n) if label[i] != i]


def _verify(width: int, threshold: int):
    """Rows come sorted by block; one block is held at a time."""

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for _, members in groupby(rows(batches), key=lambda r: r[0]):
            nodes, sides, sets, seen = [], [], [], set()
            for _, node, side, text in members:
                if (node, side) in seen:
                    continue
                s = shingle_set(text, words, width)
                if xxhash.xxh3_128_digest(s.tobytes()) != node:  # another row of a repeated id
                    continue
                seen.add((node, side))
                nodes.append(node)
                sides.append(side)
                sets.append(s)
            found = block_forest(sets, np.array(sides, np.int8), threshold)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i, _ in found], pa.binary()), pa.array([nodes[j] for _, j in found], pa.binary())],
                    names=["a", "b"],
                )

    return run


def _placed(members: DataFrame, threshold: int, block_nodes: int, block_shingles: int) -> DataFrame:
    """``(rep, node, block, side)``: the blocks in which each candidate is compared."""
    base = math.log(100 / (threshold - 1))
    classed = members.withColumn("c", F.floor(F.log("n") / F.lit(base)).cast("int"))
    per_class = classed.groupBy("comp", "c").agg(F.count(F.lit(1)).alias("cnt"), F.sum("n").alias("vol"))
    need = lambda c, v: F.greatest(F.ceil(c / F.lit(float(block_nodes))), F.ceil(v / F.lit(float(block_shingles))))
    per_comp = per_class.groupBy("comp").agg(
        (need(F.sum("cnt"), F.sum("vol")) <= 1).alias("one"),
        F.map_from_entries(F.collect_list(F.struct("c", need(F.col("cnt"), F.col("vol")).cast("int")))).alias("g"),
    )
    sized = classed.join(per_comp, "comp").withColumn(
        "i", F.pmod(F.xxhash64("node", F.lit(7)), F.element_at("g", F.col("c"))).cast("int")
    )
    block = lambda lo, i, hi, j: F.concat_ws("/", F.hex("comp"), lo, i, hi, j)
    c, i = F.col("c"), F.col("i")
    count = lambda k: F.coalesce(F.try_element_at("g", k), F.lit(0))
    upto = lambda k: F.filter(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda x: x < k)
    own = F.transform(
        upto(count(c)),
        lambda j: F.struct(
            block(c, F.least(i, j), c, F.greatest(i, j)).alias("block"),
            F.when(i == j, 2).when(i < j, 0).otherwise(1).alias("side"),
        ),
    )
    up = F.transform(upto(count(c + 1)), lambda j: F.struct(block(c, i, c + 1, j).alias("block"), F.lit(0).alias("side")))
    down = F.transform(upto(count(c - 1)), lambda j: F.struct(block(c - 1, j, c, i).alias("block"), F.lit(1).alias("side")))
    whole = F.array(F.struct(F.hex("comp").alias("block"), F.lit(2).alias("side")))
    return sized.select("rep", "node", F.when(F.col("one"), whole).otherwise(F.concat(own, up, down)).alias("blocks"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    block_nodes: int = BLOCK_NODES,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Two documents are linked if 100 * |intersection| >= threshold * |union|.
    A pair exactly at the default threshold shares no band with a chance of
    about 1e-5, a pair at 0.9 of 1e-8; every candidate is then compared on the
    full sets. ``component_id`` is the smallest id that links lead to. Rows
    with a NULL id keep their own NULL as component.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = cut(texts.mapInArrow(releasing(_sketch(width, bands * band_rows, band_rows)), _SKETCH), "sketch")
    nodes = cut(
        sketch.where("node is not null").groupBy("node").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")
        ),
        "nodes",
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    star = keyed.join(shared, "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    groups = connected_components(star).withColumnRenamed("root", "comp")
    placed = _placed(nodes.drop("bands").join(groups, "node"), threshold, block_nodes, block_shingles)
    shipped = texts.join(placed, texts.id == placed.rep).select("node", "text", F.explode("blocks").alias("at"))
    dealt = (
        shipped.select("at.block", "node", "at.side", "text")
        .repartition(F.col("block"))
        .sortWithinPartitions("block", "node", "side")
    )
    links = dealt.mapInArrow(releasing(_verify(width, threshold)), "a binary, b binary")
    joined = connected_components(links)
    rooted = nodes.select("node", "rep").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    owner = rooted.join(least, "root").select("node", "component")
    return sketch.join(owner, "node", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
