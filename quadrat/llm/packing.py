"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Texts become token ids (and an end id), cut into pieces of at most
``capacity``. Full pieces are sequences of their own. The others are dealt at
random into problems of about ``GROUP`` pieces; every problem is solved on
islands, each a population of packings. Crossover injects the best filled bins
of one parent whole into the other, drops the bins that hold the same pieces,
and places the displaced pieces by best fit, largest first. After each epoch
the elite of an island moves to the next island of its problem. An island rests
once its best packing needs no more bins than the lower bound and all but one
of them are full.

Fitness counts bins first and then favours full ones, so a problem's free room
gathers in few bins. The ``HANDED`` emptiest bins of each problem go, opened,
into a next and much smaller round, until one problem is left: the room of all
problems together ends in that one's last bins, with more islands and
generations to search them.

Only lengths travel between islands, never texts or ids. A problem's size is
bounded by the deal, so a hot key cannot gather in one.

A NULL text counts as empty: one piece with the end id alone. Repeated rows
and ids are packed like others, each as a row of its own; a text of any length
is cut into pieces; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.memory import releasing
from quadrat.session import cut

CAPACITY, END_ID = 4096, 1
GROUP, LEAST_BINS, HANDED, POPULATION = 4096, 64, 8, 4
EFFORT, LAST_EFFORT = (2, 2, 4), (4, 3, 40)  # islands, epochs, generations of an epoch: every problem, and the last one
_CACHE = 450_000

# ---- tokens ----

_LATIN = [c for c in map(chr, range(0x180)) if c.isprintable() and c not in "İ" or c in "\t\n\r"]
_CLASS = lambda test: "".join(re.escape(c) for c in _LATIN if test(unicodedata.category(c)))
_LETTER, _NUMBER, _BLANK = _CLASS(lambda k: k[0] == "L"), _CLASS(lambda k: k[0] == "N"), "\t\n\r "
#: Texts of these characters split into words here; the tokenizer library sees each distinct word once.
_PLAIN = re.compile("[" + "".join(re.escape(c) for c in _LATIN) + "]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")


class Packer:
    """text -> packed 32-bit ids, through the tokenizer library, with distinct words remembered (a bounded number).

    The words of a text that are not known yet go to the library together, with blanks between them.
    The file's added tokens are found in texts as the library finds them: texts that hold one go to it whole.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}

        self.library = Tokenizer.from_buffer(raw)
        self.added = [t["content"].lower() for t in json.loads(raw).get("added_tokens") or ()]

    def _direct(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        found: list[list[int]] = [[] for _ in words]
        coded = self.library.encode(" ".join(words), add_special_tokens=False)
        for token, word in zip(coded.ids, coded.word_ids):
            found[word].append(token)
        return {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in zip(words, found)}

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text):
            return self._direct(text)
        low = text.lower()
        if any(c in low for c in self.added):
            return self._direct(text)
        words = _WORDS.findall(low)
        unknown = set(words).difference(self.known)
        if not unknown:
            return b"".join(map(self.known.__getitem__, words))
        if len(self.known) + len(unknown) > _CACHE:
            self.known.clear()
            unknown = set(words)
        learned = self._learn(list(unknown))
        self.known |= learned
        out = b"".join(map(self.known.__getitem__, words))
        for w in learned:
            if len(w) > 64:
                del self.known[w]
        return out


_PACKERS: dict[bytes, Packer] = {}


def packer(raw: bytes) -> Packer:
    """The worker's packer for this tokenizer file; it lives as long as the worker, with the words it knows."""
    key = hashlib.md5(raw).digest()
    if key not in _PACKERS:
        _PACKERS.clear()
        _PACKERS[key] = Packer(raw)
    return _PACKERS[key]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every whole text; the tokenizer file is read once and broadcast."""
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = packer(raw.value)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = code.ids(text.as_py()) + end
                for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[b : b + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(b // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        releasing(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


# ---- the genetic algorithm: a packing is a list of bins, a bin a list of item numbers ----


def best_fit(bins: list[list[int]], items: list[int], size: list[int], capacity: int) -> None:
    """Place ``items`` in order, each where the least room stays; new bins as needed."""
    room = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (size[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - size[i], len(bins) - 1))
            continue
        left, k = room.pop(at)
        bins[k].append(i)
        if left > size[i]:
            insort(room, (left - size[i], k))


def fills(bins: list[list[int]], size: list[int]) -> list[int]:
    return [sum([size[i] for i in b]) for b in bins]


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, int]:
    """Fewer bins first; among equals, fuller full bins (sum of squares)."""
    return -len(bins), sum([f * f for f in fills(bins, size)])


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng) -> list[list[int]]:
    fill = fills(b, size)
    filled = sorted(range(len(b)), key=lambda k: -fill[k])
    taken = [b[k] for k in filled[: max(1, int(len(b) * rng.uniform(0.2, 0.6)))]]
    inside = {i for t in taken for i in t}
    kept = [x for x in a if inside.isdisjoint(x)]
    held = {i for x in kept for i in x} | inside
    child = [list(t) for t in taken] + [list(x) for x in kept]
    loose = sorted((i for x in a for i in x if i not in held), key=lambda i: -size[i])
    best_fit(child, loose, size, capacity)
    return child


def mutate(bins: list[list[int]], size: list[int], capacity: int, rng) -> list[list[int]]:
    """Empty the least filled bin and a few others, and place their pieces again."""
    fill = fills(bins, size)
    order = sorted(range(len(bins)), key=lambda k: fill[k])
    gone = {order[0], *rng.choice(len(bins), min(len(bins), 4), replace=False).tolist()}
    child = [list(x) for k, x in enumerate(bins) if k not in gone]
    best_fit(child, sorted((i for k in gone for i in bins[k]), key=lambda i: -size[i]), size, capacity)
    return child


def to_bins(label: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(label, default=-1) + 1)]
    for i, b in enumerate(label):
        bins[b].append(i)
    return [b for b in bins if b]


def to_labels(bins: list[list[int]], n: int) -> list[int]:
    label = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            label[i] = k
    return label


def evolve(size: list[int], capacity: int, seed: int, elites: list[list[int]], generations: int, population: int) -> list[list[int]]:
    """Evolve one island for an epoch; elites are label lists. Returns its two best packings as label lists."""
    total, least = sum(size), -(-sum(size) // capacity)
    best = -least, (least - 1) * capacity**2 + (total - (least - 1) * capacity) ** 2
    rated = lambda bins: (fitness(bins, size, capacity), bins)
    rank = lambda pool: pool.sort(key=lambda x: x[0], reverse=True)
    pool = [rated(to_bins(e)) for e in elites]
    rng = np.random.default_rng(seed)
    if not pool:
        first: list[list[int]] = []
        best_fit(first, sorted(range(len(size)), key=lambda i: -size[i]), size, capacity)
        pool = [rated(first)]
    rank(pool)
    if pool[0][0] < best:
        while len(pool) < population:
            noise = rng.uniform(0.7, 1.3, len(size)).tolist()
            bins: list[list[int]] = []
            best_fit(bins, sorted(range(len(size)), key=lambda i: -size[i] * noise[i]), size, capacity)
            pool.append(rated(bins))
        rank(pool)
        for _ in range(generations):
            if pool[0][0] >= best:
                break
            a, b = rng.choice(min(3, len(pool)), 2, replace=False)
            child = crossover(pool[a][1], pool[b][1], size, capacity, rng)
            changed = mutate(child, size, capacity, rng)
            pool[-1] = max(rated(child), rated(changed), key=lambda x: x[0])
            rank(pool)
    return [to_labels(b, len(size)) for _, b in pool[:2]]


_STATE = "g bigint, island int, size array<int>, elites array<array<int>>, bins int"


def _epoch(capacity: int, generations: int, population: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seed = (row["g"] * 1_000 + row["island"]) * 100 + epoch
                elites = evolve(row["size"], capacity, seed, row["elites"] or [], generations, population)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["g"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["size"]], pa.list_(pa.int32())),
                     pa.array([elites], pa.list_(pa.list_(pa.int32()))), pa.array([max(elites[0]) + 1], pa.int32())],
                    names=["g", "island", "size", "elites", "bins"],
                )

    return run


_PIECE = ("u", "doc_id", "piece", "start", "length", "ids_crc32")


def _laid_out(capacity: int, handed: int, stage: int):
    """Each problem's pieces with their sequence and offset; ``again`` marks those of the ``handed`` emptiest bins with room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                g, label = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                items = batch.column(1)[k].values
                length = items.field("length").to_pylist()
                used = [0] * (max(label) + 1)
                offset = []
                for i, b in enumerate(label):
                    offset.append(used[b])
                    used[b] += length[i]
                opened = {b for f, b in sorted((f, b) for b, f in enumerate(used) if f < capacity)[:handed]}
                yield pa.RecordBatch.from_arrays(
                    [items.field(n) for n in _PIECE]
                    + [pa.array([(stage << 56) + (g << 20) + b for b in label], pa.int64()), pa.array(offset, pa.int64()), pa.array([b in opened for b in label])],
                    names=[*_PIECE, "sequence_id", "offset", "again"],
                )

    return run


def _solved(problems: DataFrame, capacity: int, effort: tuple[int, int, int], stage: int) -> DataFrame:
    """``(g, label)``: the best packing that any island of a problem found."""
    islands, epochs, generations = effort
    state = problems.select(
        "g",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.transform("items", lambda x: x["length"].cast("int")).alias("size"),
        F.lit(None).cast("array<array<int>>").alias("elites"),
        F.lit(0).alias("bins"),
    ).repartition("g", "island")
    for epoch in range(epochs):
        state = cut(state.mapInArrow(_epoch(capacity, generations, POPULATION, stage * 10 + epoch), _STATE), "islands")
        if epoch + 1 < epochs:
            moved = state.select("g", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.element_at("elites", 1).alias("guest"))
            state = state.join(moved, ["g", "island"]).select(
                "g", "island", "size", F.array_distinct(F.concat("elites", F.array("guest"))).alias("elites"), "bins"
            )
    return state.groupBy("g").agg(F.min_by(F.element_at("elites", 1), F.struct("bins", "island")).alias("label"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows ``(doc_id, piece, start, length, ids_crc32)``."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    rows = cut(pieces.withColumn("u", F.monotonically_increasing_id()), "pieces").select(*_PIECE)
    full = rows.where(F.col("length") >= capacity)
    done = [full.withColumns({"sequence_id": -1 - F.col("u"), "offset": F.lit(0).cast("bigint")})]
    loose, stage, groups = rows.where(F.col("length") < capacity), 0, 2
    fields = f"u bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, again boolean"
    while groups > 1:
        n, volume = loose.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, min(-(-n // group), volume // (LEAST_BINS * capacity)))
        item = F.struct((-F.col("length")).alias("k"), *_PIECE)
        dealt = loose.groupBy(F.pmod(F.xxhash64("u", F.lit(stage)), F.lit(groups)).alias("g")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        problems = cut(dealt, "problems")
        best = _solved(problems, capacity, EFFORT if groups > 1 else LAST_EFFORT, stage)
        packed = problems.join(best, "g").select("g", "items", "label").mapInArrow(_laid_out(capacity, HANDED if groups > 1 else 0, stage), fields)
        packed = cut(packed, "packed")
        done.append(packed.where(~F.col("again")).drop("again"))
        loose, stage = packed.where("again").select(*_PIECE), stage + 1
    return reduce(DataFrame.unionByName, done).drop("u")


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenize every whole text and pack the pieces: one row for each piece.

    Ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
    """
    return pack(token_pieces(docs, path, capacity, end_id, id_col, text_col), capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
