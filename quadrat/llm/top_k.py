"""Exact top-k inner-product search by a three-phase uniform threshold.

The components of a vector are split in ``slices``; the inner product is the
sum of one partial score for each slice. Vectors are packed in blocks, and a
block of queries meets a block of candidates in one task:

1. for each query and slice a block of candidates gathers the list of its k
   best partial scores and resolves the entries on the lists, and only those.
   An entry on no list scores at most the sum of the lists' last partial
   scores: the block's bound for the query;
2. the k-th best resolved score over all blocks is a cutoff that is safe, since
   k entries reach it. It goes out to the blocks whose bound reaches it, all
   others have nothing more to say; an entry that reaches cutoff t has a
   partial score of at least t / slices in some slice, so each of those blocks
   collects the entries of its slices at that uniform threshold;
3. what was collected is resolved over all slices, entries under the cutoff
   go, and each block hands on its k best; ties go to the smaller id.

Only k entries for each (query, block) leave a task. Query blocks, the smaller
side, travel to the candidates, each once to every part of the candidates; a part is a
number of blocks, and there are a few parts a core however many blocks there are. Spark
takes a side for as small as it was before it was repeated, so joins say that
nothing is broadcast. The more candidates there are, the higher the
cutoff and the fewer blocks phase 2 meets.

Scores are exact for all finite components: products run in float32 or float64
while every sum fits the mantissa, else in 64-bit or unbounded integers. A
score beyond 64 bits counts, and is returned, as the nearest 64-bit integer.

Vectors that are NULL, empty or hold NULL or non-finite components, and rows
without an id, take no part. Vectors of different lengths are not compared.
Every row with an id that is a multiple of ``every`` is a query; a candidate
with the query's id is its own row and left out. Repeated rows are candidates
and queries each on its own, with equal results. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.session import cut

K, EVERY, SLICES = 20, 20, 2
QUERY_BLOCK, BLOCK, WIDE_BLOCK = 512, 4096, 64
PARTS = 4  # parts of the candidates a core, at most
_MOST = (1 << 63) - 1


def _packed(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[tuple[int, bool, list, list]]:
    """Blocks of vectors of one length: (length, wide, ids, vectors). Scaled components that don't fit 32 bits are kept apart, unscaled."""
    held: dict[tuple[int, bool], tuple[list, list]] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        plain = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            flat = np.floor(scale * plain)
        ends = np.cumsum([len(x) for x in lists])
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            wide = bool(np.abs(flat[a:b]).max() >= 2**31)
            key = int(b - a), wide
            found = held.setdefault(key, ([], []))
            found[0].append(ids[i])
            found[1].append(plain[a:b] if wide else flat[a:b])
            if len(found[0]) == (min(size, WIDE_BLOCK) if wide else size):
                yield (*key, *held.pop(key))
    for key, found in held.items():
        yield (*key, *found)


def _pack(size: int, scale: int):
    def run(batches):
        for d, wide, ids, vectors in _packed(batches, size, scale):
            raw = np.array(vectors).astype(np.float64 if wide else np.int32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([wide]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([raw], pa.binary())],
                names=["d", "wide", "ids", "raw"],
            )

    return run


def _integers(raw: bytes, d: int, wide: bool, scale: int) -> np.ndarray:
    """Scaled vectors as 32-bit integers, or as unbounded ones where they are wide."""
    if not wide:
        return np.frombuffer(raw, np.int32).reshape(-1, d)
    whole = [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in np.frombuffer(raw, np.float64).tolist()]
    return np.array(whole, object).reshape(-1, d)


def _partial(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial scores (query, candidate) of each slice, as exact numbers."""
    most = lambda x: max(-int(x.min()), int(x.max()))
    bound = most(q) * most(c) * q.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < _MOST else object
    q, c = q.astype(kind), c.astype(kind)
    return [a @ b.T for a, b in zip(np.array_split(q, slices, axis=1), np.array_split(c, slices, axis=1)) if a.shape[1]]


def _fitted(x: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit integers, the nearest where they don't fit."""
    return np.clip(x, -_MOST, _MOST).astype(np.int64) if x.dtype == object else x.astype(np.int64)


def _sides(row: dict, scale: int, asked: list[int] | None = None) -> tuple:
    q, c = _integers(row["q_raw"], row["d"], row["q_wide"], scale), _integers(row["raw"], row["d"], row["wide"], scale)
    q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    return (q, q_ids, c, ids) if asked is None else (q[asked], q_ids[asked], c, ids)


_LISTS = "qb bigint, at int, query_id bigint, blk bigint, bound bigint, best array<struct<score: bigint, vec_id: bigint>>"


def _kept(at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best entries of each query, best first, ties to the smaller id."""
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], score[keep], ids[keep]


def _listed(qb: int, blk: int, spots: np.ndarray, q_ids: np.ndarray, bounds: list, kept: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """One row for each query: its kept entries and the block's bound."""
    at, score, ids = kept
    ends = np.searchsorted(at, np.arange(len(spots) + 1)).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(score, pa.int64()), pa.array(ids, pa.int64())], names=["score", "vec_id"])
    full = lambda x: pa.array(np.full(len(spots), x, np.int64))
    return pa.RecordBatch.from_arrays(
        [full(qb), pa.array(spots.astype(np.int32)), pa.array(q_ids), full(blk), pa.array(bounds, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), entries)],
        names=["qb", "at", "query_id", "blk", "bound", "best"],
    )


def _gather(k: int, slices: int, scale: int):
    """Phase 1: list, resolve what is listed, and bound the rest."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                q, q_ids, c, ids = _sides(row, scale)
                parts = _partial(q, c, slices)
                n = len(ids)
                own = q_ids[:, None] == ids[None, :]
                lists, last = [], 0
                for part in parts:
                    seen = np.where(own, part.min() - 1, part)
                    lists.append(np.argpartition(seen, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(q), 1)))
                    last = last + np.take_along_axis(seen, lists[-1], axis=1).min(axis=1).astype(object if part.dtype == object else np.int64)
                bounds = _fitted(np.asarray(last)).tolist() if n > k else [None] * len(q)
                entry = np.sort(np.concatenate(lists, axis=1), axis=1)
                good = ~np.take_along_axis(own, entry, axis=1)
                good[:, 1:] &= entry[:, 1:] != entry[:, :-1]
                at, spot = np.nonzero(good)
                col = entry[at, spot]
                score = _fitted(sum(p[at, col] for p in parts))
                yield _listed(row["qb"], row["blk"], np.arange(len(q)), q_ids, bounds, _kept(at, score, ids[col], k))

    return run


def _resolve(k: int, slices: int, scale: int):
    """Phases 2 and 3: collect at the uniform threshold, resolve, keep the k best of the block."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                asked = sorted((a["at"], a["cutoff"]) for a in row["asked"])
                spots = np.array([a for a, _ in asked])
                q, q_ids, c, ids = _sides(row, scale, spots.tolist())
                parts = _partial(q, c, slices)
                cutoff = np.array([-_MOST if t is None else t for _, t in asked], np.int64)
                part_cutoff = (cutoff.astype(object) if parts[0].dtype == object else cutoff)[:, None] // len(parts)
                collected = parts[0] >= part_cutoff
                for part in parts[1:]:
                    collected |= part >= part_cutoff
                at, col = np.nonzero(collected.astype(bool))
                score = _fitted(sum(p[at, col] for p in parts))
                keep = (score >= cutoff[at]) & (q_ids[at] != ids[col])
                yield _listed(row["qb"], row["blk"], spots, q_ids, [None] * len(spots), _kept(at[keep], score[keep], ids[col[keep]], k))

    return run


def phases(
    vectors: DataFrame, id_col: str, vector_col: str, k: int, every: int, scale: int, slices: int, query_block: int, block: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists of phase 1 with their cutoffs (those of pruned blocks; those to ask again), and the lists of phase 3."""
    v = F.col(vector_col)
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fits).select(
        F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v")
    )
    asked = good.where(F.col("id") % every == 0)
    n, m = good.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shape = "d int, wide boolean, ids binary, raw binary"
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_parts, n_queries = max(1, min(-(-n // block), PARTS * cores)), max(1, -(-m // query_block))
    ways = max(1, min(n_queries, 2 * cores // n_parts))
    blocks = cut(
        good.repartition(n_parts).mapInArrow(_pack(block, scale), shape)
        .withColumns({"cn": F.spark_partition_id(), "blk": F.monotonically_increasing_id()}),
        "candidates",
    )
    queries = cut(
        asked.repartition(n_queries).mapInArrow(_pack(query_block, scale), shape)
        .withColumnsRenamed({"ids": "q_ids", "raw": "q_raw", "wide": "q_wide"})
        .withColumns({"way": F.pmod(F.spark_partition_id(), F.lit(ways)), "qb": F.monotonically_increasing_id()}),
        "queries",
    )
    each_block = blocks.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    each_query = queries.withColumn("cn", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    lists = cut(each_block.join(each_query.hint("merge"), ["cn", "way", "d"]).mapInArrow(_gather(k, slices, scale), _LISTS), "lists")
    scores = lists.select("qb", "at", F.explode("best.score").alias("score"))
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy("qb", "at").orderBy(F.desc("score")))).where(f"r <= {k}")
    cutoffs = ranked.groupBy("qb", "at").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("found")).where(f"found = {k}").drop("found")
    known = lists.join(cutoffs, ["qb", "at"], "left").withColumn("open", F.coalesce(F.col("bound") >= F.coalesce("cutoff", F.lit(-_MOST)), F.lit(False)))
    near = F.filter("best", lambda e: F.coalesce(e.score >= F.col("cutoff"), F.lit(True)))  # others are not among the query's k best
    known = cut(known.withColumn("best", near), "known")
    again = known.where("open").groupBy("qb", F.shiftright("blk", 33).cast("int").alias("cn")).agg(F.collect_list(F.struct("blk", "at", "cutoff")).alias("asked"))
    met = again.join(queries.drop("way").hint("merge"), "qb").hint("merge").join(blocks, ["cn", "d"])
    met = met.withColumn("asked", F.filter("asked", lambda a: a.blk == F.col("blk"))).where(F.size("asked") > 0)
    return known.where(~F.col("open")), known.where("open"), met.mapInArrow(_resolve(k, slices, scale), _LISTS)


def exact_top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
    scale: int = 64, slices: int = SLICES, query_block: int = QUERY_BLOCK, block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` best rows by integer inner product."""
    settled, _, resolved = phases(vectors, id_col, vector_col, k, every, scale, slices, query_block, block)
    columns = "qb", "at", "query_id", F.explode("best").alias("e")
    entries = settled.select(*columns).unionByName(resolved.select(*columns)).select("qb", "at", "query_id", "e.vec_id", "e.score")
    place = F.row_number().over(Window.partitionBy("qb", "at", "query_id").orderBy(F.desc("score"), "vec_id"))
    return entries.withColumn("rank", place).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
