"""Hard-negative mining by a secondary-sort shuffle.

Pair scores are integer inner products. They travel packed in keys (anchor,
descending score, side, id), the side setting positives before negatives of an
equal score; ``repartitionAndSortWithinPartitions`` brings an anchor's pairs
together in that order, and an iterator reads them one by one: a positive opens
its window of scores, a negative goes to every open window that has it, a full
or passed window closes. Of an anchor at most ``positives`` windows are held, never its rows.

Pairs are pre-aggregated before the shuffle, exactly: every anchor meets every
row in blocks, and a block hands on

1. the ``positives`` best rows of the anchor's label; their best over all blocks
   are the positives and give the windows;
2. for each window its first ``negatives`` rows of other labels: what comes
   after them in the block can't be among the first of all.

So a block of candidates sends at most ``positives`` x (1 + ``negatives``)
pairs of an anchor, whatever its size, and copies of a vector, a label or an
anchor that hold much of the table weigh no more than others.

Rows with a NULL id or label, and vectors that are NULL, empty or hold NULL or
non-finite components, take no part. Vectors of different lengths are not
compared. Every row whose id is a multiple of ``every`` is an anchor; rows with
the anchor's id are its own. Repeated rows are candidates and anchors each on
its own. Scores beyond 64 bits count as the nearest 64-bit integer. A positive
below zero has an empty window. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.top_k import BLOCK, PARTS, QUERY_BLOCK, WIDE_BLOCK, _fitted, _integers, _kept, _partial
from quadrat.session import cut

EVERY, SCALE = 50, 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
_SHAPE = "d int, wide boolean, ids binary, labels binary, raw binary"
_PAIRS = "qb bigint, at int, anchor_id bigint, blk bigint, vec_id bigint, score bigint"
_MOST = (1 << 63) - 1


def _pack(size: int, scale: int):
    """Blocks of vectors of one length; scaled components that don't fit 32 bits are kept apart, unscaled."""

    def block(d: int, wide: bool, rows: list) -> pa.RecordBatch:
        ids, labels, vectors = zip(*rows)
        raw = np.array(vectors).astype(np.float64 if wide else np.int32).tobytes()
        whole = lambda x: pa.array([np.array(x, np.int64).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([wide]), whole(ids), whole(labels), pa.array([raw], pa.binary())], names=["d", "wide", "ids", "labels", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {}
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            plain = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                flat = np.floor(scale * plain)
            end = 0
            for i, n in enumerate(map(len, batch.column(2))):
                part, end = slice(end, end + n), end + n
                wide = bool(np.abs(flat[part]).max() >= 2**31)
                rows = held.setdefault((n, wide), [])
                rows.append((ids[i], labels[i], plain[part] if wide else flat[part]))
                if len(rows) == (min(size, WIDE_BLOCK) if wide else size):
                    yield block(n, wide, held.pop((n, wide)))
        for key, rows in held.items():
            yield block(*key, rows)

    return run


def _rows(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple]:
    """Pairs of blocks: the row, anchors' ids, labels and vectors, candidates' ids, labels and vectors."""
    for batch in batches:
        for i in range(len(batch)):
            (row,) = batch.slice(i, 1).to_pylist()
            sides = [
                (np.frombuffer(row[p + "ids"], np.int64), np.frombuffer(row[p + "labels"], np.int64), _integers(row[p + "raw"], row["d"], row[p + "wide"], scale))
                for p in ("q_", "")
            ]
            yield row, *sides[0], *sides[1]


def _found(row: dict, q_ids: np.ndarray, kept: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    at, score, ids = kept
    full = lambda x: pa.array(np.full(len(at), x, np.int64))
    return pa.RecordBatch.from_arrays(
        [full(row["qb"]), pa.array(at.astype(np.int32)), pa.array(q_ids[at]), full(row["blk"]), pa.array(ids, pa.int64()), pa.array(score, pa.int64())],
        names=["qb", "at", "anchor_id", "blk", "vec_id", "score"],
    )


def _best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of allowed scores that reach their row's k-th best allowed one."""
    seen = np.where(allowed, score, np.iinfo(np.int64).min)
    n = seen.shape[1]
    floor = np.partition(seen, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(seen), 1), np.iinfo(np.int64).min)
    return np.nonzero(allowed & (seen >= floor))


def _positives(scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, q_ids, q_labels, q, ids, labels, c in _rows(batches, scale):
            for label in np.intersect1d(q_labels, labels):
                a, b = np.flatnonzero(q_labels == label), np.flatnonzero(labels == label)
                score = _fitted(_partial(q[a], c[b], 1)[0])
                at, col = _best(score, q_ids[a][:, None] != ids[b][None, :], k)
                at, best, near = _kept(at, score[at, col], ids[b][col], k)
                yield _found(row, q_ids, (a[at], best, near))

    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score of a negative for a positive's score: low * score <= 100 * x <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(scale: int, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, q_ids, q_labels, q, ids, labels, c in _rows(batches, scale):
            spots = np.array(sorted({p["at"] for p in row["asked"]}))
            windows: dict[int, list] = {}
            for p in sorted({(p["at"], p["score"]) for p in row["asked"]}):
                windows.setdefault(p[0], []).append(window(p[1], low, high))
            score = _fitted(_partial(q[spots], c, 1)[0])
            other = q_labels[spots][:, None] != labels[None, :]
            met = []
            for i in range(max(map(len, windows.values()))):
                least, most = np.array([w[i] if i < len(w := windows[s]) else (1, 0) for s in spots.tolist()], np.int64).T
                at, col = _best(score, other & (score >= least[:, None]) & (score <= most[:, None]), k)
                order = np.lexsort((ids[col], -score[at, col], at))
                at, col = at[order], col[order]
                keep = np.arange(len(at)) - np.searchsorted(at, at) < k
                met.append(at[keep] * len(ids) + col[keep])
            at, col = np.divmod(np.unique(np.concatenate(met)), len(ids))
            if len(at):
                yield _found(row, q_ids, (spots[at], score[at, col], ids[col]))

    return run


_KEY = struct.Struct(">QIQBQ")


def packed(qb: int, at: int, score: int, side: int, vec_id: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, side (0 positive, 1 negative) and id."""
    return _KEY.pack(qb + (1 << 63), at, _MOST - score, side, vec_id + (1 << 63))


def mined(pairs: Iterator[tuple[bytes, int]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Pairs (key, anchor id) in key order to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    anchor, opened, count = None, [], 0
    for key, anchor_id in pairs:
        qb, at, turned, side, shifted = _KEY.unpack(key)
        score, vec_id = _MOST - turned, shifted - (1 << 63)
        if (qb, at) != anchor:
            anchor, opened, count = (qb, at), [], 0
        if side == 0:
            if count < positives:
                count += 1
                opened.append([vec_id, score, *window(score, low, high), 0])
            continue
        going = []
        for w in opened:
            positive_id, positive, least, most, rank = w
            if score < least:
                continue
            if score <= most:
                w[4] = rank = rank + 1
                yield anchor_id, positive_id, rank, vec_id, positive, score
            if rank < negatives:
                going.append(w)
        opened = going


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_block: int = QUERY_BLOCK, block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are its ``positives`` best other rows of its label; a
    positive's negatives are the first ``negatives`` rows of other labels with
    ``low`` to ``high`` per cent of its score.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fits).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), v.cast("array<double>").alias("v")
    )
    n, m = good.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    cores = spark.sparkContext.defaultParallelism
    n_parts, n_anchors = max(1, min(-(-n // block), PARTS * cores)), max(1, -(-m // anchor_block))
    ways = max(1, min(n_anchors, 2 * cores // n_parts))
    blocks = cut(
        good.repartition(n_parts).mapInArrow(_pack(block, scale), _SHAPE)
        .withColumns({"cn": F.spark_partition_id(), "blk": F.monotonically_increasing_id()}),
        "candidates",
    )
    anchors = cut(
        good.where(F.col("id") % every == 0).repartition(n_anchors).mapInArrow(_pack(anchor_block, scale), _SHAPE)
        .withColumnsRenamed({"ids": "q_ids", "labels": "q_labels", "raw": "q_raw", "wide": "q_wide"})
        .withColumns({"way": F.pmod(F.spark_partition_id(), F.lit(ways)), "qb": F.monotonically_increasing_id()}),
        "anchors",
    )
    each_block = blocks.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("cn")
    met = each_block.join(anchors.select("*", everywhere).hint("merge"), ["cn", "way", "d"])  # Spark takes repeated anchors for as small as they were
    place = F.row_number().over(Window.partitionBy("qb", "at").orderBy(F.desc("score"), "vec_id"))
    best = cut(met.mapInArrow(_positives(scale, positives), _PAIRS).withColumn("r", place).where(F.col("r") <= positives).drop("r"), "positives")
    asked = best.groupBy("qb").agg(F.collect_list(F.struct("at", "score")).alias("asked"))  # at most anchor_block x positives
    again = each_block.join(anchors.join(asked, "qb").select("*", everywhere).hint("merge"), ["cn", "way", "d"])
    others = again.mapInArrow(_negatives(scale, negatives, low, high), _PAIRS)
    pairs = best.withColumn("side", F.lit(0)).unionByName(others.withColumn("side", F.lit(1)))
    keyed = pairs.select("qb", "at", "score", "side", "vec_id", "anchor_id").rdd.map(lambda r: (packed(*r[:5]), r[5]))
    ways_out = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_pairs = keyed.repartitionAndSortWithinPartitions(ways_out, partitionFunc=lambda key: zlib.crc32(key[:12]))
    rows = sorted_pairs.mapPartitions(lambda part: mined(part, positives, negatives, low, high))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame(rows, schema, verifySchema=False)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


SQL = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    ), p AS (
      SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ), n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
