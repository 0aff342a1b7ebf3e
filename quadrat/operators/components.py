"""Connected components of an edge table, without collecting the graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.session import cut


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the edges of one partition to a forest of (node, smallest node)."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if schema is None:
        return
    nodes = [n for n in parent if find(n) != n]
    for i in range(0, len(nodes), 20_000):
        part = nodes[i : i + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, schema.field(0).type), pa.array([find(n) for n in part], schema.field(1).type)], schema=schema
        )


HOT, SALTS = 512, 64


def _beside_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with their node's ``m`` from ``least`` (u, m, k rows of that node).

    Nodes with more than a 256th of all rows (at most 256 of them, so their
    table is broadcast) are salted: their rows spread over ``SALTS`` keys.
    """
    hot = F.col("k") > max(HOT, 2 * total // 256)
    few = F.broadcast(least.where(hot).select("u", F.lit(True).alias("_hot")))
    salted = rows.join(few, "u", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(least.select("u", "m", F.explode(salts).alias("_salt")), ["u", "_salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, root)`` for every node that has an edge to another node.

    ``root`` is the smallest node of the component and has a row too. Each
    partition is contracted by union-find first; rounds of large and small
    stars then join the partial forests. The edge count never grows, a hot
    node meets partial aggregates and salted joins, and each round is a table
    in the shared folder. NULL ends and loops are ignored.
    """
    kind = edges.schema[a].dataType.simpleString()
    plain = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = cut(plain.mapInArrow(_union_find, f"u {kind}, v {kind}").distinct(), "forest")
    seen, n = None, links.count()
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count(F.lit(1)).alias("k"))
        large = _beside_least(both, low, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = (
            _beside_least(large, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = cut(small, "stars")
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
