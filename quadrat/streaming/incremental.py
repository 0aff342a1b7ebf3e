"""Mergeable aggregates as Structured Streaming jobs.

Depth, richness sums and fingerprints are sums, so the batch operators also
run over an unbounded stream of count rows, with the same result once all
rows have arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrat.operators.graph import fingerprint


def alpha_stream(cells: DataFrame, profile: str = "profile", n: str = "n") -> DataFrame:
    """Running depth, richness and Shannon of a stream in which each (profile, feature) cell arrives once."""
    x = F.col(n).cast("double")
    return (
        cells.where(F.col(n) > 0).groupBy(profile)
        .agg(F.sum(n).alias("depth"), F.count(F.lit(1)).alias("richness"), F.sum(x * F.log(x)).alias("_s"))
        .withColumn("shannon", F.log("depth") - F.col("_s") / F.col("depth")).drop("_s")
    )


def fingerprint_stream(rows: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    return fingerprint(rows, cols, by)


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Start a query into an in-memory table and process what is there (for tests and small dashboards)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    return q
