"""Ranks, scores, blocks, adjustments, top rows, and set comparisons."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.numeric import ratio
from quadrat.operators.tiles import pair_tiles
from quadrat.session import cut


def rank_taxa(rel: DataFrame, total: int | Column, prevalence: float, taxon: str = "taxon", unit: str = "profile", value: str = "rel") -> DataFrame:
    """Taxa seen in a share of the units, ranked by mean relative abundance over all units (ties by name)."""
    n = F.lit(total) if isinstance(total, int) else total
    g = rel.groupBy(taxon).agg(ratio(F.sum(value), n).alias("mean_rel"), ratio(F.count_distinct(F.when(F.col(value) > 0, F.col(unit))), n).alias("prevalence"))
    return g.where(F.col("prevalence") >= prevalence).withColumn("rank", F.row_number().over(Window.orderBy(F.round("mean_rel", 12).desc(), taxon)))


def avg_rank(part: list[str], value: str | Column) -> Column:
    """Ascending rank in which equal values share the mean of their places."""
    v = F.col(value) if isinstance(value, str) else value
    tie = F.count(F.lit(1)).over(Window.partitionBy(*part, v))
    return F.rank().over(Window.partitionBy(*part).orderBy(v)) + (tie - 1) / 2.0


def zscore_within(group: list[str], value: str) -> Column:
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)


def center_within(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy(*group)) for c in cols})


def prefix_sum(part: list[str], order: str, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def elapsed_hours(df: DataFrame, campaign: str, ts: str) -> DataFrame:
    first = F.min(F.col(ts).cast("timestamp")).over(Window.partitionBy(campaign))
    return df.withColumn("elapsed_hours", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(first)) / 3.6e9)


def contiguous_blocks(part: list[str], order: list[str], blocks: int) -> Column:
    """Block 0..blocks-1 of equal counts along an order: floor(i * blocks / n)."""
    i = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    return F.floor(i * blocks / F.count(F.lit(1)).over(Window.partitionBy(*part))).cast("int")


def route_maps(sites: DataFrame, order: list[str], site: str = "site") -> DataFrame:
    """All cyclic shifts of a route and of its reverse: (shift, reflected, site, mapped_site). For a route of sites."""
    w = Window.orderBy(*order)
    r = sites.select(F.col(site).alias(site), (F.row_number().over(w) - 1).alias("i"))
    n = r.agg(F.count(F.lit(1)).cast("int").alias("n"))
    maps = r.join(F.broadcast(n)).select(site, "i", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shift"))
    maps = maps.withColumn("reflected", F.explode(F.array(F.lit(0), F.lit(1))))
    base = F.when(F.col("reflected") == 1, F.col("n") - 1 - F.col("i")).otherwise(F.col("i"))
    maps = maps.withColumn("j", F.pmod(base + F.col("shift"), F.col("n")))
    return maps.join(r.select(F.col("i").alias("j"), F.col(site).alias("mapped_site")), "j").select("shift", "reflected", site, "mapped_site")




def with_bh(df: DataFrame, p: str, family: list[str] = (), ties: list[str] = (), out: str = "q") -> DataFrame:
    """Benjamini-Hochberg ``out`` and Bonferroni ``out_bonferroni``; NULL p stays NULL and is not counted."""
    known = df.where(F.col(p).isNotNull())
    ranked = known.withColumn("_k", F.row_number().over(Window.partitionBy(*family).orderBy(p, *ties))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    down = Window.partitionBy(*family).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({out: F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_k")).over(down)), f"{out}_bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("_n"))})
    none = df.where(F.col(p).isNull()).withColumns({out: F.lit(None).cast("double"), f"{out}_bonferroni": F.lit(None).cast("double")})
    return ranked.drop("_k", "_n").unionByName(none)


def distance_class(df: DataFrame, d: str, k: int, out: str = "class") -> DataFrame:
    """Quantile class 1..k of a distance; edges are exact percentiles, classes are closed on the right."""
    inner = [i / k for i in range(1, k)]
    edges = df.agg(*(F.percentile(d, F.lit(q)).alias(f"_e{i}") for i, q in enumerate(inner)))
    cls = reduce(lambda acc, i: acc + F.when(F.col(d) > F.col(f"_e{i}"), 1).otherwise(0), range(k - 1), F.lit(1))
    return df.join(F.broadcast(edges)).withColumn(out, cls).drop(*(f"_e{i}" for i in range(k - 1)))


BINS = 1 << 14  # bins of a unit of value


def _ranked(df: DataFrame, by: list[str], order: str, weight: str) -> DataFrame:
    """Rows with the weight before (``_before``) and up to (``_upto``) them, and their group's (``n``)."""
    w = Window.partitionBy(*by)
    upto = F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"_upto": upto, "_before": upto - F.col(weight), "n": F.sum(weight).over(w)})


def middle_bins(hist: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, n, _low, _high, _skip)`` from counts of bins (``bin``, ``w``): the bins of the two middle values and the weight before the first."""
    first, second = F.expr("(n - 1) div 2"), F.expr("n div 2")
    c = _ranked(hist.groupBy(*by, "bin").agg(F.sum("w").alias("w")), by, "bin", "w")
    has = lambda at: (F.col("_before") <= at) & (at < F.col("_upto"))
    out = c.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(has(first), F.col("bin"))).alias("_low"), F.max(F.when(has(second), F.col("bin"))).alias("_high"), F.max(F.when(has(first), F.col("_before"))).alias("_skip"))
    return out.where("n > 0")


def middle_of(values: DataFrame, middle: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(*by, median, n)`` from the values (weight ``w``) of the middle bins."""
    c = _ranked(values.groupBy(*by, value).agg(F.sum("w").alias("w")), by, value, "w").drop("n").join(middle, by)
    at = lambda k: F.max(F.when((F.col("_before") + F.col("_skip") <= k) & (k < F.col("_upto") + F.col("_skip")), F.col(value)))
    return c.groupBy(*by, "n").agg(((at(F.expr("(n - 1) div 2")) + at(F.expr("n div 2"))) / 2).alias("median")).select(*by, "median", "n")


def median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """``(*by, median, n)``: the exact median of values with whole weights. Bins are counted first, so
    a group's task holds its bins and the values of the middle one, never all values."""
    binned = df.where(F.col(value).isNotNull()).select(*by, F.col(value), F.floor(F.col(value) * BINS).alias("bin"), F.col(weight).alias("w"))
    middle = cut(middle_bins(binned, by), "middle")
    near = binned.join(middle.select(*by, "_low", "_high"), by).where("bin = _low or bin = _high")
    return middle_of(near, middle, by, value)


def cumulative_share(df: DataFrame, value: str, order: list[Column], target: float) -> DataFrame:
    w = Window.orderBy(*order)
    cum = ratio(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(Window.partitionBy()))
    out = df.withColumn("axis", F.row_number().over(w)).withColumn("cumulative", cum)
    return out.withColumn("reaches", F.col("axis") == F.min(F.when(F.col("cumulative") >= target, F.col("axis"))).over(Window.partitionBy()))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def library_suffix(df: DataFrame, key: str, order: list[str], out: str = "library") -> DataFrame:
    """Deterministic ``__lib<N>`` suffix where a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    i = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(out, F.when(n > 1, F.concat(F.col(key).cast("string"), F.lit("__lib"), i.cast("string"))).otherwise(F.col(key).cast("string")))


def top_k(df: DataFrame, k: int, by: list[Column]) -> DataFrame:
    return df.orderBy(*by).limit(k)


def best_pair(df: DataFrame, site: str, run: str, analyte: str, value: str) -> DataFrame:
    """Per site, the pair of runs whose values over shared analytes correlate best (ties: smaller runs).

    Sums of all pairs are made in tiles of a site's runs, and only a tile's best
    pair leaves it. ``r`` is NULL where a run is constant over what is shared;
    NULL and NaN values count as shared, and not in ``r``.
    """
    rows = df.select(F.col(site).alias("g"), F.col(run).alias("u"), F.col(analyte).alias("t"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v"))
    centre = rows.groupBy("g", "u").agg(F.avg("v").alias("m"))  # near a run's own mean, sums of squares lose nothing
    rows = rows.join(centre, ["g", "u"]).select("g", "u", "t", (F.col("v") - F.col("m")).alias("v"))
    far = np.inf

    def of(rule):
        return lambda x, y: np.where(np.isnan(x) | np.isnan(y), 0.0, rule(x, y))

    def ends(rule, empty):
        return lambda x, y: np.where(np.isnan(x) | np.isnan(y), empty, rule(x, y))

    first, second = (lambda x, y: x), (lambda x, y: y)
    sums = {
        "n": (np.add, 0, np.int32, lambda x, y: np.int32(1)), "k": (np.add, 0, np.float64, of(lambda x, y: 1.0)),
        "x": (np.add, 0, np.float64, of(first)), "y": (np.add, 0, np.float64, of(second)), "xy": (np.add, 0, np.float64, of(np.multiply)),
        "xx": (np.add, 0, np.float64, of(lambda x, y: x * x)), "yy": (np.add, 0, np.float64, of(lambda x, y: y * y)),
        "low_x": (np.minimum, far, np.float64, ends(first, far)), "high_x": (np.maximum, -far, np.float64, ends(first, -far)),
        "low_y": (np.minimum, far, np.float64, ends(second, far)), "high_y": (np.maximum, -far, np.float64, ends(second, -far)),
    }
    g, u = rows.schema["g"].dataType.simpleString(), rows.schema["u"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"g {g}, a {u}, b {u}, r double, n_shared bigint")

    def finish(tile):
        best = None
        for i, j in tile.strips():
            s = {c: v[i, j] for c, v in tile.sums.items()}
            known = (s["k"] > 0) & (s["high_x"] > s["low_x"]) & (s["high_y"] > s["low_y"])
            with np.errstate(all="ignore"):
                r = (s["xy"] - s["x"] * s["y"] / s["k"]) / np.sqrt((s["xx"] - s["x"] ** 2 / s["k"]) * (s["yy"] - s["y"] ** 2 / s["k"]))
            known &= np.isfinite(r)
            r = np.clip(r, -1, 1)
            key = np.where(s["n"] == 0, -9.0, np.where(known, np.round(r, 9), -3.0))
            top = int(np.argmax(key))  # the first of them: strips go by (a, b)
            if key[top] > -9 and (best is None or key[top] > best[0]):
                best = (key[top], i[top], j[top], float(r[top]) if known[top] else None, int(s["n"][top]))
        if best is not None:
            i, j = pa.array([best[1]]), pa.array([best[2]])
            field = lambda h, f, k: pc.struct_field(h, f).take(k)
            yield pa.RecordBatch.from_arrays([field(tile.first, "g", i), field(tile.first, "u", i), field(tile.second, "u", j), pa.array([best[3]], pa.float64()), pa.array([best[4]])], names=schema.names)

    r = pair_tiles(rows, "u", "t", "v", sums, finish, schema, ["g"], largest=1024).withColumnRenamed("g", site)
    rank = F.row_number().over(Window.partitionBy(site).orderBy(F.round("r", 9).desc_nulls_last(), "a", "b"))
    return r.withColumn("_k", rank).where("_k = 1").drop("_k")


def examples(df: DataFrame, code: str, n: int, order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(code).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def union_shared(*dfs: DataFrame) -> DataFrame:
    """Union on the columns that all tables have, in the first one's order."""
    shared = [c for c in dfs[0].columns if all(c in d.columns for d in dfs)]
    return reduce(lambda a, b: a.unionByName(b), (d.select(*shared) for d in dfs))


def shared_ids(a: DataFrame, b: DataFrame, ident: str) -> DataFrame:
    return a.select(ident).intersect(b.select(ident))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with both counts; empty means equal."""
    cols = a.columns
    rows = a.withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionByName(b.select(*cols).withColumns({"_l": F.lit(0), "_r": F.lit(1)}))
    return rows.groupBy(*cols).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right")).where("n_left <> n_right")


def graph_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def graph_delta(asserted: DataFrame, materialized: DataFrame) -> DataFrame:
    """Triples of ``materialized`` that are not asserted."""
    return materialized.join(asserted, asserted.columns, "left_anti").distinct()


def jaccard(a: DataFrame, b: DataFrame, edge: list[str], by: list[str] = ()) -> DataFrame:
    x = a.select(*by, *edge).distinct().withColumn("_a", F.lit(1))
    y = b.select(*by, *edge).distinct().withColumn("_b", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    g = x.join(y, [*by, *edge], "full_outer").groupBy(*by).agg(F.count_if(both).alias("shared"), F.count(F.lit(1)).alias("either"))
    return g.withColumn("jaccard", F.col("shared") / F.col("either"))
