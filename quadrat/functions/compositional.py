"""Compositions: closure, log ratios, zero treatment, guild ratios, kernels, tiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.numeric import ratio


def relative(df: DataFrame, group: list[str], value: str = "n", out: str = "rel") -> DataFrame:
    return df.withColumn(out, ratio(value, F.sum(value).over(Window.partitionBy(*group))))


def zero_filled(df: DataFrame, group: list[str], part: str, value: str = "n") -> DataFrame:
    """Every (group, part) pair of the table, absent cells as 0. Parts are kept few before (top-k, prevalence)."""
    cells = df.select(*group).distinct().join(df.select(part).distinct(), how="cross")
    return cells.join(df, [*group, part], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def clr(df: DataFrame, group: list[str], part: str, value: str = "n", pseudo: float = 0.5, zero: str = "add") -> DataFrame:
    """Centred log ratio over zero-filled cells, column ``clr``.

    ``zero='add'`` adds ``pseudo`` to every cell; ``'multiplicative'`` puts
    0.65 / total in empty cells and shrinks the others so that parts sum to 1.
    """
    w = Window.partitionBy(*group)
    full = zero_filled(df, group, part, value)
    if zero == "add":
        x = F.log(F.col(value) + pseudo)
    else:
        total = F.sum(value).over(w)
        empty = F.sum(F.when(F.col(value) == 0, 1).otherwise(0)).over(w)
        delta = ratio(F.lit(0.65), total)
        x = F.log(F.when(F.col(value) == 0, delta).otherwise(ratio(value, total) * (1 - empty * delta)))
    return full.withColumn("_x", x).withColumn("clr", F.col("_x") - F.avg("_x").over(w)).drop("_x")


def guild_logratio(df: DataFrame, group: list[str], part: str, members: list, value: str = "n", pseudo: float = 0.5) -> DataFrame:
    inside = F.sum(F.when(F.col(part).isin(*members), F.col(value)).otherwise(0))
    outside = F.sum(F.when(F.col(part).isin(*members), 0).otherwise(F.col(value)))
    return df.groupBy(*group).agg(F.log(ratio(inside + pseudo, outside + pseudo)).alias("log_ratio"))


def pulse_kernel(lag: Column, peak: Column) -> Column:
    """Gamma-shaped response that is 1 at ``peak`` days."""
    return lag / peak * F.exp(1 - lag / peak)


def pulse_exposure(lags: DataFrame, obs: str, lag: str, value: str, peaks: list[float]) -> DataFrame:
    """Kernel-weighted sum of the lagged values for every peak of a short grid."""
    grid = F.explode(F.array(*map(F.lit, peaks))).alias("peak")
    return lags.select(obs, lag, value, grid).groupBy(obs, "peak").agg(F.sum(F.col(value) * pulse_kernel(F.col(lag), F.col("peak"))).alias("exposure"))


def decay_days(peak: float, level: float) -> float:
    """Days after which the kernel has fallen to ``level`` of its maximum."""
    low, high = peak, peak * 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mid / peak * math.exp(1 - mid / peak) > level else (low, mid)
    return (low + high) / 2


def mimag_tier(completeness: Column, contamination: Column, rrna: Column, trna: Column) -> Column:
    """Quality tier of a genome. Fixed limits: high > 90 / < 5 with all rRNA and 18 tRNA, medium >= 50 / < 10."""
    return (
        F.when((completeness > 90) & (contamination < 5) & rrna & (trna >= 18), "high")
        .when((completeness >= 50) & (contamination < 10), "medium")
        .when(contamination < 10, "low")
        .otherwise("unqualified")
    )


def applicability(rules: dict[str, Column]) -> Column:
    """Reasons that hold, joined by ``;`` (empty: applicable)."""
    return F.concat_ws(";", F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items()))))


def km_axes(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Local kilometres east (``x``) and north (``y``) of the mean point. 110.574 and 111.320 km a degree."""
    mean = points.agg(F.avg(lat).alias("_la"), F.avg(lon).alias("_lo"))
    return (
        points.join(F.broadcast(mean))
        .withColumn("y", (F.col(lat) - F.col("_la")) * 110.574)
        .withColumn("x", (F.col(lon) - F.col("_lo")) * 111.320 * F.cos(F.radians("_la")))
        .drop("_la", "_lo")
    )


def transect(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Position along the principal direction of the points, which grows eastward (closed form of the 2 x 2 case)."""
    km = km_axes(points, lat, lon)
    m = km.agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("c"), F.covar_pop("x", "y").alias("b"))
    m = m.withColumn("t", F.lit(0.5) * F.atan2(2 * F.col("b"), F.col("a") - F.col("c")))
    m = m.select(F.cos("t").alias("_u"), F.sin("t").alias("_v"))
    return km.join(F.broadcast(m)).withColumn("position", F.col("x") * F.col("_u") + F.col("y") * F.col("_v")).drop("_u", "_v")


MAX_LEVELS = 2_000


def design(df: DataFrame, numeric: list[str] = (), factors: list[str] = (), quadratic: list[str] = (), interactions: list[tuple[str, str]] = ()) -> DataFrame:
    """Columns of a linear model: intercept, numeric terms, squares, dummies (first level left out), products.

    A factor of more than ``MAX_LEVELS`` levels is an error: each level is a column.
    """
    out = df.withColumn("one", F.lit(1.0))
    for c in numeric:
        out = out.withColumn(c, F.col(c).cast("double"))
    for c in quadratic:
        out = out.withColumn(f"{c}_2", F.col(c) * F.col(c))
    for c in factors:
        levels = [r[0] for r in df.select(c).distinct().orderBy(c).limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        for level in levels[1:]:
            out = out.withColumn(f"{c}_is_{level}", (F.col(c) == F.lit(level)).cast("double"))
    for a, b in interactions:
        out = out.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))
    return out
