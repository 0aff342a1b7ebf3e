"""Resampling as tables of draws.

A draw is a row set keyed by ``draw``; a permutation, sign flip, bootstrap or
shift becomes one join and one aggregation instead of a loop. Draws are
ordered by md5 of (seed, draw, unit), so they are the same on every run and in
any SQL engine, and every partition can make its own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _key(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *(p.cast("string") for p in parts)))


def _int(key: Column) -> Column:
    """First 32 bits of an md5 as a number."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def _draws(df: DataFrame, reps: int) -> DataFrame:
    """``df`` once a draw. Spark takes it for as small as ``df``, so its rows are dealt before they
    are repeated, and its next join is told not to broadcast it."""
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)
    return dealt.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(reps)))).hint("merge")


def permutations(units: DataFrame, reps: int, unit: str, strata: list[str] = (), seed: int = 1) -> DataFrame:
    """``(draw, unit, perm_unit)``: units exchanged at random, within strata if given."""
    base = units.select(unit, *strata).distinct()
    d = _draws(base, reps)
    part = ["draw", *strata]
    place = F.row_number().over(Window.partitionBy(*part).orderBy(unit))
    shuffled = F.row_number().over(Window.partitionBy(*part).orderBy(_key(seed, F.col("draw"), F.col(unit)), unit))
    a = d.withColumn("_k", place)
    b = d.withColumn("_k", shuffled).withColumnRenamed(unit, "perm_unit")
    return a.join(b, [*part, "_k"]).drop("_k")


def sign_flips(units: DataFrame, reps: int, unit: str, seed: int = 1) -> DataFrame:
    """``(draw, unit, sign)`` with signs +1 or -1."""
    d = _draws(units.select(unit).distinct(), reps)
    return d.withColumn("sign", F.when(_int(_key(seed, F.col("draw"), F.col(unit))) % 2 == 0, 1).otherwise(-1))


def bootstrap(units: DataFrame, reps: int, unit: str, strata: list[str] = (), seed: int = 1) -> DataFrame:
    """``(draw, unit, weight)``: how often each unit is drawn with replacement (0 is left out). Units may be clusters or blocks."""
    base = units.select(unit, *strata).distinct()
    part = list(strata)
    numbered = base.withColumn("_i", F.row_number().over(Window.partitionBy(*part).orderBy(unit)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    picks = _draws(numbered, reps).withColumn("_j", _int(_key(seed, F.col("draw"), F.col(unit))) % F.col("_n"))
    chosen = picks.select("draw", *part, F.col("_j").alias("_i"))
    return chosen.groupBy("draw", *part, "_i").agg(F.count(F.lit(1)).alias("weight")).join(numbered.drop("_n"), [*part, "_i"]).drop("_i")


def time_shifts(obs: DataFrame, daily: DataFrame, reps: int, campaign: str, site: str, day: str, before: int, minimum: int, seed: int = 1, admit: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(draw, campaign, shift)``: one common shift of days per campaign, at least ``minimum`` either way,
    such that every observation keeps ``before`` days of series; shifts of a campaign are distinct."""
    span = daily.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    room = obs.groupBy(campaign).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).join(F.broadcast(span))
    low = F.datediff("_lo", "_a") + before
    high = F.datediff("_hi", "_b")
    options = room.where(low <= high).select(campaign, F.explode(F.sequence(low, high)).alias("shift")).where(F.abs("shift") >= minimum)
    options = options if admit is None else admit(options)
    order = F.row_number().over(Window.partitionBy(campaign).orderBy(_key(seed, F.col(campaign), F.col("shift")), "shift"))
    return options.withColumn("draw", order).where(F.col("draw") <= reps).select("draw", campaign, "shift")


def estimable_shifts(
    obs: DataFrame, daily: DataFrame, options: DataFrame, spans: list[tuple[int, int]], nuisance: list[str], campaign: str, site: str = "site", day: str = "date", obs_id: str = "obs_id", value: str = "value",
) -> DataFrame:
    """Candidate shifts (campaign, shift) under which the design of nuisance columns and shifted exposures keeps its rank.

    A campaign's observations of one site and day have one exposure, so they meet
    the shifts as one row of sums: what is made grows with the days, not with the observations.
    Exposures of all candidates come from the same prefix sums, each day's once, and their cross
    products from one aggregation; only the ranks of small matrices are left.
    Observations whose window leaves the series don't count.
    """
    from quadrat.operators.joins import exposure
    from quadrat.operators.models import unpack_gram

    p, names = len(nuisance), [f"_x{i}" for i in range(len(spans))]
    columns = [*nuisance, *names]
    places = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    c = [F.col(n).cast("double") for n in nuisance]
    own = [F.sum(c[i]).alias(f"_s{i}") for i in range(p)] + [F.sum(c[i] * c[j]).alias(f"_q{i}_{j}") for i, j in places if j < p]
    cells = obs.groupBy(campaign, site, day).agg(F.count(F.lit(1)).alias("_n"), *own)
    moved = cells.join(F.broadcast(options), campaign).withColumn(day, F.date_add(day, F.col("shift")))
    asked = moved.select(site, day).distinct().withColumn("_id", F.struct(F.col(site).alias("s"), F.col(day).alias("d")))
    e = exposure(asked, daily, spans, site, day, value, "_id")
    wide = e.groupBy("_id").agg(*(F.max(F.when((F.col("from_lag") == a) & (F.col("to_lag") == b), F.col("exposure"))).alias(n) for (a, b), n in zip(spans, names)))
    whole = moved.join(wide.dropna().select(F.col("_id.s").alias(site), F.col("_id.d").alias(day), *names), [site, day])

    def product(i: int, j: int) -> Column:
        if j < p:
            return F.col(f"_q{i}_{j}")
        return F.col(columns[j]) * (F.col(f"_s{i}") if i < p else F.col("_n") * F.col(columns[i]))

    sums = whole.groupBy(campaign, "shift").agg(*(F.sum(product(i, j)).alias(f"m_{i}_{j}") for i, j in places))

    def ranked(parts):
        for pdf in parts:
            keep = []
            for _, r in pdf.iterrows():
                m = unpack_gram(r, len(columns))
                scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
                keep.append(bool((np.diag(m) > 0).all()) and np.linalg.matrix_rank(m / scale[:, None] / scale[None, :], tol=1e-10) == len(columns))
            yield pdf.loc[keep, [campaign, "shift"]]

    return sums.mapInPandas(ranked, T.StructType([options.schema[campaign], options.schema["shift"]]))


def lag_rotations(lags: DataFrame, horizon: int, shifts: DataFrame, lag: str = "lag") -> DataFrame:
    """Lag tables with the lag axis rotated by each draw's ``shift``."""
    return lags.join(F.broadcast(shifts)).withColumn(lag, F.pmod(F.col(lag) - 1 + F.col("shift"), F.lit(horizon)) + 1)


def interval(draws: DataFrame, value: str, by: list[str] = (), level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return draws.groupBy(*by).agg(
        F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.stddev(value).alias("se"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("p_positive"), F.count(F.lit(1)).alias("n_draws"),
    )


def perm_p(null: DataFrame, observed: Column, value: str, by: list[str] = (), tail: str = "greater", tol: float = 1e-9) -> DataFrame:
    """Plus-one p of ``observed`` (a column of the null table): one-sided, two-sided, or two-sided about the null mean."""
    v = F.col(value)
    if tail == "centred":
        mean = F.avg(value).over(Window.partitionBy(*by))
        v, observed = F.abs(v - mean), F.abs(observed - mean)
    elif tail == "two":
        v, observed = F.abs(v), F.abs(observed)
    hit = v >= observed - tol if tail != "less" else v <= observed + tol
    return null.withColumn("_h", hit.cast("int")).groupBy(*by).agg(((1 + F.sum("_h")) / (1 + F.count(F.lit(1)))).alias("p"), F.count(F.lit(1)).alias("n_draws"))


def max_statistic(null: DataFrame, value: str, draw: str = "draw", by: list[str] = ()) -> DataFrame:
    """Largest absolute statistic of each draw over a family."""
    return null.groupBy(*by, draw).agg(F.max(F.abs(value)).alias(value))


def jackknife(df: DataFrame, unit: str, value: str, by: list[str] = ()) -> DataFrame:
    """Mean over units, delete-one standard error, and bounds of the 95 % t interval."""
    from quadrat.functions.numeric import ratio, t_quantile

    @F.pandas_udf("double")
    def quantile(k: pd.Series) -> pd.Series:
        known = {n: t_quantile(0.975, n - 1) for n in set(k.dropna())}
        return k.map(known).astype("float64")

    u = df.groupBy(*by, unit).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    w = Window.partitionBy(*by)
    loo = u.withColumn("_l", ratio(F.sum("s").over(w) - F.col("s"), F.sum("k").over(w) - F.col("k")))
    n = F.count(F.lit(1))
    out = loo.groupBy(*by).agg(ratio(F.sum("s"), F.sum("k")).alias("estimate"), F.sqrt((n - 1) * F.var_pop("_l")).alias("se"), n.alias("n_units"))
    return out.withColumn("_t", quantile(F.when(F.col("n_units") > 1, F.col("n_units").cast("double")))).withColumns({"low": F.col("estimate") - F.col("_t") * F.col("se"), "high": F.col("estimate") + F.col("_t") * F.col("se")}).drop("_t")
