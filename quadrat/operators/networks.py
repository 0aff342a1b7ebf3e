"""Sparse association networks from cross products: penalty paths, calibration, stability, comparison.

A fit needs the correlations of the parts only. Tasks add up weighted cross
products of the rows that they hold, partial sums of a (group, draw) meet, and
every penalty is fitted where they met, from the largest down, each from the
one before. Rows of a group never meet in one table; bootstrap draws are arrays
of weights that travel with a row's cluster, so rows are not repeated by draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.numeric import ratio
from quadrat.operators import resample as RS
from quadrat.session import cut

MAX_PARTS, DRAW_BLOCK, EDGE = 400, 50, 1e-8


def part_names(df: DataFrame, part: str) -> list:
    """The parts in order; more than ``MAX_PARTS`` raise an error."""
    names = [r[0] for r in df.select(part).distinct().orderBy(part).limit(MAX_PARTS + 1).collect()]
    if len(names) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} parts")
    return names


def vectors(df: DataFrame, keys: list[str], unit: str, part: str, value: str, parts: list) -> DataFrame:
    """``(keys, unit, x)``: a unit's values in the order of ``parts``, NULL where it has none."""
    cells = df.groupBy(*dict.fromkeys([*keys, unit]), part).agg(F.avg(value).alias("_v"))
    held = cells.groupBy(*dict.fromkeys([*keys, unit])).agg(F.map_from_entries(F.collect_list(F.struct(part, "_v"))).alias("_m"))
    order = F.array(*(F.lit(p) for p in parts))
    return held.withColumn("x", F.transform(order, lambda p: F.try_element_at("_m", p))).drop("_m")


def correlation(n: float, g: np.ndarray, c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Correlations from cross products of values, of values with presence, and of presence; an absent cell counts as
    the part's mean, a constant part has none."""
    mean = np.diag(c) / np.maximum(np.diag(m), 1e-300)
    cov = (g - c * mean[None, :] - (c * mean[None, :]).T + mean[:, None] * mean[None, :] * m) / n
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    still = sd <= 1e-12 * np.maximum(np.abs(mean), 1e-12)
    r = cov / np.where(still, 1, sd)[:, None] / np.where(still, 1, sd)[None, :]
    r[still], r[:, still] = 0, 0
    np.fill_diagonal(r, 1.0)
    return r


def path(s: np.ndarray, alphas: list[float]) -> dict[float, np.ndarray]:
    """Partial correlations for each penalty, fitted from the largest down."""
    from quadrat.operators.models import glasso

    out, betas = {}, None
    for alpha in sorted(alphas, reverse=True):
        theta, betas = glasso(s, alpha, start=betas, with_start=True)
        scale = np.sqrt(np.diag(theta))
        partial = -theta / scale[:, None] / scale[None, :]
        np.fill_diagonal(partial, 0)
        out[alpha] = partial
    return out


def fits(rows: DataFrame, keys: list[str], parts: list, alphas: list[float], weighted: bool = False) -> DataFrame:
    """``(keys, draw, alpha, edges)`` from vectors ``x``; with ``weighted``, rows have ``block`` and ``w``, weights of a block of draws.

    ``edges`` has the pairs (a < b) that a fit keeps, with their partial correlation.
    """
    p = len(parts)
    every = [*keys, "block"] if weighted else list(keys)
    kinds = [rows.schema[c] for c in every]
    sums = T.StructType([*kinds, T.StructField("i", T.IntegerType()), T.StructField("n", T.DoubleType()), T.StructField("m", T.BinaryType())])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, own in pdf.groupby(every, dropna=False, sort=False) if every else [((), pdf)]:
                x = np.array([[np.nan if v is None else v for v in r] for r in own["x"]], float)
                seen = ~np.isnan(x)
                x, seen = np.where(seen, x, 0), seen.astype(float)
                w = np.array(own["w"].tolist(), float) if weighted else np.ones((len(x), 1))
                for i in range(w.shape[1]):
                    wx, ws = x * w[:, i : i + 1], seen * w[:, i : i + 1]
                    new = np.stack([x.T @ wx, x.T @ ws, seen.T @ ws])
                    at = held.setdefault((*key, i), [0.0, np.zeros((3, p, p))])
                    at[0] += w[:, i].sum()
                    at[1] += new
            if len(held) * p * p > 4_000_000:
                yield pd.DataFrame([[*k, n, m.tobytes()] for k, (n, m) in held.items()], columns=sums.names)
                held = {}
        if held:
            yield pd.DataFrame([[*k, n, m.tobytes()] for k, (n, m) in held.items()], columns=sums.names)

    edge = "array<struct<a: int, b: int, r: double>>"
    out = T.StructType([*(rows.schema[c] for c in keys), T.StructField("draw_of_block", T.IntegerType()), *([rows.schema["block"]] if weighted else []), T.StructField("alpha", T.DoubleType()), T.StructField("edges", T._parse_datatype_string(edge))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total, found = sum(np.frombuffer(m).reshape(3, p, p) for m in pdf["m"]), []
        first = pdf.iloc[0]
        if pdf["n"].sum() > 0:
            for alpha, partial in path(correlation(pdf["n"].sum(), *total), alphas).items():
                i, j = np.nonzero(np.triu(np.abs(partial) > EDGE, 1))
                edges = [{"a": int(a), "b": int(b), "r": float(partial[a, b])} for a, b in zip(i, j)]
                found.append([*(first[c] for c in keys), int(first["i"]), *([first["block"]] if weighted else []), float(alpha), edges])
        return pd.DataFrame(found, columns=out.names)

    added = rows.mapInPandas(add, sums)
    got = added.groupBy(*every, "i").applyInPandas(fit, out)
    draw = F.col("block") * DRAW_BLOCK + F.col("draw_of_block") + 1 if weighted else F.lit(0)
    names = F.array(*(F.lit(str(x)) for x in parts))
    named = F.transform("edges", lambda e: F.struct(F.get(names, e["a"]).alias("a"), F.get(names, e["b"]).alias("b"), e["r"].alias("partial_r")))
    return got.select(*keys, draw.cast("int").alias("draw") if "draw" not in keys else F.lit(0).alias("fit"), "alpha", named.alias("edges"))


def network(df: DataFrame, group: list[str], unit: str, part: str, value: str, alphas: list[float]) -> DataFrame:
    """Partial-correlation edges (a < b) of each group and penalty."""
    parts = part_names(df, part)
    got = fits(vectors(df, group, unit, part, value, parts), group, parts, alphas)
    return got.select(*group, "alpha", F.explode("edges").alias("e")).select(*group, "alpha", "e.*")


def permuted(df: DataFrame, group: list[str], unit: str, part: str, value: str, reps: int, within: list[str] = (), seed: int = 1) -> DataFrame:
    """``(draw, group, unit, part, value)``: every part's values exchanged among units by itself, within groups and ``within``."""
    cell = F.concat_ws("\u001f", F.col(unit).cast("string"), F.col(part).cast("string"))
    strata = list(dict.fromkeys([*group, *within, part]))
    rows = df.select(unit, *strata, value, cell.alias("_cell"))
    moves = RS.permutations(rows, reps, "_cell", strata, seed)
    return moves.join(rows.select(F.col("_cell").alias("perm_unit"), *strata, value), ["perm_unit", *strata]).join(rows.select("_cell", *strata, unit), ["_cell", *strata]).select("draw", *group, unit, part, value)


def _null(df: DataFrame, group: list[str], unit: str, part: str, value: str, parts: list, alphas: list[float], reps: int, within: list[str], seed: int) -> DataFrame:
    moved = permuted(df, group, unit, part, value, reps, within, seed)
    return fits(vectors(moved, ["draw", *group], unit, part, value, parts), ["draw", *group], parts, alphas).drop("fit")


def calibrate(
    df: DataFrame, group: list[str], unit: str, part: str, value: str, alphas: list[float], reps: int, allowed: float, least: int = 1, within: list[str] = (), seed: int = 1,
) -> DataFrame:
    """Per group and penalty: edges, mean edges of the permuted null, their ratio, and the penalty that is chosen.

    Chosen is the smallest penalty with at least ``least`` edges whose null has
    at most ``allowed`` of them; allowing more never raises it.
    """
    parts = part_names(df, part)
    seen = fits(vectors(df, group, unit, part, value, parts), group, parts, alphas).select(*group, "alpha", F.size("edges").alias("n_edges"))
    null = _null(df, group, unit, part, value, parts, alphas, reps, within, seed).groupBy(*group, "alpha").agg(F.avg(F.size("edges")).alias("null_edges"))
    both = cut(seen.join(null, [*group, "alpha"]).withColumn("null_ratio", ratio("null_edges", "n_edges")), "calibration")
    good = both.where((F.col("n_edges") >= least) & (F.col("null_ratio") <= allowed)).groupBy(*group).agg(F.min("alpha").alias("chosen"))
    joined = both.join(good, group, "left") if group else both.join(F.broadcast(good))
    return joined.withColumn("chosen", F.coalesce(F.col("alpha") == F.col("chosen"), F.lit(False)))


def drawn(df: DataFrame, group: list[str], unit: str, part: str, value: str, cluster: str, parts: list, alphas: list[float], reps: int, seed: int = 1) -> DataFrame:
    """``(group, draw, alpha, edges)`` over bootstrap draws of clusters; a draw takes the same clusters in every group."""
    of = df.select(*dict.fromkeys([*group, unit, cluster])).distinct()
    boot = RS.bootstrap(df.select(cluster).distinct(), reps, cluster, seed=seed)
    place = F.col("draw") - 1
    held = boot.groupBy(cluster, F.floor(place / DRAW_BLOCK).cast("int").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((place % DRAW_BLOCK).cast("int").alias("i"), "weight"))).alias("_w"))
    size = F.least(F.lit(DRAW_BLOCK), F.lit(reps) - F.col("block") * DRAW_BLOCK)
    weights = held.withColumn("w", F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.try_element_at("_w", i), F.lit(0)))).drop("_w")
    rows = vectors(df, group, unit, part, value, parts).join(of, list(dict.fromkeys([*group, unit]))).join(weights, cluster)
    return fits(rows, group, parts, alphas, weighted=True)


def stability(df: DataFrame, group: list[str], unit: str, part: str, value: str, alpha: float, reps: int, cluster: str | None = None, within: list[str] = (), seed: int = 1) -> DataFrame:
    """Share of bootstrap draws with each edge, sign consistency, mean, and the share of permuted tables with it."""
    parts = part_names(df, part)
    got = drawn(df, group, unit, part, value, cluster or unit, parts, [alpha], reps, seed)
    edges = got.select(*group, "draw", F.explode("edges").alias("e")).select(*group, "draw", "e.*")
    r = F.col("partial_r")
    stable = edges.groupBy(*group, "a", "b").agg(
        (F.count(F.lit(1)) / F.lit(reps)).alias("stability"), F.greatest(F.avg((r > 0).cast("double")), F.avg((r < 0).cast("double"))).alias("sign_consistency"), F.avg(r).alias("mean_r")
    )
    null = _null(df, group, unit, part, value, parts, [alpha], reps, within, seed + 1)
    null = null.select(*group, F.explode("edges").alias("e")).groupBy(*group, "e.a", "e.b").agg((F.count(F.lit(1)) / F.lit(reps)).alias("null_frequency"))
    return stable.join(null, [*group, "a", "b"], "left").na.fill(0.0, ["null_frequency"])


def compare(df: DataFrame, group: str, first, second, unit: str, part: str, value: str, cluster: str, alphas: list[float], primary: float, reps: int, seed: int = 1) -> DataFrame:
    """Density difference of two groups' networks with its bootstrap interval, Jaccard, and how sure the direction is.

    Clusters are drawn for both groups together. ``same_direction`` is the
    share of penalties whose difference has the sign of the primary one's;
    ``supported``: the interval is off 0 and four of five penalties agree.
    """
    parts = part_names(df, part)
    possible = F.lit(len(parts) * (len(parts) - 1) / 2.0)
    rows = df.where(F.col(group).isin(first, second))
    side = F.when(F.col(group) == first, 1).otherwise(-1)
    point = cut(fits(vectors(rows, [group], unit, part, value, parts), [group], parts, alphas), "networks")
    delta = point.groupBy("alpha").agg(ratio(F.sum(side * F.size("edges")), possible).alias("d"))
    names = lambda g: F.max(F.when(F.col(group) == g, F.transform("edges", lambda e: F.concat_ws("\u001f", e["a"], e["b"]))))
    sets = point.where(F.col("alpha") == primary).agg(names(first).alias("x"), names(second).alias("y"))
    shared, either = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    sets = sets.select(F.size("x").alias("n_first"), F.size("y").alias("n_second"), shared.alias("shared"), F.when(either > 0, shared / either).alias("jaccard"))
    main = delta.agg(F.max(F.when(F.col("alpha") == primary, F.col("d"))).alias("density_difference"), F.collect_list("d").alias("_all"))
    sign = F.signum("density_difference")
    agree = F.when(sign == 0, F.lit(0.0)).otherwise(ratio(F.size(F.filter("_all", lambda d: F.signum(d) == F.signum(F.col("density_difference")))), F.size("_all")))
    draws = drawn(rows, [group], unit, part, value, cluster, parts, [primary], reps, seed).groupBy("draw").agg(ratio(F.sum(side * F.size("edges")), possible).alias("v"))
    ci = RS.interval(draws, "v").select("low", "high", F.col("p_positive").alias("p_first_denser"), "n_draws")
    out = main.withColumn("same_direction", agree).drop("_all").join(F.broadcast(ci)).join(F.broadcast(sets))
    return out.withColumn("supported", ((F.col("low") > 0) | (F.col("high") < 0)) & (F.col("same_direction") >= 0.8))
