"""Tests and association measures as aggregations; nulls are tables of draws."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.numeric import f_ratio, lgamma, pdist, ratio
from quadrat.operators import resample as RS
from quadrat.operators.distance import tiled_medians
from quadrat.operators.windows import avg_rank
from quadrat.session import cut


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation, NULL for a constant."""
    return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.corr(x, y))


def pearson(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(safe_corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": avg_rank(list(by), x), "_y": avg_rank(list(by), y)})
    return ranked.groupBy(*by).agg(safe_corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str, by: list[str] = ()) -> DataFrame:
    """Spearman of x and y with z held: closed form from the three rank correlations."""
    r = df.withColumns({"_x": avg_rank(list(by), x), "_y": avg_rank(list(by), y), "_z": avg_rank(list(by), z)})
    c = r.groupBy(*by).agg(safe_corr("_x", "_y").alias("xy"), safe_corr("_x", "_z").alias("xz"), safe_corr("_y", "_z").alias("yz"), F.count(F.lit(1)).alias("n"))
    rho = ratio(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))))
    return c.select(*by, rho.alias("rho"), "n")


def spearman_draws(df: DataFrame, unit: str, x: str, y: str, reps: int, seed: int = 1, strata: list[str] = ()) -> DataFrame:
    """Bootstrap distribution of Spearman's rho: rows repeated by weight and ranked again in each draw."""
    w = RS.bootstrap(df, reps, unit, strata, seed).join(df, [unit, *strata])
    rows = w.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    return spearman(rows, x, y, ["draw"])


def wilcoxon(df: DataFrame, diff: str, by: list[str] = ()) -> DataFrame:
    """Signed-rank statistic with mid-ranks, zeros dropped; normal p with tie correction."""
    rows = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("_a", F.abs(F.round(diff, 9)))
    r = rows.withColumn("_r", avg_rank(list(by), "_a"))
    tie = F.count(F.lit(1)).over(Window.partitionBy(*by, "_a"))
    r = r.withColumn("_t", tie * tie - 1)  # sums to t^3 - t over a tied group
    n = F.count(F.lit(1))
    g = r.groupBy(*by).agg(n.alias("n"), F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(diff) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"), F.sum("_t").alias("_t"))
    k = F.col("n")
    var = k * (k + 1) * (2 * k + 1) / 24 - F.col("_t") / 48
    z = (F.least("w_plus", "w_minus") - k * (k + 1) / 4) / F.sqrt(var)
    return g.withColumn("z", F.when(var > 0, z)).drop("_t")


def wilcoxon_exact_p(n: Column, w: Column) -> Column:
    """Exact two-sided p of the smaller signed-rank sum without ties, for any n, as a pandas UDF on result rows.

    Counts are shares of all sign patterns, up to the observed sum: n times w steps for a row. NULL for n under 1.
    """

    @F.pandas_udf("double")
    def run(n, w):
        def one(k, stat):
            if k != k or k < 1 or stat != stat:
                return None
            share = np.zeros(int(stat) + 1)
            share[0] = 1.0
            for i in range(1, int(k) + 1):
                share[i:] += share[: max(len(share) - i, 0)].copy()
                share /= 2
            return float(min(1.0, 2 * share.sum()))

        import pandas as pd

        return pd.Series([one(k, s) for k, s in zip(n, w)], dtype="float64")

    return run(n.cast("double"), w.cast("double"))


def friedman(df: DataFrame, block: list[str], treatment: str, value: str) -> DataFrame:
    """Friedman chi-square over complete blocks, with tie correction."""
    r = df.withColumn("_r", avg_rank(block, F.round(value, 9)))
    t = F.count(F.lit(1)).over(Window.partitionBy(*block, F.round(value, 9)))
    r = r.withColumn("_t", t * t - 1)
    ties = r.agg(F.sum("_t").alias("ties"), F.count_distinct(F.struct(*block)).alias("n"), F.count_distinct(treatment).alias("k"))
    sums = r.groupBy(treatment).agg(F.sum("_r").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    n, k = F.col("n"), F.col("k")
    chi = ratio(ratio(12.0 * F.col("ss"), n * k * (k + 1)) - 3 * n * (k + 1), 1 - ratio("ties", n * k * (k * k - 1)))
    return ties.join(F.broadcast(sums)).select(n.alias("n_blocks"), k.alias("k"), chi.alias("chi2"))


def fisher_greater(a, b, c, d) -> Column:
    """One-sided Fisher exact p of the table [[a, b], [c, d]] for a larger a: first term from log gammas, then by ratios."""
    a, b, c, d = (F.col(x).cast("int") if isinstance(x, str) else x.cast("int") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    ln = lambda x: lgamma(x + F.lit(1.0))
    first = ln(row) + ln(n - row) + ln(col) + ln(n - col) - ln(n) - ln(a) - ln(row - a) - ln(col - a) - ln(n - row - col + a)
    step = lambda k: F.log((row - k).cast("double") * (col - k) / ((k + 1).cast("double") * (n - row - col + k + 1)))
    total = F.aggregate(
        F.sequence(a, F.least(row, col)),
        F.struct(F.lit(0.0).alias("sum"), first.alias("log")),
        lambda acc, k: F.struct((acc["sum"] + F.exp(acc["log"])).alias("sum"), (acc["log"] + step(k)).alias("log")),
        lambda acc: acc["sum"],
    )
    return F.least(F.lit(1.0), total)


def cliffs_delta(df: DataFrame, group: str, first, second, value: str, by: list[str] = ()) -> DataFrame:
    """Cliff's delta of ``first`` over ``second`` from the mid-rank sum."""
    r = df.where(F.col(group).isin(first, second)).withColumn("_r", avg_rank(list(by), value))
    g = r.groupBy(*by).agg(F.sum(F.when(F.col(group) == first, F.col("_r"))).alias("s"), F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) == second).alias("n2"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    return g.select(*by, (ratio(2 * u, F.col("n1") * F.col("n2")) - 1).alias("delta"), "n1", "n2")


def t_of_rho(rho: str, n: str) -> Column:
    """Student's t of a correlation; infinite where it is perfect (within 1e-12), NULL without freedom."""
    r, free = F.col(rho).cast("double"), F.col(n) - 2
    t = r * F.sqrt(ratio(free, F.greatest(1 - r * r, F.lit(0.0))))
    return F.when((free > 0) & (F.abs(r) >= 1 - 1e-12), F.signum(r) * F.lit(float("inf"))).when(free > 0, t)


def paired_differences(df: DataFrame, block: list[str], position: str, contrasts: list[tuple], value: str) -> DataFrame:
    """``(contrast, block, diff)`` of blocks that have both positions."""
    wide = df.groupBy(*block).pivot(position, sorted({p for c in contrasts for p in c})).agg(F.avg(value))
    cells = F.explode(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(str(a)) - F.col(str(b))).alias("diff")) for a, b in contrasts))).alias("c")
    return wide.select(*block, cells).select(*block, "c.contrast", "c.diff").where("diff is not null")


def paired_contrasts(df: DataFrame, block: list[str], position: str, contrasts: list[tuple], value: str, reps: int = 200, seed: int = 1) -> DataFrame:
    """Per contrast: n, mean, median, bootstrap interval of the mean, signed rank, share above 0, p and q."""
    from quadrat.operators.windows import with_bh

    d = paired_differences(df, block, position, contrasts, value).withColumn("unit", F.concat_ws("/", *block))
    main = d.groupBy("contrast").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.median("diff").alias("median"), F.avg(F.when(F.col("diff") > 0, 1.0).otherwise(0.0)).alias("share_positive"))
    draws = RS.bootstrap(d, reps, "unit", ["contrast"], seed).join(d, ["contrast", "unit"]).groupBy("contrast", "draw").agg(ratio(F.sum(F.col("weight") * F.col("diff")), F.sum("weight")).alias("m"))
    ci = RS.interval(draws, "m", ["contrast"]).select("contrast", "low", "high")
    w = wilcoxon(d, "diff", ["contrast"]).select("contrast", "w_plus", "w_minus", "z")
    out = main.join(ci, "contrast").join(w, "contrast", "left").withColumn("p", pdist("normal", "z"))
    return with_bh(out, "p", ties=["contrast"])


def paired_location(df: DataFrame, block: str, part: str, diff: str, reps: int, seed: int = 1) -> DataFrame:
    """Norm of the mean difference vector with its sign-flip null: (statistic, p, n_blocks)."""
    mean = df.groupBy(part).agg(F.avg(diff).alias("m"))
    obs = mean.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("statistic"))
    flips = RS.sign_flips(df, reps, block, seed)
    null = df.join(flips, block).groupBy("draw", part).agg(F.avg(F.col("sign") * F.col(diff)).alias("m")).groupBy("draw").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("v"))
    p = RS.perm_p(null.join(F.broadcast(obs)), F.col("statistic"), "v", ["statistic"])
    return p.join(F.broadcast(df.agg(F.count_distinct(block).alias("n_blocks"))))


def paired_dispersion(df: DataFrame, block: str, diff: str, reps: int, seed: int = 1) -> DataFrame:
    """Mean paired difference of distances to centroid with a sign-flip p."""
    obs = df.agg(F.avg(diff).alias("statistic"), F.count(F.lit(1)).alias("n_blocks"))
    null = df.join(RS.sign_flips(df, reps, block, seed), block).groupBy("draw").agg(F.avg(F.col("sign") * F.col(diff)).alias("v"))
    return RS.perm_p(null.join(F.broadcast(obs)), F.col("statistic"), "v", ["statistic", "n_blocks"], tail="two")


def location_interval(df: DataFrame, block: str, part: str, diff: str, reps: int, seed: int = 1) -> DataFrame:
    """Norm of the mean difference vector with its bootstrap interval over blocks, and the norm over the pooled spread of differences."""
    per = df.groupBy(block, part).agg(F.sum(diff).alias("_d"), F.count(diff).alias("_k"))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    obs = df.groupBy(part).agg(F.avg(diff).alias("_m"), F.var_samp(diff).alias("_v")).agg(norm("_m").alias("statistic"), ratio(norm("_m"), F.sqrt(F.sum("_v"))).alias("effect"))
    draws = RS.bootstrap(df.select(block).distinct(), reps, block, seed=seed).join(per, block).groupBy("draw", part).agg(ratio(F.sum(F.col("weight") * F.col("_d")), F.sum(F.col("weight") * F.col("_k"))).alias("_m"))
    return obs.join(F.broadcast(RS.interval(draws.groupBy("draw").agg(norm("_m").alias("v")), "v").select("low", "high", "se", "n_draws")))


def mean_interval(df: DataFrame, block: str, value: str, reps: int, seed: int = 1) -> DataFrame:
    """Mean of a value with its bootstrap interval over blocks of rows, the mean over the standard deviation, and how many rows and blocks there are."""
    known = df.where(F.col(value).isNotNull())
    per = known.groupBy(block).agg(F.sum(value).alias("_d"), F.count(F.lit(1)).alias("_k"))
    obs = known.agg(F.avg(value).alias("mean"), F.median(value).alias("median"), ratio(F.avg(value), F.stddev(value)).alias("effect"), F.count(F.lit(1)).alias("n"), F.count_distinct(block).alias("n_blocks"))
    draws = RS.bootstrap(per, reps, block, seed=seed).join(per, block).groupBy("draw").agg(ratio(F.sum(F.col("weight") * F.col("_d")), F.sum(F.col("weight") * F.col("_k"))).alias("v"))
    return obs.join(F.broadcast(RS.interval(draws, "v").select("low", "high", "se", "n_draws")))


def _group_ss(df: DataFrame, by: list[str], group: str, part: str, value: str) -> DataFrame:
    """Total and within-group sums of squares summed over parts, per draw."""
    g = df.groupBy(*by, group, part).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count(F.lit(1)).alias("k"))
    t = g.groupBy(*by, part).agg(F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum("k").alias("K"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("B"), F.count(F.lit(1)).alias("G"))
    return t.groupBy(*by).agg(F.sum(F.col("B") - F.col("S") * F.col("S") / F.col("K")).alias("between"), F.sum(F.col("Q") - F.col("B")).alias("within"), F.max("K").alias("n"), F.max("G").alias("g"))


def _f(ss: DataFrame, by: list[str]) -> DataFrame:
    """F (infinite without variation within groups, NULL without any) and explained share (NULL without variation)."""
    total = F.col("between") + F.col("within")
    f = f_ratio(ratio("between", F.col("g") - 1), ratio("within", F.col("n") - F.col("g")), total)
    return ss.select(*by, f.alias("f"), ratio("between", total).alias("r2"))


def permanova(df: DataFrame, unit: str, group: str, part: str, value: str, reps: int, strata: list[str] = (), seed: int = 1) -> DataFrame:
    """One-factor pseudo-F on Euclidean geometry with permuted units: (f, r2, p). With ``strata`` labels move within them."""
    obs = _f(_group_ss(df, [], group, part, value), [])
    moved = RS.permutations(df, reps, unit, strata, seed).join(df.select(unit, group).distinct().withColumnRenamed(unit, "perm_unit"), "perm_unit")
    null = _f(_group_ss(df.drop(group).join(moved.select("draw", unit, group), unit), ["draw"], group, part, value), ["draw"]).select("draw", F.col("f").alias("v"))
    return RS.perm_p(null.join(F.broadcast(obs)), F.col("f"), "v", ["f", "r2"])


def omnibus_f(df: DataFrame, block: str, position: str, part: str, value: str, reps: int, seed: int = 1) -> DataFrame:
    """Block-centred pseudo-F of positions; labels are permuted within blocks."""
    centred = df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(block, part))).withColumn("_u", F.concat_ws("/", F.col(block).cast("string"), F.col(position).cast("string")))
    return permanova(centred, "_u", position, part, value, reps, [block], seed)


def mantel(x: DataFrame, y: DataFrame, reps: int, seed: int = 1, d: str = "d") -> DataFrame:
    """Correlation of two pair tables and its node-permutation p."""
    left, right = x.select("a", "b", F.col(d).alias("dx")), y.select("a", "b", F.col(d).alias("dy"))
    obs = left.join(right, ["a", "b"]).agg(safe_corr("dx", "dy").alias("r"))
    nodes = left.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    perm = RS.permutations(nodes, reps, "u", seed=seed)
    moved = left.join(perm.select("draw", F.col("u").alias("a"), F.col("perm_unit").alias("pa")), "a").join(perm.select("draw", F.col("u").alias("b"), F.col("perm_unit").alias("pb")), ["draw", "b"])
    moved = moved.select("draw", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "dx")
    null = moved.join(right, ["a", "b"]).groupBy("draw").agg(safe_corr("dx", "dy").alias("v"))
    return RS.perm_p(null.join(F.broadcast(obs)), F.col("r"), "v", ["r"])


def correlogram(pairs: DataFrame, distance: str, value: str, k: int) -> DataFrame:
    """Mantel correlation of each distance class: value against membership of the class."""
    from quadrat.operators.windows import distance_class

    c = distance_class(pairs, distance, k)
    n, sy, sq = F.sum("n").over(Window.partitionBy()), F.sum("s").over(Window.partitionBy()), F.sum("q").over(Window.partitionBy())
    g = c.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    spread = F.greatest(F.col("n") * (1 - F.col("n") / n) * (sq - sy * sy / n), F.lit(0.0))
    r = ratio(F.col("s") - F.col("n") * sy / n, F.sqrt(F.when(spread > 1e-12 * sq, spread)))
    return g.select("class", "n", (-r).alias("r"))


def distance_decay(pairs: DataFrame, x: str, y: str, reps: int, seed: int = 1) -> DataFrame:
    """Slope of pair values on distance, node-permutation p (centred), and delete-one-node jackknife error."""
    obs = pairs.agg(F.regr_slope(y, x).alias("slope"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    perm = RS.permutations(nodes, reps, "u", seed=seed)
    moved = pairs.select("a", "b", F.col(x).alias("_x")).join(perm.select("draw", F.col("u").alias("a"), F.col("perm_unit").alias("pa")), "a").join(perm.select("draw", F.col("u").alias("b"), F.col("perm_unit").alias("pb")), ["draw", "b"])
    null = moved.select("draw", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "_x").join(pairs.select("a", "b", F.col(y).alias("_y")), ["a", "b"]).groupBy("draw").agg(F.regr_slope("_y", "_x").alias("v"))
    p = RS.perm_p(null.join(F.broadcast(obs)), F.col("slope"), "v", ["slope"], tail="centred")
    sums = lambda c: (F.count(F.lit(1)).alias(f"{c}n"), F.sum(x).alias(f"{c}x"), F.sum(y).alias(f"{c}y"), F.sum(F.col(x) * F.col(y)).alias(f"{c}xy"), F.sum(F.col(x) * F.col(x)).alias(f"{c}xx"))
    own = pairs.select(F.explode(F.array("a", "b")).alias("u"), x, y).groupBy("u").agg(*sums("o"))
    loo = own.join(F.broadcast(pairs.agg(*sums("t"))))
    m = {k: F.col(f"t{k}") - F.col(f"o{k}") for k in ("n", "x", "y", "xy", "xx")}
    loo = loo.withColumn("s", ratio(m["xy"] - ratio(m["x"] * m["y"], m["n"]), m["xx"] - ratio(m["x"] * m["x"], m["n"])))
    k = F.count(F.lit(1))
    return p.join(F.broadcast(loo.agg(F.sqrt((k - 1) * F.var_pop("s")).alias("jackknife_se"))))


def moran(df: DataFrame, edges: DataFrame, unit: str, value: str, reps: int, by: list[str] = (), seed: int = 1) -> DataFrame:
    """Moran's I over an undirected edge table, with a permutation p within ``by``; of a constant both are NULL."""
    w = Window.partitionBy(*by)
    z = df.select(*by, unit, (F.col(value) - F.avg(value).over(w)).alias("z"))
    norm = z.groupBy(*by).agg(F.sum(F.col("z") * F.col("z")).alias("_s"), F.count(F.lit(1)).alias("_n"))

    def index(rows: DataFrame, keys: list[str]) -> DataFrame:
        a = rows.select(*keys, F.col(unit).alias("a"), F.col("z").alias("za"))
        b = rows.select(*keys, F.col(unit).alias("b"), F.col("z").alias("zb"))
        cross = edges.join(a, "a").join(b, [*keys, "b"]).groupBy(*keys).agg(F.sum(F.col("za") * F.col("zb")).alias("_c"), F.count(F.lit(1)).alias("_e"))
        j = cross.join(norm, list(by)) if by else cross.join(F.broadcast(norm))
        return j.select(*keys, ratio(F.col("_n") * F.col("_c"), F.col("_e") * F.col("_s")).alias("i"))

    obs = index(z, list(by))
    perm = RS.permutations(z, reps, unit, by, seed)
    moved = perm.join(z.withColumnRenamed(unit, "perm_unit"), ["perm_unit", *by]).select("draw", *by, unit, "z")
    null = index(moved, ["draw", *by]).withColumnRenamed("i", "v")
    j = null.join(obs, list(by)) if by else null.join(F.broadcast(obs))
    return RS.perm_p(j, F.col("i"), "v", [*by, "i"])


def moran_multivariate(df: DataFrame, edges: DataFrame, unit: str, part: str, value: str, reps: int, seed: int = 1) -> DataFrame:
    """Moran's I of many responses (or residuals) at once: the trace form n tr(E'WE) / (sum W tr(E'E)), with a p from exchanged rows.

    The products of all responses are summed once for each pair of units; a
    draw only looks pairs up. Units are few (their pairs are a table).
    """
    z = df.select(F.col(unit).alias("u"), F.col(part).alias("t"), (F.col(value) - F.avg(value).over(Window.partitionBy(part))).alias("z"))
    norm = z.agg(F.sum(F.col("z") * F.col("z")).alias("_s"), F.count_distinct("u").alias("_n"))
    pair = z.toDF("a", "t", "za").join(z.toDF("b", "t", "zb"), "t").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("za") * F.col("zb")).alias("g"))
    pair = cut(pair, "products")
    links = edges.select("a", "b")

    def index(moved: DataFrame, keys: list[str]) -> DataFrame:
        got = moved.join(pair, ["a", "b"]).groupBy(*keys).agg(F.sum("g").alias("_c"), F.count(F.lit(1)).alias("_e"))
        return got.join(F.broadcast(norm)).select(*keys, ratio(F.col("_n") * F.col("_c"), F.col("_e") * F.col("_s")).alias("i"))

    obs = index(links, [])
    perm = RS.permutations(z.select("u").distinct(), reps, "u", seed=seed)
    moved = links.join(perm.select("draw", F.col("u").alias("a"), F.col("perm_unit").alias("pa")), "a").join(perm.select("draw", F.col("u").alias("b"), F.col("perm_unit").alias("pb")), ["draw", "b"])
    null = index(moved.select("draw", F.col("pa").alias("a"), F.col("pb").alias("b")), ["draw"]).withColumnRenamed("i", "v")
    return RS.perm_p(null.join(F.broadcast(obs)), F.col("i"), "v", ["i"])


def residual_trend(df: DataFrame, part: str, value: str, x: str, out: str = "residual") -> DataFrame:
    """What is left of each part after its straight line on ``x``."""
    w = Window.partitionBy(part)
    slope = F.regr_slope(value, x).over(w)
    return df.withColumn(out, F.col(value) - F.avg(value).over(w) - slope * (F.col(x) - F.avg(x).over(w)))


def pair_kinds(units: DataFrame, kinds: list[str]) -> DataFrame:
    """``(x, y, n)``: how many pairs of units, each taken in both orders, are of kinds x and y (structs)."""
    g = units.groupBy(F.struct(*kinds).alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    both = g.crossJoin(g.toDF("y", "_m"))
    return both.select("x", "y", (F.col("_n") * F.col("_m") - F.when(F.col("x").eqNullSafe(F.col("y")), F.col("_n")).otherwise(0)).alias("n"))


def near_pairs(ranks: DataFrame, unit: str, gap: float, by: list[str] = ()) -> DataFrame:
    """``(*by, a, b)``: units a < b whose ranks differ by at most ``gap``; an equi join on cells of the rank."""
    cell = F.floor(F.col("rank") / max(gap, 1))
    a = ranks.select(*by, F.col(unit).alias("a"), F.col("rank").alias("ra"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    b = ranks.select(*by, F.col(unit).alias("b"), F.col("rank").alias("rb"), cell.alias("_c"))
    return a.hint("merge").join(b, [*by, "_c"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ra") - F.col("rb")) <= gap)).select(*by, "a", "b")


def adjacency_test(
    pairs: DataFrame, units: DataFrame, rank: DataFrame, unit: str, gap: float, strata: dict[str, Callable[[Column, Column], Column]], value: str, reps: int, seed: int = 1, rest: float = 1.0,
) -> DataFrame:
    """Weighted mean over strata of the difference between adjacent and other pairs of ``units``, with ranks shuffled over the units for its null.

    ``pairs`` (a < b) need not hold every pair: what it lacks has the value
    ``rest``. ``strata`` are rules of two units' other columns that don't depend
    on their order. Only adjacent pairs meet the draws; the others are a stratum's
    sum less theirs, and pairs are counted by kinds of units.
    """
    pairs = cut(pairs.select("a", "b", F.col(value).alias("_v")), "pairs")

    def known(near: DataFrame, marked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        return marked(pairs).select(*strata, (F.col("_v") - rest).alias("more")), pairs

    return _adjacency(known, units, rank, unit, gap, strata, reps, seed, rest)


def adjacency_by_parts(
    df: DataFrame, part: str, n: str, units: DataFrame, rank: DataFrame, unit: str, gap: float, strata: dict[str, Callable[[Column, Column], Column]], reps: int, seed: int = 1,
) -> DataFrame:
    """``adjacency_test`` of the Bray-Curtis of all pairs of ``df``'s units, of which no pair but the adjacent becomes a row."""
    from quadrat.operators.blocks import shared_sums

    def known(near: DataFrame, marked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        sums, d = shared_sums(df, unit, part, n, near, units)
        return sums.withColumns({k: rule(F.col("x"), F.col("y")) for k, rule in strata.items()}).select(*strata, "more"), d.withColumnRenamed("d", "_v")

    return _adjacency(known, units, rank, unit, gap, strata, reps, seed, 1.0)


def _adjacency(known: Callable, units: DataFrame, rank: DataFrame, unit: str, gap: float, strata: dict, reps: int, seed: int, rest: float) -> DataFrame:
    """``known``: from adjacent pairs to (strata, more), what pairs are from ``rest``, and the values ``_v`` of pairs (a, b) that are not at ``rest``."""
    shuffled = RS.permutations(rank, reps, unit, seed=seed).join(rank.withColumnRenamed(unit, "perm_unit"), "perm_unit").select("draw", unit, "rank")
    ranks = cut(rank.select(F.lit(0).alias("draw"), unit, "rank").unionByName(shuffled), "ranks")
    kinds = [c for c in units.columns if c != unit]
    what = units.select(F.col(unit).alias("_u"), F.struct(*kinds).alias("_k"))

    def marked(df: DataFrame) -> DataFrame:
        both = df.join(what.toDF("a", "x"), "a").join(what.toDF("b", "y"), "b")
        return both.withColumns({k: rule(F.col("x"), F.col("y")) for k, rule in strata.items()})

    of = pair_kinds(units.join(rank.select(unit).distinct(), unit, "left_semi"), kinds)
    counted = of.withColumns({k: rule(F.col("x"), F.col("y")) for k, rule in strata.items()}).groupBy(*strata).agg((F.sum("n") / 2).alias("n"), F.lit(0.0).alias("more"))
    near = near_pairs(ranks, unit, gap, ["draw"])
    listed, pairs = known(near, marked)
    total = counted.unionByName(listed.groupBy(*strata).agg(F.lit(0.0).alias("n"), F.sum("more").alias("more"))).groupBy(*strata).agg(F.sum("n").alias("n"), F.sum("more").alias("more"))
    g = marked(near.join(pairs, ["a", "b"], "left")).groupBy("draw", *strata).agg(F.count(F.lit(1)).alias("n1"), F.sum(F.coalesce("_v", F.lit(rest))).alias("s1"))
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"t.{k}")) for k in strata]
    m1, m0 = F.col("s1") / F.col("n1"), (F.col("n") * rest + F.col("more") - F.col("s1")) / (F.col("n") - F.col("n1"))
    j = g.alias("g").join(F.broadcast(total.alias("t")), reduce(and_, same)).where("n > n1").select("draw", "n1", (m1 - m0).alias("_d"))
    deltas = j.groupBy("draw").agg(ratio(F.sum(F.col("n1") * F.col("_d")), F.sum("n1")).alias("v"), F.sum("n1").alias("n_adjacent"), F.count(F.lit(1)).alias("n_strata"))
    deltas = cut(deltas, "deltas")
    obs = deltas.where("draw = 0").select(F.col("v").alias("delta"), "n_adjacent", "n_strata")
    return RS.perm_p(deltas.where("draw > 0").select("draw", "v").join(F.broadcast(obs)), F.col("delta"), "v", ["delta", "n_adjacent", "n_strata"])


def neighbour_excess(pairs: DataFrame, rank: DataFrame, unit: str, gap: float, value: str, rest: float = 1.0) -> DataFrame:
    """Per unit: mean value to units at most ``gap`` ranks away minus mean to the others; pairs that ``pairs`` (a < b) lacks have the value ``rest``."""
    pairs = cut(pairs.select("a", "b", F.col(value).alias("_v")), "pairs")
    more = pairs.select(F.explode(F.array("a", "b")).alias("unit"), "_v").groupBy("unit").agg(F.sum(F.col("_v") - rest).alias("more"))
    return _excess(more, pairs, near_pairs(rank, unit, gap), rank, unit, rest)


def excess_by_parts(df: DataFrame, part: str, n: str, rank: DataFrame, unit: str, gap: float) -> DataFrame:
    """``neighbour_excess`` of the Bray-Curtis of all pairs of ``df``'s units, of which no pair but the near becomes a row."""
    from quadrat.operators.blocks import shared_sums

    near = near_pairs(rank, unit, gap)
    more, d = shared_sums(df, unit, part, n, near)
    return _excess(more, d.withColumnRenamed("d", "_v"), near, rank, unit, 1.0)


def _excess(more: DataFrame, pairs: DataFrame, near: DataFrame, rank: DataFrame, unit: str, rest: float) -> DataFrame:
    near = near.join(pairs, ["a", "b"], "left")
    near = near.select(F.explode(F.array("a", "b")).alias("unit"), F.coalesce("_v", F.lit(rest)).alias("_v")).groupBy("unit").agg(F.count(F.lit(1)).alias("n1"), F.sum("_v").alias("s1"))
    others = rank.agg((F.count(F.lit(1)) - 1).alias("n"))
    u = rank.select(F.col(unit).alias("unit")).join(F.broadcast(others)).where("n > 0").join(more, "unit", "left").join(near, "unit", "left")
    m0 = ratio(F.col("n") * rest + F.coalesce("more", F.lit(0.0)) - F.col("s1"), F.col("n") - F.col("n1"))
    return u.select("unit", (F.col("s1") / F.col("n1") - m0).alias("excess"))


def method_agreement(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Two methods on the same units: positive agreement, log10 bias and limits, median ratio."""
    pa, pb = F.coalesce(F.col(a) > 0, F.lit(False)), F.coalesce(F.col(b) > 0, F.lit(False))
    log = F.when(pa & pb, F.log10(F.when(pa & pb, F.col(a) / F.col(b))))
    both = F.count_if(pa & pb)
    g = df.groupBy(by).agg(both.alias("both"), F.count_if(pa & ~pb).alias("only_a"), F.count_if(~pa & pb).alias("only_b"), F.count_if(~pa & ~pb).alias("neither"), F.avg(log).alias("bias"), F.stddev(log).alias("sd"), F.median(F.when(pa & pb, F.col(a) / F.col(b))).alias("median_ratio"))
    return g.withColumns({"positive_agreement": ratio(2 * F.col("both"), 2 * F.col("both") + F.col("only_a") + F.col("only_b")), "low": F.col("bias") - 1.96 * F.col("sd"), "high": F.col("bias") + 1.96 * F.col("sd")}).drop("sd")


def product_agreement(df: DataFrame, product: str, unit: list[str], value: str, by: list[str] = ()) -> DataFrame:
    """Pearson, Spearman and mean absolute difference of each pair of products."""
    l = df.select(*by, *unit, F.col(product).alias("a"), F.col(value).alias("va"))
    r = df.select(*by, *unit, F.col(product).alias("b"), F.col(value).alias("vb"))
    j = l.join(r, [*by, *unit]).where("a < b").withColumns({"_x": avg_rank([*by, "a", "b"], "va"), "_y": avg_rank([*by, "a", "b"], "vb")})
    return j.groupBy(*by, "a", "b").agg(safe_corr("va", "vb").alias("pearson"), safe_corr("_x", "_y").alias("spearman"), F.avg(F.abs(F.col("va") - F.col("vb"))).alias("mad"), F.count(F.lit(1)).alias("n"))


def exposure_diagnostics(df: DataFrame, by: list[str], value: str, row: str, col: str, large: float = 5.0) -> DataFrame:
    """Support of an exposure, with the variance share left after removing row and column means."""
    w = lambda *k: Window.partitionBy(*by, *k)
    resid = F.col(value) - F.avg(value).over(w(row)) - F.avg(value).over(w(col)) + F.avg(value).over(w())
    return df.withColumn("_e", resid).groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("high"), F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("share_zero"),
        F.count_distinct(value).alias("n_distinct"), F.count_if(F.col(value) >= large).alias("n_large"), F.when(F.var_pop(value) > 0, F.var_pop("_e") / F.var_pop(value)).alias("residual_share"),
    )


def community_profile(abund: DataFrame, ann: DataFrame, sample: str = "sample", genome: str = "genome", weight: str = "w", term: str = "ko", copies: str = "copies") -> DataFrame:
    """Abundance-weighted function profile of each sample."""
    return abund.join(ann, genome).groupBy(sample, term).agg(F.sum(F.col(weight) * F.col(copies)).alias("v"))


def redundancy_null(abund: DataFrame, ann: DataFrame, group: DataFrame, reps: int, seed: int = 1) -> DataFrame:
    """Median Bray-Curtis of function profiles per group against genomes with exchanged annotations.

    The annotations as they are count as draw 0; all draws take the same two readings of tiles.
    """
    perm = RS.permutations(ann, reps, "genome", seed=seed)
    moved = perm.join(ann.withColumnRenamed("genome", "perm_unit"), "perm_unit").select("draw", "genome", "ko", "copies")
    moved = cut(ann.select(F.lit(0).alias("draw"), "genome", "ko", "copies").unionByName(moved), "annotations")
    dealt = abund.repartition(int(abund.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sample")  # a number, as rows grow by draws and terms
    profile = dealt.join(moved, "genome").groupBy("draw", "sample", "ko").agg(F.sum(F.col("w") * F.col("copies")).cast("double").alias("v"))
    rows = cut(profile.where("v is not null").join(group, "sample").where("grp is not null"), "profiles")
    m = cut(tiled_medians(rows, ["draw", "grp"], "sample", "ko", "v"), "medians")
    obs = m.where("draw = 0").select("grp", F.col("median").alias("m"))
    null = m.where("draw > 0").select("draw", "grp", F.col("median").alias("v"))
    j = null.join(obs, "grp")
    low = RS.perm_p(j, F.col("m"), "v", ["grp", "m"], tail="less").select("grp", "m", F.col("p").alias("p_low"))
    high = RS.perm_p(j, F.col("m"), "v", ["grp"]).select("grp", F.col("p").alias("p_high"))
    mean = null.groupBy("grp").agg(F.avg("v").alias("null_mean"))
    return low.join(high, "grp").join(mean, "grp").select("grp", F.col("m").alias("observed"), "null_mean", "p_low", "p_high")


def community_weighted(abund: DataFrame, traits: DataFrame, sample: list[str], genome: str, weight: str, trait: str) -> DataFrame:
    """Weighted trait of each sample over all reads and over the reads of genomes with a trait value."""
    j = abund.join(traits.select(genome, trait), genome, "left")
    known = F.col(trait).isNotNull()
    top = F.sum(F.when(known, F.col(weight) * F.col(trait)).otherwise(0.0))
    return j.groupBy(*sample).agg(ratio(top, F.sum(weight)).alias("whole"), ratio(top, F.sum(F.when(known, F.col(weight)))).alias("mapped"), ratio(F.sum(F.when(known, F.col(weight)).otherwise(0)), F.sum(weight)).alias("coverage"))


def weighted_contrast(
    scores: DataFrame, visits: DataFrame, positions: tuple, reference: str, reps: int, seed: int = 1, sample: str = "sample", spec: str = "spec", score: str = "score",
) -> DataFrame:
    """Difference of a weighted trait between two positions, per specification, with a block-bootstrap interval.

    ``scores``: sample, specification, score. ``visits``: sample, site, visit,
    position, block. Only visits with both positions count (for every
    specification); a site's value is the mean of its visits' differences.
    Blocks of sites are drawn, the same for all specifications, so the
    difference to the ``reference`` specification has an interval of its own.
    """
    first, second = positions
    placed = scores.select(F.col(sample).alias("_s"), F.col(spec).alias("spec"), F.col(score).alias("v")).join(visits.withColumnRenamed(sample, "_s"), "_s")
    cell = lambda p: F.avg(F.when(F.col("position") == p, F.col("v")))
    pairs = placed.groupBy("spec", "site", "block", "visit").agg(cell(first).alias("a"), cell(second).alias("b")).where("a is not null and b is not null")
    site = pairs.groupBy("spec", "site", "block").agg(F.avg(F.col("a") - F.col("b")).alias("d"), F.count(F.lit(1)).alias("k"))
    ref = site.where(F.col("spec") == reference).select("site", F.col("d").alias("r"))
    site = cut(site.join(ref, "site", "left").withColumn("e", F.col("d") - F.col("r")), "site-differences")
    main = site.groupBy("spec").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("k").alias("n_visits"), F.avg("d").alias("estimate"), F.avg("e").alias("delta"))
    sums = site.groupBy("spec", "block").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("m"), F.sum("e").alias("e"), F.count("e").alias("me"))
    draws = RS.bootstrap(site.select("block").distinct(), reps, "block", seed=seed).join(sums, "block").groupBy("spec", "draw").agg(
        ratio(F.sum(F.col("weight") * F.col("d")), F.sum(F.col("weight") * F.col("m"))).alias("d"), ratio(F.sum(F.col("weight") * F.col("e")), F.sum(F.col("weight") * F.col("me"))).alias("e")
    )
    q = lambda c, x: F.percentile(c, F.lit(x))
    ci = draws.groupBy("spec").agg(q("d", 0.025).alias("low"), q("d", 0.975).alias("high"), F.stddev("d").alias("se"), q("e", 0.025).alias("delta_low"), q("e", 0.975).alias("delta_high"), F.count(F.lit(1)).alias("n_draws"))
    return main.join(ci, "spec").withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def niche(counts: DataFrame, gradient: DataFrame, profile: str, feature: str, n: str, x: str) -> DataFrame:
    """Abundance-weighted mean of a gradient for each feature."""
    return counts.join(gradient, profile).groupBy(feature).agg(ratio(F.sum(F.col(n) * F.col(x)), F.sum(n)).alias("niche"), F.count(F.lit(1)).alias("n_profiles"))


def mde(fits: DataFrame, se: str, power_z: float = 0.8416212335729143, alpha_z: float = 1.959963984540054) -> DataFrame:
    """Approximate minimum detectable effect of each fit."""
    return fits.withColumn("mde", (F.lit(alpha_z) + F.lit(power_z)) * F.col(se))


def agreement_by_sample(a: DataFrame, b: DataFrame, sample: str, term: str, value: str) -> DataFrame:
    """Spearman between two products' profiles of each sample over shared terms."""
    j = a.select(sample, term, F.col(value).alias("va")).join(b.select(sample, term, F.col(value).alias("vb")), [sample, term])
    return spearman(j, "va", "vb", [sample])

