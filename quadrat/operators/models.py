"""Linear and multivariate models: sufficient statistics in Spark, small solves after.

One aggregation yields cross products (p x p) for every group; only those
reach the driver or a grouped solve. Design columns are few and fixed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.numeric import f_ratio, pdist, ratio, symmetric_solve, t_quantile, tail
from quadrat.operators import resample as RS
from quadrat.session import cut


def gram(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Cross products of all column pairs as ``m_i_j`` (i <= j), and row counts."""
    sums = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("n_rows"))


def unpack_gram(row, k: int) -> np.ndarray:
    m = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m_{i}_{j}"]
    return m


def coefficients(df: DataFrame, y: list[str], x: list[str]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(beta, X'X, rows, whole cross product) of responses ``y`` on ``x``."""
    row = gram(df, [*x, *y]).first()
    m = unpack_gram(row, len(x) + len(y))
    p = len(x)
    return symmetric_solve(m[:p, :p], m[:p, p:]), m[:p, :p], row["n_rows"], m


def linear(x: list[str], beta: np.ndarray) -> Column:
    total = F.lit(0.0)
    for name, b in zip(x, np.asarray(beta).ravel()):
        total = total + F.col(name) * float(b)
    return total


def ols(df: DataFrame, y: str, x: list[str], cluster: str) -> DataFrame:
    """Least squares with cluster-robust errors (small-sample factor): one row a term."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *x]))
    beta, xx, n, _ = coefficients(rows, [y], x)
    e = F.col(y) - linear(x, beta)
    scores = rows.groupBy(cluster).agg(*(F.sum(F.col(c) * e).alias(f"s_{i}") for i, c in enumerate(x)))
    g = gram(scores, [f"s_{i}" for i in range(len(x))]).first()
    k, clusters = np.linalg.matrix_rank(xx), g["n_rows"]
    bread = np.linalg.pinv(xx, hermitian=True)
    factor = clusters / max(clusters - 1, 1) * (n - 1) / max(n - k, 1)
    cov = bread @ unpack_gram(g, len(x)) @ bread * factor
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    out = []
    for name, b, s in zip(x, beta[:, 0], se):
        t = b / s if s > 0 else None
        out.append((name, float(b), float(s), t if t is None else float(t), None if t is None else tail("t", t, clusters - 1), n, clusters))
    return df.sparkSession.createDataFrame(out, "term string, beta double, se double, t double, p double, n bigint, n_clusters bigint")


def residualize(df: DataFrame, cols: list[str], x: list[str]) -> DataFrame:
    """Columns ``r_<c>``: what is left of each column after its least-squares fit on ``x``."""
    beta = coefficients(df, cols, x)[0]
    return df.withColumns({f"r_{c}": F.col(c) - linear(x, beta[:, i]) for i, c in enumerate(cols)})


def simple_fit(df: DataFrame, y: str, x: str, by: list[str] = ()) -> DataFrame:
    """One-regressor fit by built-in moments."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def pcoa(pairs: DataFrame, share: float = 0.9, d: str = "d") -> DataFrame:
    """Principal coordinates of a unit distance table: (unit, axis, coordinate, eigenvalue, cumulative).

    The eigenproblem is of size units x units, which the all-pairs table bounds
    already, so it is solved in one group.
    """
    both = pairs.select("a", "b", (F.col(d) * F.col(d) * -0.5).alias("v"))
    sym = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    units = sym.select("a").distinct()
    full = sym.unionByName(units.select("a", F.col("a").alias("b"), F.lit(0.0).alias("v")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="v").sort_index().sort_index(axis=1)
        g = m.to_numpy()
        g = g - g.mean(axis=0) - g.mean(axis=1)[:, None] + g.mean()
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        order = np.argsort(-values)
        values, vectors = values[order], vectors[:, order]
        keep = values > 1e-9 * max(values[0], 1e-300)
        values, vectors = values[keep], vectors[:, keep]
        cum = np.cumsum(values) / values.sum()
        k = int(np.searchsorted(cum, share - 1e-12)) + 1
        rows = []
        for j in range(min(k, len(values))):
            v = vectors[:, j] * np.sign(vectors[np.argmax(np.abs(vectors[:, j])), j])
            rows += [(str(u), j + 1, float(c), float(values[j]), float(cum[j])) for u, c in zip(m.index, v * math.sqrt(values[j]))]
        return pd.DataFrame(rows, columns=["unit", "axis", "coordinate", "eigenvalue", "cumulative"])

    return full.groupBy(F.lit(1).alias("_g")).applyInPandas(lambda pdf: solve(pdf), "unit string, axis int, coordinate double, eigenvalue double, cumulative double")


def elemental_axis(df: DataFrame, unit: str, part: str, value: str, strata: list[str], detect: float, reference: list[str]) -> tuple[DataFrame, DataFrame]:
    """First principal axis of parts detected in a share of units, standardised within strata; oriented so the
    reference parts load positively. Returns (scores, loadings)."""
    from quadrat.operators.windows import zscore_within

    n = df.select(unit).distinct().count()
    ok = df.where(F.col(value) > 0).groupBy(part).agg(F.count_distinct(unit).alias("k")).where(F.col("k") >= detect * n).select(part)
    z = df.join(ok, part, "left_semi").withColumn("z", zscore_within([*strata, part], value))
    x = z.select(unit, F.col(part).alias("p"), "z")
    cov = x.toDF("u", "p", "zp").join(x.toDF("u", "q", "zq"), "u").groupBy("p", "q").agg(F.sum(F.col("zp") * F.col("zq")).alias("c")).toPandas()
    m = cov.pivot(index="p", columns="q", values="c").fillna(0.0)
    values, vectors = np.linalg.eigh(m.to_numpy())
    v = vectors[:, -1]
    ref = [list(m.index).index(r) for r in reference if r in m.index]
    v = v if not ref or v[ref].sum() >= 0 else -v
    load = df.sparkSession.createDataFrame([(str(p), float(a), float(values[-1] / values.sum())) for p, a in zip(m.index, v)], "part string, loading double, share double")
    scores = x.join(load, F.col("p").cast("string") == F.col("part")).groupBy(unit).agg(F.sum(F.col("z") * F.col("loading")).alias("score"))
    return scores, load


def multivariate_trend(df: DataFrame, unit: str, part: str, value: str, x: Column, degree: int, reps: int, seed: int = 1) -> DataFrame:
    """R2 and pseudo-F of a polynomial trend in all parts at once, with a unit-permutation p.

    A perfect trend has an infinite F; without variation R2 and F are NULL.
    """
    rows = df.withColumn("_x", x)
    terms = [f"t{i}" for i in range(degree + 1)]
    rows = rows.withColumns({"t0": F.lit(1.0), **{f"t{i}": F.pow("_x", F.lit(i)) for i in range(1, degree + 1)}})
    design = rows.select(unit, *terms).distinct()
    xx = unpack_gram(gram(design, terms).first(), degree + 1)
    inv = np.linalg.pinv(xx, hermitian=True)
    n = design.count()

    def explained(r: DataFrame, keys: list[str]) -> DataFrame:
        sums = r.groupBy(*keys, part).agg(*(F.sum(F.col(t) * F.col(value)).alias(f"s{i}") for i, t in enumerate(terms)), F.sum(F.col(value) * F.col(value)).alias("q"), F.sum(value).alias("s"))
        fit = sum((F.col(f"s{i}") * F.col(f"s{j}") * float(inv[i, j]) for i in range(degree + 1) for j in range(degree + 1)), F.lit(0.0))
        g = sums.groupBy(*keys).agg(F.sum(fit - F.col("s") * F.col("s") / n).alias("between"), F.sum(F.col("q") - F.col("s") * F.col("s") / n).alias("total"))
        left = ratio(F.col("total") - F.col("between"), F.lit(n - degree - 1))
        return g.select(*keys, ratio("between", "total").alias("r2"), f_ratio(F.col("between") / degree, left, F.col("total")).alias("f"))

    obs = explained(rows, [])
    perm = RS.permutations(design, reps, unit, seed=seed)
    moved = perm.join(rows.select(F.col(unit).alias("perm_unit"), part, value), "perm_unit").join(design, unit)
    null = explained(moved, ["draw"]).select("draw", F.col("f").alias("v"))
    return RS.perm_p(null.join(F.broadcast(obs)), F.col("f"), "v", ["r2", "f"])


def trend_jackknife(df: DataFrame, unit: str, part: str, value: str, x: str) -> DataFrame:
    """R2 of a quadratic trend in all parts at once, with its delete-one-unit jackknife: (r2, jackknife_mean, se, low, high, n_units).

    Every unit has a value of every part. Sums without a unit are the totals
    less its own, so all deletions come from one aggregation; the interval is
    Student's with n - 1 degrees of freedom.
    """
    w = Window.partitionBy("t")
    at = F.col(x) - F.avg(x).over(Window.partitionBy())  # near 0, so powers don't cancel
    rows = df.select(F.col(unit).alias("u"), F.col(part).alias("t"), F.col(value).cast("double").alias("y"), at.alias("z"))
    own = {"n": F.lit(1.0), "y0": F.col("y"), "yy": F.col("y") * F.col("y"), **{f"z{i}": F.pow("z", F.lit(i)) for i in range(1, 5)}, "y1": F.col("y") * F.col("z"), "y2": F.col("y") * F.col("z") * F.col("z")}

    def explained(m: dict[str, Column]) -> tuple[Column, Column]:
        c = lambda top, a, b: m[top] - m[a] * m[b] / m["n"]
        s11, s12, s22, t1, t2 = c("z2", "z1", "z1"), c("z3", "z1", "z2"), c("z4", "z2", "z2"), c("y1", "z1", "y0"), c("y2", "z2", "y0")
        return ratio(s22 * t1 * t1 - 2 * s12 * t1 * t2 + s11 * t2 * t2, s11 * s22 - s12 * s12), c("yy", "y0", "y0")

    sums = rows.withColumns({f"_{k}": F.sum(c).over(w) for k, c in own.items()})
    whole, left = explained({k: F.col(f"_{k}") for k in own}), explained({k: F.col(f"_{k}") - c for k, c in own.items()})
    per = sums.withColumns({"wb": whole[0], "wt": whole[1], "lb": left[0], "lt": left[1]}).groupBy("u").agg(*(F.sum(c).alias(c) for c in ("wb", "wt", "lb", "lt")))
    per = per.select(ratio("wb", "wt").alias("r2"), ratio("lb", "lt").alias("l"))
    n = F.count("l")
    g = per.agg(F.max("r2").alias("r2"), F.avg("l").alias("jackknife_mean"), F.sqrt((n - 1) * F.var_pop("l")).alias("se"), n.alias("n_units"))
    free = g.first()["n_units"] - 1
    t = t_quantile(0.975, free) if free > 0 else None
    half = F.col("se") * F.lit(t).cast("double")
    return g.withColumns({"low": F.col("r2") - half, "high": F.col("r2") + half})


def nested_test(df: DataFrame, unit: str, part: str, value: str, reduced: list[str], x: str, site: str, reps: int, seed: int = 1) -> DataFrame:
    """Does ``x`` explain the responses beyond ``reduced``? Residuals of the reduced model are exchanged within
    sites (Freedman-Lane); statistic is the explained share of the residual sum of squares."""
    design = df.select(unit, site, x, *reduced).dropDuplicates([unit])
    rx = residualize(design, [x], reduced).select(unit, site, F.col(f"r_{x}").alias("rx"), *reduced)
    inv = np.linalg.pinv(unpack_gram(gram(design, reduced).first(), len(reduced)), hermitian=True)
    y = df.select(unit, F.col(part).alias("part"), F.col(value).alias("y")).join(rx, unit)
    sums = y.groupBy("part").agg(*(F.sum(F.col(c) * F.col("y")).alias(f"xy{i}") for i, c in enumerate(reduced)))
    b = {f"b{i}": sum((F.col(f"xy{j}") * float(inv[i, j]) for j in range(len(reduced))), F.lit(0.0)) for i in range(len(reduced))}
    fit = y.join(sums.select("part", *(c.alias(k) for k, c in b.items())), "part")
    res = fit.withColumn("e", F.col("y") - sum((F.col(c) * F.col(f"b{i}") for i, c in enumerate(reduced)), F.lit(0.0))).select(unit, "part", "e")

    def share(r: DataFrame, keys: list[str]) -> DataFrame:
        g = r.groupBy(*keys, "part").agg(F.sum(F.col("rx") * F.col("e")).alias("c"), F.sum(F.col("rx") * F.col("rx")).alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"))
        return g.groupBy(*keys).agg(ratio(F.sum(ratio(F.col("c") * F.col("c"), "s")), F.sum("q")).alias("v"))

    obs = share(res.join(rx.select(unit, "rx"), unit), []).withColumnRenamed("v", "partial_r2")
    perm = RS.permutations(rx, reps, unit, [site], seed)
    null = share(perm.join(res.withColumnRenamed(unit, "perm_unit"), "perm_unit").join(rx.select(unit, "rx"), unit), ["draw"])
    return RS.perm_p(null.join(F.broadcast(obs)), F.col("partial_r2"), "v", ["partial_r2"])


def scan(y: DataFrame, exposures: DataFrame, obs: str, response: str, key: str | list[str], value: str, nuisance: list[str]) -> DataFrame:
    """Each exposure (``key``, one column or several) alone after partialling the nuisance out of both sides: beta, se, t, partial R2.

    The nuisance projection is shared: cross products of every exposure with
    the nuisance columns and the residual response come from one aggregation.
    Rows of ``y`` with one ``obs`` (say a site's observations of a day) share
    their exposure and meet it as one row of sums.
    """
    k, by = len(nuisance), [key] if isinstance(key, str) else key
    inv = np.linalg.pinv(unpack_gram(gram(y, nuisance).first(), k), hermitian=True)
    ry = residualize(y, [response], nuisance).select(obs, F.col(f"r_{response}").alias("ry"), *nuisance)
    n, syy = ry.agg(F.count(F.lit(1)), F.sum(F.col("ry") * F.col("ry"))).first()
    met = ry.groupBy(obs).agg(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(nuisance)), F.sum("ry").alias("_sy"), F.count(F.lit(1)).alias("_rows"))
    j = exposures.join(met, obs).groupBy(*by).agg(
        *(F.sum(F.col(value) * F.col(f"_s{i}")).alias(f"a{i}") for i in range(k)), F.sum(F.col(value) * F.col(value) * F.col("_rows")).alias("xx"), F.sum(F.col(value) * F.col("_sy")).alias("xy")
    )
    quad = sum((F.col(f"a{i}") * F.col(f"a{m}") * float(inv[i, m]) for i in range(k) for m in range(k)), F.lit(0.0))
    j = j.withColumn("sxx", F.col("xx") - quad).withColumn("beta", F.when(F.col("sxx") > 1e-9, F.col("xy") / F.col("sxx")))
    df = n - k - 1
    syy = F.lit(float(syy or 0.0))
    sse = F.greatest(syy - F.col("beta") * F.col("xy"), F.lit(0.0))
    se = F.sqrt(ratio(ratio(sse, F.lit(df)), "sxx"))
    return j.select(*by, "beta", se.alias("se"), ratio("beta", se).alias("t"), ratio(F.col("beta") * F.col("xy"), syy).alias("partial_r2"))


MAX_TERMS = 4_000  # columns of a design whose cross products fit the driver


def long_gram(cells: DataFrame, unit: str, term: str, value: str, terms: list) -> np.ndarray:
    """Cross products of many columns given in long form; an absent cell counts as 0.

    Rows of the matrix are built where a unit's cells meet, blocks of them are
    multiplied in their task, and the p x p sums of the tasks are added up.
    """
    p = len(terms)
    if p > MAX_TERMS:
        raise ValueError(f"{p} terms; at most {MAX_TERMS}")
    spark = cells.sparkSession
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], T.StructType([T.StructField("_t", cells.schema[term].dataType), T.StructField("_i", T.IntegerType())]))
    placed = cells.where(F.col(value).isNotNull()).join(F.broadcast(numbers), F.col(term) == F.col("_t"))
    rows = placed.groupBy(unit).agg(F.collect_list(F.struct("_i", F.col(value).cast("double").alias("v"))).alias("cells"))

    def multiply(parts):
        total = np.zeros((p, p))
        for pdf in parts:
            for at in range(0, len(pdf), 1_000):
                some = pdf["cells"].iloc[at : at + 1_000]
                x = np.zeros((len(some), p))
                for r, one in enumerate(some):
                    for c in one:
                        x[r, c["_i"]] += c["v"]
                total += x.T @ x
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    m = np.zeros((p, p))
    for r in rows.select("cells").mapInPandas(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        m[r.i, r.j] = m[r.j, r.i] = r.v
    return m


def joint_lags(y: DataFrame, lags: DataFrame, obs: str, response: str, lag: str, value: str, nuisance: list[str]) -> DataFrame:
    """Omnibus F of all lags together, the largest absolute t among them, and the rank of the design.

    Every lag takes part (``MAX_TERMS`` columns at most, else an error). F and
    its p are NULL if the lags add nothing to the rank or no freedom is left.
    """
    names = [r[0] for r in lags.select(lag).distinct().orderBy(lag).limit(MAX_TERMS + 1).collect()]
    if len(names) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} lags")
    known = lags.join(y.select(obs), obs).select(obs, F.concat(F.lit("l_"), F.col(lag).cast("string")).alias("term"), F.col(value).cast("double").alias("v"))
    own = y.join(lags.select(obs).distinct(), obs, "left_semi")
    fixed = own.select(obs, F.explode(F.array(*(F.struct(F.lit(f"n_{i}").alias("term"), F.col(c).cast("double").alias("v")) for i, c in enumerate([*nuisance, response])))).alias("c")).select(obs, "c.term", "c.v")
    terms = [*(f"n_{i}" for i in range(len(nuisance))), *(f"l_{n}" for n in names), f"n_{len(nuisance)}"]
    m, n = long_gram(known.unionByName(fixed), obs, "term", "v", terms), own.count()
    k, p = len(nuisance), len(nuisance) + len(names)

    def sse(i):
        b = symmetric_solve(m[:i, :i], m[:i, -1])
        return m[-1, -1] - b @ m[:i, -1], b

    (full, b), (small, _) = sse(p), sse(k)
    rank = int(np.linalg.matrix_rank(m[:p, :p]))
    q = rank - int(np.linalg.matrix_rank(m[:k, :k]))
    free = n - rank
    f = float((small - full) / q / (full / free)) if q > 0 and free > 0 and full > 0 else None
    t = None
    if free > 0 and names:
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(m[:p, :p], hermitian=True)), 0) * max(full, 0) / free)
        t = float(np.abs(b[k:] / np.where(se[k:] > 0, se[k:], np.inf)).max())
    out = (f, q, free, None if f is None else tail("f", f, q, free), t, rank, p)
    return y.sparkSession.createDataFrame([out], "f double, df1 int, df2 bigint, p double, max_abs_t double, rank int, columns int")


MAX_SIZES = 100_000


def gee_fit(df: DataFrame, y: str, x: list[str], cluster: str, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(beta, robust covariance, correlation, clusters) of a Gaussian GEE with exchangeable correlation.

    The inverse of an exchangeable matrix has a closed form in the cluster's
    size, so sums over clusters of one size are all that a round needs: the
    driver gets one row for each distinct size (at most ``MAX_SIZES``), never
    clusters. The robust covariance is one more aggregation over the clusters.
    Raises if the rounds do not settle.
    """
    p = len(x)
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *x]))
    X = [F.col(c).cast("double") for c in x]
    Y = F.col(y).cast("double")
    own = cut(rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("m"), F.sum(Y).alias("y1"), F.sum(Y * Y).alias("yy"), *(F.sum(c).alias(f"x{i}") for i, c in enumerate(X)),
        *(F.sum(c * Y).alias(f"xy{i}") for i, c in enumerate(X)), *(F.sum(X[i] * X[j]).alias(f"xx{i}_{j}") for i in range(p) for j in range(i, p)),
    ), "clusters")
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    of_size = own.groupBy("m").agg(
        F.count(F.lit(1)).alias("k"), F.sum("yy").alias("yy"), F.sum(F.col("y1") * F.col("y1")).alias("y1y1"), *(F.sum(f"xy{i}").alias(f"xy{i}") for i in range(p)),
        *(F.sum(F.col(f"x{i}") * F.col("y1")).alias(f"x1y1{i}") for i in range(p)), *(F.sum(f"xx{i}_{j}").alias(f"xx{i}_{j}") for i, j in upper),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"x1x1{i}_{j}") for i, j in upper),
    ).limit(MAX_SIZES + 1).toPandas().sort_values("m")
    if len(of_size) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} distinct cluster sizes")

    def matrices(prefix):
        out = np.empty((len(of_size), p, p))
        for i, j in upper:
            out[:, i, j] = out[:, j, i] = of_size[f"{prefix}{i}_{j}"]
        return out

    vector = lambda prefix: of_size[[f"{prefix}{i}" for i in range(p)]].to_numpy(float)
    m, k = of_size["m"].to_numpy(float), of_size["k"].to_numpy(float)
    XX, S, XY, SY = matrices("xx"), matrices("x1x1"), vector("xy"), vector("x1y1")
    yy, y1y1 = of_size["yy"].sum(), of_size["y1y1"].sum()
    n, rho, beta = (m * k).sum(), 0.0, symmetric_solve(XX.sum(0), XY.sum(0))
    pairs = (k * m * (m - 1) / 2).sum() - p
    for _ in range(rounds):
        c = rho / (1 - rho + rho * m)
        A = (XX - c[:, None, None] * S).sum(0)
        new = symmetric_solve(A, (XY - c[:, None] * SY).sum(0))
        ee = yy - 2 * XY.sum(0) @ new + new @ XX.sum(0) @ new
        e1 = y1y1 - 2 * SY.sum(0) @ new + new @ S.sum(0) @ new
        phi = ee / max(n - p, 1)
        before, rho = rho, float(np.clip((e1 - ee) / 2 / max(pairs, 1) / phi, -0.9 / max(m.max() - 1, 1), 0.99)) if phi > 0 else 0.0
        done, beta = np.abs(new - beta).max() < 1e-8 * max(1, np.abs(new).max()) and abs(rho - before) < 1e-8, new
        if done:
            break
    else:
        raise RuntimeError(f"the correlation did not settle in {rounds} rounds")
    c = rho / (1 - rho + rho * m)
    bread = np.linalg.pinv((XX - c[:, None, None] * S).sum(0), hermitian=True)
    fit = lambda name: sum((F.col(name(j)) * float(b) for j, b in enumerate(beta)), F.lit(0.0))
    weight = F.lit(rho) / (F.lit(1 - rho) + F.lit(rho) * F.col("m"))
    cross = lambda i: lambda j: f"xx{min(i, j)}_{max(i, j)}"
    score = [F.col(f"xy{i}") - fit(cross(i)) - weight * (F.col("y1") - fit(lambda j: f"x{j}")) * F.col(f"x{i}") for i in range(p)]
    meat = gram(own.select(*(s.alias(f"u{i}") for i, s in enumerate(score))), [f"u{i}" for i in range(p)]).first()
    return beta, bread @ unpack_gram(meat, p) @ bread, rho, int(k.sum())


def gee(df: DataFrame, y: str, x: list[str], cluster: str, rounds: int = 50) -> DataFrame:
    """Gaussian GEE with exchangeable correlation: each term with its robust error, z, p and 95 % interval."""
    beta, cov, rho, _ = gee_fit(df, y, x, cluster, rounds)
    rows = []
    for t, b, s in zip(x, beta.tolist(), np.sqrt(np.maximum(np.diag(cov), 0)).tolist()):
        rows.append((t, b, s, b / s if s > 0 else None, tail("normal", b / s) if s > 0 else None, b - 1.959963984540054 * s, b + 1.959963984540054 * s, rho))
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, z double, p double, low double, high double, rho double")


def gee_tests(df: DataFrame, y: str, x: list[str], cluster: str, contrasts: dict[str, dict[str, float]], wald: dict[str, list[str]], rounds: int = 50) -> DataFrame:
    """Contrasts of terms (estimate, robust error, interval, p), and joint Wald tests of sets of terms such as interactions."""
    beta, cov, rho, n = gee_fit(df, y, x, cluster, rounds)
    rows = []
    for name, weights in contrasts.items():
        w = np.array([weights.get(t, 0.0) for t in x])
        b, s = float(w @ beta), float(math.sqrt(max(w @ cov @ w, 0)))
        rows.append((name, "contrast", b, s, b - 1.959963984540054 * s, b + 1.959963984540054 * s, b / s if s > 0 else None, 1, tail("normal", b / s) if s > 0 else None, rho, n))
    for name, terms in wald.items():
        at = [x.index(t) for t in terms]
        own = cov[np.ix_(at, at)]
        chi, rank = float(beta[at] @ np.linalg.pinv(own, hermitian=True) @ beta[at]), int(np.linalg.matrix_rank(own))
        rows.append((name, "wald", None, None, None, None, chi, rank, tail("chi2", chi, rank) if rank else None, rho, n))
    return df.sparkSession.createDataFrame(rows, "test string, kind string, estimate double, se double, low double, high double, statistic double, dof int, p double, rho double, n_clusters int")


def block_cv(df: DataFrame, fold: str, x: list[str], y: str, group: list[str] = ()) -> DataFrame:
    """Leave-one-block-out skill of a linear fit: all folds from one pass of cross products.

    The training moments of a fold are the total less its own.
    """
    cols = [*x, y]
    g = gram(df, cols, [*group, fold])
    total = gram(df, cols, list(group))
    names = [c for c in g.columns if c.startswith("m_")]
    train = g.join(total.withColumnsRenamed({c: f"t_{c}" for c in [*names, "n_rows"]}), list(group)) if group else g.crossJoin(F.broadcast(total.withColumnsRenamed({c: f"t_{c}" for c in [*names, "n_rows"]})))
    p = len(x)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            m = np.empty((p + 1, p + 1))
            for i in range(p + 1):
                for j in range(i, p + 1):
                    m[i, j] = m[j, i] = r[f"t_m_{i}_{j}"] - r[f"m_{i}_{j}"]
            out.append([*(r[c] for c in [*group, fold]), symmetric_solve(m[:p, :p], m[:p, p]).tolist(), m[0, p] / m[0, 0]])
        return pd.DataFrame(out, columns=[*group, fold, "beta", "train_mean"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*group, fold])
    fits = train.mapInPandas(lambda it: (solve(pdf) for pdf in it), f"{kinds}, beta array<double>, train_mean double")
    pred = sum((F.element_at("beta", i + 1) * F.col(c) for i, c in enumerate(x)), F.lit(0.0))
    scored = df.join(fits, [*group, fold]).withColumn("e2", F.pow(F.col(y) - pred, 2)).withColumn("b2", F.pow(F.col(y) - F.col("train_mean"), 2))
    return scored.groupBy(*group).agg((1 - ratio(F.sum("e2"), F.sum("b2"))).alias("skill"), F.sqrt(F.avg("e2")).alias("rmse"), F.count(F.lit(1)).alias("n"), F.count_distinct(fold).alias("n_folds"))


def route_null(values: DataFrame, maps: DataFrame, site: str, statistic) -> DataFrame:
    """A statistic under every shift and reflection of a route; ``statistic`` maps (rows, keys) to a table with ``v``."""
    moved = maps.join(values.withColumnRenamed(site, "mapped_site"), "mapped_site").drop("mapped_site")
    return statistic(moved, ["shift", "reflected"])


def order_alias(visits: DataFrame, campaign: str, elapsed: str, position: str, limit: float = 0.9) -> DataFrame:
    """How far collection order and position say the same in each campaign."""
    from quadrat.operators.stats import safe_corr
    from quadrat.operators.windows import avg_rank

    r = visits.withColumns({"_e": avg_rank([campaign], elapsed), "_p": avg_rank([campaign], position)})
    g = r.groupBy(campaign).agg(safe_corr(elapsed, position).alias("pearson"), safe_corr("_e", "_p").alias("spearman"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("status", F.when(F.abs("spearman") >= limit, "aliased").when(F.col("spearman").isNull(), "undefined").otherwise("separable"))


def glasso(s: np.ndarray, alpha: float, rounds: int = 100, tol: float = 1e-3, start: np.ndarray | None = None, with_start: bool = False):
    """Sparse inverse covariance by block coordinate descent; ``start``: coefficients of a fit at a near penalty."""
    p = len(s)
    w = s + alpha * np.eye(p)
    betas = np.zeros((p, p)) if start is None else start.copy()
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            w11, s12, b = w[np.ix_(rest, rest)], s[rest, j], betas[rest, j]
            for _ in range(100):
                old = b.copy()
                for k in range(p - 1):
                    r = s12[k] - w11[k] @ b + w11[k, k] * b[k]
                    b[k] = np.sign(r) * max(abs(r) - alpha, 0) / w11[k, k]
                if np.abs(b - old).max() < tol * 1e-2:
                    break
            betas[rest, j] = b
            w[rest, j] = w[j, rest] = w11 @ b
        if np.abs(w - before).mean() < tol * np.abs(s - np.diag(np.diag(s))).mean() + 1e-12:
            break
    theta = np.zeros((p, p))
    for j in range(p):
        rest = np.arange(p) != j
        theta[j, j] = 1 / (w[j, j] - w[rest, j] @ betas[rest, j])
        theta[rest, j] = -betas[rest, j] * theta[j, j]
    theta = (theta + theta.T) / 2
    return (theta, betas) if with_start else theta


def compare_networks(edges: DataFrame, group: str, first, second, possible: int) -> DataFrame:
    """Density difference and Jaccard of two groups' edge sets."""
    a = edges.where(F.col(group) == first).select("a", "b", F.lit(1).alias("x"))
    b = edges.where(F.col(group) == second).select("a", "b", F.lit(1).alias("y"))
    j = a.join(b, ["a", "b"], "full_outer")
    g = j.agg(F.count("x").alias("n_first"), F.count("y").alias("n_second"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("either"))
    return g.withColumns({"density_difference": ratio(F.col("n_first") - F.col("n_second"), F.lit(float(possible))), "jaccard": F.when(F.col("either") > 0, F.col("shared") / F.col("either"))})


def design_rank(df: DataFrame, x: list[str], tol: float = 1e-9) -> DataFrame:
    """Rank deficiency of a design and its near-constant columns."""
    m = unpack_gram(gram(df, x).first(), len(x))
    scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
    rank = int(np.linalg.matrix_rank(m / scale[:, None] / scale[None, :], tol=1e-8))
    var = df.agg(*(F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x))).first()
    return df.sparkSession.createDataFrame([(c, float(v), bool(v < tol), rank, len(x)) for c, v in zip(x, var)], "term string, variance double, near_constant boolean, rank int, columns int")


def with_p(df: DataFrame, t: str, dof: str) -> DataFrame:
    return df.withColumn("p", pdist("t", t, dof))
