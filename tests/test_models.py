"""Models against direct matrix computations."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import models as M


def data(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x, g = rng.normal(size=n), np.arange(n) % 6
    y = 2 + 0.5 * x + rng.normal(size=n) + g * 0.3
    df = spark.createDataFrame([(float(a), float(b), int(c), 1.0, int(i)) for i, (a, b, c) in enumerate(zip(x, y, g))], "x double, y double, g int, one double, i int")
    return x, y, g, df


def test_cluster_robust_ols(spark):
    x, y, g, df = data(spark)
    X = np.column_stack([np.ones_like(x), x])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    U = np.array([(X[g == k] * e[g == k, None]).sum(0) for k in range(6)])
    inv = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(inv @ (U.T @ U) @ inv * 6 / 5 * 59 / 58))
    got = M.ols(df, "y", ["one", "x"], "g").collect()
    assert [r.beta for r in got] == pytest.approx(b) and [r.se for r in got] == pytest.approx(se)


def test_gee_reduces_to_ols_for_single_rows(spark):
    x, y, _, df = data(spark)
    b = np.linalg.lstsq(np.column_stack([np.ones_like(x), x]), y, rcond=None)[0]
    assert [r.beta for r in M.gee(df, "y", ["one", "x"], "i").collect()] == pytest.approx(b, abs=1e-6)


def test_gee_matches_the_explicit_inverse(spark):
    x, y, g, df = data(spark)
    got = M.gee(df, "y", ["one", "x"], "g").collect()
    rho, X = got[0].rho, np.column_stack([np.ones_like(x), x])
    A, c = np.zeros((2, 2)), np.zeros(2)
    for k in range(6):
        m = g == k
        V = np.linalg.inv((1 - rho) * np.eye(m.sum()) + rho)
        A += X[m].T @ V @ X[m]
        c += X[m].T @ V @ y[m]
    assert [r.beta for r in got] == pytest.approx(np.linalg.solve(A, c), abs=1e-7)


def test_scan_is_a_partial_regression(spark):
    x, y, g, df = data(spark)
    e = df.select("i", F.lit("k").alias("key"), (F.col("x") * 2 + F.col("g")).alias("v"))
    v = 2 * x + g
    X = np.column_stack([np.ones_like(x), x, v])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    assert M.scan(df, e, "i", "y", "key", "v", ["one", "x"]).first()["beta"] == pytest.approx(b[2])


def test_scan_by_shared_exposures_equals_scan_by_rows(spark):
    _, _, _, df = data(spark)
    df = df.withColumn("cell", F.floor("x"))
    e = df.select("cell", F.col("cell").cast("double").alias("v")).distinct().withColumn("key", F.lit("k"))
    by_cell = M.scan(df, e, "cell", "y", "key", "v", ["one", "x"]).first()
    by_row = M.scan(df, df.select("i", F.lit("k").alias("key"), F.col("cell").cast("double").alias("v")), "i", "y", "key", "v", ["one", "x"]).first()
    assert [by_cell[c] for c in ("beta", "se", "t", "partial_r2")] == pytest.approx([by_row[c] for c in ("beta", "se", "t", "partial_r2")])


def test_scans_of_daily_exposures_join_days_not_observations(spark):
    """Observations of one site and day meet an exposure as one row, so lags are never repeated for every observation."""
    from quadrat.plans import models_plan, roles

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    obs, days = models_plan._by_day(models_plan._obs(roles.Roles(spark, "/root/testdata/sf0.001")))
    assert days.count() == obs.select("site", "date").distinct().count() < obs.count()


def test_pcoa_recovers_a_line(spark):
    pts = [0.0, 1.0, 3.0, 7.0]
    pairs = spark.createDataFrame([(i, j, abs(pts[i] - pts[j])) for i in range(4) for j in range(i + 1, 4)], "a int, b int, d double")
    got = {int(r.unit): r.coordinate for r in M.pcoa(pairs, 0.99).collect()}
    assert abs(abs(got[3] - got[0]) - 7) < 1e-9 and abs(abs(got[1] - got[0]) - 1) < 1e-9


def test_glasso_limits():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(400, 4))
    z[:, 1] += z[:, 0]
    s = np.corrcoef(z.T)
    strong = M.glasso(s, 0.9)
    assert np.abs(strong - np.diag(np.diag(strong))).max() < 1e-8
    assert np.allclose(M.glasso(s, 1e-4, tol=1e-6), np.linalg.inv(s + 1e-4 * np.eye(4)), atol=0.05)


def test_design_rank_sees_an_alias(spark):
    _, _, _, df = data(spark)
    r = M.design_rank(df.withColumn("twice", F.col("x") * 2), ["one", "x", "twice"]).first()
    assert (r["rank"], r["columns"]) == (2, 3)


def test_permutation_of_a_clear_trend(spark):
    d = spark.createDataFrame([(i, p, float(i * k)) for i in range(12) for p, k in (("a", 1), ("b", -2))], "u int, p string, v double")
    r = M.multivariate_trend(d, "u", "p", "v", F.col("u").cast("double"), 1, 30).first()
    assert r.p == pytest.approx(1 / 31) and r.r2 == pytest.approx(1)


def test_no_variation_and_perfect_fits_are_no_errors(spark):
    flat = spark.createDataFrame([(i, p, 1.0) for i in range(8) for p in "ab"], "u int, p string, v double")
    r = M.multivariate_trend(flat, "u", "p", "v", F.col("u").cast("double"), 1, 9).first()
    assert r is None or (r.r2 is None and r.f is None)
    d = spark.createDataFrame([(i, i % 2, "a", 1.0, float(i), float(i)) for i in range(8)], "u int, site int, p string, one double, x double, v double")
    assert M.nested_test(d, "u", "p", "v", ["one"], "x", "site", 9).count() == 1
    assert M.nested_test(flat.selectExpr("u", "0 AS site", "p", "1D AS one", "1D AS x", "v"), "u", "p", "v", ["one"], "x", "site", 9).first()["partial_r2"] is None
    e = d.select("u", F.lit("k").alias("key"), F.col("x").alias("e"))
    exact = M.scan(d, e, "u", "v", "key", "e", ["one"]).first()
    assert exact.beta == pytest.approx(1) and exact.partial_r2 == pytest.approx(1)
    assert M.scan(d.withColumn("v", F.lit(3.0)), e, "u", "v", "key", "e", ["one"]).count() == 1
    assert M.block_cv(d.withColumn("v", F.lit(3.0)), "site", ["one"], "v").first()["skill"] is None
    tiny = M.joint_lags(d, d.select("u", F.lit(1).alias("lag"), F.col("x").alias("e")), "u", "v", "lag", "e", ["one"]).first()
    assert tiny["rank"] == 2 and tiny.df1 == 1


def test_more_lags_than_four_hundred_all_take_part(spark):
    rng = np.random.default_rng(4)
    n, h = 500, 450
    x, y = rng.normal(size=(n, h)), rng.normal(size=n)
    y += x[:, 449]
    obs = spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate(y)], "i int, y double, one double")
    lags = spark.createDataFrame(__import__("pandas").DataFrame({"i": np.repeat(np.arange(n), h).astype("int32"), "lag": np.tile(np.arange(h), n).astype("int32"), "v": x.ravel()}))
    got = M.joint_lags(obs, lags, "i", "y", "lag", "v", ["one"]).first()
    X = np.column_stack([np.ones(n), x])
    full, small = y - X @ np.linalg.lstsq(X, y, rcond=None)[0], y - y.mean()
    assert (got["columns"], got["rank"], got.df1) == (451, 451, 450)
    assert got.f == pytest.approx(((small @ small) - (full @ full)) / 450 / ((full @ full) / (n - 451)), rel=1e-6)


def test_gee_tests_and_convergence(spark):
    x, y, g, df = data(spark)
    df = df.withColumn("xg", F.col("x") * (F.col("g") % 2))
    beta, cov, rho, n = M.gee_fit(df, "y", ["one", "x", "xg"], "g")
    X, U, A = np.column_stack([np.ones_like(x), x, x * (g % 2)]), [], np.zeros((3, 3))
    for k in range(6):
        m = g == k
        V = np.linalg.inv((1 - rho) * np.eye(m.sum()) + rho)
        A += X[m].T @ V @ X[m]
        U.append(X[m].T @ V @ (y[m] - X[m] @ beta))
    U = np.array(U)
    want = np.linalg.inv(A) @ (U.T @ U) @ np.linalg.inv(A)
    assert n == 6 and np.allclose(cov, want, atol=1e-8)
    got = {r.test: r for r in M.gee_tests(df, "y", ["one", "x", "xg"], "g", {"odd": {"x": 1.0, "xg": 1.0}}, {"interaction": ["xg"]}).collect()}
    assert got["odd"].estimate == pytest.approx(beta[1] + beta[2]) and got["odd"].se == pytest.approx(np.sqrt(want[1, 1] + want[2, 2] + 2 * want[1, 2]))
    assert got["interaction"].statistic == pytest.approx(beta[2] ** 2 / want[2, 2]) and got["interaction"].dof == 1
    with pytest.raises(RuntimeError):
        M.gee(df, "y", ["one", "x"], "g", rounds=1)


def test_multivariate_moran_equals_matrix_algebra(spark):
    from quadrat.operators import stats as S

    rng = np.random.default_rng(5)
    e = rng.normal(size=(12, 4))
    edges = [(i, j) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.3]
    w = np.zeros((12, 12))
    for i, j in edges:
        w[i, j] = w[j, i] = 1
    c = e - e.mean(0)
    want = 12 / w.sum() * np.trace(c.T @ w @ c) / np.trace(c.T @ c)
    df = spark.createDataFrame([(i, f"p{j}", float(e[i, j])) for i in range(12) for j in range(4)], "u int, t string, v double")
    got = S.moran_multivariate(df.withColumnsRenamed({"u": "unit", "t": "part"}), spark.createDataFrame(edges, "a int, b int"), "unit", "part", "v", 19).first()
    assert got.i == pytest.approx(want) and got.n_draws == 19
    one = S.moran(df.where("t = 'p0'"), spark.createDataFrame(edges, "a int, b int"), "u", "v", 19).first()
    alone = S.moran_multivariate(df.where("t = 'p0'").withColumnsRenamed({"u": "unit", "t": "part"}), spark.createDataFrame(edges, "a int, b int"), "unit", "part", "v", 19).first()
    assert (alone.i, alone.p) == pytest.approx((one.i, one.p))


def test_shifts_that_make_the_design_singular_are_left_out(spark):
    import datetime

    from quadrat.operators import resample as RS

    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    # a series that is constant from day 40 on: its week sums then equal the intercept
    series = spark.createDataFrame([(0, day(k), float(k % 5 if k < 40 else 2)) for k in range(80)], "site bigint, date date, value double")
    obs = spark.createDataFrame([(i, 0, 0, day(8 + i), 1.0, float(i)) for i in range(10)], "obs_id bigint, campaign bigint, site bigint, date date, one double, day double")
    options = spark.createDataFrame([(0, s) for s in (0, 5, 20, 45, 55, 70)], "campaign bigint, shift int")
    got = RS.estimable_shifts(obs, series, options, [(1, 3)], ["one", "day"], "campaign").collect()
    assert sorted(r["shift"] for r in got) == [0, 5, 20]
    all_draws = RS.time_shifts(obs, series, 99, "campaign", "site", "date", 3, 4).collect()
    some = RS.time_shifts(obs, series, 99, "campaign", "site", "date", 3, 4, admit=lambda o: RS.estimable_shifts(obs, series, o, [(1, 3)], ["one", "day"], "campaign")).collect()
    assert 0 < len(some) < len(all_draws) and max(r["shift"] for r in some) < 35 and sorted(r.draw for r in some) == list(range(1, len(some) + 1))


@pytest.mark.parametrize("n,dims", [(200, 30), (6, 3)])
def test_leading_coordinates_equal_the_dense_solution(spark, n, dims):
    from quadrat.operators import ordination as O

    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims)) * (0.8 ** np.arange(dims))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if n == 200:
        d = d**0.9  # not Euclidean any more
    rows = [(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    got = O.pcoa_axes(spark.createDataFrame(rows, "a int, b int, d double").repartition(6), 3).collect()
    j = np.eye(n) - 1 / n
    b = -0.5 * j @ (d * d) @ j
    values, vectors = np.linalg.eigh(b)
    for a in (1, 2, 3):
        own = {int(r.unit): r.coordinate for r in got if r.axis == a}
        want = vectors[:, -a] * np.sqrt(values[-a])
        c = np.array([own[i] for i in range(n)])
        assert next(r for r in got if r.axis == a).eigenvalue == pytest.approx(values[-a], rel=1e-9)
        assert next(r for r in got if r.axis == a).share == pytest.approx(values[-a] / np.trace(b), rel=1e-9)
        assert np.allclose(c * np.sign(c @ want), want, atol=1e-5) and c[np.argmax(np.abs(c))] > 0
    assert O.pcoa_axes(spark.createDataFrame([], "a int, b int, d double"), 3).count() == 0


def test_axes_settle_where_values_lie_close(spark):
    from quadrat.operators import ordination as O

    n = 400
    d = np.triu(np.random.default_rng(4).uniform(0.9, 1, (n, n)), 1)
    d += d.T
    rows = [(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    got = {r.axis: r.eigenvalue for r in O.pcoa_axes(spark.createDataFrame(rows, "a int, b int, d double"), 4).collect()}
    centred = -0.5 * d * d
    centred = centred - centred.mean(0)
    centred = centred - centred.mean(1)[:, None]
    want = np.linalg.eigvalsh(centred)[::-1]
    assert [got[i + 1] for i in range(4)] == pytest.approx(list(want[:4]), rel=1e-9)


def test_shifts_meet_days_not_observations(spark):
    """Many observations of a day are one row when shifts are tried, and count as many."""
    import datetime

    from quadrat.operators import resample as RS

    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(40)]
    rng = np.random.default_rng(3)
    series = spark.createDataFrame([(s, d, float(rng.integers(0, 9))) for s in (0, 1) for d in days], "site int, date date, value double")
    rows = [(k, 0, k % 2, days[10 + k % 3], 1.0, float(k % 3)) for k in range(600)] + [(600 + k, 1, 0, days[12], 1.0, 2.0) for k in range(50)]
    obs = spark.createDataFrame(rows, "obs_id int, campaign int, site int, date date, one double, day double")
    options = spark.createDataFrame([(c, s) for c in (0, 1) for s in range(-6, 30)], "campaign int, shift int")
    plan = RS.estimable_shifts(obs, series, options, [(1, 3), (4, 6)], ["one", "day"], "campaign")
    made = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "obs_id" not in made.split("LogicalRDD")[0]
    value = {(r.site, r.date): r.value for r in series.collect()}
    want = []
    for c in (0, 1):
        for shift in range(-6, 30):
            x = []
            for _, k, s, d, one, day in rows:
                at = [[d + datetime.timedelta(days=shift - lag) for lag in lags] for lags in ((1, 2, 3), (4, 5, 6))]
                if k == c and all((s, q) in value for lags in at for q in lags):
                    x.append([one, day, *(sum(value[s, q] for q in lags) for lags in at)])
            if x and np.linalg.matrix_rank(np.array(x) / np.maximum(np.sqrt((np.array(x) ** 2).sum(0)), 1e-150), tol=1e-5) == 4:
                want.append((c, shift))
    assert sorted((r.campaign, r["shift"]) for r in plan.collect()) == want and 5 < len(want)


def test_axes_take_one_job_a_pass(spark):
    from quadrat.operators import ordination as O

    n = 240
    d = np.triu(np.random.default_rng(5).uniform(0.9, 1, (n, n)), 1)
    df = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "a int, b int, d double")
    spark.sparkContext.setJobGroup("axes", "axes")
    O.pcoa_axes(df, 4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("axes"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs < 40


def test_blocks_keep_no_mean(monkeypatch):
    """The uncentred table's own largest value, along the mean, is some hundred times the others."""
    from quadrat.operators import ordination as O

    n = 900
    d = np.triu(np.random.default_rng(6).uniform(0.95, 1, (n, n)), 1)
    table = -0.5 * (d + d.T) ** 2
    centred = table - table.mean(0)
    centred = centred - centred.mean(1)[:, None]
    monkeypatch.setattr(O, "_product", lambda strips, n, x: (y := table @ x) - y.mean(0))
    values, vectors = O._leading(None, n, 4, float(np.trace(centred)), 1)
    assert values == pytest.approx(np.linalg.eigvalsh(centred)[::-1][:4], rel=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-9)


def test_trend_jackknife_equals_refits_without_each_unit(spark):
    rng = np.random.default_rng(8)
    n, p = 14, 3
    x = np.sort(rng.uniform(0, 500, n))
    y = np.outer((x - 200) / 100, [1.0, -0.5, 0.2]) + rng.normal(size=(n, p)) * 0.4 + 50

    def r2(keep):
        z = np.stack([np.ones(len(keep)), x[keep], x[keep] ** 2], 1)
        e = y[keep] - z @ np.linalg.lstsq(z, y[keep], rcond=None)[0]
        return 1 - (e**2).sum() / ((y[keep] - y[keep].mean(0)) ** 2).sum()

    every = np.arange(n)
    left = np.array([r2(np.delete(every, i)) for i in range(n)])
    df = spark.createDataFrame([(int(i), f"p{j}", float(y[i, j]), float(x[i])) for i in range(n) for j in range(p)], "unit int, part string, v double, x double")
    got = M.trend_jackknife(df, "unit", "part", "v", "x").first()
    se = np.sqrt((n - 1) * left.var())
    assert (got.r2, got.jackknife_mean, got.se, got.n_units) == pytest.approx((r2(every), left.mean(), se, n))
    assert got.high - got.r2 == pytest.approx(2.160369 * se, rel=1e-5)
