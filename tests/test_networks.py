"""Networks from cross products: against whole tables, calibration on independent and chained data, intervals."""

import numpy as np
import pytest

from quadrat.operators import models as M
from quadrat.operators import networks as N


def table(spark, x, group="g", parts=None, clusters=None):
    rows = [(group, f"u{i}", (clusters[i] if clusters is not None else i), f"p{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if not np.isnan(v)]
    return spark.createDataFrame(rows, "g string, unit string, site int, part string, v double").repartition(5)


def chained(n, p, seed, a=0.7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    for j in range(1, p):
        x[:, j] = a * x[:, j - 1] + np.sqrt(1 - a * a) * x[:, j]
    return x


def test_correlations_and_edges_equal_whole_tables(spark):
    x = chained(60, 5, 1)
    x[3, 2] = x[7, 2] = np.nan
    x[:, 4] = 2.0  # constant
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    want = np.corrcoef(filled[:, :4].T)
    got = {(r.a, r.b): r.partial_r for r in N.network(table(spark, x), ["g"], "unit", "part", "v", [0.1]).collect()}
    theta = M.glasso(want, 0.1)
    for i in range(4):
        for j in range(i + 1, 4):
            r = -theta[i, j] / np.sqrt(theta[i, i] * theta[j, j])
            assert got.get((f"p{i}", f"p{j}"), 0) == pytest.approx(r if abs(r) > 1e-8 else 0, abs=2e-3)
    assert not any("p4" in k for k in got)


def test_warm_path_equals_cold_fits():
    s = np.corrcoef(chained(80, 6, 2).T)
    for alpha, partial in N.path(s, [0.5, 0.3, 0.1, 0.05]).items():
        t = M.glasso(s, alpha, tol=1e-6)
        assert np.allclose(partial, np.where(np.eye(6), 0, -t / np.sqrt(np.outer(np.diag(t), np.diag(t)))), atol=5e-3)


def test_weighted_draws_equal_repeated_rows(spark):
    x = chained(30, 4, 3)
    df = table(spark, x, clusters=[i // 3 for i in range(30)])
    parts = N.part_names(df, "part")
    got = {r.draw: {(e.a, e.b): e.partial_r for e in r.edges} for r in N.drawn(df, ["g"], "unit", "part", "v", "site", parts, [0.1], 53, seed=4).collect()}
    assert sorted(got) == list(range(1, 54))
    boot = {}
    from quadrat.operators import resample as RS

    for r in RS.bootstrap(df.select("site").distinct(), 53, "site", seed=4).collect():
        boot.setdefault(r.draw, {})[r.site] = r.weight
    for d in (1, 50, 51, 53):
        rows = np.concatenate([np.repeat(x[i : i + 1], boot[d].get(i // 3, 0), axis=0) for i in range(30)])
        partial = N.path(np.corrcoef(rows.T), [0.1])[0.1]
        for i in range(4):
            for j in range(i + 1, 4):
                assert got[d].get((f"p{i}", f"p{j}"), 0) == pytest.approx(partial[i, j] if abs(partial[i, j]) > 1e-8 else 0, abs=1e-6)


def test_permuted_tables_keep_values_and_lose_links(spark):
    x = chained(200, 3, 5, 0.95)
    moved = N.permuted(table(spark, x), ["g"], "unit", "part", "v", 2, seed=2).collect()
    assert len(moved) == 2 * 600
    for d in (1, 2):
        m = {(r.unit, r.part): r.v for r in moved if r.draw == d}
        y = np.array([[m[(f"u{i}", f"p{j}")] for j in range(3)] for i in range(200)])
        assert np.allclose(np.sort(y, axis=0), np.sort(x, axis=0))
        assert np.abs(np.corrcoef(y.T) - np.eye(3)).max() < 0.25


def test_penalty_is_calibrated_and_monotone(spark):
    both = table(spark, chained(80, 6, 6), "chain").unionByName(table(spark, np.random.default_rng(7).normal(size=(80, 6)), "free"))
    alphas = [0.02, 0.1, 0.2, 0.3, 0.4, 0.6]
    chosen = {}
    for allowed in (0.05, 0.3, 1.5):
        rows = N.calibrate(both, ["g"], "unit", "part", "v", alphas, 20, allowed, least=2).collect()
        for r in rows:
            if r.chosen:
                chosen[(r.g, allowed)] = r.alpha
        by = {r.alpha: r for r in rows if r.g == "chain"}
        assert by[0.3].n_edges >= 4 and by[0.3].null_edges < by[0.02].null_edges
    assert chosen[("chain", 0.05)] >= chosen[("chain", 0.3)] >= chosen[("chain", 1.5)] == 0.02
    assert ("free", 0.05) not in chosen  # nothing stands out of independent data


def test_interval_of_the_density_difference(spark):
    dense, free = chained(90, 6, 8), np.random.default_rng(9).normal(size=(90, 6))
    sites = [i // 3 for i in range(90)]
    df = table(spark, dense, "A", clusters=sites).unionByName(table(spark, free, "R", clusters=sites))
    r = N.compare(df, "g", "A", "R", "unit", "part", "v", "site", [0.2, 0.3, 0.4], 0.3, 60).first()
    assert r.low <= r.density_difference <= r.high and r.low > 0 and r.supported and r.same_direction == 1 and r.p_first_denser == 1
    same = table(spark, dense, "A", clusters=sites).unionByName(table(spark, dense, "R", clusters=sites))
    r = N.compare(same, "g", "A", "R", "unit", "part", "v", "site", [0.2, 0.3], 0.3, 20).first()
    assert (r.density_difference, r.low, r.high, r.jaccard, r.same_direction, r.supported) == (0, 0, 0, 1, 0, False)
