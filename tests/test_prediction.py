"""Blocked prediction and route orbits against loops over folds and pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import models as M
from quadrat.operators import prediction as P
from quadrat.operators import windows as W


def data(seed=1, n_sites=10, campaigns=(1, 2, 3), n_parts=12, effect=1.0):
    rng = np.random.default_rng(seed)
    design, counts = [], []
    for c in campaigns:
        for comp in "AB":
            for s in range(n_sites):
                if rng.random() < 0.1:
                    continue
                u = f"{c}{comp}{s}"
                design.append((u, s, c, f"{c}/{comp}", float(s * 3 + (s * s) % 4), s * 5 // n_sites))
                for p in range(n_parts):
                    lam = 40 * math.exp(effect * (s - n_sites / 2) / n_sites * ((p % 5) - 2)) * (1 + 0.3 * rng.random()) / (1 + p)
                    n = int(rng.poisson(lam))
                    if n:
                        counts.append((u, f"t{p:02}", n))
    return design, counts


def loop(design, counts, k, prevalence, pseudo, pairs, min_train=20, min_sites=5, global_taxa=False):
    """Folds by plain loops: {fold: (sse, sst)}."""
    n = {}
    for u, p, c in counts:
        n.setdefault(u, {})[p] = c
    units = {r[0]: r for r in design}
    parts = sorted({p for _, p, _ in counts})
    folds = sorted({(r[5], r[2]) if pairs else (r[5],) for r in design})
    out = {}

    def top(us):
        mean = {p: sum(n[u].get(p, 0) / sum(n[u].values()) for u in us) / len(us) for p in parts}
        able = [p for p in parts if sum(p in n[u] for u in us) / len(us) >= prevalence]
        return sorted(able, key=lambda p: (-round(mean[p], 12), p))[:k] if len(able) >= k else None

    for f in folds:
        hold = [u for u, r in units.items() if r[5] == f[0] and (not pairs or r[2] == f[1])]
        train = [u for u, r in units.items() if r[5] != f[0] and (not pairs or r[2] != f[1])]
        taxa = top(list(units) if global_taxa else train) if len(train) >= min_train else None
        if not taxa:
            continue
        clr = {}
        for u in hold + train:
            x = np.log([n[u].get(p, 0) + pseudo for p in taxa])
            clr[u] = x - x.mean()
        strata = sorted({units[u][3] for u in train})
        if pairs:
            pos = np.array([units[u][4] for u in train])
            at, sd = pos.mean(), pos.std(ddof=1)
            z = (pos - at) / sd
            X, Y = np.stack([z, z * z], 1), np.array([clr[u] for u in train])
            for s in strata:
                i = [j for j, u in enumerate(train) if units[u][3] == s]
                X[i] -= X[i].mean(0)
                Y[i] -= Y[i].mean(0)
            b = np.linalg.lstsq(X, Y, rcond=None)[0]
            sse = sst = 0.0
            for i, u in enumerate(hold):
                for v in hold[i + 1 :]:
                    if units[u][3] == units[v][3] and units[u][1] != units[v][1]:
                        zu, zv = (units[u][4] - at) / sd, (units[v][4] - at) / sd
                        d = clr[u] - clr[v]
                        sse += ((d - b[0] * (zu - zv) - b[1] * (zu**2 - zv**2)) ** 2).sum()
                        sst += (d**2).sum()
            if sst > 0:
                out[f] = (sse, sst)
            continue
        centre = {s: np.mean([clr[u] for u in train if units[u][3] == s], axis=0) for s in strata}
        site = {}
        for u in hold + train:
            site.setdefault(units[u][1], []).append(clr[u] - centre.get(units[u][3], 0))
        where = {units[u][1]: units[u][4] for u in units}
        ts, hs = sorted({units[u][1] for u in train}), sorted({units[u][1] for u in hold})
        if len(ts) < min_sites or len(hs) < 2:
            continue
        pos = np.array([where[s] for s in ts])
        at, sd = pos.mean(), pos.std(ddof=1)
        design_of = lambda ss: np.array([[1, z, z * z] for z in [(where[s] - at) / sd for s in ss]])
        Y = np.array([np.mean(site[s], axis=0) for s in ts])
        b = np.linalg.lstsq(design_of(ts), Y, rcond=None)[0]
        H = np.array([np.mean(site[s], axis=0) for s in hs])
        out[f] = (((H - design_of(hs) @ b) ** 2).sum(), ((H - Y.mean(0)) ** 2).sum())
    return out


def frames(spark, design, counts):
    d = spark.createDataFrame(design, "unit string, site int, campaign int, stratum string, position double, block int").repartition(3)
    return d, spark.createDataFrame(counts, "unit string, part string, n bigint").repartition(3)


@pytest.mark.parametrize("pairs", [False, True])
def test_folds_equal_loops_over_units_and_pairs(spark, pairs):
    design, counts = data()
    d, c = frames(spark, design, counts)
    got = {tuple(map(int, r.fold.split("/"))): (r.sse, r.sst) for r in P.nested_cv(c, d, 6, pairs=pairs).collect()}
    want = loop(design, counts, 6, 0.2, 0.5, pairs)
    assert got.keys() == want.keys() and len(want) >= 5
    for f in want:
        assert got[f] == pytest.approx(want[f], rel=1e-8)
    s = P.skill(P.nested_cv(c, d, 6, pairs=pairs)).first()
    assert s.pooled == pytest.approx(1 - sum(x for x, _ in want.values()) / sum(y for _, y in want.values())) and s.n_folds == len(want)


def test_selection_inside_the_fold_does_not_leak(spark):
    """A part that fills one block alone is chosen from all units, but never from that block's training units."""
    design, counts = data(5, n_sites=20, campaigns=(1, 2), n_parts=6, effect=0.0)
    marked = []
    for u, s, *_ in design:
        if s >= 16:
            marked.append((u, "zz", 4000))
    d, c = frames(spark, design, counts + marked)
    members = P.fold_members(d)
    taxa = P.fold_taxa(c, members, 3, 0.0).groupBy("fold").agg(F.sort_array(F.collect_list("part")).alias("p")).collect()
    by = {r.fold: r.p for r in taxa}
    assert "zz" not in by["4"] and all("zz" in by[f] for f in "0123")
    inside = {f[0]: 1 - a / b for f, (a, b) in loop(design, counts + marked, 3, 0.0, 0.5, False).items()}
    leaking = {f[0]: 1 - a / b for f, (a, b) in loop(design, counts + marked, 3, 0.0, 0.5, False, global_taxa=True).items()}
    got = {int(r.fold): r.skill for r in P.nested_cv(c, d, 3, prevalence=0.0).collect()}
    assert got[4] == pytest.approx(inside[4], rel=1e-8) and leaking[4] > inside[4] + 0.01


def test_global_selection_gives_a_higher_skill_than_selection_in_the_fold():
    """Pure noise of many parts: parts chosen for their trend over all units look predictable, parts chosen in training don't."""
    rng = np.random.default_rng(2)
    z = np.linspace(-1, 1, 40)
    y, fold = rng.normal(size=(40, 3000)), np.arange(40) % 5

    def fitted(train, test, cols):
        x = np.stack([np.ones(40), z, z * z], 1)
        b = np.linalg.lstsq(x[train], y[train][:, cols], rcond=None)[0]
        return ((y[test][:, cols] - x[test] @ b) ** 2).sum(), ((y[test][:, cols] - y[train][:, cols].mean(0)) ** 2).sum()

    chosen = lambda rows: np.argsort(-np.abs(np.corrcoef(z[rows], y[rows].T)[0, 1:]))[:10]
    score = lambda pick: (lambda r: 1 - sum(a for a, _ in r) / sum(b for _, b in r))([fitted(fold != f, fold == f, pick(f)) for f in range(5)])
    everywhere = chosen(np.ones(40, bool))
    assert score(lambda f: everywhere) > 0.1 > score(lambda f: chosen(fold != f)) + 0.05


def test_orbit_of_skill_equals_a_loop_over_the_maps(spark):
    design, counts = data(3)
    d, c = frames(spark, design, counts)
    maps = W.route_maps(d.select("site", "position").distinct(), ["position", "site"])
    where = {r[1]: (r[4], r[5]) for r in design}
    members = {}
    for r in maps.collect():
        members.setdefault((r.shift, r.reflected), {})[r.site] = r.mapped_site
    assert len(members) == 20
    want = {}
    for m, to in members.items():
        moved = [(u, s, g, st, *where[to[s]]) for u, s, g, st, _, _ in design]
        f = loop(moved, counts, 6, 0.2, 0.5, False)
        want[m] = 1 - sum(a for a, _ in f.values()) / sum(b for _, b in f.values())
    folds = P.nested_cv(c, P.orbit_design(d, maps), 6, keys=["shift", "reflected"])
    got = {(r["shift"], r["reflected"]): r.pooled for r in P.skill(folds, ["shift", "reflected"]).collect()}
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m], rel=1e-7, abs=1e-9) for m in want)
    identity = (F.col("shift") == 0) & (F.col("reflected") == 0)
    r = {x.measure: x for x in P.skill_null(c, d, maps, identity, k=6).collect()}["pooled"]
    assert r.observed == pytest.approx(want[(0, 0)]) and r.n_draws == 19
    assert r.p == pytest.approx((1 + sum(want[m] >= want[(0, 0)] - 1e-9 for m in want if m != (0, 0))) / 20)


def test_orbit_of_a_route_with_sites_that_have_no_units(spark):
    design, counts = data(6)
    lost = {r[0] for r in design if r[1] in (3, 7)}
    d, c = frames(spark, [r for r in design if r[0] not in lost], [r for r in counts if r[0] not in lost])
    route = frames(spark, design, counts)[0].select("site", "position", "block").distinct()
    maps = W.route_maps(route, ["position", "site"])
    moved = P.orbit_design(d, maps, route)
    assert moved.groupBy("shift", "reflected").count().select("count").distinct().collect()[0][0] == d.count() and moved.count() == 20 * d.count()


def test_orbit_of_a_scan_equals_scans_of_moved_series(spark):
    rng = random.Random(4)
    obs = [(i, i % 10, i % 7, rng.random(), 1.0, float(i % 3)) for i in range(120)]
    y = spark.createDataFrame(obs, "obs_id int, site int, date int, value double, one double, day double")
    x = {(s, t, k): rng.random() for s in range(10) for t in range(7) for k in ("a", "b", "c")}
    exposures = spark.createDataFrame([(*k, v) for k, v in x.items()], "site int, date int, key string, x double")
    maps = W.route_maps(y.select("site").distinct(), ["site"])
    fit = lambda rows, keys: M.scan(y, rows.select("obs_id", *keys, "key", "x"), "obs_id", "value", [*keys, "key"], "x", ["one", "day"])
    got = {(r["shift"], r["reflected"]): (r.max_t, r.max_abs_t) for r in P.scan_orbit(y, exposures, maps, fit).collect()}
    assert len(got) == 20
    to = {}
    for r in maps.collect():
        to.setdefault((r.shift, r.reflected), {})[r.site] = r.mapped_site
    for m in [(0, 0), (3, 0), (7, 1)]:
        ts = []
        for k in "abc":
            X = np.array([[1.0, o[5], x[(to[m][o[1]], o[2], k)]] for o in obs])
            v = np.array([o[3] for o in obs])
            b, res = np.linalg.lstsq(X, v, rcond=None)[:2]
            ts.append(b[2] / math.sqrt(res[0] / (120 - 3) * np.linalg.inv(X.T @ X)[2, 2]))
        assert got[m] == pytest.approx((max(ts), max(map(abs, ts))), rel=1e-6)
