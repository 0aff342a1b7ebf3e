"""Tests over pairs of units of which only those that share a part become rows."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quadrat.operators import distance as D
from quadrat.operators import resample as RS
from quadrat.operators import stats as S
from quadrat.operators import windows as W

draw = random.Random(4)
UNITS = {u: {k: draw.randint(1, 9) for k in draw.sample(range(40), draw.randint(1, 6))} for u in range(17)}


def _d(a, b):
    low = sum(min(n, UNITS[b].get(t, 0)) for t, n in UNITS[a].items())
    return 1 - 2 * low / (sum(UNITS[a].values()) + sum(UNITS[b].values()))


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(u, t, n) for u, parts in UNITS.items() for t, n in parts.items()], "u int, t int, n long")


@pytest.fixture(scope="module")
def ranks(spark):
    return spark.createDataFrame([(u, 2 * u) for u in UNITS], "u int, rank int")


def test_only_pairs_that_share_are_rows(counts):
    got = {(r.a, r.b): r.d for r in D.sharing(counts, "u", "t", "n").collect()}
    want = {(a, b): _d(a, b) for a, b in itertools.combinations(UNITS, 2) if set(UNITS[a]) & set(UNITS[b])}
    assert got == pytest.approx(want) and len(want) < 17 * 8


def test_neighbour_excess_counts_the_rest(counts, ranks):
    got = {r.unit: r.excess for r in S.neighbour_excess(D.sharing(counts, "u", "t", "n"), ranks, "u", 4, "d").collect()}
    for u in UNITS:
        near = [_d(*sorted((u, v))) for v in UNITS if 0 < abs(u - v) <= 2]
        far = [_d(*sorted((u, v))) for v in UNITS if abs(u - v) > 2]
        assert got[u] == pytest.approx(statistics.mean(near) - statistics.mean(far))


def test_adjacency_counts_the_rest(spark, counts, ranks):
    block = {u: u % 3 for u in UNITS if u != 5}  # unit 5 is of no pair, and holds a rank
    units = spark.createDataFrame(list(block.items()), "u int, block int")
    same = {"same": lambda x, y: x["block"] == y["block"]}
    got = S.adjacency_test(D.sharing(counts, "u", "t", "n"), units, ranks, "u", 4, same, "d", 9).first()
    moves = {0: {u: 2 * u for u in UNITS}}
    for r in RS.permutations(ranks, 9, "u").collect():
        moves.setdefault(r.draw, {})[r.u] = 2 * r.perm_unit
    delta = {}
    for k, rank in moves.items():
        top = n = strata = 0
        for s in (True, False):
            pairs = [(_d(a, b), abs(rank[a] - rank[b]) <= 4) for a, b in itertools.combinations(sorted(block), 2) if (block[a] == block[b]) is s]
            near, far = [d for d, adj in pairs if adj], [d for d, adj in pairs if not adj]
            if near and far:
                top, n, strata = top + len(near) * (statistics.mean(near) - statistics.mean(far)), n + len(near), strata + 1
        delta[k] = (top / n, n, strata)
    p = (1 + sum(v[0] >= delta[0][0] - 1e-9 for k, v in delta.items() if k)) / 10
    assert tuple(got) == pytest.approx((*delta[0], p, 9))


def test_median_dissimilarity_counts_the_rest(spark, counts):
    site = {u: u % 4 for u in UNITS if u != 3}
    got = {r.site: (r.median_d, r.n_pairs) for r in D.median_dissimilarity(counts, spark.createDataFrame(list(site.items()), "u int, site int"), "u", "t", "n").collect()}
    for s in range(4):
        d = [_d(a, b) for a, b in itertools.combinations(sorted(site), 2) if site[a] == site[b] == s]
        assert got[s] == pytest.approx((statistics.median(d), len(d)))


def test_median_of_weighted_values(spark):
    rows = [(g, draw.choice([0.0, 0.25, 0.2500001, 0.9, 1.0]), draw.randint(1, 3)) for g in range(6) for _ in range(draw.randint(1, 7))]
    got = {r.g: (r.median, r.n) for r in W.median(spark.createDataFrame(rows, "g int, v double, w long"), ["g"], "v", "w").collect()}
    for g in range(6):
        every = [v for k, v, w in rows if k == g for _ in range(w)]
        assert got[g] == (pytest.approx(statistics.median(every), abs=1e-12), len(every))


def test_pairs_are_not_exploded(counts, ranks):
    plan = S.neighbour_excess(D.sharing(counts, "u", "t", "n"), ranks, "u", 4, "d")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
    kinds = S.pair_kinds(ranks.withColumn("k", F.col("u") % 2), ["k"]).agg(F.sum("n")).first()[0]
    assert kinds == 17 * 16


def test_tiled_medians_hand_on_no_pairs(spark, monkeypatch):
    from quadrat.operators import tiles

    monkeypatch.setattr(tiles, "SMALLEST", 3)
    monkeypatch.setattr(tiles, "BLOCKS", 4)
    rows = [(g, u, t, float(draw.randint(0, 4) if u != 2 else 0)) for g in range(3) for u in range(11) for t in draw.sample(range(5), draw.randint(1, 5))]
    rows += [(7, 0, t, 2.0) for t in range(5)] + [(7, 1, t, 1.0) for t in range(5)] + [(8, 0, 1, 2.0)]
    rows = [r for r in rows if r[:2] != (1, 4)] + [(1, 4, 99, 3.0)]  # shares nothing
    df = spark.createDataFrame(rows, "grp int, u int, t int, v double")
    got = {r.grp: (r.median, r.n) for r in D.tiled_medians(df, ["grp"], "u", "t", "v").collect()}
    want = {}
    for g in (0, 1, 2, 7):
        units = {}
        for k, u, t, v in rows:
            if k == g:
                units.setdefault(u, {})[t] = v
        d = []
        for a, b in itertools.combinations(sorted(units), 2):
            total = sum(units[a].values()) + sum(units[b].values())
            if set(units[a]) & set(units[b]) and total:
                d.append(1 - 2 * sum(min(v, units[b].get(t, 0)) for t, v in units[a].items()) / total)
        want[g] = (pytest.approx(statistics.median(d), abs=1e-12), len(d))
    assert got == want


@pytest.mark.parametrize("cells,at_once,table,named", [(1 << 20, 1 << 18, 1 << 24, False), (9, 4, 0, True), (9, 3, 1 << 24, False)])
def test_sums_by_blocks_equal_sums_of_pairs(spark, counts, ranks, monkeypatch, cells, at_once, table, named):
    from quadrat.operators import blocks

    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    monkeypatch.setattr(blocks, "TABLE", table)
    df = counts.withColumn("t", F.concat(F.lit("p"), "t")) if named else counts
    pairs = D.sharing(counts, "u", "t", "n")
    want = {r.unit: r.excess for r in S.neighbour_excess(pairs, ranks, "u", 4, "d").collect()}
    got = {r.unit: r.excess for r in S.excess_by_parts(df, "t", "n", ranks, "u", 4).collect()}
    assert got == pytest.approx(want) and len(got) == 17
    units = spark.createDataFrame([(u, u % 3 if u != 7 else None) for u in UNITS if u != 5], "u int, block int")
    same = {"same": lambda x, y: x["block"] == y["block"]}
    want = S.adjacency_test(pairs, units, ranks, "u", 4, same, "d", 9).first()
    assert tuple(S.adjacency_by_parts(df, "t", "n", units, ranks, "u", 4, same, 9).first()) == pytest.approx(tuple(want))


@pytest.mark.parametrize("name", ["stat20_neighbour_excess", "stat19_adjacency", "pl18_library_adjacency"])
def test_no_pair_is_a_row(spark, monkeypatch, name):
    from quadrat import plans

    def sharing(*args):
        raise AssertionError("pairs became rows")

    monkeypatch.setattr(D, "sharing", sharing)
    assert plans.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
