"""Operators against values known in closed form."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadrat.functions import compositional as C
from quadrat.functions.numeric import beta_inc, lgamma, pdist, t_quantile, tail
from quadrat.operators import agg as A
from quadrat.operators import distance as D
from quadrat.operators import joins as J
from quadrat.operators import keys as K
from quadrat.operators import resample as RS
from quadrat.operators import stats as S
from quadrat.operators import windows as W


def counts(spark, data):
    return spark.createDataFrame(data, "profile string, feature string, n bigint")


def test_uniform_profile_has_log_richness(spark):
    r = A.alpha_basic(counts(spark, [("a", f"f{i}", 5) for i in range(8)])).first()
    assert r["richness"] == 8 and r["shannon"] == pytest.approx(math.log(8))
    assert A.alpha_basic(counts(spark, [("a", "f", 0)])).count() == 0


def test_rarefied_richness(spark):
    c = counts(spark, [("a", "x", 2), ("a", "y", 1), ("a", "z", 1)])
    get = lambda d: A.rarefied_richness(c, d).first()["rarefied"]
    assert get(4) == pytest.approx(3, abs=1e-9) and get(1) == pytest.approx(1, abs=1e-9) and get(5) is None


def test_random_rarefaction_keeps_depth(spark):
    c = counts(spark, [("a", "x", 6), ("a", "y", 4), ("b", "x", 1)])
    r = A.rarefy(c, 5)
    assert r.agg(F.sum("n")).first()[0] == 5 and r.where("profile = 'b'").count() == 0
    assert rows(r) == rows(A.rarefy(c, 5))


def test_lgamma(spark):
    got = spark.createDataFrame([(float(x),) for x in (1, 2, 3.5, 10, 200, 3e5)], "x double").select("x", lgamma("x").alias("g")).collect()
    for x, g in got:
        assert g == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-10)


def test_p_values(spark):
    assert tail("normal", 1.959963984540054) == pytest.approx(0.05, abs=1e-9)
    assert tail("t", 2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert tail("chi2", 3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tail("F", 4.9646027437307, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert beta_inc(2, 3, 0.5) == pytest.approx(0.6875) and t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-6)
    got = spark.createDataFrame([(1.96,), (None,)], "z double").select(pdist("normal", "z").alias("p")).collect()
    assert got[0]["p"] == pytest.approx(0.05, abs=1e-3) and (got[1]["p"] is None or got[1]["p"] != got[1]["p"])


def test_bray_and_sorensen(spark):
    c = counts(spark, [("a", "x", 3), ("a", "y", 1), ("b", "x", 3), ("b", "y", 1), ("c", "z", 2), ("d", "x", 9)])
    bray = {(r.a, r.b): r.d for r in D.bray_curtis(c, "profile", "feature", "n").collect()}
    assert bray["a", "b"] == 0 and bray["a", "c"] == 1
    s = {(r.a, r.b): (r.sorensen, r.turnover, r.nestedness) for r in D.sorensen_partition(c, "profile", "feature", "n").collect()}
    assert s["a", "b"] == (0, 0, 0) and s["a", "c"] == (1, 1, 0)
    three = counts(spark, [("p", k, 1) for k in "abc"] + [("q", "a", 1)])
    r = D.sorensen_partition(three, "profile", "feature", "n").first()
    assert (r.sorensen, r.turnover, r.nestedness) == (0.5, 0, 0.5)


def test_bh_of_an_even_series(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04, None))], "i int, p double")
    got = {r.i: r.q for r in W.with_bh(df, "p", ties=["i"]).collect()}
    assert all(got[i] == pytest.approx(0.04) for i in range(4)) and got[4] is None


def test_mid_ranks(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int")
    assert sorted(r[0] for r in df.select(W.avg_rank([], "v")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_reading_rules(spark):
    df = spark.createDataFrame([("s", 0.0, 1), ("s", 4.0, 2), ("s", 2.0, 3)], "s string, v double, k int")
    r = A.all_reductions(df, ["s"], "v", F.col("k")).first()
    assert (r["max_positive"], r["mean_positive"], r["median_positive"], r["first"], r["last"]) == (4, 3, 3, 0, 2)


def test_clr(spark):
    df = spark.createDataFrame([("g", k, 1) for k in "abc"] + [("h", "a", 5)], "g string, t string, n bigint")
    got = C.clr(df, ["g"], "t")
    assert all(abs(r.clr) < 1e-12 for r in got.where("g = 'g'").collect())
    assert got.where("g = 'h'").agg(F.sum("clr")).first()[0] == pytest.approx(0, abs=1e-12) and got.count() == 6
    m = C.clr(df, ["g"], "t", zero="multiplicative").where("g = 'h'")
    assert m.agg(F.sum("clr")).first()[0] == pytest.approx(0, abs=1e-12)


def test_exposure_windows(spark):
    daily = spark.sql("select 1 as site, date_add(date'2024-01-01', cast(id - 1 as int)) as date, cast(id as double) as value from range(1, 11)")
    obs = spark.sql("select 7 as obs_id, 1 as site, date'2024-01-10' as date")
    got = {(r.from_lag, r.to_lag): r.exposure for r in J.exposure(obs, daily, [(0, 2), (1, 3), (5, 12)]).collect()}
    assert got == {(0, 2): 27.0, (1, 3): 24.0, (5, 12): None}
    gap = daily.where("date <> date'2024-01-08'")
    assert J.exposure(obs, gap, [(1, 3)]).first()["exposure"] is None
    assert [r.value for r in J.lag_matrix(obs, daily, 3).orderBy("lag").collect()] == [9.0, 8.0, 7.0]


def test_core_cohort_does_not_cut_labels(spark):
    df = spark.createDataFrame([(s, 1, "P") for s in ("19", "19.5", "12.5+A", "77", None)], "site string, campaign int, kind string")
    assert rows(K.core_cohort(df, "site", "campaign", "kind").select("site")) == [("19",)]


def test_sample_id_and_formula(spark):
    df = spark.createDataFrame([("e0001_T61PRr2RE",), ("12Dr1",), ("EB1",), (None,)], "id string")
    got = [tuple(r[0]) for r in df.select(K.parse_sample_id("id")).collect()]
    assert got[:2] == [(2, 61, "PR", 2, "RE"), (1, 12, "D", 1, "")] and got[2][2] == "Unknown"
    f = spark.createDataFrame([("CaSO4.2H2O",), ("C6H12O6",)], "f string").select(K.parse_formula("f")).collect()
    assert [tuple(x) for x in f[0][0]] == [("Ca", 1), ("H", 4), ("O", 6), ("S", 1)] and [tuple(x) for x in f[1][0]] == [("C", 1), ("H", 2), ("O", 1)]


def test_row_numbers_are_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = K.row_numbers(df, [F.col("k")], start=5).collect()
    assert sorted(r.number for r in got) == list(range(5, 1005)) and all(r.number == r.k + 5 for r in got)


def test_jackknife_of_a_mean_is_its_standard_error(spark):
    v = [1.0, 4.0, 2.0, 7.0, 5.5]
    df = spark.createDataFrame(list(enumerate(v)), "u int, v double")
    r = RS.jackknife(df, "u", "v").first()
    sd = math.sqrt(sum((x - sum(v) / 5) ** 2 for x in v) / 4)
    assert r.estimate == pytest.approx(sum(v) / 5) and r.se == pytest.approx(sd / math.sqrt(5))


def test_draws(spark):
    u = spark.range(6).select(F.col("id").alias("u"), (F.col("id") % 2).alias("s"))
    p = RS.permutations(u, 5, "u", ["s"])
    assert p.count() == 30 and p.where("u % 2 <> perm_unit % 2").count() == 0
    assert all(r[1] == 6 for r in RS.bootstrap(u, 4, "u").groupBy("draw").agg(F.sum("weight")).collect())
    assert {r.sign for r in RS.sign_flips(u, 10, "u").collect()} == {-1, 1}


def test_wilcoxon_and_cliff(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, 2.0, -3.0, 0.0, 4.0)], "d double")
    r = S.wilcoxon(d, "d").first()
    assert (r.n, r.w_plus, r.w_minus) == (4, 7.0, 3.0)
    exact = spark.createDataFrame([(4, 3.0)], "n int, w double").select(S.wilcoxon_exact_p(F.col("n"), F.col("w"))).first()[0]
    assert exact == pytest.approx(2 * 5 / 16)
    g = spark.createDataFrame([("a", 3.0), ("a", 4.0), ("b", 1.0), ("b", 2.0)], "g string, v double")
    assert S.cliffs_delta(g, "g", "a", "b", "v").first()["delta"] == 1.0


def test_fisher_matches_the_hypergeometric_sum(spark):
    a, b, c, d = 3, 1, 1, 5
    exact = sum(math.comb(4, k) * math.comb(6, 4 - k) for k in (3, 4)) / math.comb(10, 4)
    got = spark.createDataFrame([(a, b, c, d)], "a int, b int, c int, d int").select(S.fisher_greater("a", "b", "c", "d")).first()[0]
    assert got == pytest.approx(exact, rel=1e-9)


def test_join_cardinality_and_cascade(spark):
    l = spark.createDataFrame([(1, "x"), (2, "y")], "k int, m string")
    r = spark.createDataFrame([(1, "x"), (1, "z")], "k int, m string")
    with pytest.raises(J.CardinalityError):
        J.checked_join(l, r, ["k"], card="m:1", agree=["m"])
    with pytest.raises(J.CardinalityError):
        J.checked_join(l, r.where("m = 'z'"), ["k"], agree=["m"])
    ids = spark.createDataFrame([("a_x",), ("b",), ("q",), (None,)], "key string")
    ref = spark.createDataFrame([("a",), ("b",)], "ref string")
    got = {r.key: (r.resolved, r.rule) for r in J.resolve_cascade(ids, ref, "key", "ref", [("exact", F.col("key")), ("stem", F.regexp_replace("key", "_x$", ""))]).collect()}
    assert got == {"a_x": ("a", "stem"), "b": ("b", "exact"), "q": (None, None), None: (None, None)}


def test_longest_name_and_allocation(spark):
    raw = spark.createDataFrame([("r_ab_cd_1",), ("r_zz_1",)], "raw string")
    known = spark.createDataFrame([("ab",), ("ab_cd",)], "known string")
    assert rows(J.longest_match(raw, known)) == [("r_ab_cd_1", "ab_cd"), ("r_zz_1", None)]
    p = spark.createDataFrame([("s", "p1"), ("s", "p2"), ("s", "p3"), ("t", "q")], "sample string, profile string")
    r = spark.createDataFrame([("s", "r1"), ("s", "r2"), ("t", "u1"), ("t", "u2")], "sample string, run string")
    assert rows(J.allocate_runs(p, r)) == [("s", "p1", "r1"), ("s", "p2", "r2"), ("s", "p3", "r2"), ("t", "q", "u1"), ("t", "q", "u2")]


def test_multiset_difference_counts_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(W.multiset_diff(a, a.distinct())) == [(1, 2, 1)] and W.multiset_diff(a, a).isEmpty()


def test_degenerate_groups_are_no_errors(spark):
    apart = spark.createDataFrame([(i, "a" if i < 4 else "b", "p", 0.0 if i < 4 else 1.0) for i in range(8)], "u int, g string, p string, v double")
    r = S.permanova(apart, "u", "g", "p", "v", 19).first()
    assert r.f == float("inf") and r.r2 == pytest.approx(1)
    flat = apart.withColumn("v", F.lit(2.0))
    assert S.permanova(flat, "u", "g", "p", "v", 5).first()["f"] is None
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "a int, b int")
    assert S.moran(flat, edges, "u", "v", 5).first()["i"] is None
    pairs = spark.createDataFrame([(i, j, float(j - i), 1.0) for i in range(5) for j in range(i + 1, 5)], "a int, b int, d double, v double")
    assert {x.r for x in S.correlogram(pairs, "d", "v", 2).collect()} == {None}
    assert S.distance_decay(pairs.withColumn("d", F.lit(1.0)), "d", "v", 3).count() == 1
    assert S.cliffs_delta(apart, "g", "a", "zz", "v").first()["delta"] is None


def test_exact_signed_rank_of_many(spark):
    from itertools import product

    rows = [(n, w) for n in (1, 3, 7) for w in range(n * (n + 1) // 4 + 1)] + [(60, 700), (400, 30_000)]
    got = spark.createDataFrame(rows, "n int, w int").select("n", "w", S.wilcoxon_exact_p(F.col("n"), F.col("w")).alias("p")).collect()
    for r in got:
        if r.n <= 7:
            sums = [sum(i + 1 for i, s in enumerate(signs) if s) for signs in product((0, 1), repeat=r.n)]
            assert r.p == pytest.approx(min(1, 2 * sum(s <= r.w for s in sums) / len(sums)))
        else:
            z = (r.w - r.n * (r.n + 1) / 4) / (r.n * (r.n + 1) * (2 * r.n + 1) / 24) ** 0.5
            assert r.p == pytest.approx(math.erfc(abs(z) / 2**0.5), rel=0.15)


def test_neighbours_at_the_poles_and_the_date_line(spark):
    from quadrat.operators import joins as J

    rng = random.Random(3)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(85.0, 0.0), (85.0, 4.5), (10.0, 179.99), (10.0, -179.99), (90.0, 12.0), (89.9, -170.0), (-89.8, 5.0), (-89.8, 185.0), (0.0, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id int, lat double, lon double")
    for metres in (50_000, 400_000, 3_000_000):
        got = {r.id: (r.other, r.metres) for r in J.proximity_join(df.where("id % 2 = 0"), df.where("id % 2 = 1").withColumnRenamed("id", "other"), "id", "other", metres).collect()}
        far = lambda a, b: 2 * 6371008.8 * math.asin(min(1, math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))
        for i, p in enumerate(spots):
            if i % 2 == 0:
                d, j = min((far(p, q), j) for j, q in enumerate(spots) if j % 2)
                assert (i in got) == (d <= metres) and (d > metres or got[i][1] == pytest.approx(d, rel=1e-6, abs=1e-3))


def test_rarefied_means_over_draws_are_the_expected_richness(spark):
    n = [1, 1, 2, 3, 5, 8, 13, 40, 200]
    c = spark.createDataFrame([(f"p{k}", f"f{i}", v) for k in range(150) for i, v in enumerate(n)], "profile string, feature string, n bigint")
    for depth in (20, 200):  # drawn directly, and by what goes
        want = A.rarefied_richness(c, depth).first()["rarefied"]
        got = A.rarefy(c, depth, 5).collect()
        depths = {}
        for r in got:
            depths[r.profile] = depths.get(r.profile, 0) + r.n
        assert set(depths.values()) == {depth} and len(depths) == 150 and all(0 < r.n <= n[int(r.feature[1:])] for r in got)
        assert abs(len(got) / 150 - want) < 0.3
        assert sum(r.n for r in got if r.feature == "f8") / 150 == pytest.approx(depth * 200 / sum(n), rel=0.04)


def test_rarefying_counts_of_a_billion(spark):
    c = spark.createDataFrame([("p", "a", 10**9), ("p", "b", 3 * 10**9), ("p", "c", 1), ("q", "a", 4), ("r", "a", 5)], "profile string, feature string, n bigint")
    got = {(r.profile, r.feature): r.n for r in A.rarefy(c, 5).collect()}
    assert sum(v for (p, _), v in got.items() if p == "p") == 5 and ("q", "a") not in got and got[("r", "a")] == 5
    many = {(r.profile, r.feature): r.n for r in A.rarefy(c, 4000, seed=3).collect()}
    assert many[("p", "a")] + many[("p", "b")] == 4000 and many[("p", "b")] == pytest.approx(3000, abs=120)


def test_a_formula_is_parsed_once_a_row(spark):
    df = spark.createDataFrame([("CaSO4.2H2O",), ("C6H12O6",), ("",), ("2H2O.NaCl",), (None,)], "f string").select(K.parse_formula("f").alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1
    got = [r.p and [tuple(x) for x in r.p] for r in df.collect()]
    assert got == [[("Ca", 1), ("H", 4), ("O", 6), ("S", 1)], [("C", 1), ("H", 2), ("O", 1)], None, [("Cl", 1), ("H", 4), ("Na", 1), ("O", 2)], None]


def test_abundance_by_rank_deals_cells_once(spark):
    """Ranks and totals come from cells dealt by profile: no shuffle follows it."""
    import re

    from quadrat.operators.agg import abundance_by_rank

    counts = spark.createDataFrame([(1, 1, 2), (1, 2, 6), (2, 1, 5), (2, 3, 0), (3, 3, 0)], "profile int, feature int, n bigint")
    taxonomy = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["d", "b"])], "feature int, lineage array<string>")
    got = abundance_by_rank(counts, taxonomy, 2)
    assert {(r.profile, r["rank"], r.taxon): (r.n, r.label, r.relative) for r in got.collect()} == {
        (1, 1, "a"): (8, "a", 1.0), (1, 2, "a;b"): (2, "b", 0.25), (1, 2, "a;c"): (6, "c", 0.75), (2, 1, "a"): (5, "a", 1.0), (2, 1, "d"): (0, "d", 0.0),
        (2, 2, "a;b"): (5, "b", 1.0), (2, 2, "d;b"): (0, "b", 0.0), (3, 1, "d"): (0, "d", None), (3, 2, "d;b"): (0, "b", None)}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(profile", plan)) == 1
