"""Every ratio over zeros is NULL (or infinite where stated) in ANSI mode, never an error."""

import math

import pytest
from pyspark.sql import functions as F

from quadrat.functions import compositional as C
from quadrat.operators import agg as A
from quadrat.operators import controls as K
from quadrat.operators import distance as D
from quadrat.operators import models as M
from quadrat.operators import stats as S
from quadrat.operators import windows as W


@pytest.fixture(scope="module")
def zeros(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    return spark.createDataFrame([("p", "x", 0, True), ("p", "y", 0, False), ("q", "x", 0, True), ("q", "y", 3, False)], "profile string, feature string, n bigint, is_control boolean")


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([("x", ["a", "b"]), ("y", ["a", "c"])], "feature string, lineage array<string>")


def test_shares_of_nothing_are_null(spark, zeros, taxonomy):
    got = {(r.profile, r["rank"], r.taxon): r.relative for r in A.abundance_by_rank(zeros, taxonomy, 2).collect()}
    assert got[("p", 1, "a")] is None and got[("q", 1, "a")] == 1 and got[("q", 2, "a;c")] == 1
    merged = A.merge_duplicates(zeros, "profile", F.col("profile"), "feature", "n", "sum").collect()
    assert {r.n for r in merged if r.profile == "p"} == {None} and sorted(r.n for r in merged if r.profile == "q") == [0, 1]
    called = zeros.where("feature = 'x'")
    r = A.removal_summary(zeros.withColumn("g", F.col("profile")), called, "g").orderBy("g").collect()
    assert (r[0].mean_share, r[0].pooled_share) == (None, None) and r[1].pooled_share == 0
    rel = C.relative(zeros, ["profile"]).collect()
    assert {x.rel for x in rel if x.profile == "p"} == {None} and sorted(x.rel for x in rel if x.profile == "q") == [0, 1]
    clr = C.clr(zeros, ["profile"], "feature", zero="multiplicative").collect()
    assert {x.clr for x in clr if x.profile == "p"} == {None}
    assert C.guild_logratio(zeros, ["profile"], "feature", ["x"], pseudo=0.0).where("profile = 'p'").first().log_ratio is None
    assert W.rank_taxa(zeros.withColumn("rel", F.col("n")), 0, 0.1, taxon="feature").count() == 0


def test_jackknife_and_cumulative_share(spark):
    pairs = spark.createDataFrame([("a", "b", 0.0, 0.0), ("a", "c", 0.0, 0.0)], "a string, b string, t double, low double")
    r = D.ratio_jackknife(pairs, "t", "low").first()
    assert (r.ratio, r.jackknife_mean, r.se, r.n_units) == (None, None, None, 0)
    some = spark.createDataFrame([("a", "b", 1.0, 2.0), ("a", "c", 1.0, 2.0), ("b", "c", 1.0, 0.0)], "a string, b string, t double, low double")
    r = D.ratio_jackknife(some, "t", "low").first()
    assert r.ratio == 0.75 and r.n_units == 2  # without a nothing is left below
    assert D.ratio_jackknife(pairs.limit(0), "t", "low").first().ratio is None
    c = W.cumulative_share(spark.createDataFrame([(0.0, 1), (0.0, 2)], "v double, i int"), "v", [F.col("i")], 0.9).collect()
    assert [x.cumulative for x in c] == [None, None]


def test_networks_contrasts_and_screens(spark, zeros):
    edges = spark.createDataFrame([], "g string, a string, b string")
    r = M.compare_networks(edges, "g", "x", "y", 0).first()
    assert (r.density_difference, r.jaccard) == (None, None)
    roles = zeros.select("profile").distinct().withColumn("is_control", F.lit(False))
    s = K.contaminant_scores(zeros.drop("is_control"), roles).first()
    assert s.share_controls is None and s.share_samples == 0.5
    assert K.contaminant_screen(zeros.drop("is_control"), roles).count() == 0
    t = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.5, 27), (0.5, 2), (None, 9)], "rho double, n bigint").withColumn("t", S.t_of_rho("rho", "n")).collect()
    assert t[0].t == math.inf and t[1].t == -math.inf and t[2].t == pytest.approx(0.5 * math.sqrt(25 / 0.75)) and t[3].t is None and t[4].t is None
