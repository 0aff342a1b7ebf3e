"""Queries over models, control screens, sources, streams, and end-to-end pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import compositional as C
from quadrat.operators import agg as A
from quadrat.operators import controls as K
from quadrat.operators import distance as D
from quadrat.operators import joins as J
from quadrat.operators import models as M
from quadrat.operators import networks as NW
from quadrat.operators import ordination as O
from quadrat.operators import resample as RS
from quadrat.operators import stats as S
from quadrat.operators import windows as W
from quadrat.plans import stats_plan as SP
from quadrat.plans.roles import registry, sql
from quadrat.session import cut
from quadrat.sources import sinks, text

DRAWS = 999
QUERIES, query = registry()
N = lambda: F.count(F.lit(1)).alias("n")
R = lambda df, digits=6: df.withColumns({c: F.round(F.col(c) + 0.0, digits) for c, kind in df.dtypes if kind == "double"})


def _clr(t):
    return C.clr(t.site_brands, ["site"], "taxon")


def _obs(t, before: int = 0, after: int = 0):
    """All observations, or those with so many days of the series before and after them."""
    e = t.table("events")
    if before or after:
        span = t.daily.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
        e = e.join(F.broadcast(span)).where((F.to_date("ts") >= F.date_add("_a", before)) & (F.to_date("ts") <= F.date_sub("_b", after)))
    return e.select(F.col("event_id").alias("obs_id"), (F.col("user_id") % 25).alias("site"), F.to_date("ts").alias("date"), "value", (F.col("user_id") % 5).alias("campaign"))


def _by_day(obs):
    """``obs`` with its site and day as ``obs_id``, and one row for each of them: all that exposures depend on."""
    obs = obs.withColumn("obs_id", F.concat_ws("|", "site", "date"))
    return obs, obs.select("obs_id", "site", "date").distinct()


# ---- models ----


@query("ml1_ols_simple", "SELECT event_type, round(regr_slope(value, user_id), 8) AS slope, round(regr_intercept(value, user_id), 6) AS intercept, round(regr_r2(value, user_id), 8) AS r2, count(*) AS n FROM events GROUP BY 1")
def _(t):
    f = M.simple_fit(t.table("events"), "value", "user_id", ["event_type"])
    return f.withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 6), "r2": F.round("r2", 8)})


@query("ml1_ols_cluster")
def _(t):
    d = C.design(_obs(t), factors=["campaign"]).withColumn("day", F.dayofmonth("date").cast("double"))
    return R(M.ols(d, "value", ["one", "day", *[c for c in d.columns if c.startswith("campaign_is_")]], "site"))


@query("ml2_pcoa")
def _(t):
    return R(M.pcoa(D.bray_curtis(t.site_brands, "site", "taxon", "n"), 0.8).withColumn("coordinate", F.abs("coordinate")))


@query("ml2_pcoa_axes")
def _(t):
    """Leading axes of all profiles' Bray-Curtis distances by passes over the pair table."""
    return R(O.pcoa_axes(D.bray_curtis(t.counts, "profile", "feature", "n"), 4), 4)


@query("ml3_elemental_axis")
def _(t):
    x = t.table("events").groupBy((F.col("user_id") % 25).alias("site"), F.col("event_type").alias("part")).agg(F.avg("value").alias("v"))
    scores, _ = M.elemental_axis(x.withColumn("all", F.lit(1)), "site", "part", "v", ["all"], 0.5, ["click", "view"])
    return R(scores)


_MOVES = "SELECT draw, u, perm_unit AS rk FROM perm UNION ALL SELECT 0, u, u FROM un"
_POS = "SELECT site AS u, (x * cos(a) + y * sin(a)) / 1000 AS x FROM km, (SELECT 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM km)"


@query("ml4_multivariate_trend", sql("sites site_brands", """
    SELECT round(o.r2, 6) AS r2, round(o.f, 6) AS f, round((1 + count(*) FILTER (d.f >= o.f - 1e-9)) / CAST(1 + count(*) AS DOUBLE), 6) AS p, count(*) AS n_draws FROM fs d, (SELECT * FROM fs WHERE draw = 0) o WHERE d.draw > 0 GROUP BY o.r2, o.f""",
    un="SELECT DISTINCT site AS u FROM site_brands", reps=SP._REPS, perm=SP._PERM, moves=_MOVES, km=SP._KM, pos=_POS, clr=SP._CLR,
    ds="SELECT var_pop(x) AS s11, var_pop(x * x) AS s22, covar_pop(x, x * x) AS s12 FROM pos JOIN un USING (u)",
    cv="SELECT draw, t, covar_pop(x, v) AS c1, covar_pop(x * x, v) AS c2, var_pop(v) AS vv, count(*) AS n FROM moves JOIN pos USING (u) JOIN clr ON clr.u = rk GROUP BY 1, 2",
    ex="SELECT draw, any_value(n) AS n, sum(n * (s22 * c1 * c1 - 2 * s12 * c1 * c2 + s11 * c2 * c2) / (s11 * s22 - s12 * s12)) AS b, sum(n * vv) AS w FROM cv CROSS JOIN ds GROUP BY 1",
    fs="SELECT draw, b / w AS r2, (b / 2) / ((w - b) / (n - 3)) AS f FROM ex"))
def _(t):
    d = _clr(t).join(C.transect(t.sites).select("site", "position"), "site")
    return R(M.multivariate_trend(d, "site", "taxon", "clr", F.col("position") / 1000, 2, DRAWS))


@query("ml4_trend_jackknife", sql("sites site_brands", """
    SELECT round(max(wb / wt), 6) AS r2, round(avg(lb / lt), 6) AS jackknife_mean, round(sqrt((count(*) - 1) * var_pop(lb / lt)), 6) AS se, count(*) AS n_units FROM (SELECT u, any_value(b) AS wb, any_value(w) AS wt, sum(lb) AS lb, sum(lt) AS lt FROM lo, tot GROUP BY 1)""",
    un="SELECT DISTINCT site AS u FROM site_brands", km=SP._KM, pos=_POS, clr=SP._CLR, yz="SELECT u, t, v, x FROM clr JOIN pos USING (u)",
    fit="SELECT t, (var_pop(x * x) * pow(covar_pop(x, v), 2) - 2 * covar_pop(x, x * x) * covar_pop(x, v) * covar_pop(x * x, v) + var_pop(x) * pow(covar_pop(x * x, v), 2)) / (var_pop(x) * var_pop(x * x) - pow(covar_pop(x, x * x), 2)) * count(*) AS b, var_pop(v) * count(*) AS w FROM yz GROUP BY 1",
    tot="SELECT sum(b) AS b, sum(w) AS w FROM fit",
    lo="""SELECT d.u, y.t, (var_pop(x * x) * pow(covar_pop(x, v), 2) - 2 * covar_pop(x, x * x) * covar_pop(x, v) * covar_pop(x * x, v) + var_pop(x) * pow(covar_pop(x * x, v), 2)) / (var_pop(x) * var_pop(x * x) - pow(covar_pop(x, x * x), 2)) * count(*) AS lb, var_pop(v) * count(*) AS lt
      FROM un d JOIN yz y ON y.u <> d.u GROUP BY 1, 2"""))
def _(t):
    d = _clr(t).join(C.transect(t.sites).select("site", "position"), "site").withColumn("position", F.col("position") / 1000)
    return R(M.trend_jackknife(d, "site", "taxon", "clr", "position").drop("low", "high"))


@query("ml5_nested_test", sql("sites site_brands", """
    SELECT round(o.v, 6) AS partial_r2, round((1 + count(*) FILTER (d.v >= o.v - 1e-9)) / CAST(1 + count(*) AS DOUBLE), 6) AS p, count(*) AS n_draws FROM sh d, (SELECT * FROM sh WHERE draw = 0) o WHERE d.draw > 0 GROUP BY o.v""",
    clr=SP._CLR, reps=SP._REPS, xs="SELECT site AS u, lon AS x, CAST(block AS DOUBLE) AS k, block FROM sites WHERE site IN (SELECT site FROM site_brands)",
    rx="SELECT u, x - regr_intercept(x, k) OVER () - regr_slope(x, k) OVER () * k AS rx FROM xs",
    re="SELECT c.u, t, v - regr_intercept(v, k) OVER w - regr_slope(v, k) OVER w * k AS e FROM clr c JOIN xs USING (u) WINDOW w AS (PARTITION BY t)",
    pm="""SELECT draw, x.u, y.u AS rk FROM (SELECT draw, block, u, row_number() OVER (PARTITION BY draw, block ORDER BY u) AS n FROM xs CROSS JOIN reps) x
      JOIN (SELECT draw, block, u, row_number() OVER (PARTITION BY draw, block ORDER BY md5('1|' || draw || '|' || u), u) AS n FROM xs CROSS JOIN reps) y USING (draw, block, n) UNION ALL SELECT 0, u, u FROM xs""",
    sh="SELECT draw, sum(c * c / s) / sum(q) AS v FROM (SELECT draw, t, sum(rx * e) AS c, sum(rx * rx) AS s, sum(e * e) AS q FROM pm JOIN rx USING (u) JOIN re ON re.u = rk GROUP BY 1, 2) GROUP BY 1"))
def _(t):
    d = _clr(t).join(t.sites, "site").withColumns({"one": F.lit(1.0), "blk": F.col("block").cast("double")})
    return R(M.nested_test(d, "site", "taxon", "clr", ["one", "blk"], "lon", "block", DRAWS))


_SCAN = """SELECT key, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS t, round(beta * xy / syy, 6) AS partial_r2{more} FROM (
      SELECT *, sqrt((syy - beta * xy) / (n - 3) / sxx) AS se FROM (
        SELECT key, xy / (xx - quad) AS beta, xx - quad AS sxx, xy, syy, n FROM (
          SELECT key, sum(exposure * exposure) AS xx, sum(exposure * ry) AS xy, any_value(syy) AS syy, any_value(n) AS n,
            (any_value(dd) * sum(exposure) * sum(exposure) - 2 * any_value(sd) * sum(exposure) * sum(exposure * day) + any_value(n) * sum(exposure * day) * sum(exposure * day)) / (any_value(n) * any_value(dd) - any_value(sd) * any_value(sd)) AS quad
          FROM ex JOIN ry USING (obs_id) CROSS JOIN (SELECT sum(ry * ry) AS syy, count(*) AS n, sum(day) AS sd, sum(day * day) AS dd FROM ry) GROUP BY key)))"""
_SCAN_OBS = "SELECT event_id AS obs_id, user_id % 25 AS site, CAST(ts AS DATE) AS date, value, CAST(day(ts) AS DOUBLE) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT min(date) FROM daily) + {before} AND (SELECT max(date) FROM daily) - {after}"
_SCAN_RY = "SELECT obs_id, day, value - (SELECT regr_intercept(value, day) FROM obs) - (SELECT regr_slope(value, day) FROM obs) * day AS ry FROM obs"
_WINDOW = "SELECT obs_id, {key} AS key, sum(d.value) AS exposure FROM obs CROSS JOIN (VALUES {spans}) s(a, b) JOIN daily d ON d.site = obs.site AND d.date BETWEEN {low} AND {high} GROUP BY obs_id, a, b HAVING count(*) = b - a + 1"
_PAST = {"low": "obs.date - b", "high": "obs.date - a"}
_FUTURE = {"low": "obs.date + a", "high": "obs.date + b"}


@query("ml6_scan", sql("daily", _SCAN.format(more=""), obs=_SCAN_OBS.format(before=14, after=0), ry=_SCAN_RY, ex=_WINDOW.format(key="a || '-' || b", spans="(1, 3), (4, 7), (8, 14)", **_PAST)))
def _(t):
    obs, days = _by_day(_obs(t, 14).withColumns({"one": F.lit(1.0), "day": F.dayofmonth("date").cast("double")}))
    e = J.exposure(days, t.daily, [(1, 3), (4, 7), (8, 14)]).withColumn("key", F.concat_ws("-", "from_lag", "to_lag")).where("exposure is not null")
    return R(M.scan(obs, e, "obs_id", "value", "key", "exposure", ["one", "day"]))


@query("ml7_joint_lags")
def _(t):
    obs = _obs(t, 7).withColumns({"one": F.lit(1.0), "day": F.dayofmonth("date").cast("double")})
    return R(M.joint_lags(obs, J.lag_matrix(obs, t.daily, 7), "obs_id", "value", "lag", "value", ["one", "day"]).withColumnRenamed("value", "v"))


@query("ml8_gee")
def _(t):
    d = C.design(_obs(t).withColumn("day", F.dayofmonth("date").cast("double")))
    return R(M.gee(d, "value", ["one", "day"], "site"), 5)


@query("ml8_tests")
def _(t):
    """Contrast of two campaigns and a joint test of all of them, with robust errors over sites."""
    d = C.design(_obs(t).withColumn("day", F.dayofmonth("date").cast("double")), numeric=["day"], factors=["campaign"])
    x = ["one", "day", *[c for c in d.columns if c.startswith("campaign_is_")]]
    return R(M.gee_tests(d, "value", x, "site", {f"{x[2]} - {x[3]}": {x[2]: 1.0, x[3]: -1.0}}, {"campaigns": x[2:]}), 5)


@query("ml9_block_cv", """
    WITH x AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY p_partkey) - 1) * 5 / (SELECT count(*) FROM part)) AS INTEGER) AS fold FROM part),
    f AS (SELECT o.fold, regr_slope(i.p_retailprice, i.p_size) AS b, regr_intercept(i.p_retailprice, i.p_size) AS a, avg(i.p_retailprice) AS m FROM (SELECT DISTINCT fold FROM x) o JOIN x i ON i.fold <> o.fold GROUP BY 1)
    SELECT round(1 - sum(pow(p_retailprice - a - b * p_size, 2)) / sum(pow(p_retailprice - m, 2)), 6) AS skill, round(sqrt(avg(pow(p_retailprice - a - b * p_size, 2))), 4) AS rmse, count(*) AS n, count(DISTINCT fold) AS n_folds FROM x JOIN f USING (fold)""")
def _(t):
    from quadrat.operators.keys import row_numbers

    p = t.table("part")
    n = p.count()
    x = row_numbers(p, [F.col("p_partkey")], start=0, out="i").withColumns({"fold": F.floor(F.col("i") * 5 / n).cast("int"), "one": F.lit(1.0), "size": F.col("p_size").cast("double")})
    return M.block_cv(x, "fold", ["one", "size"], "p_retailprice").withColumns({"skill": F.round("skill", 6), "rmse": F.round("rmse", 4)})


@query("ml10_route_null")
def _(t):
    v = t.daily.groupBy("site").agg(F.avg("value").alias("v"))
    where = t.sites.select("site", "lat")
    return R(M.route_null(v, W.route_maps(t.sites, ["lon", "site"]), "site", lambda rows, keys: rows.join(where, "site").groupBy(*keys).agg(S.safe_corr("lat", "v").alias("v"))))


@query("ml11_order_alias", """
    SELECT campaign, round(corr(e, p), 6) AS pearson, round(corr(re, rp), 6) AS spearman, count(*) AS n, CASE WHEN abs(corr(re, rp)) >= 0.9 THEN 'aliased' WHEN corr(re, rp) IS NULL THEN 'undefined' ELSE 'separable' END AS status FROM (
      SELECT *, rank() OVER (PARTITION BY campaign ORDER BY e) + (count(*) OVER (PARTITION BY campaign, e) - 1) / 2.0 AS re, rank() OVER (PARTITION BY campaign ORDER BY p) + (count(*) OVER (PARTITION BY campaign, p) - 1) / 2.0 AS rp
      FROM (SELECT user_id % 5 AS campaign, CAST(day(ts) AS DOUBLE) AS e, CAST(user_id AS DOUBLE) AS p FROM events)) GROUP BY 1""")
def _(t):
    e = t.table("events").select((F.col("user_id") % 5).alias("campaign"), F.dayofmonth("ts").cast("double").alias("e"), F.col("user_id").cast("double").alias("p"))
    return R(M.order_alias(e, "campaign", "e", "p"))


def _net(t):
    return C.clr(t.phyla.groupBy("site", "campaign", "position", "taxon").agg(F.sum("n").alias("n")), ["site", "campaign", "position"], "taxon").withColumn("unit", F.concat_ws("/", "site", "campaign"))


@query("ml12_network")
def _(t):
    return R(NW.network(_net(t), ["position"], "unit", "taxon", "clr", [0.05, 0.2]), 4)


@query("ml12_stability")
def _(t):
    return R(NW.stability(_net(t), ["position"], "unit", "taxon", "clr", 0.1, 200), 4)


@query("ml12_calibration")
def _(t):
    """Penalty of each position: the smallest whose permuted tables have at most a fifth of its edges."""
    return R(NW.calibrate(_net(t), ["position"], "unit", "taxon", "clr", [0.05, 0.1, 0.2, 0.3, 0.5], 199, 0.2, within=["campaign"]), 4)


@query("ml13_compare_networks")
def _(t):
    edges = NW.network(_net(t), ["position"], "unit", "taxon", "clr", [0.1])
    k = t.phyla.select("taxon").distinct().count()
    return R(M.compare_networks(edges, "position", "A", "R", k * (k - 1) // 2))


@query("ml13_density_interval")
def _(t):
    """Density difference of two positions' networks, its interval over draws of sites, and its sign over penalties."""
    return R(NW.compare(_net(t), "position", "A", "R", "unit", "taxon", "clr", "site", [0.05, 0.1, 0.2, 0.3], 0.1, 2000), 4)


@query("ml15_design_rank")
def _(t):
    d = C.design(t.sites, numeric=["lat"], factors=["block"]).withColumn("twice", F.col("lat") * 2)
    return R(M.design_rank(d, ["one", "lat", "twice", *[c for c in d.columns if c.startswith("block_is_")]]))


# ---- control screens ----

_FISHER = "list_sum(list_transform(range(a, least(r, c) + 1), lambda k: exp(lgamma(r + 1.0) + lgamma(nn - r + 1.0) + lgamma(c + 1.0) + lgamma(nn - c + 1.0) - lgamma(nn + 1.0) - lgamma(k + 1.0) - lgamma(r - k + 1.0) - lgamma(c - k + 1.0) - lgamma(nn - r - c + k + 1.0))))"


@query("ctl1_contaminant_screen", sql("counts profiles", f"""
    SELECT feature, a AS in_controls, c - a AS in_samples, round(least(1.0, {_FISHER}), 6) AS p FROM (
      SELECT feature, count(*) FILTER (is_control) AS a, (SELECT count(*) FROM profiles WHERE is_control) AS r, count(*) AS c, (SELECT count(*) FROM profiles) AS nn FROM counts JOIN profiles USING (profile) GROUP BY 1)
    WHERE a > 0 AND {_FISHER} < 0.1 AND a / CAST(r AS DOUBLE) > (c - a) / CAST(nn - r AS DOUBLE)"""))
def _(t):
    return K.contaminant_screen(t.counts, t.profiles, 0.1).select("feature", "in_controls", "in_samples", F.round("p", 6).alias("p"))


@query("ctl2_batch_screen", sql("counts profiles", f"""
    SELECT threshold, min_support, count(*) FILTER (p < threshold AND a >= min_support) AS n_called FROM (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) t(threshold) CROSS JOIN (VALUES (1), (2)) s(min_support) LEFT JOIN (
      SELECT a, CASE WHEN a > 0 THEN least(1.0, {_FISHER}) ELSE 1.0 END AS p FROM (
        SELECT profile % 2 AS batch, feature, count(*) FILTER (is_control) AS a, count(*) AS c FROM counts JOIN pf USING (profile) GROUP BY 1, 2) JOIN (SELECT profile % 2 AS batch, count(*) FILTER (is_control) AS r, count(*) AS nn FROM pf GROUP BY 1) USING (batch)
      WHERE r >= 2 AND nn > r AND a / CAST(r AS DOUBLE) > (c - a) / CAST(nn - r AS DOUBLE)) x ON true GROUP BY 1, 2""", pf="SELECT profile, profile % 7 = 0 AS is_control FROM profiles"))
def _(t):
    roles = t.profiles.select("profile", (F.col("profile") % 7 == 0).alias("is_control"))
    batches = t.profiles.select("profile", (F.col("profile") % 2).alias("batch"))
    return K.batch_scenarios(K.batch_screen(t.counts, roles, batches), [0.05, 0.1], [1, 2])


@query("ctl3_spillover", sql("counts taxonomy", """
    SELECT feature, CASE WHEN profile = 5 THEN 'positive' WHEN profile % 10 = 0 THEN 'negative' ELSE 'sample' END AS role, count(*) AS profiles, CAST(sum(n) AS BIGINT) AS reads, round(max(n / CAST(depth AS DOUBLE)), 9) AS max_share
    FROM counts JOIN taxonomy USING (feature) JOIN (SELECT profile, sum(n) AS depth FROM counts GROUP BY 1) USING (profile) WHERE r2 IN ('Brand#11', 'Brand#22') AND feature IN (SELECT feature FROM counts WHERE profile = 5) GROUP BY 1, 2"""))
def _(t):
    p = F.col("profile")
    roles = t.profiles.select("profile", F.when(p == 5, "positive").when(p % 10 == 0, "negative").otherwise("sample").alias("role"))
    return R(K.spillover(t.counts, roles, t.taxonomy, ["Brand#11", "Brand#22"], 2), 9)


def _called(t):
    return t.table("part").where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("feature"))


@query("ctl4_apply_removal", sql("counts", "SELECT profile, CAST(sum(n) AS BIGINT) AS before, CAST(coalesce(sum(n) FILTER (feature % 9 = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (feature % 9 <> 0), 0) AS BIGINT) AS after, true AS ok FROM counts GROUP BY 1"))
def _(t):
    return K.apply_removal(t.counts, _called(t))[1]


@query("ctl5_compare_headlines", sql("counts", """
    SELECT a.profile, 'richness' AS metric, CAST(x AS DOUBLE) AS before, CAST(y AS DOUBLE) AS after, CAST(y - x AS DOUBLE) AS change FROM (SELECT profile, count(*) AS x, count(*) FILTER (feature % 9 <> 0) AS y FROM counts GROUP BY 1) a"""))
def _(t):
    return R(K.removal_effect(t.counts, _called(t)).where("metric = 'richness'"))


@query("ctl6_control_inventory", """
    SELECT norm, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds, count(DISTINCT kind) > 1 AS conflict, count(*) AS n_evidence FROM (
      SELECT regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS norm, 'sheet' AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'blank' ELSE 'mock' END AS kind FROM supplier
      UNION ALL SELECT regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g'), 'lab', CASE WHEN s_suppkey % 2 = 0 THEN 'blank' ELSE 'mock' END FROM supplier WHERE s_suppkey % 5 > 0) GROUP BY 1""")
def _(t):
    s = t.table("supplier")
    kind = lambda m: F.when(F.col("s_suppkey") % m == 0, "blank").otherwise("mock").alias("kind")
    lab = s.where("s_suppkey % 5 > 0").select(F.upper("s_name").alias("label"), kind(2))
    return K.control_inventory({"sheet": s.select(F.col("s_name").alias("label"), kind(3)), "lab": lab})


# ---- sources and sinks over the given tables ----


@query("src2_melt_counts", sql("phyla", "SELECT 'c' || campaign AS profile, site, CAST(sum(n) AS BIGINT) AS n FROM phyla GROUP BY 1, 2"))
def _(t):
    wide = text.to_wide(t.phyla.withColumn("c", F.concat(F.lit("c"), "campaign")), "site", "c", ["c1", "c2", "c3", "c4", "c5"])
    return text.melt_counts(wide, "site", ["c1", "c2", "c3", "c4", "c5"])


@query("snk2_to_wide", sql("phyla", "SELECT taxon, CAST(coalesce(sum(n) FILTER (position = 'A'), 0) AS BIGINT) AS A, CAST(coalesce(sum(n) FILTER (position = 'N'), 0) AS BIGINT) AS N, CAST(coalesce(sum(n) FILTER (position = 'R'), 0) AS BIGINT) AS R FROM phyla GROUP BY 1"))
def _(t):
    return text.to_wide(t.phyla, "taxon", "position", ["A", "N", "R"])


@query("src5_one_file_per_day", """
    SELECT CAST(d AS VARCHAR) AS key, CASE WHEN day(d) % 10 = 3 THEN 'missing' WHEN day(d) % 7 = 0 THEN 'duplicate' ELSE 'ok' END AS status, CASE WHEN day(d) % 10 <> 3 AND day(d) % 7 <> 0 THEN 'f_' || d || '_0' END AS path FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)""")
def _(t):
    d = t.table("events").select(F.to_date("ts").alias("d")).distinct()
    key = F.col("d").cast("string")
    copies = F.explode(F.when(F.dayofmonth("d") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    files = d.where("day(d) % 10 <> 3").select(key.alias("key"), copies.alias("i")).select("key", F.concat(F.lit("f_"), "key", F.lit("_"), F.col("i").cast("string")).alias("path"))
    return text.select_one_per_key(files, d.select(key.alias("key")))


@query("src6_instrument_blocks", "SELECT user_id AS id, event_type AS formula, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(t):
    line = F.concat("event_type", F.lit("\t"), F.round("value", 2).cast("string"))
    body = t.table("events").groupBy(F.col("user_id").alias("id")).agg(F.concat_ws("\n", F.collect_list(line)).alias("b"))
    doc = F.concat(F.lit("Report\nFormula\tConc\n"), "b", F.lit("\nMaterial\tsoil\nnoise\t1\nFormula\tConc\nMode\tx\nlast\t2"))
    out = text.parse_instrument_blocks(body.select("id", doc.alias("text")), "id", "text")
    return out.groupBy("id", "formula").agg(N(), F.round(F.sum("value"), 2).alias("total"))


@query("src10_parse_nquads", sql("triples", "SELECT p, o_kind, count(*) AS n, count(DISTINCT s || o) AS distinct_n FROM triples GROUP BY 1, 2"))
def _(t):
    quads, _ = text.parse_nquads(sinks.render_nquads(t.triples))
    return quads.groupBy("p", "o_kind").agg(N(), F.count_distinct(F.concat("s", "o")).alias("distinct_n"))


@query("src11_daily_json", sql("daily", "SELECT site, date, value AS rain FROM daily"))
def _(t):
    rows = t.daily.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("d"), "value"))).alias("x"))
    payload = F.to_json(F.struct(F.struct(F.transform("x", lambda r: r["d"]).alias("time"), F.transform("x", lambda r: r["value"]).alias("rain")).alias("daily")))
    return text.explode_daily_json(rows.select("site", payload.alias("j")), "site", "j", ["rain"])


# ---- pipelines ----


def _alpha(t):
    return A.alpha_basic(t.counts_pos.join(t.profiles.where("not is_control"), "profile"), ["profile", "site", "campaign", "position"])


@query("pl2_diversity_contrasts", sql("counts_pos profiles", SP.CONTRASTS, **SP.contrast_parts(
    "SELECT site, campaign, position, avg(h) AS v FROM (SELECT profile, campaign, position, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM counts_pos WHERE n > 0 GROUP BY 1, 2, 3) JOIN profiles USING (profile) WHERE NOT is_control GROUP BY 1, 2, 3", "('A', 'N'), ('A', 'R'), ('N', 'R')", "site, campaign")))
def _(t):
    """Replicate collapse, then paired contrasts between positions."""
    cells = A.collapse_replicates(_alpha(t), ["site", "campaign", "position"], ["shannon", "richness"], ["depth"])
    return R(S.paired_contrasts(cells, ["site", "campaign"], "position", [("A", "N"), ("A", "R"), ("N", "R")], "shannon", SP.BOOTS))


_PL3 = {
    "cells": "SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY site, position) AS total FROM (SELECT site, position, taxon, sum(n) AS n FROM phyla GROUP BY 1, 2, 3)) WHERE total >= 2000",
    "z": """SELECT site, position, taxon, ln(n + 0.5) - avg(ln(n + 0.5)) OVER (PARTITION BY site, position) AS v FROM (
      SELECT g.site, g.position, p.taxon, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT site, position FROM cells) g CROSS JOIN (SELECT DISTINCT taxon FROM cells) p LEFT JOIN cells c USING (site, position, taxon))""",
    "pd": "SELECT x.site, x.taxon, x.v - y.v AS diff FROM z x JOIN z y USING (site, taxon) WHERE x.position = 'A' AND y.position = 'R'",
    "reps": SP._REPS,
    "flip": "SELECT draw, site, CASE WHEN CAST('0x' || substr(md5('1|' || draw || '|' || site), 1, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT site FROM pd) CROSS JOIN reps",
    "cen": "SELECT site, position, site || '/' || position AS u, taxon AS t, v - avg(v) OVER (PARTITION BY site, taxon) AS v FROM z",
    "un": "SELECT DISTINCT site, position, u FROM cen",
    "mv": """SELECT x.draw, x.u, y.position AS pp FROM (SELECT draw, site, u, row_number() OVER (PARTITION BY draw, site ORDER BY u) AS k FROM un CROSS JOIN reps) x
      JOIN (SELECT draw, site, position, row_number() OVER (PARTITION BY draw, site ORDER BY md5('1|' || draw || '|' || u), u) AS k FROM un CROSS JOIN reps) y USING (draw, site, k)""",
}


@query("pl3_composition", sql("phyla", f"""
    SELECT 'location' AS test, round(o, 6) AS statistic, round((1 + count(*) FILTER (v >= o - 1e-9)) / CAST(1 + count(*) AS DOUBLE), 6) AS p FROM (
      SELECT draw, sqrt(sum(m * m)) AS v FROM (SELECT draw, taxon, avg(sign * diff) AS m FROM pd JOIN flip USING (site) GROUP BY 1, 2) GROUP BY 1), (SELECT sqrt(sum(m * m)) AS o FROM (SELECT taxon, avg(diff) AS m FROM pd GROUP BY 1)) GROUP BY o
    UNION ALL
    SELECT 'omnibus', round(f, 6), round((1 + count(*) FILTER (v >= f - 1e-9)) / CAST(1 + count(*) AS DOUBLE), 6) FROM (
      SELECT draw, (bt / (g - 1)) / (wi / (n - g)) AS v FROM ({SP._ss('draw,', 'SELECT draw, pp AS block, c.t, c.v FROM cen c JOIN mv USING (u)')})),
      (SELECT (bt / (g - 1)) / (wi / (n - g)) AS f FROM ({SP._ss('', 'SELECT position AS block, t, v FROM cen')})) GROUP BY f""", **_PL3))
def _(t):
    """Gate, rank, log-ratio, then location and omnibus tests of positions."""
    cells = A.grouped_counts(t.phyla, ["site", "position"], "taxon", 2000)
    z = C.clr(cells, ["site", "position"], "taxon")
    loc = S.paired_location(S.paired_differences(z, ["site", "taxon"], "position", [("A", "R")], "clr"), "site", "taxon", "diff", DRAWS)
    omni = S.omnibus_f(z, "site", "position", "taxon", "clr", DRAWS)
    return R(loc.select(F.lit("location").alias("test"), "statistic", "p").unionByName(omni.select(F.lit("omnibus").alias("test"), F.col("f").alias("statistic"), "p")))


@query("pl4_geographic_structure", sql("site_brands counts profiles sites", """
    SELECT 'decay' AS test, round(slope, 6) AS statistic, round((1 + count(*) FILTER (abs(v - mv) >= abs(slope - mv) - 1e-9)) / CAST(1 + count(*) AS DOUBLE), 6) AS p FROM (
      SELECT *, avg(v) OVER () AS mv FROM (SELECT m.draw, regr_slope(dd.d, m.km) AS v FROM (SELECT p.draw, least(p.perm_unit, q.perm_unit) AS a, greatest(p.perm_unit, q.perm_unit) AS b, km FROM geo JOIN perm p ON p.u = a JOIN perm q ON q.u = b AND q.draw = p.draw) m JOIN dd USING (a, b) GROUP BY 1)),
      (SELECT regr_slope(d, km) AS slope FROM geo JOIN dd USING (a, b)) GROUP BY slope
    UNION ALL
    SELECT 'moran', round(i, 6), round((1 + count(*) FILTER (v >= i - 1e-9)) / CAST(1 + count(*) AS DOUBLE), 6) FROM (
      SELECT p.draw, (SELECT count(*) / sum(z * z) FROM zz) * sum(x.z * y.z) / count(*) AS v FROM knn JOIN perm p ON p.u = a JOIN perm q ON q.u = b AND q.draw = p.draw JOIN zz x ON x.site = p.perm_unit JOIN zz y ON y.site = q.perm_unit GROUP BY 1),
      (SELECT (SELECT count(*) / sum(z * z) FROM zz) * sum(x.z * y.z) / count(*) AS i FROM knn JOIN zz x ON x.site = a JOIN zz y ON y.site = b) GROUP BY i""",
    un="SELECT DISTINCT site AS u FROM site_brands", reps=SP._REPS, perm=SP._PERM, **SP._GEOM, knn=SP._KNN,
    zz="SELECT site, y - avg(y) OVER () AS z FROM (SELECT site, avg(r) AS y FROM (SELECT profile, count(*) AS r FROM counts WHERE n > 0 GROUP BY 1) JOIN profiles USING (profile) GROUP BY 1)"))
def _(t):
    """Distance decay of composition and Moran's I of richness."""
    p = D.geo_pairs(t.sites).join(D.euclidean(_clr(t), "site", "taxon", "clr"), ["a", "b"])
    decay = S.distance_decay(p, "km", "d", DRAWS).select(F.lit("decay").alias("test"), F.col("slope").alias("statistic"), "p")
    rich = A.collapse_replicates(A.alpha_basic(t.counts).join(t.profiles, "profile"), ["site"], ["richness"])
    moran = S.moran(rich, J.knn_graph(C.km_axes(t.sites), 5, node="site"), "site", "richness", DRAWS).select(F.lit("moran").alias("test"), F.col("i").alias("statistic"), "p")
    return R(decay.unionByName(moran))


@query("pl5_prediction", sql("counts profiles sites", """
    SELECT round(1 - sum(pow(y - a - b * x, 2)) / sum(pow(y - m, 2)), 6) AS skill, round(sqrt(avg(pow(y - a - b * x, 2))), 6) AS rmse, count(*) AS n, count(DISTINCT fold) AS n_folds FROM tr JOIN (
      SELECT o.fold, regr_slope(i.y, i.x) AS b, regr_intercept(i.y, i.x) AS a, avg(i.y) AS m FROM (SELECT DISTINCT fold FROM tr) o JOIN tr i ON i.fold <> o.fold GROUP BY 1) USING (fold)""",
    km=SP._KM, rich="SELECT site, avg(r) AS y FROM (SELECT profile, count(*) AS r FROM counts WHERE n > 0 GROUP BY 1) JOIN profiles USING (profile) GROUP BY 1",
    tr="""SELECT site, y, x, floor((row_number() OVER (ORDER BY x, site) - 1) * 5 / count(*) OVER ()) AS fold FROM rich JOIN (
      SELECT site, (x * cos(a) + y * sin(a)) / 1000 AS x FROM km, (SELECT 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM km)) USING (site)"""))
def _(t):
    """Blocked leave-out skill of position for richness, along the transect."""
    rich = A.collapse_replicates(A.alpha_basic(t.counts).join(t.profiles, "profile"), ["site"], ["richness"])
    x = C.transect(t.sites).select("site", "position").join(rich, "site")
    x = x.withColumns({"fold": W.contiguous_blocks([], ["position", "site"], 5), "one": F.lit(1.0), "pos": F.col("position") / 1000})
    return R(M.block_cv(x, "fold", ["one", "pos"], "richness"))


@query("pl6_response_window", sql("daily", _SCAN.format(more=", round((1.959963984540054 + 0.8416212335729143) * se, 6) AS mde"), obs=_SCAN_OBS.format(before=9, after=9), ry=_SCAN_RY,
    ex=_WINDOW.format(key="'past ' || a", spans="(1, 3), (4, 7), (8, 9)", **_PAST) + " UNION ALL " + _WINDOW.format(key="'future ' || a", spans="(1, 3), (4, 7), (8, 9)", **_FUTURE)))
def _(t):
    """Antecedent windows: exposures, partial scan, past against future placebo."""
    obs, days = _by_day(_obs(t, 9, 9).withColumns({"one": F.lit(1.0), "day": F.dayofmonth("date").cast("double")}))
    spans = [(1, 3), (4, 7), (8, 9)]
    past, future = J.exposure(days, t.daily, spans), J.exposure(days, t.daily, spans, future=True)
    both = past.withColumn("key", F.concat(F.lit("past "), "from_lag")).unionByName(future.withColumn("key", F.concat(F.lit("future "), "from_lag")))
    fits = M.scan(obs, both.where("exposure is not null"), "obs_id", "value", "key", "exposure", ["one", "day"])
    return R(S.mde(fits, "se"))


@query("pl7_pulse_response")
def _(t):
    """Pulse kernels over daily lags, scanned over peaks, with lag-rotation nulls."""
    obs, days = _by_day(_obs(t, 14).withColumns({"one": F.lit(1.0), "day": F.dayofmonth("date").cast("double")}))
    lags = J.lag_matrix(days, t.daily, 14).where("value is not null")
    peaks = [1.0, 3.0, 7.0]
    fit = lambda table, key: M.scan(obs, table, "obs_id", "value", key, "exposure", ["one", "day"])
    shifts = t.spark.range(1, 14).select(F.col("id").cast("int").alias("shift"))
    rotated = RS.lag_rotations(lags, 14, shifts)
    e = rotated.select("obs_id", "shift", "lag", "value", F.explode(F.array(*map(F.lit, peaks))).alias("peak")).groupBy("obs_id", "shift", "peak").agg(F.sum(F.col("value") * C.pulse_kernel(F.col("lag"), F.col("peak"))).alias("exposure"))
    null = fit(e.withColumn("key", F.concat_ws("|", F.col("peak").cast("string"), F.col("shift").cast("string"))), "key").select(F.split("key", r"\|")[0].alias("peak"), "t")
    obs_t = fit(C.pulse_exposure(lags, "obs_id", "lag", "value", peaks).withColumn("peak", F.col("peak").cast("string")), "peak")
    return R(RS.perm_p(null.withColumnRenamed("t", "v").join(obs_t.select("peak", "t", "beta"), "peak"), F.col("t"), "v", ["peak", "t", "beta"], tail="two"))


@query("pl8_climate_associations", sql("counts profiles daily", "SELECT pair, n, dof, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("rho", "t", "p", "q", "q_bonferroni")) + f" FROM ({SP.adjusted('pair', 'SELECT * FROM ps')})",
    clim="SELECT site, avg(m) AS mean_value, avg(s) AS sum_value FROM (SELECT site, round(avg(value), 3) AS m, round(sum(value), 3) AS s FROM daily GROUP BY site, year(date), month(date)) GROUP BY 1",
    al="SELECT site, avg(h) AS shannon, avg(r) AS richness FROM (SELECT profile, count(*) AS r, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM counts WHERE n > 0 GROUP BY 1) JOIN profiles USING (profile) GROUP BY 1",
    xy="SELECT a || '~' || b AS pair, CASE a WHEN 'mean_value' THEN mean_value ELSE sum_value END AS x, CASE b WHEN 'shannon' THEN shannon ELSE richness END AS y FROM clim JOIN al USING (site) CROSS JOIN (VALUES ('mean_value'), ('sum_value')) p(a) CROSS JOIN (VALUES ('shannon'), ('richness')) q(b)",
    rk="SELECT pair, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS ry FROM xy",
    rh="SELECT pair, corr(rx, ry) AS rho, count(*) AS n, count(*) - 2 AS dof FROM rk GROUP BY 1", ts="SELECT *, CASE WHEN abs(rho) >= 1 - 1e-12 THEN sign(rho) * CAST('inf' AS DOUBLE) ELSE rho * sqrt(dof / (1 - rho * rho)) END AS t FROM rh", ps=f"SELECT *, CASE WHEN isinf(t) THEN 0.0 ELSE {SP.p_student('t', 'dof')} END AS p FROM ts"))
def _(t):
    """Site climatology against diversity: rank correlation, interval, adjusted p."""
    clim = A.site_climatology(A.monthly(t.daily, ["value"], ["value"]), ["mean_value", "sum_value"])
    x = A.collapse_replicates(A.alpha_basic(t.counts).join(t.profiles, "profile"), ["site"], ["shannon", "richness"]).join(clim, "site")
    cells = x.select("site", F.explode(F.array(*(F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).alias("x"), F.col(b).cast("double").alias("y")) for a in ("mean_value", "sum_value") for b in ("shannon", "richness")))).alias("c")).select("site", "c.*")
    rho = S.spearman(cells, "x", "y", ["pair"]).withColumn("t", S.t_of_rho("rho", "n"))
    return R(W.with_bh(M.with_p(rho.withColumn("dof", F.col("n") - 2), "t", "dof"), "p", ties=["pair"]))


@query("pl9_geochemical_axis")
def _(t):
    """First axis of the readings against the first principal coordinate of composition."""
    x = t.table("events").groupBy((F.col("user_id") % 25).alias("site"), F.col("event_type").alias("part")).agg(F.avg("value").alias("v")).withColumn("all", F.lit(1))
    scores, _ = M.elemental_axis(x, "site", "part", "v", ["all"], 0.5, ["click"])
    axes = M.pcoa(D.bray_curtis(t.site_brands, "site", "taxon", "n"), 0.5).where("axis = 1").select(F.col("unit").cast("bigint").alias("site"), "coordinate")
    return R(S.spearman(scores.join(axes, "site"), "score", "coordinate").withColumn("rho", F.abs("rho")))


@query("pl10_curated_readings", sql("readings", """
    SELECT analyte, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT sample, analyte, median(value) AS v FROM readings WHERE value <= 200 AND sample % 20 <> 0 GROUP BY 1, 2) GROUP BY 1"""))
def _(t):
    """Disposition rules, admitted rows, replicate reduction, summary."""
    from quadrat.operators.keys import qc_flags

    rows = qc_flags(t.readings, {"range": F.col("value") > 200, "qc": F.col("sample") % 20 == 0}).where("disposition = 'admitted'")
    red = A.reduce_readings(rows, ["sample", "analyte"], "value", F.struct("ts", "event_id"), "median_positive")
    return R(red.groupBy("analyte").agg(N(), F.avg("value").alias("mean")))


@query("pl11_pathway_structure")
def _(t):
    """Per-part paired tests with global adjustment."""
    from quadrat.functions.numeric import pdist

    z = C.clr(A.grouped_counts(t.phyla, ["site", "position"], "taxon", 1), ["site", "position"], "taxon")
    d = S.paired_differences(z, ["site", "taxon"], "position", [("A", "N")], "clr")
    return R(W.with_bh(S.wilcoxon(d, "diff", ["taxon"]).withColumn("p", pdist("normal", "z")), "p", ties=["taxon"]))


@query("pl12_product_agreement", sql("counts_pos taxonomy", """
    SELECT count(*) AS n_profiles, round(median(rho), 6) AS median_rho FROM (SELECT profile, corr(ra, rb) AS rho FROM (
      SELECT profile, rank() OVER (PARTITION BY profile ORDER BY va) + (count(*) OVER (PARTITION BY profile, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY profile ORDER BY vb) + (count(*) OVER (PARTITION BY profile, vb) - 1) / 2.0 AS rb FROM (
        SELECT a.profile, a.v AS va, b.v AS vb FROM (SELECT profile, r2, sum(n) AS v FROM counts_pos JOIN taxonomy USING (feature) WHERE campaign = 1 GROUP BY 1, 2) a JOIN (SELECT profile, r2, sum(n) AS v FROM counts_pos JOIN taxonomy USING (feature) WHERE campaign = 2 GROUP BY 1, 2) b USING (profile, r2))) GROUP BY 1)"""))
def _(t):
    prod = lambda c: A.collapse_rank(t.counts_pos.where(F.col("campaign") == c), t.taxonomy, 2).withColumnRenamed("n", "v")
    return R(S.agreement_by_sample(prod(1), prod(2), "profile", "taxon", "v").agg(F.count(F.lit(1)).alias("n_profiles"), F.median("rho").alias("median_rho")))


@query("pl14_paired_endpoint", sql("counts", SP.CONTRASTS, **SP.contrast_parts(
    "SELECT CAST(floor(profile / 2) AS BIGINT) AS pair, CASE WHEN profile % 2 = 0 THEN 'treated' ELSE 'control' END AS position, count(*) AS v FROM counts WHERE n > 0 GROUP BY 1, 2, profile", "('treated', 'control')", "pair")))
def _(t):
    """Paired endpoint: richness of the two members of each supplier pair, signed-rank and interval."""
    a = A.alpha_basic(t.counts).withColumns({"pair": F.floor(F.col("profile") / 2), "arm": F.when(F.col("profile") % 2 == 0, "treated").otherwise("control")})
    return R(S.paired_contrasts(a, ["pair"], "arm", [("treated", "control")], "richness", SP.BOOTS))


@query("pl16_gradient_signal", sql("counts profiles sites", SP.MANTEL, un="SELECT feature AS u FROM counts GROUP BY 1 ORDER BY sum(n) DESC, feature LIMIT 40", reps=SP._REPS, perm=SP._PERM,
    nc="SELECT feature, sum(n * lat) / sum(n) AS v FROM counts JOIN un ON u = feature JOIN profiles USING (profile) JOIN sites USING (site) GROUP BY 1",
    geo="SELECT x.feature AS a, y.feature AS b, abs(x.v - y.v) AS km FROM nc x JOIN nc y ON x.feature < y.feature", dd="SELECT x.p_partkey AS a, y.p_partkey AS b, abs(x.p_retailprice - y.p_retailprice) AS d FROM part x JOIN part y ON x.p_partkey < y.p_partkey AND x.p_partkey IN (SELECT u FROM un) AND y.p_partkey IN (SELECT u FROM un)"))
def _(t):
    """Niche differences of common features against a supplied distance table."""
    g = t.profiles.select("profile", "site").join(t.sites.select("site", "lat"), "site").select("profile", "lat")
    common = W.top_k(t.counts.groupBy("feature").agg(F.sum("n").alias("n")), 40, [F.desc("n"), F.col("feature")]).select("feature")
    x = S.niche(t.counts.join(common, "feature", "left_semi"), g, "profile", "feature", "n", "lat")
    p = J.pairs(x, "feature", keep=["niche"]).select("a", "b", F.abs(F.col("niche_a") - F.col("niche_b")).alias("d"))
    sizes = t.table("part").select(F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("v")).join(common, "feature", "left_semi")
    q = J.pairs(sizes, "feature", keep=["v"]).select("a", "b", F.abs(F.col("v_a") - F.col("v_b")).alias("d"))
    return R(S.mantel(p, q, DRAWS))


@query("pl19_reading_audit", sql("readings", """
    SELECT analyte, count(*) AS n_samples, round(avg(mx - mn), 6) AS mean_spread FROM (SELECT sample, analyte, max(value) AS mx, min(value) AS mn FROM readings GROUP BY 1, 2) GROUP BY 1"""))
def _(t):
    g = t.readings.groupBy("sample", "analyte").agg(F.max("value").alias("mx"), F.min("value").alias("mn"))
    return R(g.groupBy("analyte").agg(F.count(F.lit(1)).alias("n_samples"), F.avg(F.col("mx") - F.col("mn")).alias("mean_spread")))


@query("pl20_control_audit", sql("counts", "SELECT count(*) AS profiles, count(*) AS n_ok, CAST(sum(r) AS BIGINT) AS removed FROM (SELECT profile, coalesce(sum(n) FILTER (feature % 9 = 0), 0) AS r FROM counts GROUP BY 1)"))
def _(t):
    inv = K.apply_removal(t.counts, _called(t))[1]
    return inv.agg(F.count(F.lit(1)).alias("profiles"), F.count_if("ok").alias("n_ok"), F.sum("removed").alias("removed"))


_SCREEN = {
    "called": f"""SELECT feature FROM (SELECT feature, count(*) FILTER (is_control) AS a, (SELECT count(*) FROM profiles WHERE is_control) AS r, count(*) AS c, (SELECT count(*) FROM profiles) AS nn FROM counts JOIN profiles USING (profile) GROUP BY 1)
      WHERE a > 0 AND {_FISHER} < 0.1 AND a / CAST(r AS DOUBLE) > (c - a) / CAST(nn - r AS DOUBLE)""",
    "marked": "SELECT c.*, called.feature IS NOT NULL AS hit FROM counts c LEFT JOIN called USING (feature)",
    "per": "SELECT profile, sum(n) AS t, coalesce(sum(n) FILTER (hit), 0) AS gone, count(*) AS rich, count(*) FILTER (NOT hit) AS rich2, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, ln(sum(n) FILTER (NOT hit)) - sum(n * ln(n)) FILTER (NOT hit) / sum(n) FILTER (NOT hit) AS h2 FROM marked GROUP BY 1",
    "batches": f"""SELECT feature FROM (SELECT feature, a, c, r, nn FROM (SELECT profile % 2 AS batch, feature, count(*) FILTER (is_control) AS a, count(*) AS c FROM counts JOIN profiles USING (profile) GROUP BY 1, 2)
      JOIN (SELECT profile % 2 AS batch, count(*) FILTER (is_control) AS r, count(*) AS nn FROM profiles GROUP BY 1) USING (batch)) WHERE r >= 2 AND nn > r AND a > 0 AND a / CAST(r AS DOUBLE) > (c - a) / CAST(nn - r AS DOUBLE) AND least(1.0, {_FISHER}) < 0.1""",
    "spill": "SELECT role, count(DISTINCT feature) AS n, max(n / CAST(depth AS DOUBLE)) AS m FROM (SELECT *, CASE WHEN profile = 5 THEN 'positive' WHEN profile % 10 = 0 THEN 'negative' ELSE 'sample' END AS role FROM counts JOIN taxonomy USING (feature) JOIN (SELECT profile, sum(n) AS depth FROM counts GROUP BY 1) USING (profile) WHERE r2 IN ('Brand#11', 'Brand#22') AND feature IN (SELECT feature FROM counts WHERE profile = 5)) GROUP BY 1",
}


@query("pl20_screen_and_rebuild", sql("counts profiles taxonomy", """
    SELECT 'controls' AS step, 'profiles' AS item, CAST(count(*) AS DOUBLE) AS value FROM profiles WHERE is_control
    UNION ALL SELECT 'screen', 'called', count(*) FROM called
    UNION ALL SELECT 'screen', 'called within batches', count(DISTINCT feature) FROM batches
    UNION ALL SELECT 'screen', 'called both ways', count(*) FROM (SELECT feature FROM called INTERSECT SELECT feature FROM batches)
    UNION ALL SELECT 'spillover ' || role, 'features', n FROM spill UNION ALL SELECT 'spillover ' || role, 'largest share', round(m, 6) FROM spill
    UNION ALL SELECT 'removal', 'conserved profiles', count(*) FROM per UNION ALL SELECT 'removal', 'reads', sum(gone) FROM per UNION ALL SELECT 'removal', 'mean share of samples', round(avg(gone / CAST(t AS DOUBLE)), 6) FROM per JOIN profiles USING (profile) WHERE NOT is_control
    UNION ALL SELECT 'headline', 'depth', round(avg(CAST(-gone AS DOUBLE)), 6) FROM per UNION ALL SELECT 'headline', 'richness', round(avg(CAST(rich2 - rich AS DOUBLE)), 6) FROM per UNION ALL SELECT 'headline', 'shannon', round(avg(h2 - h), 6) FROM per""", **_SCREEN))
def _(t):
    """Controls screened over all and within batches, spillover of the positive control, removal with its invariants, and
    what the headline numbers change."""
    counts = cut(t.counts, "counts")
    roles = t.profiles.select("profile", "is_control")
    called = cut(K.contaminant_screen(counts, roles, 0.1).select("feature"), "called")
    within = K.batch_screen(counts, roles, roles.select("profile", (F.col("profile") % 2).alias("batch"))).where("commoner and in_controls > 0 and p < 0.1").select("feature").distinct()
    k = F.col("profile")
    role = t.profiles.select("profile", F.when(k == 5, "positive").when(k % 10 == 0, "negative").otherwise("sample").alias("role"))
    spill = K.spillover(counts, role, t.taxonomy, ["Brand#11", "Brand#22"], 2).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max("max_share").alias("m"))
    _, inv = K.apply_removal(counts, called)
    share = A.removal_summary(counts.join(roles, "profile"), called, "is_control").where("not is_control")
    change = K.removal_effect(counts, called).groupBy("metric").agg(F.avg("change").alias("value"))
    row = lambda df, step, item, value: df.select((F.lit(step) if isinstance(step, str) else step).alias("step"), (F.lit(item) if isinstance(item, str) else item).alias("item"), value.cast("double").alias("value"))
    n = F.count(F.lit(1))
    parts = [
        row(roles.where("is_control").agg(n.alias("n")), "controls", "profiles", F.col("n")), row(called.agg(n.alias("n")), "screen", "called", F.col("n")),
        row(within.agg(n.alias("n")), "screen", "called within batches", F.col("n")), row(within.join(called, "feature", "left_semi").agg(n.alias("n")), "screen", "called both ways", F.col("n")),
        row(spill, F.concat(F.lit("spillover "), "role"), "features", F.col("n")), row(spill, F.concat(F.lit("spillover "), "role"), "largest share", F.col("m")),
        row(inv.where("ok").agg(n.alias("n")), "removal", "conserved profiles", F.col("n")), row(inv.agg(F.sum("removed").alias("n")), "removal", "reads", F.col("n")),
        row(share, "removal", "mean share of samples", F.col("mean_share")), row(change, "headline", F.col("metric"), F.col("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return R(out)


@query("pl22_abundance_graph", sql("counts taxonomy", """
    SELECT rank, count(*) AS n_nodes, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 1 AS rank, profile, r1 AS x, sum(n) AS n FROM counts JOIN taxonomy USING (feature) GROUP BY 1, 2, 3 UNION ALL SELECT 2, profile, r1 || r2, sum(n) FROM counts JOIN taxonomy USING (feature) GROUP BY 1, 2, 3) GROUP BY 1"""))
def _(t):
    """Abundance rows to triples, validated by shape, conservation and link fingerprints, then read back."""
    from quadrat.operators import graph as G
    from quadrat.operators import quality as Q
    from quadrat.operators.keys import stable_id

    ab = cut(A.abundance_by_rank(t.counts, t.taxonomy, 2), "abundance")
    node, run = stable_id("abundance", "profile", "rank", "taxon"), F.concat(F.lit("run/"), F.col("profile").cast("string"))
    g = G.reify(ab, [(node, "type", F.lit("Abundance"), "iri"), (node, "ofRun", run, "iri"), (run, "hasAbundance", node, "iri"), (node, "rank", F.col("rank"), "literal"), (node, "count", F.col("n"), "literal")])
    g = cut(g, "triples")  # read by three checks and the answer
    if not Q.conservation(ab, t.counts, ["profile"]).isEmpty():
        raise ValueError("counts are not conserved")
    there = G.fingerprint(g.where("p = 'ofRun'").select(F.col("s").alias("x"), F.col("o").alias("y")), ["x", "y"]).first()
    back = G.fingerprint(g.where("p = 'hasAbundance'").select(F.col("o").alias("x"), F.col("s").alias("y")), ["x", "y"]).first()
    if there != back:
        raise ValueError("inverse links differ")
    got = G.bgp(g, [G.Pattern("?a", "rank", "?rank"), G.Pattern("?a", "count", "?count")])
    return got.groupBy(F.col("rank").cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.col("count").cast("bigint")).alias("n"))


@query("pl26_product_exposures", """
    WITH d AS (SELECT event_type AS product, user_id % 25 AS site, CAST(ts AS DATE) AS date, round(sum(value), 2) AS v FROM events GROUP BY 1, 2, 3),
    o AS (SELECT event_id AS obs_id, user_id % 25 AS site, CAST(ts AS DATE) AS date FROM events),
    e AS (SELECT p.product, a, b, obs_id, CASE WHEN count(d.v) = b - a + 1 THEN sum(d.v) END AS x FROM o CROSS JOIN (SELECT DISTINCT product FROM d) p CROSS JOIN (VALUES (1, 3), (4, 7), (8, 14)) s(a, b)
      LEFT JOIN d ON d.product = p.product AND d.site = o.site AND d.date BETWEEN o.date - b AND o.date - a GROUP BY 1, 2, 3, 4)
    SELECT product, a AS from_lag, b AS to_lag, count(*) AS n, count(x) AS n_known, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(max(x), 4) AS high FROM e GROUP BY 1, 2, 3""")
def _(t):
    """Trailing exposures of every observation from each product's daily series, with their support."""
    series = F.concat_ws("/", F.col("product"), F.col("site").cast("string"))
    d = t.table("events").groupBy(F.col("event_type").alias("product"), (F.col("user_id") % 25).alias("site"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 2).alias("value"))
    products = d.select("product").distinct()
    obs = _obs(t).crossJoin(F.broadcast(products)).select("product", F.concat_ws("#", "obs_id", "product").alias("obs_id"), series.alias("site"), "date")
    e = J.exposure(obs, d.select(series.alias("site"), "date", "value"), [(1, 3), (4, 7), (8, 14)])
    e = e.withColumn("product", F.substring_index("obs_id", "#", -1))
    return R(e.groupBy("product", "from_lag", "to_lag").agg(N(), F.count("exposure").alias("n_known"), F.avg("exposure").alias("mean"), F.median("exposure").alias("median"), F.max("exposure").alias("high")), 4)


@query("pl26_gridded_products", sql("sites", """
    SELECT product, a AS from_lag, b AS to_lag, count(*) AS n, count(x) AS n_known, round(avg(x), 4) AS mean, round(max(x), 4) AS high, any_value(days) AS n_days FROM e JOIN (SELECT product, count(*) AS days FROM chosen GROUP BY 1) USING (product) GROUP BY 1, 2, 3""",
    chosen="SELECT DISTINCT event_type AS product, CAST(ts AS DATE) AS date FROM events WHERE day(ts) % 10 <> 3 AND day(ts) % 7 <> 0",
    grid="SELECT event_type AS product, CAST(ts AS DATE) AS date, user_id % 5 AS i, event_id % 5 AS j, round(sum(value), 2) AS v FROM events GROUP BY 1, 2, 3, 4",
    cell="""SELECT site, i, j FROM (SELECT site, a.r_regionkey AS i, b.r_regionkey AS j, row_number() OVER (PARTITION BY site ORDER BY abs(lat - a.r_regionkey * 2), a.r_regionkey, abs(lon - b.r_regionkey * 5), b.r_regionkey) AS r
      FROM sites CROSS JOIN region a CROSS JOIN region b) WHERE r = 1""",
    d="SELECT product, site, date, v FROM grid JOIN chosen USING (product, date) JOIN cell USING (i, j)",
    o="SELECT event_id AS obs_id, user_id % 25 AS site, CAST(ts AS DATE) AS date FROM events",
    e="""SELECT p.product, a, b, obs_id, CASE WHEN count(d.v) = b - a + 1 THEN sum(d.v) END AS x FROM o CROSS JOIN (SELECT DISTINCT product FROM chosen) p CROSS JOIN (VALUES (1, 2), (1, 5)) s(a, b)
      LEFT JOIN d ON d.product = p.product AND d.site = o.site AND d.date BETWEEN o.date - b AND o.date - a GROUP BY 1, 2, 3, 4"""))
def _(t):
    """Gridded products: one file a day is chosen (missing and doubled days are left out), each site takes the cell nearest
    on both axes, and every observation its trailing exposures from that cell's days."""
    e = t.table("events").withColumnRenamed("event_type", "product").withColumn("date", F.to_date("ts"))
    days = e.select("product", "date").distinct().withColumn("key", F.concat_ws("|", "product", F.col("date").cast("string")))
    copies = F.explode(F.when(F.dayofmonth("date") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    files = days.where("day(date) % 10 <> 3").select("key", copies.alias("i")).select("key", F.concat_ws("_", F.lit("f"), "key", "i").alias("path"))
    chosen = days.join(text.select_one_per_key(files, days.select("key")).where("status = 'ok'").select("key"), "key").select("product", "date")
    grid = e.groupBy("product", "date", (F.col("user_id") % 5).alias("i"), (F.col("event_id") % 5).alias("j")).agg(F.round(F.sum("value"), 2).alias("value"))
    axis = lambda name, step: t.table("region").select(F.col("r_regionkey").alias(name), (F.col("r_regionkey") * step).cast("double").alias("at"))
    cell = J.nearest_grid(J.nearest_grid(t.sites, axis("i", 2), "site", "lat", "i", "at"), axis("j", 5), "site", "lon", "j", "at").select("site", "i", "j")
    own = F.concat_ws("/", F.col("product"), F.col("site").cast("string"))
    series = grid.join(chosen, ["product", "date"]).join(F.broadcast(cell), ["i", "j"]).select(own.alias("site"), "date", "value")
    obs = _obs(t).join(F.broadcast(chosen.select("product").distinct())).select("product", F.concat_ws("#", "obs_id", "product").alias("obs_id"), own.alias("site"), "date")
    x = J.exposure(obs, series, [(1, 2), (1, 5)]).withColumn("product", F.substring_index("obs_id", "#", -1))
    n_days = chosen.groupBy("product").agg(F.count(F.lit(1)).alias("n_days"))
    g = x.groupBy("product", "from_lag", "to_lag").agg(N(), F.count("exposure").alias("n_known"), F.avg("exposure").alias("mean"), F.max("exposure").alias("high"))
    return R(g.join(F.broadcast(n_days), "product"), 4)
