"""Queries over aggregations and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import compositional as C
from quadrat.operators import agg as A
from quadrat.operators import keys as K
from quadrat.plans.roles import registry, sql

QUERIES, query = registry()
N = lambda: F.count(F.lit(1)).alias("n")
R = lambda df, digits=6, **k: df.withColumns({c: F.round(F.col(c) + 0.0, digits) for c, kind in df.dtypes if kind == "double"})

_ALPHA = "SELECT profile, CAST(sum(n) AS BIGINT) AS depth, count(*) AS richness, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS shannon FROM counts GROUP BY 1"
_DEPTH = "SELECT CAST(greatest(floor(quantile_cont(depth, 0.05) / 1000) * 1000, 1000) AS BIGINT) AS d FROM alpha"
_RARE = """SELECT profile, CASE WHEN max(t) >= max(d) THEN sum(CASE WHEN t - n < d THEN 1.0 ELSE 1 - exp(lgamma(t - n + 1.0) - lgamma(t - n - d + 1.0) - lgamma(t + 1.0) + lgamma(t - d + 1.0)) END) END AS rarefied
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY profile) AS BIGINT) AS t FROM counts), depth WHERE true GROUP BY 1"""


@query("agg1_alpha_basic", sql("counts", "SELECT profile, depth, richness, round(shannon, 6) AS shannon FROM alpha", alpha=_ALPHA))
def _(t):
    return R(A.alpha_basic(t.counts))


@query("agg2_rarefied_richness", sql("counts", "SELECT profile, round(rarefied, 4) AS rarefied FROM rare", depth="SELECT 5000 AS d", rare=_RARE.replace("t - n < d", "t < d OR t - n < d")))
def _(t):
    return A.rarefied_richness(t.counts, 5000).withColumn("rarefied", F.round("rarefied", 4))


@query("agg3_evenness", sql("counts", "SELECT profile, CASE WHEN richness > 1 THEN round(shannon / ln(richness), 6) END AS pielou FROM alpha", alpha=_ALPHA))
def _(t):
    return A.alpha_basic(t.counts).select("profile", F.round(A.evenness(F.col("shannon"), F.col("richness")), 6).alias("pielou"))


@query("agg4_choose_depth", sql("counts", "SELECT d AS depth_choice FROM depth", alpha=_ALPHA, depth=_DEPTH))
def _(t):
    return A.choose_depth(A.alpha_basic(t.counts))


def rarefied_parts(seed: int, depth: int) -> dict[str, str]:
    """``rarefied`` (profile, feature, n): numbers drawn by md5 over features in order of their part."""
    return {
        "laid": f"""SELECT *, sum(n) OVER (PARTITION BY profile ORDER BY part, feature) - n AS start, sum(n) OVER (PARTITION BY profile) AS t
          FROM (SELECT *, CAST('0x' || substr(md5('{seed}|' || feature), 1, 8) AS BIGINT) % 64 AS part FROM counts WHERE n > 0) QUALIFY t >= {depth}""",
        "tried": f"""SELECT profile, k, spot, min(i) AS i FROM (SELECT profile, k, i, CAST('0x' || substr(md5('{seed}|' || profile || '|' || i), 1, 15) AS BIGINT) % t AS spot
          FROM (SELECT profile, t, least({depth}, t - {depth}) AS k, unnest(range(1, CAST(2 * least({depth}, t - {depth}) + 201 AS BIGINT))) AS i FROM (SELECT DISTINCT profile, CAST(t AS BIGINT) AS t FROM laid))) GROUP BY 1, 2, 3""",
        "drawn": "SELECT profile, spot FROM tried QUALIFY row_number() OVER (PARTITION BY profile ORDER BY i) <= k",
        "rarefied": f"""SELECT profile, feature, n FROM (SELECT c.profile, c.feature, CAST(CASE WHEN any_value(t) - {depth} < {depth} THEN any_value(n) - count(spot) ELSE count(spot) END AS BIGINT) AS n
          FROM laid c LEFT JOIN drawn d ON d.profile = c.profile AND d.spot >= c.start AND d.spot < c.start + c.n GROUP BY 1, 2) WHERE n > 0""",
    }


@query("agg5_rarefy", sql("counts", "SELECT * FROM rarefied", **rarefied_parts(7, 2000)))
def _(t):
    return A.rarefy(t.counts, 2000, seed=7)


@query("agg6_collapse_rank", sql("counts taxonomy", "SELECT profile, r2 AS taxon, CAST(sum(n) AS BIGINT) AS n FROM counts JOIN taxonomy USING (feature) GROUP BY 1, 2"))
def _(t):
    return A.collapse_rank(t.counts, t.taxonomy, 2)


@query("agg7_abundance_by_rank", sql("counts taxonomy", """
    SELECT profile, rank, taxon, CAST(sum(n) AS BIGINT) AS n, min(label) AS label, round(sum(n) / sum(sum(n)) OVER (PARTITION BY profile, rank), 9) AS relative FROM (
      SELECT profile, n, 1 AS rank, r1 AS taxon, r1 AS label FROM counts JOIN taxonomy USING (feature)
      UNION ALL SELECT profile, n, 2, r1 || ';' || r2, r2 FROM counts JOIN taxonomy USING (feature)
      UNION ALL SELECT profile, n, 3, r1 || ';' || r2 || ';' || r3, r3 FROM counts JOIN taxonomy USING (feature)) GROUP BY profile, rank, taxon"""))
def _(t):
    return R(A.abundance_by_rank(t.counts, t.taxonomy, 3), 9)


@query("agg8_collapse_replicates", sql("counts profiles", """
    SELECT site, round(avg(shannon), 6) AS shannon, CAST(sum(depth) AS BIGINT) AS depth, count(*) AS n_profiles FROM alpha JOIN profiles USING (profile) GROUP BY 1""", alpha=_ALPHA))
def _(t):
    return R(A.collapse_replicates(A.alpha_basic(t.counts).join(t.profiles, "profile"), ["site"], ["shannon"], ["depth"]))


@query("agg9_grouped_counts", sql("phyla", """
    SELECT site, campaign, position, taxon, CAST(n AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY site, campaign, position) AS total FROM phyla) WHERE total >= 4000"""))
def _(t):
    return A.grouped_counts(t.phyla, ["site", "campaign", "position"], "taxon", 4000)


@query("agg9_group_accounting", sql("phyla", """
    SELECT count(*) AS groups_in, count(*) FILTER (r >= 4000) AS groups_kept, count(*) FILTER (r < 4000) AS groups_dropped, CAST(sum(r) AS BIGINT) AS reads_in, CAST(coalesce(sum(r) FILTER (r >= 4000), 0) AS BIGINT) AS reads_kept
    FROM (SELECT sum(n) AS r FROM phyla GROUP BY site, campaign, position)"""))
def _(t):
    return A.group_accounting(t.phyla, ["site", "campaign", "position"], 4000)


@query("agg10_merge_duplicates", sql("brands", """
    SELECT 's' || (profile % 7) AS id, taxon, round(sum(n) / any_value(k), 6) AS n, any_value(k) AS n_merged FROM brands
    JOIN (SELECT profile % 7 AS g, count(DISTINCT profile) AS k FROM brands GROUP BY 1) ON g = profile % 7 GROUP BY 1, 2"""))
def _(t):
    df = t.brands.withColumn("id", F.concat(F.lit("e"), F.col("profile").cast("string")))
    norm = F.concat(F.lit("s"), (F.regexp_replace("id", "^e", "").cast("int") % 7).cast("string"))
    return R(A.merge_duplicates(df, "id", norm, "taxon", "n"))


_RED = "max(value) FILTER (value > 20) AS max_positive, avg(value) FILTER (value > 20) AS mean_positive, median(value) FILTER (value > 20) AS median_positive, arg_min(v2, (ts, event_id)) AS first, arg_max(v2, (ts, event_id)) AS last, count(*) AS n_readings"
_READ = "SELECT sample, analyte, value - 20 AS value, ts, event_id FROM readings"
_REDUCED = """SELECT sample, analyte, max(value) FILTER (value > 0) AS max_positive, avg(value) FILTER (value > 0) AS mean_positive, median(value) FILTER (value > 0) AS median_positive,
    max(value) FILTER (r = 1) AS first, max(value) FILTER (q = 1) AS last, count(*) AS n_readings FROM (
    SELECT *, row_number() OVER (PARTITION BY sample, analyte ORDER BY ts, event_id) AS r, row_number() OVER (PARTITION BY sample, analyte ORDER BY ts DESC, event_id DESC) AS q FROM shifted) GROUP BY 1, 2"""


def _reduced(t):
    rows = t.readings.withColumn("value", F.col("value") - 20)
    return A.all_reductions(rows, ["sample", "analyte"], "value", F.struct("ts", "event_id"))


@query("agg11_reduce_readings", sql("readings", "SELECT sample, analyte, round(max_positive, 6) AS max_positive, round(mean_positive, 6) AS mean_positive, round(median_positive, 6) AS median_positive, round(first, 6) AS first, round(last, 6) AS last, n_readings FROM red", shifted=_READ, red=_REDUCED))
def _(t):
    return R(_reduced(t))


@query("agg12_reduction_sensitivity", sql("readings", """
    SELECT analyte, rule, count(*) AS n, count(*) FILTER (n_readings > 1) AS n_multi, count(*) FILTER (abs(v - p) > 1e-9) AS n_differ,
           round(median(CASE WHEN p <> 0 THEN abs(v - p) / abs(p) END), 6) AS median_rel_diff, round(max(CASE WHEN p <> 0 THEN abs(v - p) / abs(p) END), 6) AS max_rel_diff FROM (
      SELECT analyte, n_readings, median_positive AS p, 'max_positive' AS rule, max_positive AS v FROM red UNION ALL SELECT analyte, n_readings, median_positive, 'mean_positive', mean_positive FROM red
      UNION ALL SELECT analyte, n_readings, median_positive, 'first', first FROM red UNION ALL SELECT analyte, n_readings, median_positive, 'last', last FROM red) GROUP BY 1, 2""", shifted=_READ, red=_REDUCED))
def _(t):
    return R(A.reduction_sensitivity(_reduced(t), "analyte", "median_positive", ["max_positive", "mean_positive", "first", "last"]))


@query("agg13_monthly", sql("daily", "SELECT site, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, round(avg(value), 3) AS mean_value, round(sum(value), 3) AS sum_value, count(*) AS n_days FROM daily GROUP BY 1, 2, 3"))
def _(t):
    return A.monthly(t.daily, ["value"], ["value"])


@query("agg14_site_climatology", sql("daily", "SELECT site, round(avg(v), 4) AS value, count(*) AS n_months FROM (SELECT site, date - CAST((day(date) - 1) % 10 AS INTEGER) AS m, avg(value) AS v FROM daily GROUP BY 1, 2) GROUP BY 1"))
def _(t):
    per = t.daily.groupBy("site", F.date_sub("date", (F.dayofmonth("date") - 1) % 10).alias("m")).agg(F.avg("value").alias("value"))
    return R(A.site_climatology(per, ["value"]), 4)


@query("agg15_feature_inventory", """
    WITH a AS (SELECT DISTINCT l_returnflag AS kind, l_partkey AS term FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_returnflag AS kind, l_partkey AS term FROM lineitem WHERE l_linestatus = 'O')
    SELECT kind, count(a.term) AS n_a, count(b.term) AS n_b, count(*) FILTER (a.term IS NOT NULL AND b.term IS NOT NULL) AS shared, count(*) FILTER (b.term IS NULL) AS only_a, count(*) FILTER (a.term IS NULL) AS only_b
    FROM (SELECT DISTINCT kind, term FROM a UNION SELECT kind, term FROM b) u LEFT JOIN a USING (kind, term) LEFT JOIN b USING (kind, term) GROUP BY 1""")
def _(t):
    x = t.table("lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("term"), "l_linestatus")
    return A.feature_inventory(x.where("l_linestatus = 'F'"), x.where("l_linestatus = 'O'"), "term", "kind")


@query("agg16_trait_prevalence", """
    SELECT p_type, p_brand, count(*) AS n, count(*) FILTER (p_size > 25) AS n_positive, count(*) FILTER (p_retailprice > 1200) AS n_good, count(*) FILTER (p_size > 25 AND p_retailprice > 1200) AS n_good_positive, round(100.0 * count(*) FILTER (p_size > 25) / count(*), 6) AS percent
    FROM part GROUP BY ROLLUP (p_type, p_brand)""")
def _(t):
    return R(A.trait_prevalence(t.table("part"), ["p_type", "p_brand"], F.col("p_size") > 25, F.col("p_retailprice") > 1200))


@query("agg17_concordance", """
    SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn,
           round(avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def _(t):
    df = t.table("labels").join(t.table("documents").select("doc_id", "lang"), "doc_id")
    return R(A.concordance(df, F.col("quality") == 1, F.col("toxic") == 0, ["lang"]))


@query("agg18_role_presence", sql("counts profiles", """
    SELECT feature, count(*) FILTER (is_control) AS in_controls, count(*) FILTER (NOT is_control) AS in_samples, CAST(coalesce(sum(n) FILTER (is_control), 0) AS BIGINT) AS reads_controls, CAST(coalesce(sum(n) FILTER (NOT is_control), 0) AS BIGINT) AS reads_samples
    FROM counts JOIN profiles USING (profile) GROUP BY 1"""))
def _(t):
    return A.role_presence(t.counts.join(t.profiles, "profile"), "is_control")


@query("agg18_removal_summary", sql("counts profiles", """
    SELECT site, count(*) AS profiles, round(avg(r / t), 6) AS mean_share, round(median(r / t), 6) AS median_share, round(max(r / t), 6) AS max_share, round(sum(r) / sum(t), 6) AS pooled_share FROM (
      SELECT site, profile, CAST(sum(n) AS DOUBLE) AS t, CAST(coalesce(sum(n) FILTER (feature % 9 = 0), 0) AS DOUBLE) AS r FROM counts JOIN profiles USING (profile) GROUP BY 1, 2) GROUP BY 1"""))
def _(t):
    called = t.table("part").where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("feature"))
    return R(A.removal_summary(t.counts.join(t.profiles, "profile"), called, "site"))


@query("agg19_scenario_grid", sql("counts", """
    SELECT threshold, min_support, count(*) FILTER (score < threshold AND support >= min_support) AS n_called FROM (SELECT feature, avg(n) / 100 AS score, count(*) AS support FROM counts GROUP BY 1)
    CROSS JOIN (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.26 AS DOUBLE)), (CAST(0.3 AS DOUBLE))) t(threshold) CROSS JOIN (VALUES (1), (25), (30)) s(min_support) GROUP BY 1, 2"""))
def _(t):
    s = t.counts.groupBy("feature").agg((F.avg("n") / 100).alias("score"), F.count(F.lit(1)).alias("support"))
    return A.scenario_grid(s, "score", "support", [0.25, 0.26, 0.3], [1, 25, 30])


@query("agg20_sum_limit", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 2500000")
def _(t):
    return A.sum_limit(t.table("orders"), ["o_custkey"], "o_totalprice", 2_500_000).withColumn("total", F.round("total", 2))


@query("agg21_ledger", """
    SELECT in_ordered, in_urgent, in_rich, count(*) AS n FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS in_ordered, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS in_urgent, c_acctbal > 5000 AS in_rich FROM customer)
    GROUP BY CUBE (in_ordered, in_urgent, in_rich)""")
def _(t):
    c, o = t.table("customer").withColumnRenamed("c_custkey", "k"), t.table("orders").withColumnRenamed("o_custkey", "k")
    ledger = A.build_ledger(c, {"ordered": o, "urgent": o.where("o_orderpriority = '1-URGENT'"), "rich": c.where("c_acctbal > 5000")}, "k")
    return A.ledger_counts(ledger, ["in_ordered", "in_urgent", "in_rich"])


@query("agg22_duplicate_audit", sql("brands profiles", """
    SELECT p.a, p.b, sum(x) AS depth_a, sum(y) AS depth_b, count(*) FILTER (x > 0) AS features_a, count(*) FILTER (y > 0) AS features_b, count(*) FILTER (x > 0 AND y > 0) AS shared, bool_and(x = y) AS equal, round(corr(x, y), 6) AS pearson FROM (
      SELECT p.a, p.b, u.taxon, CAST(coalesce(m.n, 0) AS DOUBLE) AS x, CAST(coalesce(k.n, 0) AS DOUBLE) AS y FROM pairs p JOIN (SELECT DISTINCT taxon FROM brands) u ON true
      LEFT JOIN brands m ON m.profile = p.a AND m.taxon = u.taxon LEFT JOIN brands k ON k.profile = p.b AND k.taxon = u.taxon WHERE m.n IS NOT NULL OR k.n IS NOT NULL) p GROUP BY 1, 2""",
    pairs="SELECT a.profile AS a, b.profile AS b FROM profiles a JOIN profiles b ON a.site = b.site AND a.profile < b.profile"))
def _(t):
    return R(A.duplicate_audit(t.brands, t.profiles, "site", feature="taxon"))


@query("agg23_numeric_profile", "SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(t):
    return A.numeric_profile(t.table("events"), "event_type", "value").withColumn("total", F.round("total", 2))


@query("agg24_summarize", """
    SELECT coalesce(event_type, 'all') AS event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY ROLLUP (event_type)""")
def _(t):
    return R(A.summarize(t.table("events"), "event_type", "value"))


@query("agg25_replicate_cv", sql("readings", """
    SELECT analyte, count(*) AS n_sites, round(median(cv), 6) AS median_cv, round(quantile_cont(cv, 0.95), 6) AS p95_cv FROM (SELECT sample, analyte, stddev_samp(value) / avg(value) AS cv FROM readings GROUP BY 1, 2 HAVING count(*) > 1 AND avg(value) > 0) GROUP BY 1"""))
def _(t):
    return R(A.replicate_cv(t.readings, "sample", "analyte", "value"))


@query("agg26_trait_table", """
    SELECT s_suppkey, CAST(coalesce(a, 0) AS BIGINT) AS high, CAST(coalesce(b, 0) AS BIGINT) AS low, coalesce(a, 0) > 5 AS is_positive, s_acctbal > 5000 AS is_good FROM supplier
    LEFT JOIN (SELECT l_suppkey, count(*) AS a FROM lineitem WHERE l_quantity > 49 GROUP BY 1) x ON x.l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey, count(*) AS b FROM lineitem WHERE l_quantity < 2 GROUP BY 1) y ON y.l_suppkey = s_suppkey""")
def _(t):
    li = t.table("lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    m = lambda cond: li.where(cond).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("value"))
    out = A.trait_table(t.table("supplier"), {"high": m("l_quantity > 49"), "low": m("l_quantity < 2")}, "s_suppkey", F.col("high") > 5, F.col("s_acctbal") > 5000)
    return out.select("s_suppkey", "high", "low", "is_positive", "is_good")


@query("agg27_rule_inventory", """
    SELECT DISTINCT p_brand AS rule, CASE WHEN p_size % 2 = 0 THEN p_type || ';even' ELSE p_type END AS constituents, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n_constituents FROM part
    WHERE p_type < 'even'
    UNION ALL SELECT DISTINCT p_brand, CASE WHEN p_size % 2 = 0 THEN 'even;' || p_type ELSE p_type END, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END FROM part WHERE p_type >= 'even'""")
def _(t):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("'"), "p_type", F.lit("' & ('even' | '"), "p_type", F.lit("')"))).otherwise(F.concat(F.lit("'"), "p_type", F.lit("'")))
    return A.rule_inventory(t.table("part").select(F.col("p_brand").alias("rule"), text.alias("text")))


@query("fn2_clr", sql("phyla", """
    SELECT site, campaign, position, taxon, CAST(n AS BIGINT) AS n, round(ln(n + 0.5) - avg(ln(n + 0.5)) OVER (PARTITION BY site, campaign, position), 6) AS clr FROM (
      SELECT g.*, u.taxon, coalesce(p.n, 0) AS n FROM (SELECT DISTINCT site, campaign, position FROM phyla) g CROSS JOIN (SELECT DISTINCT taxon FROM phyla) u LEFT JOIN phyla p USING (site, campaign, position, taxon))"""))
def _(t):
    return R(C.clr(t.phyla, ["site", "campaign", "position"], "taxon"))


@query("fn3_clr_multiplicative", sql("counts_pos taxonomy", """
    SELECT u, taxon, CAST(n AS BIGINT) AS n, round(ln(x) - avg(ln(x)) OVER (PARTITION BY u), 6) AS clr FROM (
      SELECT *, CASE WHEN n = 0 THEN 0.65 / t ELSE n / t * (1 - z * 0.65 / t) END AS x FROM (
        SELECT *, CAST(sum(n) OVER (PARTITION BY u) AS DOUBLE) AS t, count(*) FILTER (n = 0) OVER (PARTITION BY u) AS z FROM (
          SELECT g.u, x.taxon, coalesce(p.n, 0) AS n FROM (SELECT DISTINCT u FROM cells) g CROSS JOIN (SELECT DISTINCT taxon FROM cells) x LEFT JOIN cells p USING (u, taxon))))""",
    cells="SELECT profile || '/' || campaign || '/' || position AS u, r2 AS taxon, sum(n) AS n FROM counts_pos JOIN taxonomy USING (feature) GROUP BY 1, 2"))
def _(t):
    cells = A.collapse_rank(t.counts_pos.withColumn("u", F.concat_ws("/", F.col("profile").cast("string"), F.col("campaign").cast("string"), "position")), t.taxonomy, 2, profile=["u"])
    return R(C.clr(cells, ["u"], "taxon", zero="multiplicative"))


@query("fn4_guild_logratio", sql("brands", """
    SELECT profile, round(ln((coalesce(sum(n) FILTER (taxon IN ('Brand#11', 'Brand#12', 'Brand#13')), 0) + 0.5) / (coalesce(sum(n) FILTER (taxon NOT IN ('Brand#11', 'Brand#12', 'Brand#13')), 0) + 0.5)), 6) AS log_ratio FROM brands GROUP BY 1"""))
def _(t):
    return R(C.guild_logratio(t.brands, ["profile"], "taxon", ["Brand#11", "Brand#12", "Brand#13"]))


@query("fn5_relative", sql("brands", "SELECT profile, taxon, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY profile), 9) AS rel FROM brands"))
def _(t):
    return R(C.relative(t.brands, ["profile"]), 9)


@query("fn6_transect", sql("sites", """
    SELECT site, round(x * cos(a) + y * sin(a), 6) AS position FROM km, (SELECT 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM km)""",
    km="SELECT site, (lon - (SELECT avg(lon) FROM sites)) * 111.320 * cos(radians((SELECT avg(lat) FROM sites))) AS x, (lat - (SELECT avg(lat) FROM sites)) * 110.574 AS y FROM sites"))
def _(t):
    return R(C.transect(t.sites).select("site", "position"))


@query("fn7_haversine", sql("sites", """
    SELECT a.site AS a, b.site AS b, round(2 * 6371.0088 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))), 6) AS km
    FROM sites a JOIN sites b ON a.site < b.site"""))
def _(t):
    from quadrat.functions.numeric import haversine_km
    from quadrat.operators.joins import pairs

    return pairs(t.sites, "site", keep=["lat", "lon"]).select("a", "b", F.round(haversine_km("lat_a", "lon_a", "lat_b", "lon_b"), 6).alias("km"))


@query("fn8_pulse_exposure", sql("daily", """
    SELECT obs_id, peak, round(sum(d.value * (lag / peak) * exp(1 - lag / peak)), 4) AS exposure FROM (SELECT event_id AS obs_id, user_id % 25 AS site, CAST(ts AS DATE) AS date FROM events) obs
    CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(1, 15)) CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(2.0 AS DOUBLE)), (CAST(7.5 AS DOUBLE))) k(peak) LEFT JOIN daily d ON d.site = obs.site AND d.date = obs.date - lag GROUP BY 1, 2"""))
def _(t):
    from quadrat.operators.joins import lag_matrix

    obs = t.table("events").select(F.col("event_id").alias("obs_id"), (F.col("user_id") % 25).alias("site"), F.to_date("ts").alias("date"))
    return R(C.pulse_exposure(lag_matrix(obs, t.daily, 14), "obs_id", "lag", "value", [0.5, 2.0, 7.5]), 4)


@query("fn11_design", sql("sites", """
    SELECT *, CAST(1 AS DOUBLE) AS one, lat * lat AS lat_2, lat * lon AS lat_x_lon, CAST(block = 1 AS DOUBLE) AS block_is_1, CAST(block = 2 AS DOUBLE) AS block_is_2,
      CAST(block = 3 AS DOUBLE) AS block_is_3, CAST(block = 4 AS DOUBLE) AS block_is_4 FROM sites"""))
def _(t):
    return C.design(t.sites, numeric=["lat", "lon"], factors=["block"], quadratic=["lat"], interactions=[("lat", "lon")])


@query("pl1_alpha_cache", sql("counts profiles", """
    SELECT site, count(*) AS n_profiles, CAST(sum(depth) AS BIGINT) AS depth, round(avg(shannon), 6) AS shannon, round(avg(rarefied), 4) AS rarefied, round(avg(CASE WHEN rarefied > 1 THEN shannon / ln(rarefied) END), 6) AS pielou
    FROM alpha JOIN rare USING (profile) JOIN profiles USING (profile) WHERE NOT is_control GROUP BY 1""", alpha=_ALPHA, depth=_DEPTH, rare=_RARE.replace("t - n < d", "t < d OR t - n < d")))
def _(t):
    """Count table to alpha diversity of sites: depth choice, rarefaction, evenness, replicate collapse."""
    counts = K.min_depth(t.counts, 1)
    alpha = A.alpha_basic(counts)
    depth = A.choose_depth(alpha).first()[0]
    rare = A.rarefied_richness(counts, depth)
    table = alpha.join(rare, "profile").join(t.profiles.where("not is_control"), "profile").withColumn("pielou", A.evenness(F.col("shannon"), F.col("rarefied")))
    out = A.collapse_replicates(table, ["site"], ["shannon", "rarefied", "pielou"], ["depth"])
    return out.withColumns({"shannon": F.round("shannon", 6), "pielou": F.round("pielou", 6), "rarefied": F.round("rarefied", 4)})
