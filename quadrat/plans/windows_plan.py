"""Queries over windows, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import windows as W
from quadrat.plans.roles import registry, sql

QUERIES, query = registry()
R = lambda df, digits=6: df.withColumns({c: F.round(F.col(c) + 0.0, digits) for c, kind in df.dtypes if kind == "double"})
N = lambda: F.count(F.lit(1)).alias("n")


@query("win1_rank_taxa", sql("brands", """
    SELECT taxon, round(mean_rel, 9) AS mean_rel, round(prevalence, 9) AS prevalence, row_number() OVER (ORDER BY round(mean_rel, 12) DESC, taxon) AS rank FROM (
      SELECT taxon, sum(n / t) / (SELECT count(DISTINCT profile) FROM brands) AS mean_rel, count(DISTINCT profile) / (SELECT CAST(count(DISTINCT profile) AS DOUBLE) FROM brands) AS prevalence
      FROM (SELECT *, sum(n) OVER (PARTITION BY profile) AS t FROM brands) GROUP BY 1) WHERE prevalence >= 0.2"""))
def _(t):
    from quadrat.functions.compositional import relative

    total = t.brands.select("profile").distinct().count()
    return R(W.rank_taxa(relative(t.brands, ["profile"]), total, 0.2), 9)


@query("win2_avg_rank", """
    SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY event_type, round(value, 0)) - 1) / 2.0 AS mid_rank FROM events""")
def _(t):
    return t.table("events").withColumn("v", F.round("value", 0)).select("event_id", W.avg_rank(["event_type"], "v").alias("mid_rank"))


@query("win3_zscore", """
    SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)""")
def _(t):
    return R(t.table("events").select("event_id", W.zscore_within(["event_type"], "value").alias("z")))


@query("win4_center", sql("phyla", "SELECT site, campaign, position, taxon, round(n - avg(n) OVER (PARTITION BY campaign, position, taxon), 6) AS n FROM phyla"))
def _(t):
    return R(W.center_within(t.phyla, ["campaign", "position", "taxon"], ["n"]))


@query("win5_prefix_sum", sql("daily", "SELECT site, date, round(sum(value) OVER (PARTITION BY site ORDER BY date), 2) AS running FROM daily"))
def _(t):
    return t.daily.select("site", "date", F.round(W.prefix_sum(["site"], "date", "value"), 2).alias("running"))


@query("win6_elapsed", """
    SELECT event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id % 5))) / 3.6e9, 9) AS elapsed_hours FROM events""")
def _(t):
    e = t.table("events").withColumn("campaign", F.col("user_id") % 5)
    return R(W.elapsed_hours(e, "campaign", "ts").select("event_id", "elapsed_hours"), 9)


@query("win7_blocks", """
    SELECT p_partkey, CAST(floor((row_number() OVER w - 1) * 7 / count(*) OVER (PARTITION BY p_brand)) AS INTEGER) AS block FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)""")
def _(t):
    return t.table("part").select("p_partkey", W.contiguous_blocks(["p_brand"], ["p_retailprice", "p_partkey"], 7).alias("block"))


@query("win8_route_maps", sql("sites", """
    SELECT s.shift, f.reflected, a.site, b.site AS mapped_site FROM r a CROSS JOIN (SELECT i AS shift FROM r) s CROSS JOIN (VALUES (0), (1)) f(reflected)
    JOIN r b ON b.i = (CASE WHEN reflected = 1 THEN (SELECT count(*) FROM r) - 1 - a.i ELSE a.i END + s.shift) % (SELECT count(*) FROM r)""", r="SELECT site, row_number() OVER (ORDER BY lon, site) - 1 AS i FROM sites"))
def _(t):
    return W.route_maps(t.sites, ["lon", "site"])


@query("win9_bh_fdr", """
    WITH p AS (SELECT p_brand AS family, p_partkey AS id, (p_partkey * 7919 % 1000 + 1) / CAST(20000 AS DOUBLE) AS p FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS n FROM p)
    SELECT family, id, round(p, 9) AS p, round(least(1.0, min(p * n / k) OVER (PARTITION BY family ORDER BY k DESC)), 9) AS q, round(least(1.0, p * n), 9) AS q_bonferroni FROM k""")
def _(t):
    p = t.table("part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919 % 1000 + 1) / 20000.0).alias("p"))
    return R(W.with_bh(p, "p", ["family"], ["id"]), 9)


@query("win10_distance_class", sql("sites", """
    SELECT a, b, 1 + CAST(list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda i: CASE WHEN d > e[i] THEN 1 ELSE 0 END)) AS INTEGER) AS class FROM d, (SELECT quantile_cont(d, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM d)""",
    d="SELECT a.site AS a, b.site AS b, abs(a.lon - b.lon) AS d FROM sites a JOIN sites b ON a.site < b.site"))
def _(t):
    from quadrat.operators.joins import pairs

    d = pairs(t.sites, "site", keep=["lon"]).select("a", "b", F.abs(F.col("lon_a") - F.col("lon_b")).alias("d"))
    return W.distance_class(d, "d", 10).select("a", "b", "class")


@query("win11_cumulative_share", """
    SELECT p_brand, round(v, 4) AS v, row_number() OVER (ORDER BY v DESC, p_brand) AS axis, round(sum(v) OVER (ORDER BY v DESC, p_brand) / sum(v) OVER (), 6) AS cumulative FROM (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1)""")
def _(t):
    b = t.table("part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 4).alias("v"))
    return R(W.cumulative_share(b, "v", [F.desc("v"), F.col("p_brand")], 0.8).select("p_brand", "v", "axis", "cumulative"))


@query("win12_keep_first", """
    SELECT o_custkey, o_orderkey, CASE WHEN n > 1 THEN o_custkey || '__lib' || i ELSE CAST(o_custkey AS VARCHAR) END AS library FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i = 1""")
def _(t):
    named = W.library_suffix(t.table("orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return W.keep_first(named, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "library")


@query("top1_top_k", sql("counts", "SELECT feature, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200"))
def _(t):
    return W.top_k(t.counts.groupBy("feature").agg(F.sum("n").alias("n")), 200, [F.desc("n"), F.col("feature")])


@query("top2_ordered_result", """
    SELECT p_brand, n, row_number() OVER (ORDER BY CAST(n AS BIGINT) DESC, p_brand) AS place FROM (SELECT p_brand, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1)""")
def _(t):
    from quadrat.operators.keys import row_numbers

    text = t.table("part").groupBy("p_brand").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return row_numbers(text, [F.col("n").cast("bigint").desc(), F.col("p_brand")], out="place").select("p_brand", "n", F.col("place").cast("bigint").alias("place"))


_RUNS = "SELECT user_id % 25 AS site, user_id AS run, event_type AS analyte, avg(value) AS v FROM events GROUP BY 1, 2, 3"


@query("top3_best_pair", f"""
    WITH x AS ({_RUNS}), r AS (SELECT a.site, a.run AS a, b.run AS b, corr(a.v, b.v) AS r, count(*) AS n_shared FROM x a JOIN x b ON a.site = b.site AND a.analyte = b.analyte AND a.run < b.run GROUP BY 1, 2, 3)
    SELECT site, a, b, round(r, 6) AS r, n_shared FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(r, 9) DESC NULLS LAST, a, b) AS k FROM r) WHERE k = 1""")
def _(t):
    x = t.table("events").groupBy((F.col("user_id") % 25).alias("site"), F.col("user_id").alias("run"), F.col("event_type").alias("analyte")).agg(F.avg("value").alias("v"))
    return R(W.best_pair(x, "site", "run", "analyte", "v"))


@query("top4_examples", """
    SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events) WHERE r <= 5""")
def _(t):
    return W.examples(t.table("events"), "event_type", 5, ["value", "event_id"]).select("event_type", "event_id")


@query("set1_union_shared", """
    SELECT kind, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY 1""")
def _(t):
    c = t.table("customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = t.table("supplier").select("s_name", F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    return W.union_shared(c, s).groupBy("kind").agg(N(), F.round(F.sum("balance"), 2).alias("balance"))


@query("set2_shared_ids", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 50 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 1")
def _(t):
    li = t.table("lineitem").withColumnRenamed("l_partkey", "k")
    return W.shared_ids(li.where("l_quantity = 50"), li.where("l_quantity = 1"), "k")


@query("set3_multiset_diff", """
    WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 AND l_linenumber <> 3 GROUP BY 1)
    SELECT k, CAST(coalesce(a.n, 0) AS BIGINT) AS n_left, CAST(coalesce(b.n, 0) AS BIGINT) AS n_right FROM a FULL JOIN b USING (k) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(t):
    li = t.table("lineitem").select(F.col("l_partkey").alias("k"), "l_linenumber")
    return W.multiset_diff(li.where("l_linenumber <= 3").select("k"), li.where("l_linenumber <= 4 and l_linenumber <> 3").select("k"))


@query("set4_graph_delta", sql("triples", """
    SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM triples WHERE p IN ('type', 'partOf', 'label') EXCEPT SELECT s, p, o FROM triples WHERE p IN ('type', 'locatedIn')) GROUP BY 1"""))
def _(t):
    g = t.triples.select("s", "p", "o")
    whole = W.graph_add(g.where("p in ('type', 'partOf')"), g.where("p in ('label', 'type')"))
    return W.graph_delta(g.where("p in ('type', 'locatedIn')"), whole).groupBy("p").agg(N())


@query("set5_jaccard", sql("counts_pos", """
    SELECT campaign, count(*) FILTER (a AND b) AS shared, count(*) AS either, round(count(*) FILTER (a AND b) / CAST(count(*) AS DOUBLE), 6) AS jaccard FROM (
      SELECT campaign, profile, feature, bool_or(position = 'A') AS a, bool_or(position = 'R') AS b FROM counts_pos WHERE position IN ('A', 'R') GROUP BY 1, 2, 3) GROUP BY 1"""))
def _(t):
    c = t.counts_pos
    return R(W.jaccard(c.where("position = 'A'"), c.where("position = 'R'"), ["profile", "feature"], ["campaign"]))
