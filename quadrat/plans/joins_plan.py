"""Queries over the join meanings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import joins as J
from quadrat.plans.roles import registry, sql

QUERIES, query = registry()
N = lambda: F.count(F.lit(1)).alias("n")


@query("jn1_checked_join", """
    SELECT n_regionkey AS block, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    s = t.table("supplier").withColumnRenamed("s_nationkey", "site").withColumn("block", F.lit(None).cast("int"))
    n = t.table("nation").select(F.col("n_nationkey").alias("site"), F.col("n_regionkey").alias("region"))
    return J.checked_join(s.drop("block"), n, ["site"], card="m:1").groupBy(F.col("region").alias("block")).agg(N(), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("jn2_lookup", """
    SELECT p_brand AS brand, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    li = t.table("lineitem").select(F.col("l_partkey").alias("k"), "l_quantity")
    return J.lookup(li, t.table("part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand")), ["k"]).groupBy("brand").agg(N(), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("jn3_anti_keys", """
    SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(t):
    c = t.table("customer").select(F.col("c_custkey").alias("k"))
    return J.anti_keys(c, t.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), ["k"])


@query("jn4_reconcile_keys", """
    WITH a AS (SELECT l_partkey AS k, l_suppkey AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_partkey AS k, l_suppkey AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT k, s, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN b.n IS NULL THEN 'left' WHEN a.n IS NULL THEN 'right' ELSE 'both' END AS presence FROM a FULL JOIN b USING (k, s)""")
def _(t):
    li = t.table("lineitem").withColumnsRenamed({"l_partkey": "k", "l_suppkey": "s"})
    return J.reconcile_keys(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["k", "s"])


@query("jn5_resolve_cascade", """
    SELECT rule, count(*) AS n, max(n_alike) AS most_alike FROM (
      SELECT id, resolved, rule, CASE WHEN resolved IS NOT NULL THEN count(*) OVER (PARTITION BY resolved) END AS n_alike FROM (
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'c' || o_custkey END AS resolved,
               CASE WHEN o_orderkey % 3 = 0 THEN 'exact' WHEN o_orderkey % 3 = 1 THEN 'suffix' END AS rule FROM (
          SELECT min(o_orderkey) AS o_orderkey, k, any_value(o_custkey) AS o_custkey FROM (
            SELECT o_orderkey % 3 AS m, o_orderkey, o_custkey, 'c' || o_custkey || '/' || (o_orderkey % 3) AS k FROM orders) GROUP BY k, m))) GROUP BY 1""")
def _(t):
    o = t.table("orders")
    m = F.col("o_orderkey") % 3
    base = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    key = F.when(m == 0, base).when(m == 1, F.concat(base, F.lit("_x"))).otherwise(F.concat(F.lit("q"), base))
    ids = o.select(key.alias("key")).distinct()
    ref = o.select(base.alias("ref")).distinct()
    rules = [("exact", F.col("key")), ("suffix", F.regexp_replace("key", "_x$", ""))]
    return J.resolve_cascade(ids, ref, "key", "ref", rules).groupBy("rule").agg(N(), F.max("n_alike").alias("most_alike"))


@query("jn6_classify_keys", """
    SELECT kind, count(*) AS n FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'numeric' WHEN 1 THEN 'named' WHEN 2 THEN 'near site' ELSE 'free text' END AS kind FROM customer) GROUP BY 1""")
def _(t):
    c = t.table("customer")
    nation = t.table("nation")
    rows = c.join(nation, c.c_nationkey == nation.n_nationkey)
    m = F.col("c_custkey") % 4
    key = F.when(m == 0, F.col("c_custkey").cast("string")).when(m == 1, F.col("n_name")).when(m == 2, F.concat("n_name", F.lit("+A"))).otherwise(F.concat(F.lit("somewhere "), F.col("c_custkey").cast("string")))
    return J.classify_keys(rows.select(key.alias("key")), nation.select(F.col("n_name").alias("label"))).groupBy("kind").agg(N())


@query("jn7_longest_match", """
    WITH raw AS (SELECT DISTINCT p_partkey, 'run_' || p_brand || '_' || p_size || '_q' AS raw FROM part),
    known AS (SELECT DISTINCT p_brand AS known FROM part UNION SELECT DISTINCT p_brand || '_' || p_size FROM part WHERE p_size < 20)
    SELECT raw, arg_max(known, length(known)) AS known, count(DISTINCT p_partkey) AS n FROM raw JOIN known ON contains(raw, '_' || known || '_') GROUP BY 1""")
def _(t):
    p = t.table("part")
    size = F.col("p_size").cast("string")
    raw = p.select(F.concat(F.lit("run_"), "p_brand", F.lit("_"), size, F.lit("_q")).alias("raw"))
    known = p.select(F.col("p_brand").alias("known")).union(p.where("p_size < 20").select(F.concat("p_brand", F.lit("_"), size)))
    hit = J.longest_match(raw.distinct(), known.distinct())
    return raw.groupBy("raw").agg(N()).join(hit, "raw").select("raw", "known", "n")


@query("jn8_geo_match", sql("sites", """
    SELECT a.site, count(b.site) AS n_hits, min(b.site) AS hit FROM sites a LEFT JOIN sites b ON abs(a.lat - b.lat) <= 0.5 AND abs(a.lon - b.lon) <= 3 AND abs(a.lon + 0.0 - b.lon) <= 0.5 GROUP BY 1"""))
def _(t):
    right = t.sites.select(F.col("site").alias("hit"), "lat", "lon")
    return J.geo_match(t.sites, right, "site", "hit", 0.5).select("site", "n_hits", "hit")


_OBS = "SELECT event_id AS obs_id, user_id % 25 AS site, CAST(ts AS DATE) AS date FROM events"


def _obs(t):
    return t.table("events").select(F.col("event_id").alias("obs_id"), (F.col("user_id") % 25).alias("site"), F.to_date("ts").alias("date"))


def _exposure_sql(first: str, last: str) -> str:
    return sql("daily", f"""
    SELECT obs_id, from_lag, to_lag, CASE WHEN count(d.value) = to_lag - from_lag + 1 THEN round(sum(d.value), 2) END AS exposure
    FROM obs CROSS JOIN (VALUES (0, 2), (1, 3), (4, 7)) s(from_lag, to_lag) LEFT JOIN daily d ON d.site = obs.site AND d.date BETWEEN {first} AND {last}
    GROUP BY 1, 2, 3""", obs=_OBS)


@query("jn9_trailing_exposure", _exposure_sql("obs.date - to_lag", "obs.date - from_lag"))
def _(t):
    return J.exposure(_obs(t), t.daily, [(0, 2), (1, 3), (4, 7)]).withColumn("exposure", F.round("exposure", 2))


@query("jn10_leading_exposure", _exposure_sql("obs.date + from_lag", "obs.date + to_lag"))
def _(t):
    return J.exposure(_obs(t), t.daily, [(0, 2), (1, 3), (4, 7)], future=True).withColumn("exposure", F.round("exposure", 2))


@query("jn11_lag_matrix", sql("daily", """
    SELECT obs_id, lag, d.value FROM obs CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(1, 15)) LEFT JOIN daily d ON d.site = obs.site AND d.date = obs.date - lag""", obs=_OBS))
def _(t):
    return J.lag_matrix(_obs(t), t.daily, 14)


@query("jn12_nearest_grid", sql("sites", """
    SELECT site, cell FROM (SELECT site, cell, row_number() OVER (PARTITION BY site ORDER BY abs(lat - c_at), cell) AS r FROM sites CROSS JOIN (SELECT r_regionkey AS cell, CAST(r_regionkey * 2 AS DOUBLE) AS c_at FROM region)) WHERE r = 1"""))
def _(t):
    axis = t.table("region").select(F.col("r_regionkey").alias("cell"), (F.col("r_regionkey") * 2.0).alias("at"))
    return J.nearest_grid(t.sites, axis, "site", "lat", "cell", "at").select("site", "cell")


_KM = """
    SELECT site, block, (lon - (SELECT avg(lon) FROM sites)) * 111.320 * cos(radians((SELECT avg(lat) FROM sites))) AS x, (lat - (SELECT avg(lat) FROM sites)) * 110.574 AS y FROM sites"""


@query("jn13_knn_graph", sql("sites", """
    SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM (
      SELECT k.site AS s, m.site AS o, row_number() OVER (PARTITION BY k.site ORDER BY round(pow(k.x - m.x, 2) + pow(k.y - m.y, 2), 9), m.site) AS r FROM km k JOIN km m ON k.site <> m.site) WHERE r <= 5""", km=_KM))
def _(t):
    from quadrat.functions.compositional import km_axes

    return J.knn_graph(km_axes(t.sites), 5, node="site")


@query("jn14_proximity_join", sql("sites", """
    SELECT a_site, site, round(metres, 3) AS metres FROM (
      SELECT a.site AS a_site, b.site AS site, m AS metres, row_number() OVER (PARTITION BY a.site ORDER BY m, b.site) AS r FROM (
        SELECT a.site, a.lat, a.lon, b.site AS o, 1000 * 2 * 6371.0088 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))) AS m
        FROM sites a JOIN shifted b ON true) x JOIN sites a ON a.site = x.site JOIN sites b ON b.site = x.o WHERE m <= 100000) WHERE r = 1""",
    shifted="SELECT site, lat + 0.1 AS lat, lon + 0.2 AS lon FROM sites"))
def _(t):
    right = t.sites.select("site", (F.col("lat") + 0.1).alias("lat"), (F.col("lon") + 0.2).alias("lon"))
    return J.proximity_join(t.sites.withColumnRenamed("site", "a_site"), right, "a_site", "site", 100_000).withColumn("metres", F.round("metres", 3))


@query("jn15_pairs_in_group", sql("profiles", """
    SELECT a.site, a.profile AS a, b.profile AS b FROM profiles a JOIN profiles b ON a.site = b.site AND a.profile < b.profile"""))
def _(t):
    return J.pairs(t.profiles, "profile", ["site"])


@query("jn16_nearest_in_series", """
    SELECT s_nationkey, s_suppkey, neighbour, gap, r FROM (
      SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS neighbour, abs(a.s_suppkey - b.s_suppkey) AS gap,
             row_number() OVER (PARTITION BY a.s_nationkey, a.s_suppkey ORDER BY abs(a.s_suppkey - b.s_suppkey), b.s_suppkey) AS r
      FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) WHERE r <= 2""")
def _(t):
    s = t.table("supplier").withColumn("number", F.col("s_suppkey"))
    return J.nearest_in_series(s, 2, ["s_nationkey"], "number", "s_suppkey").select("s_nationkey", "s_suppkey", "neighbour", "gap", "r")


@query("jn17_complete_blocks", sql("counts_pos", """
    SELECT campaign, count(*) AS n, count(DISTINCT profile) AS blocks FROM (SELECT *, count(*) OVER (PARTITION BY profile, campaign, feature) AS k FROM counts_pos) WHERE k = 3 GROUP BY 1"""))
def _(t):
    return J.complete_blocks(t.counts_pos, ["profile", "campaign", "feature"], "position", ["A", "N", "R"]).groupBy("campaign").agg(N(), F.count_distinct("profile").alias("blocks"))


@query("jn18_allocate_runs", """
    WITH p AS (SELECT s_nationkey AS sample, s_suppkey AS profile, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS np FROM supplier),
    r AS (SELECT c_nationkey AS sample, c_custkey AS run, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS j, count(*) OVER (PARTITION BY c_nationkey) AS nr FROM customer)
    SELECT p.sample, profile, run FROM p JOIN r ON p.sample = r.sample AND (np = 1 OR j = least(i, nr))""")
def _(t):
    p = t.table("supplier").select(F.col("s_nationkey").alias("sample"), F.col("s_suppkey").alias("profile"))
    r = t.table("customer").select(F.col("c_nationkey").alias("sample"), F.col("c_custkey").alias("run"))
    return J.allocate_runs(p, r)


@query("jn19_fold_accessions", """
    SELECT c_custkey, runs, CAST(c_custkey AS VARCHAR) AS biosample FROM customer LEFT JOIN (
      SELECT o_custkey, string_agg(run, ';' ORDER BY run) AS runs FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey AS VARCHAR) AS run FROM orders) GROUP BY 1) ON o_custkey = c_custkey WHERE runs IS NOT NULL""")
def _(t):
    runs = t.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("run"), F.col("o_custkey").cast("string").alias("biosample"))
    return J.fold_accessions(t.table("customer").select("c_custkey"), runs, "c_custkey", "run", "biosample").where("runs is not null")
