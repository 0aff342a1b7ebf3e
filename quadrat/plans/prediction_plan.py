"""Queries over nested leave-out prediction and its null over the route's orbit."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import compositional as C
from quadrat.operators import joins as J
from quadrat.operators import models as M
from quadrat.operators import prediction as P
from quadrat.operators import windows as W
from quadrat.plans import stats_plan as SP
from quadrat.plans.models_plan import _SCAN_RY, R, _by_day, _obs
from quadrat.plans.roles import registry, sql

QUERIES, query = registry()
TAXA, ORBIT_TAXA, BLOCKS = 20, 10, 5
HERE = "shift = 0 AND reflected = 0"


def _counts(t):
    return t.names.select(F.concat_ws("/", "site", "campaign", "position").alias("unit"), F.col("taxon").alias("part"), "n")


def _route(t):
    x = C.transect(t.sites).select("site", "position")
    return x.withColumn("block", W.contiguous_blocks([], ["position", "site"], BLOCKS))


def _design(t):
    units = t.names.select("site", "campaign", F.col("position").alias("compartment")).distinct()
    named = units.select("site", "campaign", F.concat_ws("/", "site", "campaign", "compartment").alias("unit"), F.concat_ws("/", "campaign", "compartment").alias("stratum"))
    return named.join(_route(t), "site")


_ROUTE = {
    "km": SP._KM,
    "route": f"""SELECT site, x, CAST(floor((row_number() OVER (ORDER BY x, site) - 1) * {BLOCKS} / count(*) OVER ()) AS INTEGER) AS block FROM (
      SELECT site, x * cos(a) + y * sin(a) AS x FROM km, (SELECT 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM km))""",
    "units": "SELECT DISTINCT concat_ws('/', site, campaign, position) AS unit, concat_ws('/', campaign, position) AS stratum, site, campaign FROM names",
    "cnt": "SELECT concat_ws('/', site, campaign, position) AS unit, taxon AS part, n FROM names",
    "rel": "SELECT unit, part, n / sum(n) OVER (PARTITION BY unit) AS rel FROM cnt WHERE n > 0",
}
_ORBIT = {
    "numbered": "SELECT site, row_number() OVER (ORDER BY x, site) - 1 AS i FROM route",
    "maps": """SELECT s.shift, f.reflected, a.site, b.site AS mapped_site FROM numbered a CROSS JOIN (SELECT i AS shift FROM numbered) s CROSS JOIN (VALUES (0), (1)) f(reflected)
      JOIN numbered b ON b.i = (CASE WHEN reflected = 1 THEN (SELECT count(*) FROM numbered) - 1 - a.i ELSE a.i END + s.shift) % (SELECT count(*) FROM numbered)""",
}
_SITE_MEMBERS = "SELECT u.unit, u.stratum, u.site, r.x, CAST(f.fold AS VARCHAR) AS fold, CASE WHEN r.block = f.fold THEN 'hold' ELSE 'train' END AS role FROM units u JOIN route r USING (site) CROSS JOIN (SELECT DISTINCT block AS fold FROM route) f"
_PAIR_MEMBERS = """SELECT * FROM (SELECT u.unit, u.stratum, u.site, r.x, concat_ws('/', b.block, c.campaign) AS fold,
      CASE WHEN r.block = b.block AND u.campaign = c.campaign THEN 'hold' WHEN r.block <> b.block AND u.campaign <> c.campaign THEN 'train' END AS role
      FROM units u JOIN route r USING (site) CROSS JOIN (SELECT DISTINCT block FROM route) b CROSS JOIN (SELECT DISTINCT campaign FROM units) c) WHERE role IS NOT NULL"""
_ORBIT_MEMBERS = """SELECT u.unit, u.stratum, u.site, r.x, concat_ws('/', shift, reflected, f.fold) AS fold, CASE WHEN r.block = f.fold THEN 'hold' ELSE 'train' END AS role
      FROM units u JOIN maps USING (site) JOIN route r ON r.site = mapped_site CROSS JOIN (SELECT DISTINCT block AS fold FROM route) f"""


def _folds(members: str, k: int) -> dict[str, str]:
    """Training-only taxa and their log ratios for the members of folds; ``@`` stands for a prefix of the names."""
    return {
        "mem": members,
        "nt": "SELECT fold, count(*) FILTER (role = 'train') AS nt, count(*) FILTER (role = 'hold') AS nh FROM @mem GROUP BY 1",
        "top": f"""SELECT fold, part FROM (SELECT fold, part, row_number() OVER (PARTITION BY fold ORDER BY round(sum(rel) / nt, 12) DESC, part) AS r
          FROM @mem JOIN rel USING (unit) JOIN @nt USING (fold) WHERE role = 'train' AND nt >= 20 GROUP BY fold, part, nt HAVING count(*) / nt >= 0.2) WHERE r <= {k} QUALIFY count(*) OVER (PARTITION BY fold) = {k}""",
        "lx": """SELECT fold, unit, site, role, stratum, x, part, ln(coalesce(n, 0) + 0.5) - avg(ln(coalesce(n, 0) + 0.5)) OVER (PARTITION BY fold, unit) AS y
          FROM @mem JOIN @top USING (fold) LEFT JOIN cnt USING (unit, part)""",
    }


_SITE_FOLDS = {
    "ce": "SELECT fold, stratum, part, avg(y) AS c FROM @lx WHERE role = 'train' GROUP BY 1, 2, 3",
    "v": "SELECT fold, site, role, x, part, avg(y - coalesce(c, 0)) AS v FROM @lx LEFT JOIN @ce USING (fold, stratum, part) GROUP BY 1, 2, 3, 4, 5",
    "sc": "SELECT fold, avg(x) FILTER (role = 'train') AS m, stddev_samp(x) FILTER (role = 'train') AS sd, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'hold') AS n_hold FROM (SELECT DISTINCT fold, site, role, x FROM @v) GROUP BY 1",
    "z": "SELECT v.*, (x - m) / sd AS z, n_train, n_hold FROM @v v JOIN @sc USING (fold)",
    "mo": "SELECT fold, part, avg(v) AS vm, avg(z) AS zm, avg(z * z) AS qm, var_pop(z) AS s11, var_pop(z * z) AS s22, covar_pop(z, z * z) AS s12, covar_pop(z, v) AS t1, covar_pop(z * z, v) AS t2 FROM @z WHERE role = 'train' GROUP BY 1, 2",
    "b": "SELECT *, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS b1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS b2 FROM @mo",
    "folds": """SELECT fold, max(n_train) AS n_train, max(n_hold) AS n_hold, sum(pow(v - vm - b1 * (z - zm) - b2 * (z * z - qm), 2)) AS sse, sum(pow(v - vm, 2)) AS sst
      FROM @z JOIN @b USING (fold, part) WHERE role = 'hold' AND n_hold >= 2 AND n_train >= 5 GROUP BY 1""",
}
_PAIR_FOLDS = {
    "sc": "SELECT fold, avg(x) FILTER (role = 'train') AS m, stddev_samp(x) FILTER (role = 'train') AS sd FROM @mem GROUP BY 1",
    "z": "SELECT l.*, (x - m) / sd AS z FROM @lx l JOIN @sc USING (fold)",
    "ct": "SELECT *, y - avg(y) OVER w AS yc, z - avg(z) OVER w AS c1, z * z - avg(z * z) OVER w AS c2 FROM @z WHERE role = 'train' WINDOW w AS (PARTITION BY fold, stratum, part)",
    "mo": "SELECT fold, part, sum(c1 * c1) AS s11, sum(c1 * c2) AS s12, sum(c2 * c2) AS s22, sum(c1 * yc) AS t1, sum(c2 * yc) AS t2 FROM @ct GROUP BY 1, 2",
    "b": "SELECT *, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS b1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS b2 FROM @mo",
    "h": "SELECT e.*, y - b1 * z - b2 * z * z AS r FROM @z e JOIN @b USING (fold, part) WHERE role = 'hold'",
    "folds": """SELECT p.fold, nt AS n_train, nh AS n_hold, sum(pow(p.r - q.r, 2)) AS sse, sum(pow(p.y - q.y, 2)) AS sst, count(DISTINCT (p.unit, q.unit)) AS n_pairs
      FROM @h p JOIN @h q ON p.fold = q.fold AND p.stratum = q.stratum AND p.part = q.part AND p.unit < q.unit AND p.site <> q.site JOIN @nt n ON n.fold = p.fold GROUP BY 1, 2, 3""",
}


def _named(prefix: str, *parts: dict[str, str]) -> dict[str, str]:
    return {prefix + name: body.replace("@", prefix) for part in parts for name, body in part.items()}


@query("ml9_site_skill", sql("names sites", "SELECT fold, n_train, n_hold, round(sse, 6) AS sse, round(sst, 6) AS sst, round(1 - sse / sst, 6) AS skill FROM folds", **_ROUTE, **_named("", _folds(_SITE_MEMBERS, TAXA), _SITE_FOLDS)))
def _(t):
    """Held-out blocks of the route, with taxa, centres and coefficients from the training blocks only."""
    return R(P.nested_cv(_counts(t), _design(t), TAXA))


@query("ml9_pair_skill", sql("names sites", "SELECT fold, n_train, n_hold, n_pairs, round(sse, 6) AS sse, round(sst, 6) AS sst, round(1 - sse / sst, 6) AS skill FROM folds", **_ROUTE, **_named("", _folds(_PAIR_MEMBERS, TAXA), _PAIR_FOLDS)))
def _(t):
    """Held-out blocks of held-out campaigns, scored by differences between their units."""
    return R(P.nested_cv(_counts(t), _design(t), TAXA, pairs=True))


_SKILLS = "SELECT split_part(fold, '/', 1) AS shift, split_part(fold, '/', 2) AS reflected, 1 - sum(sse) / sum(sst) AS pooled, avg(1 - sse / sst) AS equal FROM folds GROUP BY 1, 2"
_SKILL_P = """SELECT measure, round(o, 6) AS observed, round((1 + count(*) FILTER (v >= o - 1e-9)) / CAST(1 + count(*) AS DOUBLE), 6) AS p, count(*) AS n_draws FROM (
      SELECT x.*, (SELECT y.v FROM ms y WHERE y.measure = x.measure AND y.here) AS o FROM ms x WHERE NOT here) GROUP BY 1, 2"""
_MS = "SELECT 'pooled' AS measure, pooled AS v, shift = '0' AND reflected = '0' AS here FROM skills UNION ALL SELECT 'equal', equal, shift = '0' AND reflected = '0' FROM skills"
_SKILL_NULL = {**_ROUTE, **_ORBIT, **_named("", _folds(_ORBIT_MEMBERS, ORBIT_TAXA), _SITE_FOLDS), "skills": _SKILLS, "ms": _MS}


def _skill_null(t):
    return P.skill_null(_counts(t), _design(t), W.route_maps(_route(t), ["position", "site"]), HERE, _route(t), k=ORBIT_TAXA)


@query("ml10_skill_orbit", sql("names sites", _SKILL_P, **_SKILL_NULL))
def _(t):
    """Skill of the route as it is against all its shifts and reflections, each with its own blocks and taxa."""
    return R(_skill_null(t))


_SPANS = [(1, 3), (4, 7)]


@query("ml10_scan_orbit", sql("daily sites", """
    SELECT shift, reflected, round(max(t), 6) AS max_t, round(max(abs(t)), 6) AS max_abs_t FROM (
      SELECT *, beta / sqrt((syy - beta * xy) / (n - 3) / sxx) AS t FROM (
        SELECT shift, reflected, key, xy / (xx - quad) AS beta, xx - quad AS sxx, xy, syy, n FROM (
          SELECT shift, reflected, key, sum(x * x) AS xx, sum(x * ry) AS xy, any_value(syy) AS syy, any_value(n) AS n,
            (any_value(dd) * sum(x) * sum(x) - 2 * any_value(sd) * sum(x) * sum(x * day) + any_value(n) * sum(x * day) * sum(x * day)) / (any_value(n) * any_value(dd) - any_value(sd) * any_value(sd)) AS quad
          FROM obs JOIN ry USING (obs_id, day) JOIN maps USING (site) JOIN ex ON ex.site = mapped_site AND ex.date = obs.date
          CROSS JOIN (SELECT sum(ry * ry) AS syy, count(*) AS n, sum(day) AS sd, sum(day * day) AS dd FROM ry) GROUP BY 1, 2, 3) WHERE xx - quad > 1e-9)) GROUP BY 1, 2""",
    obs="SELECT event_id AS obs_id, user_id % 25 AS site, CAST(ts AS DATE) AS date, value, CAST(day(ts) AS DOUBLE) AS day FROM events", ry=_SCAN_RY, **{k: _ROUTE[k] for k in ("km", "route")}, **_ORBIT,
    ex="SELECT o.site, o.date, a || '-' || b AS key, sum(d.value) AS x FROM daily o CROSS JOIN (VALUES (1, 3), (4, 7)) s(a, b) JOIN daily d ON d.site = o.site AND d.date BETWEEN o.date - b AND o.date - a GROUP BY 1, 2, 3, a, b HAVING count(*) = b - a + 1"))
def _(t):
    """The strongest exposure of a scan, for every shift and reflection of the route that the series come from."""
    obs, own = _by_day(_obs(t).withColumns({"one": F.lit(1.0), "day": F.dayofmonth("date").cast("double")}))
    days = t.daily.select("site", "date", F.concat_ws("|", "site", "date").alias("obs_id"))
    e = J.exposure(days, t.daily, _SPANS).where("exposure is not null").withColumn("key", F.concat_ws("-", "from_lag", "to_lag"))
    e = e.join(days, "obs_id").select("site", "date", "key", F.col("exposure").alias("x"))
    fit = lambda rows, keys: M.scan(obs, rows.select("obs_id", *keys, "key", "x"), "obs_id", "value", [*keys, "key"], "x", ["one", "day"])
    return R(P.scan_orbit(own, e, W.route_maps(_route(t), ["position", "site"]), fit))


@query("pl5_geographic_prediction", sql("names sites", f"""
    SELECT 'skill ' || measure AS measure, observed AS value, p, n_draws AS n FROM ({_SKILL_P})
    UNION ALL SELECT 'pair skill', round(1 - sum(sse) / sum(sst), 6), NULL, sum(n_pairs) FROM pfolds
    UNION ALL SELECT 'order alias ' || campaign, round(corr(re, rp), 6), NULL, count(*) FROM (
      SELECT campaign, rank() OVER (PARTITION BY campaign ORDER BY e) + (count(*) OVER (PARTITION BY campaign, e) - 1) / 2.0 AS re, rank() OVER (PARTITION BY campaign ORDER BY x) + (count(*) OVER (PARTITION BY campaign, x) - 1) / 2.0 AS rp
      FROM visits JOIN route USING (site)) GROUP BY campaign""",
    **_SKILL_NULL, visits="SELECT user_id % 5 AS campaign, user_id % 25 AS site, min(epoch_us(ts)) AS e FROM events GROUP BY 1, 2",
    **_named("p", _folds(_PAIR_MEMBERS, TAXA), _PAIR_FOLDS)))
def _(t):
    """Geographic prediction: site skill with its orbit null, pair skill over held-out campaigns, and how far the order
    of first visits follows the route in each campaign."""
    null = _skill_null(t).select(F.concat(F.lit("skill "), "measure").alias("measure"), F.col("observed").alias("value"), "p", F.col("n_draws").alias("n"))
    pairs = P.nested_cv(_counts(t), _design(t), TAXA, pairs=True)
    pooled = P.skill(pairs).join(F.broadcast(pairs.agg(F.sum("n_pairs").alias("n")))).select(F.lit("pair skill").alias("measure"), F.col("pooled").alias("value"), F.lit(None).cast("double").alias("p"), "n")
    visits = t.table("events").groupBy((F.col("user_id") % 5).alias("campaign"), (F.col("user_id") % 25).alias("site")).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).cast("double").alias("elapsed"))
    alias = M.order_alias(visits.join(_route(t), "site"), "campaign", "elapsed", "position")
    alias = alias.select(F.concat(F.lit("order alias "), F.col("campaign").cast("string")).alias("measure"), F.col("spearman").alias("value"), F.lit(None).cast("double").alias("p"), "n")
    return R(null.unionByName(pooled).unionByName(alias))
