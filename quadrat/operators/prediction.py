"""Blocked leave-out prediction of compositions along a route, and its null over the route's orbit.

Everything that a fold learns (which taxa it models, stratum means, positions'
scale, coefficients) comes from its training units. A fold differs from another
only by keys, so all folds, and all shifts and reflections of the route at once,
are rows of the same aggregations; models are solved in closed form from their
cross products.

``design``: one row a unit and ``keys`` (such as shift and reflection) with
``unit``, ``site``, ``stratum``, ``position``, ``block`` and, for folds by
campaign, ``campaign``. ``counts``: ``unit``, ``part``, ``n``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.numeric import ratio
from quadrat.operators import resample as RS
from quadrat.session import cut


def fold_members(design: DataFrame, keys: list[str] = (), by_campaign: bool = False) -> DataFrame:
    """Units of every fold with their role: ``train``, ``hold``, or ``out``.

    A fold is a block, trained on all other blocks; or a block of a campaign,
    trained on other blocks of other campaigns.
    """
    own = ["block", "campaign"] if by_campaign else ["block"]
    folds = design.select(*keys, *own).distinct().withColumnsRenamed({c: f"fold_{c}" for c in own})
    folds = folds.withColumn("fold", F.concat_ws("/", *(F.col(f"fold_{c}").cast("string") for c in own)))
    met = design.join(folds, list(keys)) if keys else design.join(F.broadcast(folds))
    same = [F.col(c) == F.col(f"fold_{c}") for c in own]
    hold, apart = same[0], ~same[0]
    for s in same[1:]:
        hold, apart = hold & s, apart & ~s
    return met.withColumn("role", F.when(hold, "hold").when(apart, "train").otherwise("out")).drop(*(f"fold_{c}" for c in own))


def fold_taxa(counts: DataFrame, members: DataFrame, k: int, prevalence: float, keys: list[str] = (), min_train: int = 1) -> DataFrame:
    """``(keys, fold, part)``: the ``k`` most abundant parts of each fold's training units that enough of them have.

    A fold's sums are those of all units less those of its units that don't
    train. Folds with fewer eligible parts or training units are left out.
    """
    fold = [*keys, "fold"]
    units = members.select("unit").distinct()
    rel = counts.where(F.col("n") > 0).join(units, "unit", "left_semi")
    rel = rel.withColumn("rel", ratio("n", F.sum("n").over(Window.partitionBy("unit")))).select("unit", "part", "rel")
    total = rel.groupBy("part").agg(F.sum("rel").alias("s"), F.count(F.lit(1)).alias("c"))
    size = members.groupBy(*fold).agg(F.count_if(F.col("role") == "train").alias("n_train")).where(F.col("n_train") >= min_train)
    left = members.where("role <> 'train'").select(*fold, "unit").join(rel, "unit").groupBy(*fold, "part").agg(F.sum("rel").alias("ls"), F.count(F.lit(1)).alias("lc"))
    every = size.agg(F.collect_list(F.struct(*fold, "n_train")).alias("folds"))  # one row: folds are a design's, not the data's
    grid = total.join(F.broadcast(every)).select("part", "s", "c", F.explode("folds").alias("f")).select("part", "s", "c", "f.*")
    train = grid.join(left, [*fold, "part"], "left")
    mean = F.round((F.col("s") - F.coalesce("ls", F.lit(0.0))) / F.col("n_train"), 12)
    share = (F.col("c") - F.coalesce("lc", F.lit(0))) / F.col("n_train")
    able = train.withColumns({"mean": mean, "share": share}).where(F.col("share") >= prevalence)
    place = F.row_number().over(Window.partitionBy(*fold).orderBy(F.col("mean").desc(), "part"))
    top = able.withColumn("place", place).where(F.col("place") <= k).select(*fold, "part")
    whole = top.groupBy(*fold).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == k).drop("m")
    return top.join(whole, fold, "left_semi")


def fold_clr(counts: DataFrame, members: DataFrame, taxa: DataFrame, pseudo: float, keys: list[str] = ()) -> DataFrame:
    """Centred log ratios ``y`` of every training and held-out unit over its fold's own parts."""
    fold = [*keys, "fold"]
    rows = members.where("role <> 'out'").join(taxa, fold).join(counts.select("unit", "part", "n"), ["unit", "part"], "left")
    x = F.log(F.coalesce(F.col("n").cast("double"), F.lit(0.0)) + pseudo)
    return rows.withColumn("x", x).withColumn("y", F.col("x") - F.avg("x").over(Window.partitionBy(*fold, "unit"))).drop("x", "n")


def _moments(rows: DataFrame, by: list[str], y: str | None = None) -> DataFrame:
    z = F.col("z")
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(F.pow(z, F.lit(i))).alias(f"z{i}") for i in range(1, 5))]
    if y is not None:
        sums = [F.sum(F.col(y)).alias("y0"), F.sum(z * F.col(y)).alias("y1"), F.sum(z * z * F.col(y)).alias("y2")]
    return rows.groupBy(*by).agg(*sums)


def _centred(top: str, a: str, b: str):
    return F.col(top) - F.col(a) * F.col(b) / F.col("n")


def _solved(rows: DataFrame) -> DataFrame:
    """``b1`` and ``b2`` of a quadratic from centred cross products; NULL where the design is singular."""
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    safe = F.when(det > 1e-12 * F.col("s11") * F.col("s22"), det)
    b1 = ratio(F.col("s22") * F.col("t1") - F.col("s12") * F.col("t2"), safe)
    b2 = ratio(F.col("s11") * F.col("t2") - F.col("s12") * F.col("t1"), safe)
    return rows.withColumns({"b1": b1, "b2": b2})


def site_folds(y: DataFrame, keys: list[str] = (), min_sites: int = 5) -> DataFrame:
    """Per fold: squared errors of site vectors under a quadratic in position, and about the training mean.

    Units are centred by training means of their stratum and averaged to one
    vector a site; held-out sites are scored by the training sites' fit.
    """
    fold = [*keys, "fold"]
    means = y.where("role = 'train'").groupBy(*fold, "stratum", "part").agg(F.avg("y").alias("c"))
    centred = y.join(means, [*fold, "stratum", "part"], "left").withColumn("v", F.col("y") - F.coalesce("c", F.lit(0.0)))
    v = centred.groupBy(*fold, "site", "role", "position", "part").agg(F.avg("v").alias("v"))
    sites = v.select(*fold, "site", "role", "position").distinct()
    train, hold = F.col("role") == "train", F.col("role") == "hold"
    p = F.when(train, F.col("position"))
    scale = sites.groupBy(*fold).agg(F.avg(p).alias("at"), F.stddev(p).alias("sd"), F.count_if(train).alias("n_train_sites"), F.count_if(hold).alias("n_hold_sites"))
    scale = scale.where((F.col("sd") > 0) & (F.col("n_train_sites") >= min_sites) & (F.col("n_hold_sites") >= 2))
    z = v.join(scale, fold).withColumn("z", (F.col("position") - F.col("at")) / F.col("sd"))
    design = _moments(z.where(train).select(*fold, "site", "z").distinct(), fold)
    fits = _moments(z.where(train), [*fold, "part"], "v").join(design, fold)
    fits = _solved(fits.withColumns({
        "s11": _centred("z2", "z1", "z1"), "s12": _centred("z3", "z1", "z2"), "s22": _centred("z4", "z2", "z2"), "t1": _centred("y1", "z1", "y0"), "t2": _centred("y2", "z2", "y0"),
    }))
    scored = z.where(hold).join(fits.select(*fold, "part", "b1", "b2", "n", "z1", "z2", "y0"), [*fold, "part"])
    base, zz = F.col("y0") / F.col("n"), F.col("z")
    e = F.col("v") - base - F.col("b1") * (zz - F.col("z1") / F.col("n")) - F.col("b2") * (zz * zz - F.col("z2") / F.col("n"))
    g = scored.groupBy(*fold).agg(F.sum(e * e).alias("sse"), F.sum((F.col("v") - base) * (F.col("v") - base)).alias("sst"), F.max("n_train_sites").alias("n_train"), F.max("n_hold_sites").alias("n_hold"))
    return g.where("sse is not null and sst > 0").withColumn("skill", 1 - ratio("sse", "sst"))


def pair_folds(y: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per fold: squared errors of differences between held-out units of one stratum and two sites.

    Strata are centred in training, so only differences are predicted. The sum
    over all pairs of a set of m is m times its sum of squares less the square
    of its sum, so pairs are never made; pairs of one site are taken off again.
    """
    fold = [*keys, "fold"]
    train, hold = F.col("role") == "train", F.col("role") == "hold"
    units = y.select(*fold, "unit", "role", "position").distinct()
    p = F.when(train, F.col("position"))
    scale = units.groupBy(*fold).agg(F.avg(p).alias("at"), F.stddev(p).alias("sd"), F.count_if(train).alias("n_train"), F.count_if(hold).alias("n_hold"))
    z = y.join(scale.where((F.col("sd") > 0) & (F.col("n_hold") >= 2)), fold).withColumn("z", (F.col("position") - F.col("at")) / F.col("sd"))
    design = _moments(z.where(train).select(*fold, "stratum", "unit", "z").distinct(), [*fold, "stratum"])
    within = _moments(z.where(train), [*fold, "stratum", "part"], "y").join(design, [*fold, "stratum"])
    s = {"s11": ("z2", "z1", "z1"), "s12": ("z3", "z1", "z2"), "s22": ("z4", "z2", "z2"), "t1": ("y1", "z1", "y0"), "t2": ("y2", "z2", "y0")}
    fits = _solved(within.groupBy(*fold, "part").agg(*(F.sum(_centred(*c)).alias(k) for k, c in s.items())))
    scored = z.where(hold).join(fits.select(*fold, "part", "b1", "b2"), [*fold, "part"])
    scored = scored.withColumn("r", F.col("y") - F.col("b1") * F.col("z") - F.col("b2") * F.col("z") * F.col("z"))

    def pairs(by: list[str], sign: int) -> DataFrame:
        q = lambda c: F.count(F.lit(1)) * F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c)
        m = F.count(F.lit(1))
        return scored.groupBy(*fold, *by, "part").agg((sign * q("r")).alias("e"), (sign * q("y")).alias("t"), (sign * m * (m - 1) / 2).alias("k"))

    both = pairs(["stratum"], 1).select(*fold, "part", "e", "t", "k").unionByName(pairs(["stratum", "site"], -1).select(*fold, "part", "e", "t", "k"))
    g = both.groupBy(*fold).agg(F.sum("e").alias("sse"), F.sum("t").alias("sst"), ratio(F.sum("k"), F.count_distinct("part")).cast("bigint").alias("n_pairs"))
    out = g.where("sse is not null and sst > 1e-12 and n_pairs > 0").join(scale.select(*fold, "n_train", "n_hold"), fold)
    return out.withColumn("skill", 1 - ratio("sse", "sst"))


def nested_cv(
    counts: DataFrame, design: DataFrame, k: int, prevalence: float = 0.2, pseudo: float = 0.5, keys: list[str] = (), pairs: bool = False, min_train: int = 20, min_sites: int = 5,
) -> DataFrame:
    """Folds of leave-out prediction with everything learned inside the fold: (keys, fold, ..., sse, sst, skill).

    ``pairs``: folds by campaign and block, scored by pairs; otherwise folds by
    block, scored by site vectors.
    """
    members = cut(fold_members(design, keys, by_campaign=pairs), "folds")
    taxa = fold_taxa(counts, members, k, prevalence, keys, min_train)
    y = cut(fold_clr(counts, members, taxa, pseudo, keys), "fold-clr")
    return pair_folds(y, keys) if pairs else site_folds(y, keys, min_sites)


def skill(folds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Pooled skill and the mean of fold skills."""
    return folds.groupBy(*keys).agg((1 - ratio(F.sum("sse"), F.sum("sst"))).alias("pooled"), F.avg("skill").alias("equal"), F.count(F.lit(1)).alias("n_folds"))


def orbit_design(design: DataFrame, maps: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The design under every shift and reflection: units keep their counts, sites take the mapped site's place and block.

    ``places``: (site, position, block) of the whole route, sites without units
    too; by default the sites of the design, which then must be the route's.
    """
    place = design.select("site", "position", "block").distinct() if places is None else places
    place = place.select(F.col("site").alias("mapped_site"), "position", "block")
    return design.drop("position", "block").join(maps.select("shift", "reflected", "site", "mapped_site"), "site").join(place, "mapped_site").drop("mapped_site")


def skill_null(counts: DataFrame, design: DataFrame, maps: DataFrame, identity, places: DataFrame | None = None, **options) -> DataFrame:
    """Skill of the route as it is against that of all its shifts and reflections: (measure, observed, p, n_null).

    ``identity``: a condition on (shift, reflected) that holds for the route as it is, a column or SQL text.
    """
    identity = F.expr(identity) if isinstance(identity, str) else identity
    keys = ["shift", "reflected"]
    every = cut(skill(nested_cv(counts, orbit_design(design, maps, places), keys=keys, **options), keys), "orbit")
    long = every.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("pooled", "equal")))).alias("m")).select(*keys, "m.*")
    obs = long.where(identity).select("measure", F.col("v").alias("observed"))
    return RS.perm_p(long.where(~identity).join(obs, "measure"), F.col("observed"), "v", ["measure", "observed"])


def scan_orbit(y: DataFrame, exposures: DataFrame, maps: DataFrame, fit: Callable[[DataFrame, list[str]], DataFrame], site: str = "site", date: str = "date") -> DataFrame:
    """Largest t and absolute t over all exposures of a scan, for every shift and reflection of the route.

    ``exposures``: (site, date, key, value). Each observation takes the series
    of the mapped site; ``fit`` scans (obs, shift, reflected, key, value), so
    the cross products of all members and keys come from one aggregation.
    ``y`` needs one row for each site and day only, if ``fit`` scans by those.
    """
    keys = ["shift", "reflected"]
    moved = y.join(maps.select(*keys, site, "mapped_site"), site).join(exposures.withColumnRenamed(site, "mapped_site"), ["mapped_site", date])
    return fit(moved, keys).groupBy(*keys).agg(F.max("t").alias("max_t"), F.max(F.abs("t")).alias("max_abs_t"))
