"""Join meanings: cardinality checks, cascades, windows in time, space and series."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.numeric import haversine_km


class CardinalityError(ValueError):
    pass


def assert_unique(df: DataFrame, key: list[str]) -> None:
    """Fail if a key has more than one row; names up to five of them."""
    bad = df.groupBy(*key).count().where("count > 1").limit(5).collect()
    if bad:
        raise CardinalityError(f"{key} is not unique: {[r.asDict() for r in bad]}")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", card: str = "m:1", agree: list[str] = ()) -> DataFrame:
    """Equi join with asserted cardinality; columns of ``agree`` must say the same on both sides."""
    if card.startswith("1:"):
        assert_unique(left, on)
    if card.endswith(":1"):
        assert_unique(right, on)
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in agree})
    out = left.join(r, on, how)
    if agree:
        differ = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in agree))
        bad = out.where(differ).select(*on).limit(5).collect()
        if bad:
            raise CardinalityError(f"{list(agree)} disagree for {[r.asDict() for r in bad]}")
    return out.drop(*(f"_r_{c}" for c in agree))


def lookup(df: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a dimension; whether it is broadcast is left to its measured size."""
    return df.join(dim, on, "left")


def anti_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def reconcile_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Each key of either side with its row counts and where it occurs."""
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("n_right"))
    return (
        a.join(b, on, "full_outer")
        .withColumn("presence", F.when(F.col("n_right").isNull(), "left").when(F.col("n_left").isNull(), "right").otherwise("both"))
        .na.fill(0, ["n_left", "n_right"])
    )


def resolve_cascade(df: DataFrame, ref: DataFrame, key: str, ref_key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Resolve ``key`` by the first rule whose form is a reference key.

    ``rules`` are (name, form of the key). Adds ``resolved``, ``rule`` and
    ``n_alike``, how many input keys were resolved to the same reference.
    """
    forms = F.posexplode(F.array(*(F.struct(F.lit(n).alias("rule"), c.alias("form")) for n, c in rules))).alias("at", "f")
    cand = df.select(key, forms).select(key, "at", F.col("f.rule").alias("rule"), F.col("f.form").alias("form"))
    known = ref.select(F.col(ref_key).alias("form")).distinct()
    first = cand.join(known, "form").groupBy(key).agg(F.min_by(F.struct("form", "rule"), "at").alias("m"))
    first = first.select(key, F.col("m.form").alias("resolved"), F.col("m.rule").alias("rule"))
    alike = first.groupBy("resolved").agg(F.count(F.lit(1)).alias("n_alike"))
    return df.join(first.join(alike, "resolved"), key, "left")


def classify_keys(keys: DataFrame, sites: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    """Kind of a site key: numeric, named, near-site annotation (``<label>+text``), or free text."""
    stem = F.regexp_extract(F.col(key), r"^([^+(]+?)\s*[+(]", 1)
    known = sites.select(F.col(label).alias("_l")).distinct()
    return (
        keys.withColumn("_s", stem)
        .join(known.withColumnsRenamed({"_l": "_own"}), F.col(key) == F.col("_own"), "left")
        .join(known.withColumnsRenamed({"_l": "_near"}), F.col("_s") == F.col("_near"), "left")
        .withColumn(
            "kind",
            F.when(F.col(key).rlike(r"^\d+$"), "numeric").when(F.col("_own").isNotNull(), "named")
            .when(F.col("_near").isNotNull(), "near site").otherwise("free text"),
        )
        .withColumn("site_label", F.coalesce("_own", "_near"))
        .drop("_s", "_own", "_near")
    )


def longest_match(raw: DataFrame, known: DataFrame, raw_col: str = "raw", known_col: str = "known") -> DataFrame:
    """The longest known name that stands between underscores inside a raw name.

    Candidates are the runs of fields of the raw name, so this is an equi join.
    """
    fields = F.split(F.col(raw_col), "_")
    n = F.size(fields)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.concat_ws("_", F.slice(fields, i, j - i + 1)))))
    cand = raw.select(raw_col, F.explode(F.array_distinct(runs)).alias("_k"))
    best = cand.join(known.select(F.col(known_col).alias("_k")).distinct(), "_k").groupBy(raw_col).agg(F.max_by("_k", F.struct(F.length("_k"), "_k")).alias(known_col))
    return raw.join(best, raw_col, "left")


def _cells(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("bigint")


def _around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return df.withColumn("_dx", F.explode(shift)).withColumn("_dy", F.explode(shift)).withColumn("_gx", _cells(F.col(x), size) + F.col("_dx")).withColumn("_gy", _cells(F.col(y), size) + F.col("_dy")).drop("_dx", "_dy")


def geo_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tol: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows of ``right`` at the same coordinates within ``tol``; adds ``n_hits`` (more than one is the caller's error).

    Meets in grid cells of size ``tol``, so only neighbouring cells are compared.
    """
    size = max(tol, 1e-9) * 1.001
    a = _around(left.select(left_id, F.col(lat).alias("_a"), F.col(lon).alias("_o")), "_a", "_o", size)
    b = right.select(right_id, F.col(lat).alias("_ra"), F.col(lon).alias("_ro")).withColumns({"_gx": _cells(F.col("_ra"), size), "_gy": _cells(F.col("_ro"), size)})
    hit = a.join(b, ["_gx", "_gy"]).where((F.abs(F.col("_a") - F.col("_ra")) <= tol) & (F.abs(F.col("_o") - F.col("_ro")) <= tol))
    n = hit.groupBy(left_id).agg(F.count(F.lit(1)).alias("n_hits"), F.min(right_id).alias(right_id))
    return left.join(n, left_id, "left").na.fill(0, ["n_hits"])


def exposure(obs: DataFrame, daily: DataFrame, intervals: list[tuple[int, int]], site: str = "site", day: str = "date", value: str = "value", obs_id: str = "obs_id", future: bool = False) -> DataFrame:
    """Sum of the daily values from ``a`` to ``b`` days before each observation (after it with ``future``).

    Prefix sums per site turn each window into two lookups. A window that
    leaves the series of its site, or meets a gap in it, is NULL.
    """
    order = Window.partitionBy(site).orderBy(day)
    pre = daily.select(site, F.col(day).alias("_d"), F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_p"), F.row_number().over(order).alias("_k"), F.col(value).alias("_v"))
    spans = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in intervals))).alias("s")
    ask = obs.select(obs_id, site, F.col(day).alias("_o"), spans).select(obs_id, site, "_o", "s.a", "s.b")
    first, last = (F.date_add("_o", F.col("a")), F.date_add("_o", F.col("b"))) if future else (F.date_sub("_o", F.col("b")), F.date_sub("_o", F.col("a")))
    ask = ask.withColumns({"_f": first, "_l": last})
    lo = pre.select(site, F.col("_d").alias("_f"), (F.col("_p") - F.col("_v")).alias("_p0"), F.col("_k").alias("_k0"))
    hi = pre.select(site, F.col("_d").alias("_l"), F.col("_p").alias("_p1"), F.col("_k").alias("_k1"))
    whole = F.col("_k1") - F.col("_k0") == F.datediff("_l", "_f")
    return ask.join(lo, [site, "_f"], "left").join(hi, [site, "_l"], "left").select(
        obs_id, F.col("a").alias("from_lag"), F.col("b").alias("to_lag"), F.when(whole, F.col("_p1") - F.col("_p0")).alias("exposure")
    )


def lag_matrix(obs: DataFrame, daily: DataFrame, horizon: int, site: str = "site", day: str = "date", value: str = "value", obs_id: str = "obs_id", future: bool = False, site_map: DataFrame | None = None) -> DataFrame:
    """``(obs_id, lag, value)`` for lags 1..horizon days before (after) each observation; ``site_map`` replaces sites."""
    if site_map is not None:
        obs = obs.join(site_map, site).drop(site).withColumnRenamed("mapped_site", site)
    asked = obs.select(obs_id, site, F.col(day).alias("_o"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lag"))
    asked = asked.withColumn(day, F.date_add("_o", F.col("lag")) if future else F.date_sub("_o", F.col("lag")))
    return asked.join(daily.select(site, day, value), [site, day], "left").select(obs_id, "lag", value)


def nearest_grid(points: DataFrame, axis: DataFrame, point_id: str, coord: str, axis_id: str, axis_coord: str) -> DataFrame:
    """Nearest value of one grid axis (a short table, checked) to each point; ties take the lower index.

    The sorted axis is a literal array in one row: a bounded lookup, not a join of all pairs.
    """
    n = axis.count()
    if n > 100_000:
        raise ValueError(f"an axis of {n} cells is not a grid axis")
    cells = axis.agg(F.array_sort(F.collect_list(F.struct(F.col(axis_coord).alias("c"), F.col(axis_id).alias("i")))).alias("_cells"))
    far = lambda x: F.struct(F.abs(x["c"] - F.col(coord)).alias("d"), x["i"].alias("i"))
    return points.join(F.broadcast(cells)).withColumn(axis_id, F.array_min(F.transform("_cells", far))["i"]).drop("_cells")


def knn_graph(points: DataFrame, k: int, group: list[str] = (), node: str = "node", x: str = "x", y: str = "y") -> DataFrame:
    """Undirected edges (a < b) from each node to its ``k`` nearest in the group (ties: smaller id).

    For tables of sites; each stratum is compared with itself.
    """
    b = points.withColumnsRenamed({node: "_n", x: "_x", y: "_y"})
    pair = points.join(b, list(group)) if group else points.join(b, F.col(node) != F.col("_n"))
    pair = pair.where(F.col(node) != F.col("_n")).withColumn("d", F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2))
    rank = F.row_number().over(Window.partitionBy(*group, node).orderBy(F.round("d", 9), "_n"))
    near = pair.withColumn("_r", rank).where(F.col("_r") <= k)
    return near.select(*group, F.least(node, "_n").alias("a"), F.greatest(node, "_n").alias("b")).distinct()


def proximity_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """For each left row the nearest right row within ``metres`` (haversine; ties: smaller id).

    Rows meet in grid cells: bands of latitude, each cut in as many longitude
    cells as its latitude next to a pole allows, counted around the globe, so
    pairs near the poles and across the date line are found.
    """
    radius = 6371008.8
    half = math.sin(min(metres / (2 * radius), math.pi / 2))
    size = max(math.degrees(metres / radius) * 1.0001, 1e-6)

    def cells(band: Column) -> Column:
        high = F.least(F.greatest(F.abs((band - 1) * size), F.abs((band + 2) * size)), F.lit(89.9999999))
        reach = F.least(F.lit(half) / F.cos(F.radians(high)), F.lit(1.0))
        return F.greatest(F.floor(360 / (F.degrees(2 * F.asin(reach)) * 1.0001)), F.lit(1)).cast("bigint")

    def cell(lon: Column, n: Column) -> Column:
        return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n).cast("bigint"), n - 1)

    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = left.select(left_id, F.col(lat).cast("double").alias("_a"), F.col(lon).cast("double").alias("_o"), F.explode(shift).alias("_i"))
    a = a.withColumn("_gx", F.floor(F.col("_a") / size) + F.col("_i")).withColumn("_n", cells(F.col("_gx")))
    near = F.array_distinct(F.transform(shift, lambda j: F.pmod(cell(F.col("_o"), F.col("_n")) + j, F.col("_n"))))
    a = a.withColumn("_gy", F.explode(near)).drop("_n", "_i")
    b = right.select(right_id, F.col(lat).cast("double").alias("_ra"), F.col(lon).cast("double").alias("_ro")).withColumn("_gx", F.floor(F.col("_ra") / size))
    b = b.withColumn("_gy", cell(F.col("_ro"), cells(F.col("_gx"))))
    d = a.join(b, ["_gx", "_gy"]).withColumn("metres", 1000 * haversine_km("_a", "_o", "_ra", "_ro")).where(F.col("metres") <= metres)
    best = d.groupBy(left_id).agg(F.min(F.struct("metres", right_id)).alias("m"))
    return best.select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.metres").alias("metres"))


def pairs(df: DataFrame, ident: str, group: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Unordered pairs (a < b) within a group of small bounded size (sites, profiles)."""
    left = df.select(*group, F.col(ident).alias("a"), *(F.col(c).alias(f"{c}_a") for c in keep))
    right = df.select(*group, F.col(ident).alias("b"), *(F.col(c).alias(f"{c}_b") for c in keep))
    return left.join(right, list(group)).where("a < b") if group else left.join(right, F.col("a") < F.col("b"))


def nearest_in_series(df: DataFrame, k: int, group: list[str], number: str, ident: str) -> DataFrame:
    """The ``k`` rows with the closest numbers in the same series (ties: smaller number).

    Only the k rows to either side in number order can be among them, so no
    pairs of a whole series are formed.
    """
    w = Window.partitionBy(*group).orderBy(number, ident)
    near = F.concat(*(F.array(F.struct(f(number, i).over(w).alias("n"), f(ident, i).over(w).alias("i"))) for f in (F.lag, F.lead) for i in range(1, k + 1)))
    out = df.select(*group, ident, number, F.filter(near, lambda x: x["n"].isNotNull()).alias("_near")).withColumn("m", F.explode("_near"))
    rank = F.row_number().over(Window.partitionBy(*group, ident).orderBy(F.abs(F.col("m.n") - F.col(number)), "m.n", "m.i"))
    return out.withColumn("r", rank).where(F.col("r") <= k).select(*group, ident, F.col("m.i").alias("neighbour"), F.abs(F.col("m.n") - F.col(number)).alias("gap"), "r")


def complete_blocks(df: DataFrame, block: list[str], position: str, wanted: list) -> DataFrame:
    """Rows of blocks that have every wanted position."""
    rows = df.where(F.col(position).isin(*wanted))
    full = rows.groupBy(*block).agg(F.count_distinct(position).alias("_k")).where(F.col("_k") == len(wanted)).drop("_k")
    return rows.join(full, block, "left_semi")


def allocate_runs(profiles: DataFrame, runs: DataFrame, sample: str = "sample", profile: str = "profile", run: str = "run") -> DataFrame:
    """The i-th profile of a sample takes run min(i, number of runs); a single profile takes all runs."""
    p = profiles.withColumn("_i", F.row_number().over(Window.partitionBy(sample).orderBy(profile))).withColumn("_np", F.count(F.lit(1)).over(Window.partitionBy(sample)))
    r = runs.withColumn("_j", F.row_number().over(Window.partitionBy(sample).orderBy(run))).withColumn("_nr", F.count(F.lit(1)).over(Window.partitionBy(sample)))
    take = (F.col("_np") == 1) | (F.col("_j") == F.least("_i", "_nr"))
    return p.join(r, sample).where(take).select(sample, profile, run)


def fold_accessions(libraries: DataFrame, runs: DataFrame, on: str, run: str, unique: str) -> DataFrame:
    """Runs of a library as one ``;`` list; a library with two values of ``unique`` is an error."""
    folded = runs.groupBy(on).agg(F.concat_ws(";", F.array_sort(F.collect_set(F.col(run).cast("string")))).alias("runs"), F.min(unique).alias(unique), F.count_distinct(unique).alias("_u"))
    bad = folded.where("_u > 1").select(on).limit(5).collect()
    if bad:
        raise CardinalityError(f"{unique} is not unique for {[b[0] for b in bad]}")
    return libraries.join(folded.drop("_u"), on, "left")
