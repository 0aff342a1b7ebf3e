"""Control screens: contaminants, batches, spillover, removal, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.numeric import ratio
from quadrat.operators.agg import alpha_basic, role_presence, scenario_grid
from quadrat.operators.stats import fisher_greater


def contaminant_scores(counts: DataFrame, roles: DataFrame, profile: str = "profile") -> DataFrame:
    """Presence by role and the one-sided Fisher p that a feature is commoner in controls."""
    totals = roles.agg(F.count_if("is_control").alias("_k"), F.count_if(~F.col("is_control")).alias("_s"))
    p = role_presence(counts.join(roles.select(profile, "is_control"), profile), "is_control").join(F.broadcast(totals))
    a, b = F.col("in_controls"), F.col("in_samples")
    return p.withColumn("p", F.when(a > 0, fisher_greater(a, F.col("_k") - a, b, F.col("_s") - b)).otherwise(1.0)).withColumn("share_controls", ratio(a, "_k")).withColumn("share_samples", ratio(b, "_s")).drop("_k", "_s")


def contaminant_screen(counts: DataFrame, roles: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Features called contaminants: p under the threshold and commoner in controls."""
    return contaminant_scores(counts, roles).where((F.col("p") < threshold) & (F.col("share_controls") > F.col("share_samples")))


def batch_screen(counts: DataFrame, roles: DataFrame, batches: DataFrame, min_blanks: int = 2) -> DataFrame:
    """The screen within each batch that has enough blanks: (batch, feature, ..., p)."""
    mapped = roles.join(batches, "profile")
    size = mapped.groupBy("batch").agg(F.count_if("is_control").alias("_k"), F.count_if(~F.col("is_control")).alias("_s")).where((F.col("_k") >= min_blanks) & (F.col("_s") > 0))
    rows = counts.where("n > 0").join(mapped, "profile").groupBy("batch", "feature").agg(F.count_if("is_control").alias("in_controls"), F.count_if(~F.col("is_control")).alias("in_samples"))
    a, b = F.col("in_controls"), F.col("in_samples")
    j = rows.join(size, "batch")
    return j.withColumn("p", F.when(a > 0, fisher_greater(a, F.col("_k") - a, b, F.col("_s") - b)).otherwise(1.0)).withColumn("commoner", a / F.col("_k") > b / F.col("_s")).drop("_k", "_s")


def batch_scenarios(scores: DataFrame, thresholds: list[float], blanks: list[int]) -> DataFrame:
    return scenario_grid(scores.where("commoner"), "p", "in_controls", thresholds, blanks)


def spillover(counts: DataFrame, roles: DataFrame, taxonomy: DataFrame, expected: list[str], rank: int, positive: str = "positive") -> DataFrame:
    """Features of expected taxa found in the positive control: where else they occur, and at most how large.

    ``roles``: profile, role. One row a feature and role.
    """
    wanted = taxonomy.where(F.element_at("lineage", rank).isin(*expected)).select("feature")
    rows = counts.join(wanted, "feature", "left_semi").join(roles, "profile")
    carried = rows.where((F.col("role") == positive) & (F.col("n") > 0)).select("feature").distinct()
    depth = counts.groupBy("profile").agg(F.sum("n").alias("depth"))
    return rows.join(carried, "feature", "left_semi").where("n > 0").join(depth, "profile").groupBy("feature", "role").agg(F.count(F.lit(1)).alias("profiles"), F.sum("n").alias("reads"), F.max(ratio("n", "depth")).alias("max_share"))


def apply_removal(counts: DataFrame, called: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts without called features, invariants per profile: depth before, removed, after)."""
    mark = called.select("feature").distinct()
    kept = counts.join(mark, "feature", "left_anti")
    before = counts.groupBy("profile").agg(F.sum("n").alias("before"))
    gone = counts.join(mark, "feature", "left_semi").groupBy("profile").agg(F.sum("n").alias("removed"))
    after = kept.groupBy("profile").agg(F.sum("n").alias("after"))
    inv = before.join(gone, "profile", "left").join(after, "profile", "left").na.fill(0, ["removed", "after"])
    return kept, inv.withColumn("ok", F.col("before") - F.col("removed") == F.col("after"))


def compare_headlines(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``(key, metric, before, after, change)`` of two headline tables."""
    cells = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values))).alias("c")).select(key, "c.metric", F.col("c.v").alias(name))
    j = cells(before, "before").join(cells(after, "after"), [key, "metric"], "full_outer")
    return j.withColumn("change", F.col("after") - F.col("before"))


def removal_effect(counts: DataFrame, called: DataFrame) -> DataFrame:
    kept, _ = apply_removal(counts, called)
    return compare_headlines(alpha_basic(counts), alpha_basic(kept), "profile", ["depth", "richness", "shannon"])


def control_inventory(sources: dict[str, DataFrame], label: str = "label", kind: str = "kind") -> DataFrame:
    """Union of evidence on controls by normalised label: sources, kinds, and whether they conflict."""
    from functools import reduce

    norm = F.regexp_replace(F.lower(F.col(label)), "[^a-z0-9]+", "")
    rows = reduce(lambda a, b: a.unionByName(b), (df.select(norm.alias("norm"), F.col(kind).alias("kind"), F.lit(name).alias("source")) for name, df in sources.items()))
    return rows.groupBy("norm").agg(
        F.concat_ws(";", F.array_sort(F.collect_set("source"))).alias("sources"), F.concat_ws(";", F.array_sort(F.collect_set("kind"))).alias("kinds"), (F.count_distinct("kind") > 1).alias("conflict"), F.count(F.lit(1)).alias("n_evidence")
    )
