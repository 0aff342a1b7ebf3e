"""Rules over tables: expectations, ledgers, versions, registries, reconciliation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.session import cut

RANGE = 100_000  # rows of a range of tolerance_windows, which a window holds at a time


class RuleError(ValueError):
    pass


def rule_columns(spec: dict[str, dict]) -> dict[str, Column]:
    """``column -> {not_null, finite, least, most, integer, domain}`` as named violation conditions."""
    out = {}
    for c, rules in spec.items():
        v = F.col(c)
        if rules.get("not_null"):
            out[f"{c}:null"] = v.isNull()
        if rules.get("finite"):
            out[f"{c}:not finite"] = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        if "least" in rules:
            out[f"{c}:low"] = v < rules["least"]
        if "most" in rules:
            out[f"{c}:high"] = v > rules["most"]
        if rules.get("integer"):
            out[f"{c}:fraction"] = v != F.floor(v)
        if "domain" in rules:
            out[f"{c}:domain"] = ~v.isin(*rules["domain"])
    return out


def expect(df: DataFrame, spec: dict[str, dict], fail: bool = False) -> DataFrame:
    """``(rule, n)`` of every rule from one pass; missing columns always fail, violations only with ``fail``."""
    missing = [c for c in spec if c not in df.columns]
    if missing:
        raise RuleError(f"missing columns: {missing}")
    rules = rule_columns(spec)
    one = df.agg(*(F.count_if(F.coalesce(r, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules.values())))
    out = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"r{i}").alias("n")) for i, k in enumerate(rules)))).alias("x")).select("x.*")
    if fail and (bad := out.where("n > 0").collect()):
        raise RuleError(", ".join(f"{r['rule']} ({r['n']})" for r in bad))
    return out


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def apply_ledger(cells: DataFrame, ledger: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Exact-cell corrections: (key, value, corrected, action).

    An entry applies only where the stored value equals its ``old_value``;
    actions are corrected, conflict (other value found), unused (no such
    cell), and kept.
    """
    j = cells.withColumn("_c", F.lit(1)).join(ledger.select(*key, "old_value", "new_value", F.lit(1).alias("_l")), key, "full_outer")
    action = F.when(F.col("_c").isNull(), "unused").when(F.col("_l").isNull(), "kept").when(F.col(value).eqNullSafe(F.col("old_value")), "corrected").otherwise("conflict")
    return j.withColumn("action", action).select(*key, value, F.when(F.col("action") == "corrected", F.col("new_value")).otherwise(F.col(value)).alias("corrected"), "action")


def assert_ledger_clean(applied: DataFrame) -> None:
    bad = applied.where("action in ('unused', 'conflict')").groupBy("action").count().collect()
    if bad:
        raise RuleError(", ".join(f"{r['action']}: {r['count']}" for r in bad))


def apply_successor(old: DataFrame, new: DataFrame, key: list[str], allowed: list[str], fixed: list[str]) -> DataFrame:
    """Coverage and changes of a successor version: one row a key with status and changed columns."""
    j = old.select(*key, *(F.col(c).alias(f"o_{c}") for c in [*allowed, *fixed]), F.lit(1).alias("_o")).join(new.select(*key, *(F.col(c).alias(f"n_{c}") for c in [*allowed, *fixed]), F.lit(1).alias("_n")), key, "full_outer")
    differs = lambda c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    illegal = reduce(lambda a, b: a | b, map(differs, fixed), F.lit(False))
    legal = reduce(lambda a, b: a | b, map(differs, allowed), F.lit(False))
    status = F.when(F.col("_n").isNull(), "dropped").when(F.col("_o").isNull(), "added").when(illegal, "illegal change").when(legal, "changed").otherwise("same")
    changed = F.concat_ws(",", F.array_compact(F.array(*(F.when(both & differs(c), F.lit(c)) for c in [*allowed, *fixed]))))
    return j.select(*key, status.alias("status"), changed.alias("changed"))


def diff_versions(a: DataFrame, b: DataFrame, key: list[str], value: str, meta: list[str], tol: float = 1e-12) -> DataFrame:
    """UNCHANGED, REVISED_VALUE, REVISED_METADATA, ABSENT or ADDED for each key; NULL equals NULL."""
    x = a.select(*key, F.col(value).alias("v1"), F.struct(*meta).alias("m1"), F.lit(1).alias("_a"))
    y = b.select(*key, F.col(value).alias("v2"), F.struct(*meta).alias("m2"), F.lit(1).alias("_b"))
    same = F.col("v1").eqNullSafe(F.col("v2")) | F.coalesce(F.abs(F.col("v1") - F.col("v2")) <= tol, F.lit(False))
    status = F.when(F.col("_b").isNull(), "ABSENT").when(F.col("_a").isNull(), "ADDED").when(~same, "REVISED_VALUE").when(~F.col("m1").eqNullSafe(F.col("m2")), "REVISED_METADATA").otherwise("UNCHANGED")
    return x.join(y, key, "full_outer").select(*key, "v1", "v2", status.alias("status"))


def sessions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Session number of each distinct key combination, in key order, joined back to the rows."""
    from quadrat.operators.keys import row_numbers

    combos = row_numbers(df.select(*keys).distinct(), [F.col(k) for k in keys], out="session")
    return df.join(combos, keys)


def reproduces(stored: DataFrame, recomputed: DataFrame, key: list[str], value: str, tol: float = 1e-9) -> DataFrame:
    j = stored.select(*key, F.col(value).alias("x")).join(recomputed.select(*key, F.col(value).alias("y")), key, "full_outer")
    ok = F.coalesce(F.abs(F.col("x") - F.col("y")) <= tol, F.col("x").isNull() & F.col("y").isNull())
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_match"), F.count_if(F.col("x").isNull() & F.col("y").isNotNull()).alias("n_not_stored"), F.count_if(F.col("y").isNull() & F.col("x").isNotNull()).alias("n_not_recomputed"))


def registry(decls: DataFrame, uses: DataFrame) -> DataFrame:
    """Problems of an identifier registry: (id, problem). ``decls``: id, label, kind; ``uses``: id, kind."""
    d = decls.groupBy("id").agg(F.count_distinct("label").alias("nl"), F.count_distinct("kind").alias("nk"), F.min("kind").alias("kind"))
    u = uses.groupBy("id").agg(F.count_distinct("kind").alias("uk"), F.min("kind").alias("ukind"))
    j = d.join(u, "id", "full_outer")
    flags = F.array_compact(F.array(
        F.when(F.col("nl") > 1, F.lit("label conflict")), F.when(F.col("nk") > 1, F.lit("kind conflict")),
        F.when((F.col("uk") > 1) | (F.col("ukind") != F.col("kind")), F.lit("use kind conflict")), F.when(F.col("nl").isNull(), F.lit("undeclared")),
    ))
    return j.select("id", F.explode(flags).alias("problem"))


def complete(df: DataFrame, keys: DataFrame, key: str, required: dict[str, list[str] | None]) -> DataFrame:
    """Keys that lack a required field or have a value outside its vocabulary."""
    j = keys.join(df, key, "left")
    flags = []
    for c, allowed in required.items():
        flags.append(F.when(F.col(c).isNull(), F.lit(f"{c} missing")))
        if allowed:
            flags.append(F.when(~F.col(c).isin(*allowed), F.lit(f"{c} not allowed")))
    return j.select(key, F.explode(F.array_compact(F.array(*flags))).alias("problem"))


def conservation(abundance: DataFrame, source: DataFrame, keys: list[str], tol: float = 0.01) -> DataFrame:
    """Groups whose relative sums differ from 1, or whose counts differ from the source. ``abundance``: keys, rank, n, relative."""
    g = abundance.groupBy(*keys, "rank").agg(F.sum("n").alias("n"), F.sum("relative").alias("relative"))
    s = source.groupBy(*keys).agg(F.sum("n").alias("source_n"))
    j = g.join(s, keys, "left")
    return j.withColumn("problem", F.when(F.abs(F.col("relative") - 1) > tol, "relative").when(~F.col("n").eqNullSafe(F.col("source_n")), "absolute")).where("problem is not null")


def tolerance_windows(df: DataFrame, group: list[str], value: str, abs_tol: float, rel_tol: float, out: str) -> DataFrame:
    """``df`` with a number ``out`` of each run of rows of a group whose neighbouring values are within tolerance.

    Rows of different runs are never within tolerance (for ``rel_tol`` up to 1).
    The order is dealt by ranges; a range learns the last row before it and the
    runs before it from a table of one row a range, so no group sits in one task.
    """
    order, plain = [*group, value], cut(df, "plain")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plain.count() // RANGE)
    ranged = cut(plain.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    w, ranges = Window.partitionBy("_p").orderBy(*order), Window.orderBy("_p")
    last = ranged.groupBy("_p").agg(F.max(F.struct(*order)).alias("_z"))
    last = F.broadcast(last.select("_p", F.lag("_z").over(ranges).alias("_z")))
    before = F.coalesce(F.lag(F.struct(*order)).over(w), F.col("_z"))
    reach = F.greatest(F.lit(abs_tol), F.greatest(F.abs(value), F.abs(before[value])) * rel_tol)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(before[c]) for c in group), F.lit(True))
    opened = F.when(before.isNotNull() & same & (F.col(value) - before[value] <= reach), 0).otherwise(1)
    marked = ranged.join(last, "_p").withColumn("_open", opened)
    total = marked.groupBy("_p").agg(F.sum("_open").alias("_o"))
    total = F.broadcast(total.select("_p", F.coalesce(F.sum("_o").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o")))
    return marked.join(total, "_p").withColumn(out, F.col("_o") + F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_z", "_open", "_o")


def matching(actual: np.ndarray, expected: np.ndarray, n_actual: list[int], n_expected: list[int], abs_tol: float, rel_tol: float) -> int:
    """Size of a largest matching of rows within tolerance in every number; equal rows stand once, with how many they are.

    Augmenting paths over the distinct rows: a path moves as many rows as its
    narrowest part has.
    """
    near = [np.flatnonzero((np.abs(actual - e) <= np.maximum(abs_tol, np.abs(e) * rel_tol)).all(axis=1)).tolist() for e in expected]
    free, flow, size = list(n_actual), [dict() for _ in actual], 0
    for e, wanted in enumerate(n_expected):
        while wanted:
            came, queue, end = {}, [e], None
            came_from = {e: None}
            for x in queue:
                for a in near[x]:
                    if a in came:
                        continue
                    came[a] = x
                    if free[a]:
                        end = a
                        break
                    for y in flow[a]:
                        if y not in came_from:
                            came_from[y] = a
                            queue.append(y)
                if end is not None:
                    break
            if end is None:
                break
            path, a = [], end
            while a is not None:
                path.append((came[a], a))
                a = came_from[came[a]]
            moved = min([wanted, free[end], *(flow[a][came[b]] for (_, b), (_, a) in zip(path, path[1:]))])
            free[end] -= moved
            for i, (x, a) in enumerate(path):
                flow[a][x] = flow[a].get(x, 0) + moved
                if i + 1 < len(path):
                    held = path[i + 1][1]
                    flow[held][x] -= moved
                    if not flow[held][x]:
                        del flow[held][x]
            wanted -= moved
            size += moved
    return size


def compare_golden(actual: DataFrame, expected: DataFrame, cats: list[str], nums: list[str], abs_tol: float = 1e-12, rel_tol: float = 1e-12) -> DataFrame:
    """``(cats, n_actual, n_expected, n_matched)`` of categorical groups without a perfect matching.

    A row matches one expected row at most, if every number is within
    ``max(abs_tol, rel_tol * |expected|)`` of it; NULL, NaN and infinities match
    their own kind only. Equal rows are counted first, so repeats cost nothing.
    Groups are cut where a sorted number leaves a gap beyond the tolerance, for
    one number after another; what hangs together is matched in one task.
    """
    if rel_tol > 1:
        raise ValueError("rel_tol is at most 1")
    kinds, values = [f"_k{i}" for i in range(len(nums))], [f"_v{i}" for i in range(len(nums))]
    inf = float("inf")

    def counted(df: DataFrame, side: str) -> DataFrame:
        x = [F.col(c).cast("double") for c in nums]
        kind = [F.when(v.isNull(), 1).when(F.isnan(v), 2).when(v == inf, 3).when(v == -inf, 4).otherwise(0).alias(k) for v, k in zip(x, kinds)]
        plain = df.select(*cats, *kind, *(F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf), v + 0.0).otherwise(0.0).alias(n) for v, n in zip(x, values)))
        return plain.groupBy(*cats, *kinds, *values).agg(F.count(F.lit(1)).alias(side))

    a, e = counted(actual, "_a"), counted(expected, "_e")
    rows = a.withColumn("_e", F.lit(0).cast("bigint")).unionByName(e.withColumn("_a", F.lit(0).cast("bigint")))
    rows = rows.groupBy(*cats, *kinds, *values).agg(F.sum("_a").alias("_a"), F.sum("_e").alias("_e"))
    group = [*cats, *kinds]
    for i, v in enumerate(values):
        rows = tolerance_windows(rows, group, v, abs_tol, rel_tol, f"_w{i}")
        group = [*cats, *kinds, f"_w{i}"]
    def solved(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        numbers, n_a, n_e = pdf[values].to_numpy(), pdf["_a"].to_numpy(), pdf["_e"].to_numpy()
        found = []
        for s, z in zip(starts, [*starts[1:], len(pdf)]):
            x, y = s + np.flatnonzero(n_a[s:z] > 0), s + np.flatnonzero(n_e[s:z] > 0)
            found.append(matching(numbers[x], numbers[y], n_a[x].tolist(), n_e[y].tolist(), abs_tol, rel_tol))
        return pd.DataFrame({last: pdf[last].to_numpy()[starts], "n_matched": np.array(found, "int64")})

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows follow each other in a sorted partition, so many small ones are solved at a time."""
        held = None
        for pdf in parts:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            starts = np.flatnonzero(np.append(True, np.diff(pdf[last].to_numpy()) != 0))
            if len(starts) > 1:
                yield solved(pdf.iloc[: starts[-1]].reset_index(drop=True), starts[:-1])
            held = pdf.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield solved(held, np.array([0]))

    # a window of one distinct row, or of one side only, needs no task of its own
    own = Window.partitionBy(*group)
    rows = rows.withColumns({"_m": F.count(F.lit(1)).over(own), "_sa": F.sum("_a").over(own), "_se": F.sum("_e").over(own)})
    rows = cut(rows, "windows") if nums else rows
    hard = (F.col("_m") > 1) & (F.col("_sa") > 0) & (F.col("_se") > 0)
    easy = rows.where(~hard).select(*cats, F.col("_a").alias("n_actual"), F.col("_e").alias("n_expected"), F.when(F.col("_m") == 1, F.least("_a", "_e")).otherwise(F.lit(0).cast("bigint")).alias("n_matched"))
    last = f"_w{len(nums) - 1}"  # its numbers go through all groups, so they name a window alone
    if nums:
        met = rows.where(hard).select(*values, last, "_a", "_e").repartition(last).sortWithinPartitions(last).mapInPandas(solve, f"{last} bigint, n_matched bigint")
        known = rows.where(hard).groupBy(last).agg(*(F.first(c).alias(c) for c in cats), F.sum("_a").alias("n_actual"), F.sum("_e").alias("n_expected"))
        easy = easy.unionByName(known.join(met, last).drop(last))
    sums = easy.groupBy(*cats).agg(*(F.sum(c).alias(c) for c in ("n_actual", "n_expected", "n_matched")))
    return sums.where("n_matched < greatest(n_actual, n_expected)")


def reconcile_counts(counts: dict[str, DataFrame | Column], expected: dict[str, int], spark) -> DataFrame:
    """``(layer, n, expected, ok)`` of labelled row counts."""
    rows = reduce(lambda a, b: a.unionByName(b), (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("layer"), "n") for k, df in counts.items()))
    want = F.create_map(*(x for k, v in expected.items() for x in (F.lit(k), F.lit(v).cast("bigint"))))
    return rows.withColumn("expected", want[F.col("layer")]).withColumn("ok", F.col("n") == F.col("expected"))


def unit_evidence(tables: DataFrame, source: str, text: str, units: dict[str, str]) -> DataFrame:
    """Which sources declare which unit: rows whose text matches the unit's pattern."""
    each = F.explode(F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(u)) for u, p in units.items())))).alias("unit")
    return tables.select(source, each).groupBy(source, "unit").agg(F.count(F.lit(1)).alias("n"))


def formula_audit(mapping: DataFrame, ref: DataFrame, key: str = "id") -> DataFrame:
    """How a mapped formula relates to the reference one: exact, empirical_equivalent, mismatch or not_asserted."""
    from quadrat.operators.keys import parse_formula

    j = mapping.join(ref.select(key, F.col("formula").alias("ref_formula"), "obsolete", "charge"), key, "left")
    relation = F.when(F.col("formula").isNull() | F.col("ref_formula").isNull(), "not_asserted").when(F.col("formula") == F.col("ref_formula"), "exact").when(parse_formula("formula") == parse_formula("ref_formula"), "empirical_equivalent").otherwise("mismatch")
    return j.withColumn("relation", relation)


def infer_dictionary(df: DataFrame) -> DataFrame:
    """Inferred kind of every (text) column, whether it is ever blank, and its distinct values (approximate)."""
    names = df.columns
    text = lambda c: F.trim(F.col(c).cast("string"))
    aggs = []
    for i, c in enumerate(names):
        v = text(c)
        full = v.isNotNull() & (v != "")
        aggs += [
            F.count_if(full).alias(f"n{i}"), F.count_if(full & v.rlike(r"^(0|1|true|false|True|False)$")).alias(f"b{i}"), F.count_if(full & v.rlike(r"^[+-]?\d+$")).alias(f"i{i}"),
            F.count_if(full & v.try_cast("double").isNotNull()).alias(f"d{i}"), F.count_if(full & v.rlike(r"^\d{4}-\d{2}-\d{2}")).alias(f"t{i}"),
        ]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    kind = lambda i: F.when(F.col(f"n{i}") == 0, "empty").when(F.col(f"b{i}") == F.col(f"n{i}"), "boolean").when(F.col(f"i{i}") == F.col(f"n{i}"), "integer").when(F.col(f"d{i}") == F.col(f"n{i}"), "number").when(F.col(f"t{i}") == F.col(f"n{i}"), "date").otherwise("string")
    cells = F.array(*(F.struct(F.lit(c).alias("field"), kind(i).alias("kind"), (F.col(f"n{i}") < F.col("rows")).alias("has_blank"), F.col(f"n{i}").alias("n_filled")) for i, c in enumerate(names)))
    return one.select(F.explode(cells).alias("x")).select("x.*")


def ordered_sequence_gaps(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """Gaps in a numbered series of each group."""
    before = F.lag(number).over(Window.partitionBy(*group).orderBy(number))
    return df.withColumn("previous", before).where(F.col(number) - F.col("previous") > 1).select(*group, "previous", number)
