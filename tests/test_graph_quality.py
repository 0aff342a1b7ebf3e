"""Rule closure, hierarchies, shapes, ledgers and versions, one defect each."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadrat.operators import graph as G
from quadrat.operators import quality as Q
from quadrat.operators import taxonomy as X
from quadrat.operators.components import connected_components


def triples(spark, data):
    return spark.createDataFrame([(*t, "literal" if t[2].startswith('"') else "iri") for t in data], "s string, p string, o string, o_kind string")


def inferred(spark, data, schema):
    return {tuple(r)[:3] for r in G.materialize(triples(spark, data), schema)[0].collect()}


def test_chain_of_five_classes(spark):
    e = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(4)], "child string, parent string")
    closed = G.closure(e)
    assert closed.count() == 10 and closed.where("node = 'c0' and ancestor = 'c4'").first()["depth"] == 4
    got = inferred(spark, [("x", "type", "c0")], G.Schema(subclass=[(f"c{i}", f"c{i + 1}") for i in range(4)]))
    assert got == {("x", "type", f"c{i}") for i in range(1, 5)}


def test_cycle_is_found(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    assert rows(G.cycles(G.closure(e))) == [("a",), ("b",)]


def test_inverse_skips_literals(spark):
    s = G.Schema(inverse=[("p", "q")])
    assert inferred(spark, [("s", "p", "o"), ("s", "p", '"5"')], s) == {("o", "q", "s")}


@pytest.mark.parametrize("schema,data,new", [
    (dict(symmetric=["near"]), [("a", "near", "b")], {("b", "near", "a")}),
    (dict(transitive=["in"]), [("a", "in", "b"), ("b", "in", "c"), ("c", "in", "d")], {("a", "in", "c"), ("b", "in", "d"), ("a", "in", "d")}),
    (dict(subproperty=[("p", "q")], domain=[("q", "D")], range=[("q", "R")]), [("a", "p", "b")], {("a", "q", "b"), ("a", "type", "D"), ("b", "type", "R")}),
    (dict(has_value=[("C", "color", "red")]), [("a", "type", "C"), ("b", "color", "red")], {("a", "color", "red"), ("b", "type", "C")}),
    (dict(some_values=[("Parent", "child", "Person")]), [("a", "child", "b"), ("b", "type", "Person"), ("c", "child", "d")], {("a", "type", "Parent")}),
    (dict(some_values=[("Parent", "child", "Thing")]), [("c", "child", "d")], {("c", "type", "Parent")}),
    (dict(all_values=[("C", "p", "F")]), [("a", "type", "C"), ("a", "p", "b")], {("b", "type", "F")}),
    (dict(intersection=[("AB", ("A", "B"))]), [("x", "type", "A"), ("x", "type", "B"), ("y", "type", "A"), ("z", "type", "AB")], {("x", "type", "AB"), ("z", "type", "A"), ("z", "type", "B")}),
    (dict(union=[("U", ("A", "B"))]), [("x", "type", "B")], {("x", "type", "U")}),
    (dict(one_of=[("E", ("e1", "e2"))]), [("q", "p", "e1")], {("e1", "type", "E"), ("e2", "type", "E")}),
    (dict(equivalent_class=[("A", "B")]), [("x", "type", "B")], {("x", "type", "A")}),
    (dict(chains=[(("father", "brother"), "uncle")]), [("a", "father", "b"), ("b", "brother", "c")], {("a", "uncle", "c")}),
    (dict(chains=[(("^has", "has", "near"), "peer")]), [("r", "has", "a"), ("r", "has", "b"), ("b", "near", "c")], {("a", "peer", "c"), ("b", "peer", "c")}),
])
def test_rules(spark, schema, data, new):
    assert inferred(spark, data, G.Schema(**schema)) == new


def test_no_rules_no_inference(spark):
    assert inferred(spark, [("a", "p", "b")], G.Schema()) == set()


def test_lists(spark):
    t = triples(spark, [("l", "first", "a"), ("l", "rest", "l2"), ("l2", "first", "b"), ("l2", "rest", "nil"), ("m", "first", "x"), ("m", "rest", "m2")])
    assert rows(G.rdf_lists(t)) == [("l", 1, "a"), ("l", 2, "b"), ("m", -1, None)]


def test_pattern_optional_and_walk(spark):
    t = triples(spark, [("s", "type", "S"), ("s", "to", "e"), ("s", "to", "f"), ("e", "to", "g"), ("f", "to", "g"), ("g", "label", '"G"')])
    assert G.walk(t, "S", ["to", "to"]).count() == 2 and G.walk(t, "S", ["to", "to"], keep_paths=False).count() == 1
    got = G.bgp(t, [G.Pattern("?a", "to", "?b")], [[G.Pattern("?b", "label", "?l")]])
    assert got.where("l is null").count() == 2 and got.count() == 4
    with pytest.raises(ValueError):
        G.bgp(t, [G.Pattern("?a", "to", "?b"), G.Pattern("?x", "label", "?y")])


def test_shapes_find_one_defect_each(spark):
    t = triples(spark, [("a", "type", "R"), ("a", "val", '"1"'), ("b", "type", "R"), ("c", "type", "R"), ("c", "val", '"1"'), ("c", "val", '"2"'), ("a", "of", "q"), ("b", "of", "q"), ("c", "of", "q"), ("q", "type", "Q"), ("c", "of", "z")])
    bad = G.validate_shapes(t, [("R", "val", 1, 1, None), ("R", "of", 1, None, "Q")])
    assert {(r.s, r.predicate) for r in bad.collect()} == {("b", "val"), ("c", "val"), ("c", "of")}


def test_fingerprint_ignores_order_and_sees_multiplicity(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    f = lambda d: G.fingerprint(d, ["a", "b"]).first()
    assert f(df) == f(df.orderBy("a", ascending=False)) and f(df) != f(df.unionAll(df.limit(1)))


def test_ledger(spark):
    cells = spark.createDataFrame([(1, "f", "old"), (2, "f", "y")], "row int, field string, value string")
    led = spark.createDataFrame([(1, "f", "old", "new"), (2, "f", "x", "z"), (9, "f", "a", "b")], "row int, field string, old_value string, new_value string")
    got = Q.apply_ledger(cells, led, ["row", "field"])
    assert {(r.row, r.corrected, r.action) for r in got.collect()} == {(1, "new", "corrected"), (2, "y", "conflict"), (9, None, "unused")}
    with pytest.raises(Q.RuleError):
        Q.assert_ledger_clean(got)


def test_versions_and_golden(spark):
    a = spark.createDataFrame([(1, 1.0, "m"), (2, None, "m"), (3, 3.0, "m")], "k int, v double, m string")
    b = spark.createDataFrame([(1, 1.0 + 1e-14, "m"), (2, None, "n"), (4, 4.0, "m")], "k int, v double, m string")
    assert {r.k: r.status for r in Q.diff_versions(a, b, ["k"], "v", ["m"]).collect()} == {1: "UNCHANGED", 2: "REVISED_METADATA", 3: "ABSENT", 4: "ADDED"}
    one = spark.createDataFrame([("c", 1.0)], "c string, v double")
    two = spark.createDataFrame([("c", 1.0), ("c", 1.0)], "c string, v double")
    assert Q.compare_golden(one, two, ["c"], ["v"]).count() == 1 and Q.compare_golden(two, two, ["c"], ["v"]).isEmpty()


def test_expectations_fail_closed(spark):
    df = spark.createDataFrame([(1.5,), (None,), (-1.0,)], "v double")
    assert {r.rule: r.n for r in Q.expect(df, {"v": {"not_null": True, "least": 0, "integer": True}}).collect()} == {"v:null": 1, "v:low": 1, "v:fraction": 1}
    with pytest.raises(Q.RuleError):
        Q.expect(df, {"w": {}})
    with pytest.raises(Q.RuleError):
        Q.expect(df, {"v": {"least": 0}}, fail=True)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (5, 5), (None, 7)], "a int, b int")
    got = {r.node: r.root for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_merge_of_two_hierarchies(spark):
    s = "id string, label string, rank string, parent string"
    a = spark.createDataFrame([("1", "Alpha", "genus", None), ("2", "Beta", "species", "1"), ("3", "Only A", "genus", None)], s)
    b = spark.createDataFrame([("7", "alpha", "genus", None), ("8", "beta", "genus", "7"), ("9", "Gamma", "genus", None)], s)
    none = spark.createDataFrame([], "a string, b string")
    hints = spark.createDataFrame([("3", "9", 2)], "pa string, pb string, votes int")
    comp = {r.node: r.component for r in X.merge_hierarchies(a, b, none, hints).collect()}
    assert comp["A:1"] == comp["B:7"] and comp["A:3"] == comp["B:9"] and comp["A:2"] != comp["B:8"]


def test_components_with_hot_nodes(spark):
    import random

    from quadrat.operators.components import connected_components

    rng = random.Random(5)
    edges = [(9_000, i) for i in range(1_500)] + [(i, i + 1) for i in range(20_000, 20_400)] + [(rng.randrange(30_000, 31_000), rng.randrange(30_000, 31_000)) for _ in range(900)] + [(9_000, 9_000), (None, 3), (5, 5)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int").repartition(40)).collect()}
    assert got == {x: find(x) for x in parent}


def matched(actual, expected, tol):
    """Size of a largest matching, by trying all assignments of the smaller side."""
    import itertools
    small, large = sorted((actual, expected), key=len)
    near = lambda x, y: all(abs(p - q) <= tol for p, q in zip(x, y))
    return max((sum(near(x, large[j]) for x, j in zip(small, p)) for p in itertools.permutations(range(len(large)), len(small))), default=0)


def test_golden_rows_are_matched_one_to_one(spark):
    schema = "c string, x double, y double"
    act = [("cross", 1.0, 5.0), ("cross", 1 + 1e-9, 1.0), ("short", 1.0, 1.0), ("short", 9.0, 1.0), ("chain", 1.0, 0.0), ("chain", 2.0, 0.0), ("chain", 3.0, 0.0), ("none", None, math.nan), ("none", math.inf, -math.inf), ("more", 1.0, 1.0)]
    exp = [("cross", 1.0, 1.0), ("cross", 1 + 1e-9, 5.0), ("short", 1.0, 1.0), ("short", 1 + 1e-9, 1.0), ("chain", 1 + 9e-7, 0.0), ("chain", 2.0, 0.0), ("chain", 3 - 9e-7, 0.0), ("none", None, math.nan), ("none", math.inf, -math.inf), ("lack", 1.0, 1.0)]
    got = Q.compare_golden(spark.createDataFrame(act, schema), spark.createDataFrame(exp, schema), ["c"], ["x", "y"], 1e-6, 0.0).collect()
    assert sorted(map(tuple, got)) == [("lack", 0, 1, 0), ("more", 1, 0, 0), ("short", 2, 2, 1)]
    # the first expected row must give up the row it took first
    a, e = np.array([[1.0], [2.0]]), np.array([[1.5], [0.5]])
    assert Q.matching(a, e, [1, 1], [1, 1], 0.6, 0.0) == 2 and Q.matching(a, e, [3, 2], [3, 3], 0.6, 0.0) == 5


def test_golden_matching_equals_all_assignments(spark):
    rng = random.Random(3)
    act, exp = [], []
    for g in range(60):
        for rows in (act, exp):
            rows += [(g, round(rng.uniform(0, 1.2), 1), round(rng.uniform(0, 0.4), 1)) for _ in range(rng.randint(0, 6))]
    schema = "c int, x double, y double"
    got = {r.c: tuple(r)[1:] for r in Q.compare_golden(spark.createDataFrame(act, schema).repartition(3), spark.createDataFrame(exp, schema), ["c"], ["x", "y"], 0.1500001, 0.0).collect()}
    for g in range(60):
        a, e = [r[1:] for r in act if r[0] == g], [r[1:] for r in exp if r[0] == g]
        n = matched(a, e, 0.1500001)
        assert got.get(g) == (None if n == len(a) == len(e) else (len(a), len(e), n)), g


def test_tolerance_windows_of_one_group_over_many_ranges(spark):
    rng = random.Random(4)
    v = sorted(rng.uniform(0, 100) for _ in range(3000))
    df = spark.createDataFrame([("g", x) for x in v], "g string, x double").repartition(7)
    got = Q.tolerance_windows(df, ["g"], "x", 0.05, 0.0, "w").orderBy("x").collect()
    want, w = [], 0
    for i, x in enumerate(v):
        w += i == 0 or x - v[i - 1] > 0.05
        want.append(w)
    assert [r.w for r in got] == want and want[-1] > 100
    repeats = spark.range(200_000).selectExpr("'a' AS c", "1.0D AS x")
    assert Q.compare_golden(repeats, repeats, ["c"], ["x"]).isEmpty()
    assert tuple(Q.compare_golden(repeats, repeats.limit(199_999), ["c"], ["x"]).first()) == ("a", 200_000, 199_999, 199_999)


def lists(spark, data):
    return {(r.list, r.position): r.member for r in G.rdf_lists(triples(spark, data).repartition(3)).collect()}


def test_lists_with_loops_shared_tails_and_gaps(spark):
    cell = lambda c, m, n: [(c, "first", m), (c, "rest", n)]
    data = [t for c in [("a", "1", "b"), ("b", "2", "c"), ("c", "3", "nil"), ("x", "9", "b"), ("one", "1", "nil"),  # two lists with one tail
                        ("q", "1", "r"), ("r", "2", "s"), ("s", "3", "r"),  # runs into a loop
                        ("k", "1", "j"), ("j", "2", "i"), ("i", "3", "k"),  # a loop alone
                        ("self", "1", "self"), ("gap", "1", "lost")] for t in cell(*c)]
    data += [("two", "first", "1"), ("two", "first", "2"), ("two", "rest", "nil"), ("half", "first", "1")]
    got = lists(spark, data)
    assert got == {("a", 1): "1", ("a", 2): "2", ("a", 3): "3", ("x", 1): "9", ("x", 2): "2", ("x", 3): "3", ("one", 1): "1",
                   ("q", -2): None, ("i", -2): None, ("self", -2): None, ("gap", -1): None, ("two", -1): None, ("half", -1): None}
    assert lists(spark, []) == {}


def test_a_list_of_fifty_thousand_cells(spark, monkeypatch):
    n, cuts = 50_000, []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df, name="cut": cuts.append(name) or cut(df, name))
    cells = spark.range(n).selectExpr("explode(array(struct(concat('c', id) AS s, 'first' AS p, concat('m', id) AS o), struct(concat('c', id) AS s, 'rest' AS p, if(id = 49999, 'nil', concat('c', id + 1)) AS o))) AS t").selectExpr("t.s", "t.p", "t.o", "'iri' AS o_kind")
    got = G.rdf_lists(cells).selectExpr("count(*) AS n", "max(position) AS m", "count_if(member = concat('m', position - 1)) AS k", "count(DISTINCT list) AS l").first()
    assert tuple(got) == (n, n, n, 1) and cuts.count("jumps") < 20


def test_closure_appends_and_counts_by_rule(spark, monkeypatch):
    import os

    from quadrat import session

    paths = []
    scratch = session.scratch
    monkeypatch.setattr(session, "scratch", lambda spark, name: paths.append(scratch(spark, name)) or paths[-1])
    data = [(f"n{i}", "next", f"n{i + 1}") for i in range(9)] + [("n0", "type", "A"), ("n3", "before", "n9")]
    schema = G.Schema(subclass=[("A", "B"), ("B", "C")], subproperty=[("next", "before")], transitive=["before"])
    inferred, counts = G.materialize(triples(spark, data), schema)
    got = {tuple(r)[:3] for r in inferred.collect()}
    want = {(f"n{i}", "before", f"n{j}") for i in range(10) for j in range(i + 1, 10)} - {("n3", "before", "n9")} | {("n0", "type", "B"), ("n0", "type", "C")}
    assert got == want and inferred.count() == len(want) == sum(n for _, _, n in counts)
    assert counts[:2] == [(1, "subclass", 2), (1, "subproperty", 9)] and all(r == "transitive" for p, r, _ in counts if p > 1)
    # every triple is written once: the table's rows are the asserted and the inferred ones, a folder for each pass
    root = next(p for p in paths if "closure" in p).removeprefix("file://")
    rows = {d: spark.read.parquet(f"{root}/{d}").count() for d in os.listdir(root) if d.startswith("pass=")}
    new = {}
    for p, _, n in counts:
        new[f"pass={p}"] = new.get(f"pass={p}", 0) + n
    assert rows == {"pass=0": len(data)} | new
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("closure_")]


def test_block_rules_name_each_problem(spark):
    data = [("v/1", "type", "V"), ("v/1", "count", "5"), ("v/1", "rank", "genus 1"), ("v/1", "run", "run/01"),
            ("v/2", "type", "V"), ("v/2", "count", "99"), ("v/2", "rank", "genus x"), ("v/2", "run", "run/03"),
            ("v/33", "type", "V"), ("v/33", "count", "many"), ("v/33", "count", "200"), ("v/33", "run", "run/33"), ("w/4", "type", "W"), ("w/4", "count", "99")]
    got = rows(G.block_rules(triples(spark, data), "V", {"count": (0, 10)}, {"rank": "^genus [0-9]$"}, {"run": ("run/", 2)}))
    assert got == [("v/2", "count out of range"), ("v/2", "rank not as patterned"), ("v/2", "run of another number"), ("v/33", "count out of range")]
    t = rows(G.class_totals(triples(spark, data), [("V", 3, "W"), ("W", 1, "V")]))
    assert t == [("V = 3 x W", 3, 1, True), ("W = 1 x V", 1, 3, False)]


def test_small_windows_are_matched_many_at_a_time(spark):
    from quadrat.operators import quality as Q

    n = 3000
    act = [(None if i % 3 else 2**60 + 1, float(i), float(k)) for i in range(n) for k in (1, 5)]
    exp = [(None if i % 3 else 2**60 + 1, i + 0.01, 1.0 if k == 1 or i % 3 == 0 else 5.0) for i in range(n) for k in (1, 5)]
    got = Q.compare_golden(spark.createDataFrame(act, "c bigint, x double, y double"), spark.createDataFrame(exp, "c bigint, x double, y double"), ["c"], ["x", "y"], 0.1, 0.0)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(2**60 + 1, 2000, 2000, 1000)]
    assert Q.compare_golden(spark.createDataFrame(act, "c bigint, x double, y double").select("c"), spark.createDataFrame(exp, "c bigint, x double, y double").select("c"), ["c"], []).isEmpty()


def test_ranges_of_tolerance_windows_stay_small(spark, monkeypatch):
    kept = {}

    def keeping(df, name, cut=Q.cut):
        kept[name] = cut(df, name)
        return kept[name]

    monkeypatch.setattr(Q, "RANGE", 50)
    monkeypatch.setattr(Q, "cut", keeping)
    df = spark.range(3000).select(F.lit("a").alias("g"), (F.col("id") + F.when(F.col("id") % 3 == 0, 0.99).otherwise(0.0)).alias("x"))
    got = Q.tolerance_windows(df, ["g"], "x", 0.05, 0.0, "w")
    assert got.agg(F.count_distinct("w")).first()[0] == 2000 and got.count() == 3000
    assert kept["ranged"].groupBy("_p").count().agg(F.max("count")).first()[0] <= 200


def test_places_of_a_list_are_written_once(spark, monkeypatch):
    from quadrat.operators import graph

    cells = [(f"c{i}", p, o) for i in range(9) for p, o in (("first", f"m{i}"), ("rest", f"c{i + 1}" if i < 8 else "nil"))]
    written, plain = [], graph.cut

    def counted(df, name="cut"):
        out = plain(df, name)
        if name == "places":
            written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = graph.rdf_lists(spark.createDataFrame(cells, "s string, p string, o string")).collect()
    assert sorted((r.position, r.member) for r in got) == [(i + 1, f"m{i}") for i in range(9)]
    assert sum(written) == 8
