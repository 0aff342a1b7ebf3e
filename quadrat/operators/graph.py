"""Triples: reification, graph patterns, hierarchy closure, rule closure, audits.

Triple tables have columns s, p, o and o_kind (iri, bnode or literal).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.session import cut

TYPE = "type"


def reify(df: DataFrame, template: list[tuple[Column, str, Column, str]]) -> DataFrame:
    """One row to its triples; ``template`` lists (subject, predicate, object, kind). NULL objects give no triple.

    Domains differ only in their templates, so every domain is data for this one operator.
    """
    each = F.explode(F.array(*(F.struct(s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_kind")) for s, p, o, k in template)))
    return df.select(each.alias("t")).select("t.*").where("s is not null and o is not null")


def measurement_template(bearer: Column, quality: Column, process: Column, value: Column, unit: Column, kind: Column) -> list:
    """Bearer, quality, process and value of a reading, with inverse edges, unit and types."""
    q, v = quality, F.concat(quality, F.lit("/value"))
    return [
        (bearer, "hasQuality", q, "iri"), (q, "qualityOf", bearer, "iri"), (q, TYPE, kind, "iri"), (process, "measures", q, "iri"), (q, "measuredBy", process, "iri"),
        (process, "hasOutput", v, "iri"), (v, "outputOf", process, "iri"), (v, "hasValue", value, "literal"), (v, "hasUnit", unit, "iri"), (v, TYPE, F.lit("Measurement"), "iri"), (process, TYPE, F.lit("Assay"), "iri"),
    ]


@dataclass
class Pattern:
    """A triple pattern; names starting with ``?`` are variables."""

    s: str
    p: str
    o: str


def _match(triples: DataFrame, pattern: Pattern) -> DataFrame:
    rows, names = triples, {}
    for col, term in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o)):
        if term.startswith("?"):
            if term in names:
                rows = rows.where(F.col(col) == F.col(names[term]))
            else:
                names[term] = col
        else:
            rows = rows.where(F.col(col) == term)
    return rows.select(*(F.col(c).alias(v[1:]) for v, c in names.items()))


def bgp(triples: DataFrame, patterns: list[Pattern], optional: list[list[Pattern]] = (), filters: list[Column] = (), select: list[str] = (), distinct: bool = False) -> DataFrame:
    """Solutions of a basic graph pattern: joins on shared variables, left joins for optional groups, then filters.

    Constant predicates are filtered before any join, so each side is a scan of one predicate.
    """
    def joined(ps: list[Pattern]) -> DataFrame:
        left, rest = _match(triples, ps[0]), list(ps[1:])
        while rest:
            at = next((i for i, p in enumerate(rest) if {v[1:] for v in (p.s, p.p, p.o) if v.startswith("?")} & set(left.columns)), None)
            if at is None:
                raise ValueError("the pattern falls apart: a triple shares no variable with the others")
            right = _match(triples, rest.pop(at))
            left = left.join(right, [c for c in right.columns if c in left.columns])
        return left

    out = joined(patterns)
    for group in optional:
        right = joined(group)
        out = out.join(right, [c for c in right.columns if c in out.columns], "left")
    for f in filters:
        out = out.where(f)
    out = out.select(*select) if select else out
    return out.distinct() if distinct else out


def walk(triples: DataFrame, start: str, path: list[str], keep_paths: bool = True) -> DataFrame:
    """Follow predicates from subjects of class ``start``; every path is a row. ``^p`` goes backwards."""
    out = triples.where((F.col("p") == TYPE) & (F.col("o") == start)).select(F.col("s").alias("n0"))
    for i, p in enumerate(path):
        back = p.startswith("^")
        step = triples.where(F.col("p") == p.lstrip("^")).select(F.col("o" if back else "s").alias(f"n{i}"), F.col("s" if back else "o").alias(f"n{i + 1}"))
        out = out.join(step, f"n{i}")
    out = out.select(*(f"n{i}" for i in range(len(path) + 1)))
    return out if keep_paths else out.select("n0", f"n{len(path)}").distinct()


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", max_rounds: int = 64) -> DataFrame:
    """``(node, ancestor, depth)`` with the least depth of every proper ancestor; a node on a cycle is its own ancestor.

    Path lengths double each round, so a hierarchy of depth d takes log2(d) rounds.
    """
    known = cut(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct(), "closure")
    size = known.count()
    for _ in range(max_rounds):
        mid = known.select(F.col("node").alias("m"), F.col("ancestor").alias("ancestor"), F.col("depth").alias("d2"))
        longer = known.withColumnsRenamed({"ancestor": "m", "depth": "d1"}).join(mid, "m").select("node", "ancestor", (F.col("d1") + F.col("d2")).alias("depth"))
        known = cut(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        now = known.agg(F.count(F.lit(1)), F.sum("depth")).first()
        if now == size:
            return known
        size = now
    raise RuntimeError("closure did not settle")


def cycles(closed: DataFrame) -> DataFrame:
    return closed.where("node = ancestor").select("node").distinct()


def rdf_lists(triples: DataFrame, first: str = "first", rest: str = "rest", nil: str = "nil") -> DataFrame:
    """``(list, position, member)`` of every list, named by its head.

    A list with a branching, incomplete or missing cell has one row of position
    -1, one that runs into a loop one of position -2; a loop without a head is
    named by its smallest cell. Lists may share a tail.

    Pointers double: after round k a cell knows the cell 2^k on, whether the
    list has ended on the way, and the smallest cell passed, so a list of n
    cells takes log2(n) rounds, and what still moves after as many rounds as
    all cells could need is in a loop. Places are dealt by the same pointers.
    """
    cell = triples.where(F.col("p") == first).groupBy(F.col("s").alias("cell")).agg(F.count(F.lit(1)).alias("nf"), F.min("o").alias("member"))
    link = triples.where(F.col("p") == rest).groupBy(F.col("s").alias("cell")).agg(F.count(F.lit(1)).alias("nr"), F.min("o").alias("next"))
    cells = cell.join(link, "cell", "full_outer")
    known = cells.select(F.col("cell").alias("next"), F.lit(True).alias("there"))
    bad = (F.coalesce("nf", F.lit(0)) != 1) | (F.coalesce("nr", F.lit(0)) != 1) | ((F.col("next") != nil) & F.col("there").isNull())
    state = F.when(bad, "bad").when(F.col("next") == nil, "end").otherwise("on")
    cells = cut(cells.join(known, "next", "left").select("cell", "member", "next", state.alias("state")), "cells")
    jump = cells.select("cell", F.col("next").alias("to"), "state", F.col("cell").alias("least"))
    n, jumps, ended = cells.count(), [], None
    while True:
        jumps.append(cut(jump, "jumps"))
        moving = jumps[-1].where("state = 'on'")
        # 2 ** (rounds - 1) steps are made; a path without a loop has at most n - 1
        if 2 ** (len(jumps) - 1) >= n or moving.isEmpty():
            break
        on = jumps[-1].select(F.col("cell").alias("to"), F.col("to").alias("to2"), F.col("state").alias("state2"), F.col("least").alias("least2"))
        further = moving.join(on, "to").select("cell", F.col("to2").alias("to"), F.col("state2").alias("state"), F.least("least", "least2").alias("least"))
        jump = jumps[-1].where("state <> 'on'").unionByName(further)
    ended = jumps[-1]
    heads = cells.join(cells.select(F.col("next").alias("cell")), "cell", "left_anti").select(F.col("cell").alias("list"))
    judged = cut(heads.join(ended.withColumnRenamed("cell", "list"), "list").select("list", "state", "to"), "heads")
    # where a moving cell has got to lies on its loop, and the smallest cell seen from there names the loop
    loop_of = ended.select(F.col("cell").alias("to"), F.col("least").alias("loop"))
    loops = ended.where("state = 'on'").select("to").distinct().join(loop_of, "to").select("loop").distinct()
    entered = judged.where("state = 'on'").join(loop_of, "to").select("loop").distinct()
    headless = loops.join(entered, "loop", "left_anti").select(F.col("loop").alias("list"), F.lit(-2).alias("position"))
    wrong = judged.where("state <> 'end'").select("list", F.when(F.col("state") == "bad", -1).otherwise(-2).alias("position"))
    placed = judged.where("state = 'end'").select("list", F.col("list").alias("cell"), F.lit(1).alias("position"))
    for k, j in enumerate(jumps):
        on = j.where("state = 'on'").select("cell", "to")
        further = placed.join(on, "cell").select("list", F.col("to").alias("cell"), (F.col("position") + (1 << k)).alias("position"))
        placed = placed.unionByName(cut(further, "places"))  # each place is written once
    fine = placed.join(cells, "cell").select("list", "position", "member")
    return fine.unionByName(wrong.unionByName(headless).select("list", "position", F.lit(None).cast("string").alias("member")))


@dataclass
class Schema:
    """Axioms of a rule closure as lists of names (a schema is small; data triples are not)."""

    subclass: list[tuple[str, str]] = field(default_factory=list)
    equivalent_class: list[tuple[str, str]] = field(default_factory=list)
    subproperty: list[tuple[str, str]] = field(default_factory=list)
    equivalent_property: list[tuple[str, str]] = field(default_factory=list)
    domain: list[tuple[str, str]] = field(default_factory=list)
    range: list[tuple[str, str]] = field(default_factory=list)
    inverse: list[tuple[str, str]] = field(default_factory=list)
    symmetric: list[str] = field(default_factory=list)
    transitive: list[str] = field(default_factory=list)
    has_value: list[tuple[str, str, str]] = field(default_factory=list)  # class, property, value
    some_values: list[tuple[str, str, str]] = field(default_factory=list)  # class, property, filler ("Thing": any)
    all_values: list[tuple[str, str, str]] = field(default_factory=list)
    intersection: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    union: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    one_of: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    chains: list[tuple[tuple[str, ...], str]] = field(default_factory=list)  # ("p", "^q", ...) -> r


def _closed(pairs: list[tuple[str, str]], equal: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Transitive closure of schema pairs (a few hundred at most), equivalents as pairs both ways."""
    known = {*pairs, *equal, *((b, a) for a, b in equal)}
    while True:
        new = {(a, d) for a, b in known for c, d in known if b == c and a != d} - known
        if not new:
            return sorted(x for x in known if x[0] != x[1])
        known |= new


def _map(pairs: list[tuple], key: Column) -> Column:
    """Array of the second members whose first is ``key`` (a literal lookup: schemas are small)."""
    table: dict = {}
    for a, *b in pairs:
        table.setdefault(a, []).append(b[0])
    if not table:
        return F.array().cast("array<string>")
    lit = F.create_map(*(x for a, bs in table.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    return F.coalesce(lit[key], F.array().cast("array<string>"))


def _rules(schema: Schema, everything: DataFrame, delta: DataFrame) -> dict[str, DataFrame]:
    """New candidate triples of each rule; at least one premise comes from ``delta``."""
    sub_c, sub_p = _closed(schema.subclass, schema.equivalent_class), _closed(schema.subproperty, schema.equivalent_property)
    t = lambda df: df.where(F.col("p") == TYPE)
    iri = lambda df: df.where("o_kind <> 'literal'")
    make = lambda df, s, p, o, k=None: df.select(s.alias("s"), p.alias("p"), o.alias("o"), (k if k is not None else F.lit("iri")).alias("o_kind"))
    S, P, O, KIND, TY = F.col("s"), F.col("p"), F.col("o"), F.col("o_kind"), F.lit(TYPE)  # noqa: E741
    out: dict[str, DataFrame] = {}
    if sub_c:
        out["subclass"] = make(t(delta).withColumn("x", F.explode(_map(sub_c, O))), S, TY, F.col("x"))
    if sub_p:
        out["subproperty"] = make(delta.withColumn("x", F.explode(_map(sub_p, P))), S, F.col("x"), O, KIND)
    if schema.domain:
        out["domain"] = make(delta.withColumn("x", F.explode(_map(schema.domain, P))), S, TY, F.col("x"))
    if schema.range:
        out["range"] = make(iri(delta).withColumn("x", F.explode(_map(schema.range, P))), O, TY, F.col("x"))
    if schema.inverse or schema.symmetric:
        swap = [*schema.inverse, *((b, a) for a, b in schema.inverse), *((p, p) for p in schema.symmetric)]
        out["inverse"] = make(iri(delta).withColumn("x", F.explode(_map(swap, P))), O, F.col("x"), S)
    if schema.transitive:
        is_t = lambda df: df.where(F.col("p").isin(*schema.transitive))
        a = lambda df: is_t(df).select("s", "p", F.col("o").alias("m"))
        b = lambda df: is_t(df).select(F.col("s").alias("m"), "p", "o", "o_kind")
        out["transitive"] = a(delta).join(b(everything), ["m", "p"]).unionByName(a(everything).join(b(delta), ["m", "p"])).select("s", "p", "o", "o_kind")
    for i, (c, p, v) in enumerate(schema.has_value):
        out[f"has_value_{i}"] = make(t(delta).where(O == c), S, F.lit(p), F.lit(v)).unionByName(make(delta.where((P == p) & (O == v)), S, TY, F.lit(c)))
    for i, (c, p, f) in enumerate(schema.some_values):
        if f == "Thing":
            out[f"some_values_{i}"] = make(delta.where(P == p), S, TY, F.lit(c))
            continue
        links = lambda df: df.where(F.col("p") == p).select("s", F.col("o").alias("m"))  # noqa: E731, B023
        typed = lambda df: t(df).where(F.col("o") == f).select(F.col("s").alias("m"))  # noqa: E731, B023
        both = links(delta).join(typed(everything), "m").unionByName(links(everything).join(typed(delta), "m"))
        out[f"some_values_{i}"] = make(both, S, TY, F.lit(c))
    for i, (c, p, f) in enumerate(schema.all_values):
        member = lambda df: t(df).where(F.col("o") == c).select("s")  # noqa: E731, B023
        links = lambda df: iri(df).where(F.col("p") == p).select("s", F.col("o").alias("m"))  # noqa: E731, B023
        both = member(delta).join(links(everything), "s").unionByName(member(everything).join(links(delta), "s"))
        out[f"all_values_{i}"] = make(both, F.col("m"), TY, F.lit(f))
    for i, (c, parts) in enumerate(schema.intersection):
        whole = t(everything).where(O.isin(*parts)).groupBy("s").agg(F.count_distinct("o").alias("k")).where(F.col("k") == len(set(parts)))
        touched = whole.join(t(delta).where(O.isin(*parts)).select("s").distinct(), "s", "left_semi")
        out[f"intersection_{i}"] = make(touched, S, TY, F.lit(c)).unionByName(make(t(delta).where(O == c).withColumn("x", F.explode(F.array(*map(F.lit, parts)))), S, TY, F.col("x")))
    for i, (c, parts) in enumerate(schema.union):
        out[f"union_{i}"] = make(t(delta).where(O.isin(*parts)), S, TY, F.lit(c))
    for i, (path, r) in enumerate(schema.chains):
        def step(df, j):
            p = path[j]  # noqa: B023
            rows = df.where(F.col("p") == p.lstrip("^"))
            rows = iri(rows) if p.startswith("^") or j < len(path) - 1 else rows  # noqa: B023
            a, b = ("o", "s") if p.startswith("^") else ("s", "o")
            return rows.select(F.col(a).alias(f"n{j}"), F.col(b).alias(f"n{j + 1}"), (F.lit("iri") if p.startswith("^") else F.col("o_kind")).alias(f"k{j + 1}"))

        runs = []
        for new in range(len(path)):
            run = step(delta if new == 0 else everything, 0)
            for j in range(1, len(path)):
                run = run.join(step(delta if j == new else everything, j), f"n{j}")
            runs.append(make(run, F.col("n0"), F.lit(r), F.col(f"n{len(path)}"), F.col(f"k{len(path)}")))
        out[f"chain_{i}"] = reduce(lambda a, b: a.unionByName(b), runs)
    return out


def materialize(asserted: DataFrame, schema: Schema, max_passes: int = 50) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """Inferred triples (none of them asserted) at the fixed point, and how many (pass, rule, new) each rule gave in each pass.

    Semi-naive: a rule fires on the last pass's new triples joined with all.
    What is known is one table in buckets of (s, p, o, o_kind) that every pass appends
    its new triples to: nothing is written twice, and the known triples stay in
    their buckets where new ones are held against them. A triple that several
    rules find in one pass counts for the first of them in rule order. Literal
    subjects never arise, since rules that swap ends drop literals.
    """
    from quadrat.session import scratch

    spark, cols = asserted.sparkSession, ["s", "p", "o", "o_kind"]
    path = scratch(spark, "closure")
    name = "closure_" + path.rsplit("-", 1)[-1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(df: DataFrame, number: int) -> None:
        rows = df.withColumn("pass", F.lit(number))  # dealt by these columns already, by the distinct or the anti join
        rows.write.format("parquet").mode("append").partitionBy("pass").bucketBy(buckets, *cols).option("path", path).saveAsTable(name)

    append(asserted.select(*cols).distinct().withColumn("rule", F.lit(None).cast("string")), 0)
    start = [(x, TYPE, c, "iri", "one_of") for c, members in schema.one_of for x in members]
    if start:
        seed = spark.createDataFrame(start, "s string, p string, o string, o_kind string, rule string")
        append(seed.join(spark.table(name).select(*cols), cols, "left_anti"), 1)
    counts = []
    for number in range(1, max_passes + 1):
        known = spark.table(name)
        delta = known.select(*cols) if number == 1 else known.where(F.col("pass") == number - 1).select(*cols)
        rules = _rules(schema, known.select(*cols), delta)
        if not rules:
            break
        found = reduce(lambda a, b: a.unionByName(b), (df.withColumn("_r", F.lit(i)) for i, df in enumerate(rules.values())))
        names = F.array(*map(F.lit, rules))
        first = found.groupBy(*cols).agg(F.min("_r").alias("_r"))
        append(first.join(known.select(*cols), cols, "left_anti").select(*cols, F.get(names, F.col("_r")).alias("rule")), number)
        new = spark.table(name).where(F.col("pass") == number).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy("rule").collect()
        counts += [(number, r.rule, r.n) for r in new]
        if not any(r.rule != "one_of" for r in new):
            break
    else:
        raise RuntimeError(f"no fixed point after {max_passes} passes")
    schema_of = spark.table(name).schema
    spark.sql(f"DROP TABLE {name}")  # its name only: the files stay in the shared folder
    return spark.read.schema(schema_of).parquet(path).where(F.col("pass") > 0).select(*cols), counts


def schema_audit(triples: DataFrame, supported: list[str]) -> DataFrame:
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects")).withColumn("supported", F.col("p").isin(*supported))


def diagnostics(triples: DataFrame, disjoint: list[tuple[str, str]], nothing: str = "Nothing") -> DataFrame:
    """Members of two disjoint classes, and members of the empty class."""
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("c")).distinct()
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disjoint))).alias("d")
    sets = types.groupBy("s").agg(F.collect_set(F.when(F.col("c").isin(*{x for d in disjoint for x in d}), F.col("c"))).alias("cs"))
    clash = sets.where(F.size("cs") > 1).select("s", "cs", pairs).where(F.array_contains("cs", F.col("d.a")) & F.array_contains("cs", F.col("d.b")))
    out = clash.select("s", F.concat(F.lit("disjoint "), F.col("d.a"), F.lit(" "), F.col("d.b")).alias("problem"))
    return out.unionByName(types.where(F.col("c") == nothing).select("s", F.lit("member of Nothing").alias("problem")))


def witness(asserted: DataFrame, inferred: DataFrame, query) -> DataFrame:
    """Solutions of ``query`` (a function of a triple table) that only the materialized graph has."""
    return query(asserted.unionByName(inferred)).exceptAll(query(asserted))


def union_modules(modules: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn("g", F.lit(g)) for g, df in modules.items()))


def unique_labels(triples: DataFrame, label: str = "label") -> DataFrame:
    """Entities without exactly one label, with what they have."""
    subjects = triples.select("s").distinct()
    labels = triples.where(F.col("p") == label).groupBy("s").agg(F.count_distinct("o").alias("n_labels"), F.concat_ws("|", F.array_sort(F.collect_set("o"))).alias("labels"))
    return subjects.join(labels, "s", "left").na.fill(0, ["n_labels"]).where("n_labels <> 1")


def validate_shapes(triples: DataFrame, shapes: list[tuple[str, str, int, int | None, str | None]]) -> DataFrame:
    """Violations of (class, predicate, least, most, object class) rules: (s, shape, predicate, found, expected).

    Counts per subject and predicate come from one aggregation; the shape table is short and broadcast.
    """
    spark = triples.sparkSession
    schema = "shape string, predicate string, least int, most int, target string"
    rules = F.broadcast(spark.createDataFrame([(c, p, lo, hi, tgt) for c, p, lo, hi, tgt in shapes], schema))
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("shape")).distinct()
    need = types.join(rules, "shape")
    got = triples.join(F.broadcast(rules.select(F.col("predicate").alias("p")).distinct()), "p", "left_semi").groupBy("s", F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("found"))
    counted = need.join(got, ["s", "predicate"], "left").na.fill(0, ["found"])
    wrong = counted.where((F.col("found") < F.col("least")) | (F.col("found") > F.coalesce("most", F.lit(1 << 30))))
    out = wrong.select("s", "shape", "predicate", "found", F.concat(F.col("least").cast("string"), F.lit(".."), F.coalesce(F.col("most").cast("string"), F.lit("*"))).alias("expected"))
    refs = need.where("target is not null").join(triples.select("s", F.col("p").alias("predicate"), "o"), ["s", "predicate"])
    typed = types.withColumnsRenamed({"s": "o", "shape": "target"})
    ill = refs.join(typed, ["o", "target"], "left_anti").groupBy("s", "shape", "predicate", "target").agg(F.count(F.lit(1)).alias("found"))
    return out.unionByName(ill.select("s", "shape", "predicate", "found", F.concat(F.lit("object is a "), "target").alias("expected")))


def block_checks(triples: DataFrame, kind: str, exact: dict[str, int]) -> DataFrame:
    """Subjects of a class whose predicate counts differ from the exact ones, and gaps in their numbered ids."""
    members = triples.where((F.col("p") == TYPE) & (F.col("o") == kind)).select("s").distinct()
    rows = triples.join(members, "s", "left_semi")
    g = rows.groupBy("s").agg(*(F.count_if(F.col("p") == p).alias(f"c_{i}") for i, p in enumerate(exact)))
    bad = F.array_compact(F.array(*(F.when(F.col(f"c_{i}") != n, F.lit(p)) for i, (p, n) in enumerate(exact.items()))))
    counts = g.select("s", F.concat_ws(",", bad).alias("problem")).where("problem <> ''")
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("bigint")
    ids = members.select("s", number.alias("k"))
    gap = ids.join(ids.select((F.col("k") + 1).alias("k")), "k", "left_anti").join(F.broadcast(ids.agg(F.min("k").alias("lo")))).where("k > lo")
    return counts.unionByName(gap.select("s", F.lit("gap before").alias("problem")))


def block_rules(
    triples: DataFrame, kind: str, ranges: dict[str, tuple[float, float]] = {}, labels: dict[str, str] = {}, links: dict[str, tuple[str, int]] = {},  # noqa: B006
) -> DataFrame:
    """``(s, problem)`` of subjects of a class whose objects break a rule on a predicate.

    ``ranges``: a number from low to high. ``labels``: a pattern. ``links``:
    what the subject's own number says, as (prefix, digits): the number at the
    end of ``s`` after the prefix, filled up with zeros to so many digits. All
    rules read the subjects' triples once; a problem is given once a subject.
    """
    members = triples.where((F.col("p") == TYPE) & (F.col("o") == kind)).select("s").distinct()
    rows = triples.where(F.col("p").isin(*{*ranges, *labels, *links})).select("s", "p", "o").join(members, "s", "left_semi")
    number, value = F.regexp_extract("s", r"(\d+)$", 1), F.col("o").try_cast("double")
    flags = [F.when((F.col("p") == p) & ~F.coalesce(value.between(lo, hi), F.lit(False)), F.lit(f"{p} out of range")) for p, (lo, hi) in ranges.items()]
    flags += [F.when((F.col("p") == p) & ~F.col("o").rlike(pattern), F.lit(f"{p} not as patterned")) for p, pattern in labels.items()]
    flags += [F.when((F.col("p") == p) & (F.col("o") != F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(digits)), F.lit("0")))), F.lit(f"{p} of another number")) for p, (prefix, digits) in links.items()]
    return rows.select("s", F.explode(F.array_compact(F.array(*flags))).alias("problem")).distinct()


def class_totals(triples: DataFrame, relations: list[tuple[str, int, str]]) -> DataFrame:
    """``(relation, n_first, n_second, ok)``: there are so many times as many members of the first class as of the second."""
    names = sorted({c for a, _, b in relations for c in (a, b)})
    n = triples.where((F.col("p") == TYPE) & F.col("o").isin(*names)).agg(*(F.count_distinct(F.when(F.col("o") == c, F.col("s"))).alias(f"n{i}") for i, c in enumerate(names)))
    of = {c: F.col(f"n{i}") for i, c in enumerate(names)}
    cells = F.array(*(F.struct(F.lit(f"{a} = {k} x {b}").alias("relation"), of[a].alias("n_first"), of[b].alias("n_second"), (of[a] == of[b] * k).alias("ok")) for a, k, b in relations))
    return n.select(F.explode(cells).alias("c")).select("c.*")


def fingerprint(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Order-independent multiset fingerprint: rows, sum of 32-bit hash halves, and xor of them (md5-based)."""
    key = F.md5(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols)))
    part = lambda a: F.conv(F.substring(key, a, 8), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("sum_hi"), F.sum(part(9)).alias("sum_lo"), F.bit_xor(part(17)).alias("xor"))

