"""Identifiers, lineages, dates, coordinates, formulas, flags and row filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sample-identifier grammar, its campaign prefixes, and rank names.
SAMPLE_ID = r"^(?:e\d+_)?([TFSV])?(\d+)(PR|[PDS])r(\d+)(O|T|RE|R)?$"
CAMPAIGN_OF_PREFIX = {"": 1, "T": 2, "F": 3, "S": 4, "V": 5}
RANKS = ("Domain", "Phylum", "Class", "Order", "Family", "Genus", "Species")
MISSING_NAMES = ("", "NA", "N/A", "nan", "None", "unassigned", "Unassigned", "unidentified")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_sample_id(col: Column | str, grammar: str = SAMPLE_ID) -> Column:
    """Struct (campaign, site, type, rep, suffix); an identifier outside the grammar has type ``Unknown``."""
    c = _col(col)
    part = lambda i: F.regexp_extract(c, grammar, i)
    prefix = reduce(lambda acc, kv: acc.when(part(1) == kv[0], kv[1]), CAMPAIGN_OF_PREFIX.items(), F.when(F.lit(False), 0))
    known = c.rlike(grammar)
    return F.struct(
        F.when(known, prefix).alias("campaign"),
        F.when(known, part(2).cast("int")).alias("site"),
        F.when(known, part(3)).otherwise("Unknown").alias("type"),
        F.when(known, part(4).cast("int")).alias("rep"),
        F.when(known, part(5)).alias("suffix"),
    )


def normalize_id(col: Column | str) -> Column:
    """Export prefix and variant suffix removed."""
    return F.regexp_replace(F.regexp_replace(_col(col), r"^e\d+_", ""), r"_(v|lib)\d+$", "")


def classify_role(col: Column | str, patterns: dict[str, str], default: str = "biological") -> Column:
    """First role whose pattern the label matches."""
    c = _col(col)
    return reduce(lambda acc, kv: acc.when(c.rlike(kv[1]), kv[0]), patterns.items(), F.when(F.lit(False), "")).otherwise(default)


def record_role(site: Column, day: Column, last_core_site: int, first_year: int) -> Column:
    """Role of a field record by site number and year of its date."""
    return (
        F.when(day.isNull(), "undated")
        .when(F.year(day) < first_year, "archive")
        .when(site.between(1, last_core_site), "core")
        .otherwise("auxiliary")
    )


def parse_lineage(col: Column | str, sep: str = ";", ranks: int = 7) -> Column:
    """Struct (lineage, supplementary, confidence): rank prefixes removed, missing names as NULL.

    ``ranks`` fields are the lineage; with two more, they are a supplementary
    name and a numeric confidence; any other number of fields gives NULL.
    """
    fields = F.split(_col(col), sep)
    clean = F.transform(
        F.slice(fields, 1, ranks), lambda x: F.nullif(F.regexp_replace(F.trim(x), r"^[a-z]__", ""), F.lit(""))
    )
    named = F.transform(clean, lambda x: F.when(~x.isin(*MISSING_NAMES), x))
    long = F.size(fields) == ranks + 2
    return F.when(
        F.size(fields).isin(ranks, ranks + 2),
        F.struct(
            named.alias("lineage"),
            F.when(long, F.try_element_at(fields, F.lit(ranks + 1))).alias("supplementary"),
            F.when(long, F.try_element_at(fields, F.lit(ranks + 2)).try_cast("double")).alias("confidence"),
        ),
    )


def lineage_at(lineage: Column | str, rank: int, sep: str = ";") -> Column:
    """The lineage truncated after ``rank`` names."""
    return F.concat_ws(sep, F.slice(_col(lineage), 1, rank))


def emitted_lineage(lineage: Column | str, names: tuple[str, ...] = RANKS) -> Column:
    """``Rank: name`` pairs."""
    c = _col(lineage)
    return F.concat_ws("; ", F.zip_with(F.slice(F.array(*map(F.lit, names)), 1, F.size(c)), c, lambda r, n: F.concat(r, F.lit(": "), n)))


def contextual_label(lineage: Column | str, rank: int) -> Column:
    """Name at ``rank``, or ``unresolved <nearest named ancestor>``."""
    c = _col(lineage)
    own = F.element_at(c, rank)
    above = F.filter(F.slice(c, 1, rank - 1), lambda x: x.isNotNull() & (x != "NA")) if rank > 1 else F.array().cast("array<string>")
    nearest = F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit("root"))
    return F.when(own.isNotNull() & (own != "NA"), own).otherwise(F.concat(F.lit("unresolved "), nearest))


def parse_point(col: Column | str) -> Column:
    """Struct (lon, lat) of ``POINT(lon lat)``, or of ``lat, lon`` text."""
    c = _col(col)
    wkt = r"^POINT\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)$"
    pair = r"^\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*$"
    get = lambda p, i: F.regexp_extract(c, p, i).try_cast("double")
    return F.when(c.rlike(wkt), F.struct(get(wkt, 1).alias("lon"), get(wkt, 2).alias("lat"))).when(
        c.rlike(pair), F.struct(get(pair, 2).alias("lon"), get(pair, 1).alias("lat"))
    )


def parse_date(col: Column | str, formats: tuple[str, ...], as_of: str) -> Column:
    """Struct (day, status): the first format that fits; dates after ``as_of`` are rejected."""
    c = _col(col)
    day = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats))
    late = day > F.lit(as_of).cast("date")
    status = F.when(c.isNull() | (F.trim(c) == ""), "missing").when(day.isNull(), "unparsed").when(late, "future").otherwise("ok")
    return F.struct(F.when(~late, day).alias("day"), status.alias("status"))


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, however often ``then`` names it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def parse_formula(col: Column | str) -> Column:
    """Array of (element, count) of a chemical formula, in element order, divided by the common divisor.

    Components may be joined by dots and carry a leading coefficient, as in ``CaSO4.2H2O``.
    """
    parts = F.split(_col(col), r"[.·]")

    def atoms(part: Column) -> Column:
        lead = F.coalesce(F.nullif(F.regexp_extract(part, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
        return F.transform(
            F.regexp_extract_all(part, F.lit(r"([A-Z][a-z]?\d*)"), 1),
            lambda t: F.struct(
                F.regexp_extract(t, r"^([A-Z][a-z]?)", 1).alias("element"),
                (lead * F.coalesce(F.nullif(F.regexp_extract(t, r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))).alias("n"),
            ),
        )

    def summed(every: Column) -> Column:
        elements = F.array_sort(F.array_distinct(F.transform(every, lambda a: a["element"])))
        count = lambda e: F.aggregate(F.filter(every, lambda a: a["element"] == e), F.lit(0), lambda acc, a: acc + a["n"])
        return F.transform(elements, lambda e: F.struct(e.alias("element"), count(e).alias("n")))

    def reduced(every: Column) -> Column:
        low = F.array_min(F.transform(every, lambda a: a["n"]))
        divisor = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(low, F.lit(1))), lambda d: F.forall(every, lambda a: a["n"] % d == 0)))
        return F.when(F.size(every) > 0, _once(divisor, lambda d: F.transform(every, lambda a: F.struct(a["element"].alias("element"), (a["n"] / d).cast("int").alias("n")))))

    return _once(_once(F.flatten(F.transform(parts, atoms)), summed), reduced)


def analyte_kind(col: Column | str) -> Column:
    c = _col(col)
    return F.when(c == "LE", "light elements").when(c.rlike(r"^[A-Z][a-z]?$"), "element").when(c.rlike(r"^([A-Z][a-z]?\d*){2,}$"), "compound").otherwise("other")


def to_oxide(df: DataFrame, factors: DataFrame, element: str = "element", value: str = "value") -> DataFrame:
    """Element weight to oxide weight by its factor (a short table); elements without one are left out."""
    return df.join(factors, element).withColumn("oxide_value", F.col(value) * F.col("factor"))


def stable_id(kind: str, *cols: Column | str) -> Column:
    """Identifier from key parts: kind and the first 24 hex digits of their SHA-256."""
    return F.concat(F.lit(kind + "_"), F.substring(F.sha2(F.concat_ws("\u001f", F.lit(kind), *map(_col, cols)), 256), 1, 24))


def match_genome(df: DataFrame, known: DataFrame, name: str = "name", key: str = "genome") -> DataFrame:
    """Resolve file-like names to known genomes: as is, then without folders and FASTA suffix, then with the ``sta`` tail restored."""
    base = F.regexp_replace(F.regexp_replace(F.col(name), r"^.*/", ""), r"\.(fasta|fna|fa)$", "")
    k = known.select(F.col(key).alias("_k")).distinct()
    out = df.withColumn("_b", base)
    for i, form in enumerate((F.col(name), F.col("_b"), F.concat(F.col("_b"), F.lit("sta")))):
        out = out.withColumn("_f", form).join(k.withColumnRenamed("_k", f"_m{i}"), F.col("_f") == F.col(f"_m{i}"), "left").drop("_f")
    return out.withColumn(key, F.coalesce("_m0", "_m1", "_m2")).drop("_b", "_m0", "_m1", "_m2")


def explode_terms(df: DataFrame, col: str, sep: str = ",", prefix: str = "ko:", out: str = "term") -> DataFrame:
    """One row for each distinct term of a multi-valued cell, prefix removed; ``-`` and empty cells give none."""
    terms = F.array_distinct(F.transform(F.split(F.col(col), sep), lambda t: F.regexp_replace(F.trim(t), f"^{prefix}", "")))
    return df.withColumn(out, F.explode(F.filter(terms, lambda t: ~t.isin("", "-"))))


def match_primers(reads: DataFrame, patterns: dict[str, str], by: str, seq: str = "seq") -> DataFrame:
    """Per file: reads, and reads that start with each primer (IUPAC ambiguity codes)."""
    codes = {"R": "[AG]", "Y": "[CT]", "S": "[GC]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "N": "[ACGT]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]"}
    hit = lambda p: F.col(seq).rlike("^" + "".join(codes.get(ch, ch) for ch in p))
    return reads.groupBy(by).agg(F.count(F.lit(1)).alias("n_reads"), *(F.count_if(hit(p)).alias(f"n_{name}") for name, p in patterns.items()))


def core_cohort(df: DataFrame, site: str, campaign: str, compartment: str, sites=(1, 60), campaigns=(1, 5), kinds=("P", "D", "S")) -> DataFrame:
    """Rows of the core design. Site labels must be whole numbers as text, so "19.5" is not cut to 19."""
    return df.where(F.col(site).rlike(r"^\d+$") & F.col(campaign).between(*campaigns) & F.col(compartment).isin(*kinds)).where(
        F.try_to_number(F.col(site), F.lit("999999")).between(*sites)
    )


def min_depth(counts: DataFrame, depth: int, profile: str = "profile", n: str = "n") -> DataFrame:
    """Rows of profiles with at least ``depth`` counts; zero cells go."""
    keep = counts.groupBy(profile).agg(F.sum(n).alias("_d")).where(F.col("_d") >= depth).select(profile)
    return counts.where(F.col(n) > 0).join(keep, profile, "left_semi")


def prevalence_filter(counts: DataFrame, share: float, profile: str = "profile", feature: str = "feature") -> DataFrame:
    """Rows of features seen in at least ``share`` of the profiles."""
    total = counts.agg(F.count_distinct(profile).alias("_t"))
    seen = counts.groupBy(feature).agg(F.count_distinct(profile).alias("_s"))
    keep = seen.join(F.broadcast(total)).where(F.col("_s") >= share * F.col("_t")).select(feature)
    return counts.join(keep, feature, "left_semi")


def qc_flags(df: DataFrame, rules: dict[str, Column], out: str = "reasons") -> DataFrame:
    """All reason codes whose rule holds, and the first of them as ``disposition`` (``admitted`` if none)."""
    flags = F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())))
    return df.withColumn(out, flags).withColumn("disposition", F.coalesce(F.try_element_at(F.col(out), F.lit(1)), F.lit("admitted")))


def row_numbers(df: DataFrame, order: list[Column], start: int = 1, out: str = "number") -> DataFrame:
    """Consecutive numbers over a total order, without gathering the rows in one task.

    Rows are range-partitioned by the order, counted per partition, and
    numbered inside each partition from that partition's offset.
    """
    from quadrat.session import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(before), "_p").withColumn(out, F.col("_o") + inside + (start - 1)).drop("_p", "_o")
