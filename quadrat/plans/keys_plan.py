"""Queries over identifiers, lineages, dates, coordinates, formulas, and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions.compositional import applicability, mimag_tier
from quadrat.operators import keys as K
from quadrat.plans.roles import registry, sql

QUERIES, query = registry()

_IDS = "SELECT *, CASE l_linenumber % 6 WHEN 0 THEN 'e0001_' ELSE '' END || CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN 'T' WHEN 2 THEN 'F' WHEN 3 THEN 'S' ELSE 'V' END || (l_suppkey % 60) || CASE l_returnflag WHEN 'A' THEN 'PR' WHEN 'N' THEN 'D' ELSE 'X' END || 'r' || (l_partkey % 3) || CASE WHEN l_partkey % 7 = 0 THEN 'RE' ELSE '' END AS id FROM lineitem"


def _ids(t):
    li = t.table("lineitem")
    case = lambda c, m, d: F.coalesce(*(F.when(c == k, v) for k, v in m.items()), F.lit(d))
    ident = F.concat(
        F.when(F.col("l_linenumber") % 6 == 0, "e0001_").otherwise(""),
        case(F.col("l_linenumber") % 5, {0: "", 1: "T", 2: "F", 3: "S"}, "V"),
        (F.col("l_suppkey") % 60).cast("string"),
        case(F.col("l_returnflag"), {"A": "PR", "N": "D"}, "X"),
        F.lit("r"),
        (F.col("l_partkey") % 3).cast("string"),
        F.when(F.col("l_partkey") % 7 == 0, "RE").otherwise(""),
    )
    return li.withColumn("id", ident)


_G = "'^(?:e[0-9]+_)?([TFSV])?([0-9]+)(PR|[PDS])r([0-9]+)(O|T|RE|R)?$'"


@query("prj1_parse_sample_id", f"""
    WITH ids AS ({_IDS}), p AS (
      SELECT regexp_matches(id, {_G}) AS ok, regexp_extract(id, {_G}, 1) AS px, regexp_extract(id, {_G}, 2) AS site, regexp_extract(id, {_G}, 3) AS kind,
             regexp_extract(id, {_G}, 4) AS rep, regexp_extract(id, {_G}, 5) AS suffix FROM ids)
    SELECT CASE WHEN ok THEN CASE px WHEN '' THEN 1 WHEN 'T' THEN 2 WHEN 'F' THEN 3 WHEN 'S' THEN 4 ELSE 5 END ELSE -1 END AS campaign,
           CASE WHEN ok THEN CAST(nullif(site, '') AS INTEGER) ELSE -1 END AS site, CASE WHEN ok THEN kind ELSE 'Unknown' END AS type,
           CASE WHEN ok THEN CAST(nullif(rep, '') AS INTEGER) ELSE -1 END AS rep, CASE WHEN ok THEN suffix END AS suffix, count(*) AS n
    FROM p GROUP BY ALL""")
def _(t):
    keys = _ids(t).select(K.parse_sample_id("id").alias("k")).select("k.*").na.fill(-1, ["campaign", "site", "rep"])
    return keys.groupBy("campaign", "site", "type", "rep", "suffix").agg(F.count(F.lit(1)).alias("n"))


@query("prj2_normalize_id", f"""
    WITH ids AS ({_IDS}) SELECT regexp_replace(regexp_replace(id || CASE WHEN l_linenumber % 4 = 0 THEN '_lib2' ELSE '' END, '^e[0-9]+_', ''), '_(v|lib)[0-9]+$', '') AS normalized, count(*) AS n
    FROM ids GROUP BY 1""")
def _(t):
    raw = F.concat("id", F.when(F.col("l_linenumber") % 4 == 0, "_lib2").otherwise(""))
    return _ids(t).groupBy(K.normalize_id(raw).alias("normalized")).agg(F.count(F.lit(1)).alias("n"))


@query("prj3_classify_role", """
    SELECT CASE WHEN regexp_matches(s_name, '0$') THEN 'blank' WHEN regexp_matches(s_name, '5$') THEN 'positive' ELSE 'biological' END AS role, count(*) AS n FROM supplier GROUP BY 1""")
def _(t):
    role = K.classify_role("s_name", {"blank": "0$", "positive": "5$"})
    return t.table("supplier").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("prj4_record_role", """
    SELECT CASE WHEN year(o_orderdate) < 1996 THEN 'archive' WHEN o_custkey % 70 BETWEEN 1 AND 60 THEN 'core' ELSE 'auxiliary' END AS role, count(*) AS n FROM orders GROUP BY 1""")
def _(t):
    role = K.record_role(F.col("o_custkey") % 70, F.to_date("o_orderdate"), 60, 1996)
    return t.table("orders").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"))


def _raw_lineage(t):
    p = t.table("part")
    base = F.concat(F.lit("d__"), "p_type", F.lit(";p__"), "p_brand", F.lit(";c__NA;o__;f__x;g__"), F.col("p_size").cast("string"), F.lit(";s__"), "p_name")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(base, F.lit(";extra;0.75"))).when(F.col("p_partkey") % 11 == 0, F.lit("broken;row")).otherwise(base).alias("raw"))


_RAW = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN base || ';extra;0.75' WHEN p_partkey % 11 = 0 THEN 'broken;row' ELSE base END AS raw FROM (SELECT *, 'd__' || p_type || ';p__' || p_brand || ';c__NA;o__;f__x;g__' || p_size || ';s__' || p_name AS base FROM part)"
_PARSED = "SELECT p_partkey, string_split(raw, ';') AS f, CASE WHEN len(string_split(raw, ';')) IN (7, 9) THEN list_transform(string_split(raw, ';')[1:7], lambda x: CASE WHEN regexp_replace(x, '^[a-z]__', '') IN ('', 'NA') THEN NULL ELSE regexp_replace(x, '^[a-z]__', '') END) END AS lineage FROM raw"


@query("prj5_parse_lineage", f"""
    WITH raw AS ({_RAW}), p AS ({_PARSED})
    SELECT p_partkey, list_aggregate(list_transform(lineage, lambda x: coalesce(x, '-')), 'string_agg', '|') AS lineage,
           CASE WHEN len(f) = 9 THEN f[8] END AS supplementary, CASE WHEN len(f) = 9 THEN CAST(f[9] AS DOUBLE) END AS confidence FROM p""")
def _(t):
    out = _raw_lineage(t).withColumn("k", K.parse_lineage("raw"))
    shown = F.when(F.col("k.lineage").isNotNull(), F.concat_ws("|", F.transform("k.lineage", lambda x: F.coalesce(x, F.lit("-")))))
    return out.select("p_partkey", shown.alias("lineage"), "k.supplementary", "k.confidence")


@query("prj6_lineage_at_rank", """
    SELECT p_type || ';' || p_brand AS truncated, 'Domain: ' || p_type || '; Phylum: ' || p_brand || '; Class: ' || p_name AS emitted, count(*) AS n FROM part GROUP BY 1, 2""")
def _(t):
    x = t.taxonomy.select(K.lineage_at("lineage", 2).alias("truncated"), K.emitted_lineage("lineage").alias("emitted"))
    return x.groupBy("truncated", "emitted").agg(F.count(F.lit(1)).alias("n"))


@query("prj7_contextual_label", f"""
    WITH raw AS ({_RAW}), p AS ({_PARSED})
    SELECT p_partkey, CASE WHEN lineage[4] IS NOT NULL THEN lineage[4]
      ELSE 'unresolved ' || coalesce(list_filter(lineage[1:3], lambda x: x IS NOT NULL)[-1], 'root') END AS label FROM p WHERE lineage IS NOT NULL""")
def _(t):
    out = _raw_lineage(t).withColumn("k", K.parse_lineage("raw")).where("k is not null")
    return out.select("p_partkey", K.contextual_label(F.col("k.lineage"), 4).alias("label"))


@query("prj8_parse_point", sql("sites", """
    SELECT site, lon, lat FROM sites"""))
def _(t):
    text = F.when(F.col("site") % 2 == 0, F.concat(F.lit("POINT("), "lon", F.lit(" "), "lat", F.lit(")"))).otherwise(F.concat("lat", F.lit(", "), "lon"))
    return t.sites.select("site", K.parse_point(text).alias("p")).select("site", "p.lon", "p.lat")


@query("prj9_parse_date", """
    SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'unparsed' WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'future' ELSE 'ok' END AS status,
           CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND o_orderdate < TIMESTAMP '2000-01-01' THEN CAST(o_orderdate AS DATE) END AS day, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(t):
    k = F.col("o_orderkey")
    text = F.when(k % 13 == 0, "").when(k % 7 == 0, "n.d.").when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = K.parse_date(text, ("yyyy-MM-dd", "dd/MM/yyyy"), "1999-12-31")
    return t.table("orders").select(day.alias("d")).groupBy("d.status", "d.day").agg(F.count(F.lit(1)).alias("n"))


@query("prj10_parse_formula", """
    WITH f(k, formula, parsed, kind) AS (VALUES (0, 'CaSO4.2H2O', 'Ca1 H4 O6 S1', 'other'), (1, 'SiO2', 'O2 Si1', 'compound'), (2, 'C6H12O6', 'C1 H2 O1', 'compound'), (3, 'Fe', 'Fe1', 'element'), (4, 'LE', NULL, 'light elements'))
    SELECT formula, parsed, kind, count(*) AS n FROM part JOIN f ON p_partkey % 5 = k GROUP BY ALL""")
def _(t):
    forms = F.array(*map(F.lit, ("CaSO4.2H2O", "SiO2", "C6H12O6", "Fe", "LE")))
    df = t.table("part").select(F.element_at(forms, (F.col("p_partkey") % 5 + 1).cast("int")).alias("formula"))
    atoms = F.when(F.col("formula") != "LE", K.parse_formula("formula"))
    shown = F.concat_ws(" ", F.transform(atoms, lambda a: F.concat(a["element"], a["n"].cast("string"))))
    return df.select("formula", F.when(F.col("formula") != "LE", shown).alias("parsed"), K.analyte_kind("formula").alias("kind")).groupBy("formula", "parsed", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("prj11_to_oxide", """
    WITH f(element, factor) AS (VALUES ('click', CAST(2.1393 AS DOUBLE)), ('view', CAST(1.8895 AS DOUBLE)), ('purchase', CAST(1.4297 AS DOUBLE)))
    SELECT event_type AS element, count(*) AS n, round(sum(value * factor), 3) AS oxide_total FROM events JOIN f ON event_type = element GROUP BY 1""")
def _(t):
    factors = t.spark.sql("SELECT * FROM VALUES ('click', 2.1393D), ('view', 1.8895D), ('purchase', 1.4297D) AS f(element, factor)")
    df = t.table("events").select(F.col("event_type").alias("element"), "value")
    return K.to_oxide(df, factors).groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("oxide_value"), 3).alias("oxide_total"))


@query("prj12_stable_id", """
    SELECT p_partkey, 'taxon_' || substr(sha256('taxon' || chr(31) || p_type || chr(31) || p_brand || chr(31) || p_name), 1, 24) AS iri FROM part""")
def _(t):
    return t.table("part").select("p_partkey", K.stable_id("taxon", "p_type", "p_brand", "p_name").alias("iri"))


@query("prj13_match_genome", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN s_name END AS genome FROM supplier""")
def _(t):
    s = t.table("supplier")
    name = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("/a/b/"), "s_name", F.lit(".fasta"))).when(F.col("s_suppkey") % 4 == 2, F.concat("s_name", F.lit(".fa"))).otherwise(F.concat("s_name", F.lit("_x.fna")))
    return K.match_genome(s.select("s_suppkey", name.alias("name")), s.select(F.col("s_name").alias("genome"))).select("s_suppkey", "genome")


@query("prj14_explode_terms", """
    WITH c AS (SELECT p_partkey, 'ko:K' || (p_size % 9) || ',ko:K' || (p_partkey % 5) || ',-' AS cell FROM part)
    SELECT term, count(*) AS n FROM (SELECT DISTINCT p_partkey, regexp_replace(u, '^ko:', '') AS term FROM (SELECT p_partkey, unnest(string_split(cell, ',')) AS u FROM c)) WHERE term <> '-' GROUP BY 1""")
def _(t):
    cell = F.concat(F.lit("ko:K"), (F.col("p_size") % 9).cast("string"), F.lit(",ko:K"), (F.col("p_partkey") % 5).cast("string"), F.lit(",-"))
    return K.explode_terms(t.table("part").select("p_partkey", cell.alias("cell")), "cell").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("prj15_match_primers", """
    WITH r AS (SELECT user_id % 10 AS file, upper(translate(md5(CAST(event_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')) AS seq FROM events)
    SELECT file, count(*) AS n_reads, count(*) FILTER (regexp_matches(seq, '^G[CT][AG]')) AS n_fwd, count(*) FILTER (regexp_matches(seq, '^[ACGT]CC')) AS n_rev FROM r GROUP BY 1""")
def _(t):
    seq = F.upper(F.translate(F.md5(F.col("event_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"))
    return K.match_primers(t.table("events").select((F.col("user_id") % 10).alias("file"), seq.alias("seq")), {"fwd": "GYR", "rev": "NCC"}, "file")


@query("flt1_core_cohort", """
    SELECT site, count(*) AS n FROM (
      SELECT CASE WHEN l_partkey % 5 = 0 THEN (l_suppkey % 70) || '.5' ELSE CAST(l_suppkey % 70 AS VARCHAR) END AS site, year(l_shipdate) % 7 AS campaign, l_returnflag AS kind FROM lineitem)
    WHERE regexp_matches(site, '^[0-9]+$') AND campaign BETWEEN 1 AND 5 AND kind IN ('A', 'N') AND CAST(CASE WHEN regexp_matches(site, '^[0-9]+$') THEN site END AS INTEGER) BETWEEN 1 AND 60 GROUP BY 1""")
def _(t):
    label = F.when(F.col("l_partkey") % 5 == 0, F.concat((F.col("l_suppkey") % 70).cast("string"), F.lit(".5"))).otherwise((F.col("l_suppkey") % 70).cast("string"))
    df = t.table("lineitem").select(label.alias("site"), (F.year("l_shipdate") % 7).alias("campaign"), F.col("l_returnflag").alias("kind"))
    return K.core_cohort(df, "site", "campaign", "kind", kinds=("A", "N")).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query("flt2_min_depth", sql("counts", """
    SELECT profile, count(*) AS cells, CAST(sum(n) AS BIGINT) AS reads FROM counts WHERE profile IN (SELECT profile FROM counts GROUP BY 1 HAVING sum(n) >= 15000) GROUP BY 1"""))
def _(t):
    return K.min_depth(t.counts, 15000).groupBy("profile").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("reads"))


@query("flt3_prevalence", sql("counts", """
    SELECT feature, count(*) AS seen, CAST(sum(n) AS BIGINT) AS reads FROM counts GROUP BY 1 HAVING count(DISTINCT profile) >= 0.3 * (SELECT count(DISTINCT profile) FROM counts)"""))
def _(t):
    return K.prevalence_filter(t.counts, 0.3).groupBy("feature").agg(F.count(F.lit(1)).alias("seen"), F.sum("n").alias("reads"))


@query("flt4_qc_flags", """
    SELECT reasons, coalesce(nullif(string_split(reasons, ';')[1], ''), 'admitted') AS disposition, count(*) AS n FROM (
      SELECT concat_ws(';', CASE WHEN value > 100 THEN 'RANGE' END, CASE WHEN user_id % 17 = 0 THEN 'DEPLETED' END, CASE WHEN event_type = 'click' AND value < 5 THEN 'LOW_CLICK' END) AS reasons FROM events) GROUP BY 1, 2""")
def _(t):
    rules = {"RANGE": F.col("value") > 100, "DEPLETED": F.col("user_id") % 17 == 0, "LOW_CLICK": (F.col("event_type") == "click") & (F.col("value") < 5)}
    return K.qc_flags(t.table("events"), rules).groupBy(F.concat_ws(";", "reasons").alias("reasons"), "disposition").agg(F.count(F.lit(1)).alias("n"))


@query("fn9_mimag_tier", """
    SELECT tier, reasons, count(*) AS n FROM (SELECT
      CASE WHEN completeness > 90 AND contamination < 5 AND rrna AND trna >= 18 THEN 'high' WHEN completeness >= 50 AND contamination < 10 THEN 'medium' WHEN contamination < 10 THEN 'low' ELSE 'unqualified' END AS tier,
      concat_ws(';', CASE WHEN NOT rrna THEN 'no_rrna' END, CASE WHEN trna < 18 THEN 'few_trna' END) AS reasons
      FROM (SELECT 40 + p_size AS completeness, p_partkey % 12 AS contamination, p_partkey % 3 > 0 AS rrna, p_partkey % 25 AS trna FROM part)) GROUP BY 1, 2""")
def _(t):
    k = F.col("p_partkey")
    df = t.table("part").select((40 + F.col("p_size")).alias("a"), (k % 12).alias("b"), (k % 3 > 0).alias("c"), (k % 25).alias("d"))
    tier = mimag_tier(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    why = applicability({"no_rrna": ~F.col("c"), "few_trna": F.col("d") < 18})
    return df.groupBy(tier.alias("tier"), why.alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("win13_row_numbers", """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders""")
def _(t):
    return K.row_numbers(t.table("orders"), [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.col("number").cast("bigint").alias("number"))
