"""Queries over real files: a given table is written in a format, in as many files as Spark makes, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions import compositional as C
from quadrat.functions.numeric import lgamma
from quadrat.operators import agg as A
from quadrat.operators import joins as J
from quadrat.operators import stats as S
from quadrat.plans import stats_plan as SP
from quadrat.plans.roles import registry, sql
from quadrat.session import scratch
from quadrat.sources import sinks, text

QUERIES, query = registry()
N = lambda: F.count(F.lit(1)).alias("n")


def _part_tsv(t) -> str:
    path = scratch(t.spark, "part-tsv")
    t.table("part").select("p_partkey", "p_name", "p_size", "p_retailprice", "p_type").write.csv(path, sep="\t", header=True, quote="", escape="")
    return path


@query("src1_typed_table", "SELECT p_type, p_partkey, p_retailprice FROM part")
def _(t):
    schema = T.StructType([T.StructField("p_type", T.StringType()), T.StructField("p_partkey", T.LongType()), T.StructField("p_retailprice", T.DoubleType())])
    return text.read_table(t.spark, _part_tsv(t), schema)


@query("src3_positional_columns", "SELECT p_partkey, p_name, CAST(p_size AS INTEGER) AS p_size FROM part")
def _(t):
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType())])
    return text.read_table(t.spark, _part_tsv(t), schema, fold_last=False, positional=3)


@query("src4_keyed_files", sql("daily", "SELECT CAST(site AS VARCHAR) AS site, CAST(date AS VARCHAR) AS date, value FROM daily"))
def _(t):
    path = scratch(t.spark, "site-files")
    t.daily.select("date", "value", F.col("site").alias("k")).write.partitionBy("k").csv(path, header=True)
    rows = text.read_keyed_files(t.spark, f"{path}/*", r"/k=(\d+)/", "site", whole_path=True)
    return rows.select("site", F.col("date").cast("string").alias("date"), F.col("value").cast("double").alias("value"))


@query("src7_fastq_reads", "SELECT upper(replace(p_name, ' ', '')) AS seq, count(*) AS n FROM part GROUP BY 1")
def _(t):
    path = scratch(t.spark, "reads")
    seq = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    t.table("part").select(F.concat_ws("\n", F.concat(F.lit("@r"), "p_partkey"), seq, F.lit("+"), F.lit("@I"))).write.text(path)
    return text.read_fastq(t.spark, path).groupBy("seq").agg(N())


@query("src8_fasta_stats", "SELECT replace(p_brand, '#', '_') AS genome, count(*) AS contigs, CAST(sum(length(replace(p_name, ' ', ''))) AS BIGINT) AS bases FROM part GROUP BY 1")
def _(t):
    path = scratch(t.spark, "genomes")
    half = F.floor(F.length("p_name") / 2).cast("int")
    record = F.concat(F.lit(">c"), "p_partkey", F.lit(" contig\n"), F.substr("p_name", F.lit(1), half), F.lit("\n"), F.substr("p_name", half + 1))
    t.table("part").select(record.alias("value"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("genome")).write.partitionBy("genome").text(path)
    return text.fasta_stats(t.spark, f"{path}/*", r"/genome=([^/]+)/")


@query("src9_annotations", "SELECT p_brand AS genome, p_brand || '@@' || p_partkey AS query, p_type AS terms FROM part")
def _(t):
    path = scratch(t.spark, "annotations")
    cells = F.concat_ws("\t", F.concat_ws("@@", "p_brand", "p_partkey"), *(F.lit(str(i)) for i in range(10)), "p_type", F.lit("more"))
    t.table("part").select(F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("#comment\n"), cells)).otherwise(cells)).write.text(path)
    return text.read_annotations(t.spark, path)


@query("snk1_tsv", """
    SELECT line, row_number() OVER (ORDER BY k) - 1 AS at FROM (
      SELECT -1 AS k, 'nation' || chr(9) || 'n' || chr(9) || 'most' AS line
      UNION ALL SELECT c_nationkey, c_nationkey || chr(9) || count(*) || chr(9) || printf('%.6f', max(c_acctbal)) FROM customer GROUP BY c_nationkey)""")
def _(t):
    path = scratch(t.spark, "tsv")
    g = t.table("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(N(), F.max("c_acctbal").alias("most"))
    sinks.write_tsv(g, path, ["nation"])
    whole = t.spark.read.text(path, wholetext=True).where("value <> ''")
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line")).select(F.col("at").cast("bigint").alias("at"), "line")


@query("snk3_sorted_nquads", sql("triples", "SELECT p, o_kind, count(*) AS n, min(s) AS first, max(o) AS last, true AS bounded FROM triples GROUP BY 1, 2"))
def _(t):
    path = scratch(t.spark, "nquads")
    sinks.write_nquads(t.triples, path, 5_000)
    lines = t.spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    bounded = lines.groupBy("file").agg(N()).agg((F.max("n") <= 5_000).alias("bounded"))
    quads, _ = text.parse_nquads(lines)
    return quads.groupBy("p", "o_kind").agg(N(), F.min("s").alias("first"), F.max("o").alias("last")).join(F.broadcast(bounded))


@query("snk4_manifest", "SELECT 'names' AS role, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes, true AS distinct_sums, true AS same_sums FROM part")
def _(t):
    """Sizes and checksums of written files; a second manifest of the same files has the same rows."""
    path = scratch(t.spark, "names")
    t.table("part").select("p_name").orderBy("p_name", "p_partkey").write.text(path)
    one, two = (sinks.manifest(t.spark, path, "names").where("name like 'part-%' and bytes > 0") for _ in range(2))
    same = one.join(two, ["name", "bytes", "sha256", "role"], "full_outer").groupBy("role").agg(N(), F.sum("bytes").alias("bytes"), F.count_distinct("sha256").alias("k"), F.count_distinct("name").alias("m"))
    return same.select("role", "bytes", (F.col("k") == F.col("m")).alias("distinct_sums"), (F.col("n") == F.col("m")).alias("same_sums"))


@query("fn1_lgamma", sql("counts", "SELECT profile, round(sum(lgamma(n + 1)), 4) AS total FROM counts GROUP BY 1"))
def _(t):
    return t.counts.groupBy("profile").agg(F.round(F.sum(lgamma(F.col("n") + 1)), 4).alias("total"))


_ML14 = {
    "rich": """SELECT resolution, site, CAST(count(DISTINCT taxon) AS DOUBLE) AS r FROM (
      SELECT site, unnest([{'resolution': 'feature', 'taxon': CAST(feature AS VARCHAR)}, {'resolution': 'rank 2', 'taxon': r2}, {'resolution': 'rank 1', 'taxon': r1}], recursive := true)
      FROM counts JOIN taxonomy USING (feature) JOIN profiles USING (profile)) GROUP BY 1, 2""",
    "zz": "SELECT resolution, site, r - avg(r) OVER (PARTITION BY resolution) AS z FROM rich",
    "norm": "SELECT resolution, count(*) / nullif(sum(z * z), 0) AS w FROM zz GROUP BY 1",
    "km": SP._KM,
    "knn": """SELECT DISTINCT neighbours, least(s, o) AS a, greatest(s, o) AS b FROM (VALUES (3), (5), (8)) n(neighbours) JOIN (
      SELECT k.site AS s, m.site AS o, row_number() OVER (PARTITION BY k.site ORDER BY round(pow(k.x - m.x, 2) + pow(k.y - m.y, 2), 9), m.site) AS r FROM km k JOIN km m ON k.site <> m.site) ON r <= neighbours""",
    "un": "SELECT DISTINCT site AS u FROM rich", "reps": "SELECT CAST(range AS INTEGER) AS draw FROM range(1, 200)", "perm": SP._PERM,
    "seen": "SELECT x.resolution, neighbours, w * sum(x.z * y.z) / count(*) AS i FROM knn JOIN zz x ON x.site = a JOIN zz y ON y.site = b AND y.resolution = x.resolution JOIN norm ON norm.resolution = x.resolution GROUP BY 1, 2, w",
    "moved": """SELECT x.resolution, neighbours, p.draw, w * sum(x.z * y.z) / count(*) AS v FROM knn JOIN perm p ON p.u = a JOIN perm q ON q.u = b AND q.draw = p.draw
      JOIN zz x ON x.site = p.perm_unit JOIN zz y ON y.site = q.perm_unit AND y.resolution = x.resolution JOIN norm ON norm.resolution = x.resolution GROUP BY 1, 2, 3, w""",
}


@query("ml14_resolution_sensitivity", sql("counts taxonomy profiles sites", """
    SELECT resolution, neighbours, round(i, 6) AS i, CASE WHEN i IS NOT NULL THEN round((1 + count(*) FILTER (v >= i - 1e-9)) / CAST(1 + count(*) AS DOUBLE), 6) END AS p FROM seen JOIN moved USING (resolution, neighbours) GROUP BY 1, 2, i""", **_ML14))
def _(t):
    """Moran's I of richness at two ranks and several neighbour counts."""
    levels = t.counts.join(t.taxonomy, "feature").join(t.profiles.select("profile", "site"), "profile")
    out = None
    for name, taxon in (("feature", F.col("feature").cast("string")), ("rank 2", F.element_at("lineage", 2)), ("rank 1", F.element_at("lineage", 1))):
        rich = levels.withColumn("taxon", taxon).groupBy("site").agg(F.count_distinct("taxon").cast("double").alias("richness"))
        for k in (3, 5, 8):
            one = S.moran(rich, J.knn_graph(C.km_axes(t.sites), k, node="site"), "site", "richness", 199)
            one = one.select(F.lit(name).alias("resolution"), F.lit(k).alias("neighbours"), F.round("i", 6).alias("i"), F.round("p", 6).alias("p"))
            out = one if out is None else out.unionByName(one)
    return out
