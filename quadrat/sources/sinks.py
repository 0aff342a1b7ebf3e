"""Deterministic writers: sorted tables, triples, and checksum manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, order_by: list[str], digits: int = 6, single: bool = True) -> None:
    """Sorted TSV with a header and fixed number formatting. ``single`` is for result tables of report size."""
    ordered = df.orderBy(*order_by)
    shown = ordered.select(*(F.format_string(f"%.{digits}f", c).alias(c) if k in ("double", "float") else F.col(c).cast("string").alias(c) for c, k in df.dtypes))
    (shown.coalesce(1) if single else shown).write.csv(path, sep="\t", header=True, emptyValue="", nullValue="")


def render_nquads(triples: DataFrame) -> DataFrame:
    """One line a triple, literals escaped, with datatype, language and graph if the columns are there."""
    has = set(triples.columns)
    term = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    tail = F.lit("")
    if "datatype" in has:
        tail = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(tail)
    if "lang" in has:
        tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(tail)
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), tail)
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), term("g"))).otherwise("") if "g" in has else F.lit("")
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(term("o"))
    return triples.select(F.concat(term("s"), F.lit(" "), term("p"), F.lit(" "), obj, graph, F.lit(" .")).alias("value"))


def write_nquads(triples: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Sorted N-Quads in files of at most ``rows_per_file`` lines (range-partitioned, so sorting scales)."""
    render_nquads(triples).orderBy("value").write.option("maxRecordsPerFile", rows_per_file).text(path)


def manifest(spark: SparkSession, path: str, role: str) -> DataFrame:
    """Name, size and SHA-256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(role).alias("role"))
