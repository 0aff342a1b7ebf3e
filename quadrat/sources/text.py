"""Readers of tabular and record text files. Every reader returns a DataFrame; nothing is opened on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class HeaderError(ValueError):
    pass


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file they stand in and an order inside it: start of the split, and place there."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )


def _first_lines(lines: DataFrame) -> DataFrame:
    """``(_file, _head_id, _head)``: the first line of each file."""
    own = lines.groupBy("_file").agg(F.min(F.struct("_block", "_id", "value")).alias("m"))
    return own.select("_file", F.col("m._id").alias("_head_id"), F.col("m.value").alias("_head"))


def read_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", fold_last: bool = True, positional: int | None = None) -> DataFrame:
    """Typed table with a header line in each file, which alone says where that file's columns are.

    Every header must have the required columns (``positional``: its first k
    names must be those of the schema, in order). Extra trailing cells fold
    into the file's last column; short rows are padded with NULL; a cell that
    does not fit its type is NULL. A data row that repeats the header is data.
    """
    lines = _numbered(spark, path)
    heads = _first_lines(lines).withColumn("_names", F.split(F.regexp_replace("_head", "\r$", ""), sep.replace("|", r"\|"), -1))
    wanted = schema.fieldNames()[:positional]
    names = F.slice("_names", 1, positional) if positional is not None else F.col("_names")
    required = F.array(*map(F.lit, wanted))
    wrong = names != required if positional is not None else F.size(F.array_except(required, names)) > 0
    if bad := heads.where(wrong).select("_file", "_names").first():
        raise HeaderError(f"{bad[0]} has the header {bad[1]}; required: {wanted}")
    cells = F.split(F.regexp_replace("value", "\r$", ""), sep.replace("|", r"\|"), -1)
    rows = lines.where(F.col("value") != "").join(heads.select("_file", "_head_id", names.alias("_names")), "_file").where(F.col("_id") != F.col("_head_id")).select(cells.alias("c"), "_names")
    n = F.size("_names")

    def cell(name: str) -> Column:
        at = F.array_position("_names", name).cast("int")
        one = F.try_element_at("c", at)
        return F.when((at == n) & (F.size("c") > n), F.concat_ws(sep, F.slice("c", n, F.size("c") - n + 1))).otherwise(one) if fold_last else one

    return rows.select(*(F.nullif(cell(c), F.lit("")).try_cast(schema[c].dataType).alias(c) for c in wanted))


def read_wide_counts(spark: SparkSession, path: str, comment: str = "# Constructed", taxon: str = "Taxon") -> DataFrame:
    """``(profile, feature, n)`` of a features x profiles matrix; comment line, taxon column and zero cells left out.

    Each file has a header of its own, its first line that is no comment.
    """
    lines = _numbered(spark, path).where(~F.col("value").startswith(comment))
    heads = _first_lines(lines).withColumn("_names", F.split(F.regexp_replace("_head", "\r$", ""), "\t"))
    if bad := heads.where(F.size("_names") < 2).select("_file").first():
        raise HeaderError(f"{bad[0]} has no profile columns")
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.join(heads, "_file").where(F.col("_id") != F.col("_head_id"))
    pairs = F.arrays_zip(F.slice("_names", 2, F.size("_names")).alias("profile"), F.slice(cells, 2, F.size("_names") - 1).alias("v"))
    long = rows.select(F.element_at(cells, 1).alias("feature"), F.explode(pairs).alias("x")).select(F.col("x.profile").alias("profile"), "feature", F.col("x.v").try_cast("double").alias("d"))
    return long.where((F.col("profile") != taxon) & (F.col("d") > 0)).select("profile", "feature", F.col("d").cast("bigint").alias("n"))


def melt_counts(wide: DataFrame, feature: str, profiles: list[str]) -> DataFrame:
    return wide.unpivot([feature], profiles, "profile", "n").where("n > 0")


def to_wide(counts: DataFrame, rows: str, cols: str, values: list, n: str = "n") -> DataFrame:
    """Long counts to a matrix with the given columns; absent cells are 0."""
    return counts.groupBy(rows).pivot(cols, values).agg(F.sum(n)).na.fill(0)


def read_keyed_files(spark: SparkSession, path: str, key_regex: str, key: str = "key", whole_path: bool = False, **options) -> DataFrame:
    """Many small CSV files; ``key`` is taken from the file name (``whole_path``: from the path, folders included)."""
    return spark.read.options(**({"header": True} | options)).csv(path).withColumn(key, F.regexp_extract(F.col("_metadata.file_path" if whole_path else "_metadata.file_name"), key_regex, 1))


def select_one_per_key(files: DataFrame, required: DataFrame, key: str = "key", path: str = "path") -> DataFrame:
    """Status of every required key: ok (with its only file), missing, or duplicate."""
    g = files.groupBy(key).agg(F.array_sort(F.collect_set(path)).alias("paths"))
    n = F.coalesce(F.size("paths"), F.lit(0))
    return required.select(key).distinct().join(g, key, "left").select(
        key, F.when(n == 1, "ok").when(F.col("paths").isNull(), "missing").otherwise("duplicate").alias("status"), F.when(n == 1, F.element_at("paths", 1)).alias("path")
    )


def parse_instrument_blocks(docs: DataFrame, ident: str, text: str, start: str = "Formula", stop: tuple[str, ...] = ("Material", "Mode")) -> DataFrame:
    """Rows of the repeated sections of an instrument report: (id, section, line, formula, value).

    A section begins after a line that starts with ``start`` and ends before one that starts with a stop word.
    """
    lines = docs.select(ident, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    w = Window.partitionBy(ident).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("raw").startswith(start)
    ends = F.lit(False)
    for s in stop:
        ends = ends | F.col("raw").startswith(s)
    marked = lines.withColumn("section", F.sum(head.cast("int")).over(w)).withColumn("_stop", F.sum((ends & ~head).cast("int")).over(Window.partitionBy(ident, "section").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    body = marked.where((F.col("section") > 0) & ~head & (F.col("_stop") == 0) & (F.trim("raw") != ""))
    cells = F.split(F.col("raw"), "\t")
    return body.select(ident, "section", "line", F.trim(F.element_at(cells, 1)).alias("formula"), F.try_element_at(cells, F.lit(2)).try_cast("double").alias("value"))


def read_fastq(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(file, record, seq)``: the second line of each record of four, optionally the first ``limit`` of each file.

    Files are read by lines in splits. A line's number is its place in the
    split plus the lines of the file's splits before it, so no file has to fit a task.
    """
    lines = _numbered(spark, path)
    counts = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("k"))
    earlier = F.sum("k").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("_file", "_block", F.coalesce(earlier, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_id")) - 1
    numbered = lines.withColumn("k", place).join(before, ["_file", "_block"]).withColumn("i", F.col("before") + F.col("k"))
    out = numbered.where("i % 4 = 1").select(F.col("_name").alias("file"), (F.floor(F.col("i") / 4) + 1).alias("record"), F.regexp_replace("value", "\r$", "").alias("seq"))
    return out.where(F.col("record") <= limit) if limit is not None else out


def fasta_stats(spark: SparkSession, path: str, genome_regex: str | None = None) -> DataFrame:
    """Contigs and bases of each genome: the file's name without its suffix, or what ``genome_regex`` finds in the path."""
    genome = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.(fasta|fna|fa))?$", 1) if genome_regex is None else F.regexp_extract(F.col("_metadata.file_path"), genome_regex, 1)
    records = spark.read.text(path, lineSep=">").select(genome.alias("genome"), "value").where(F.trim("value") != "")
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return records.groupBy("genome").agg(F.count(F.lit(1)).alias("contigs"), F.sum(F.length(seq)).alias("bases"))


def read_annotations(spark: SparkSession, path: str, terms_col: int = 12) -> DataFrame:
    """``(genome, query, terms)`` of an annotation table; comments skipped, genome is the query up to ``@@``."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(cells.alias("c"))
    return rows.where(F.size("c") >= terms_col).select(F.substring_index(F.element_at("c", 1), "@@", 1).alias("genome"), F.element_at("c", 1).alias("query"), F.element_at("c", terms_col).alias("terms"))


# One term of an N-Triples or N-Quads line.
_IRI, _BNODE = r"<([^>]*)>", r"(_:[A-Za-z0-9_.-]+)"
_LINE = rf'^\s*(?:{_IRI}|{_BNODE})\s+{_IRI}\s+(?:{_IRI}|{_BNODE}|"((?:[^"\\]|\\.)*)"(?:\^\^{_IRI}|@([A-Za-z0-9-]+))?)\s*(?:{_IRI}|{_BNODE})?\s*\.\s*$'


def parse_nquads(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(quads, rejected lines). Quads: g, s, p, o, o_kind, datatype, lang. Comments and empty lines count for nothing."""
    rows = lines.where((F.trim(value) != "") & ~F.trim(value).startswith("#"))
    ok = F.col(value).rlike(_LINE)
    part = lambda i: F.nullif(F.regexp_extract(value, _LINE, i), F.lit(""))
    literal = F.coalesce(part(4), part(5)).isNull()
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(value, _LINE, 6), r'\\"', '"'), r"\\n", "\n"), r"\\\\", r"\\")
    quads = rows.where(ok).select(
        F.coalesce(part(9), part(10)).alias("g"), F.coalesce(part(1), part(2)).alias("s"), part(3).alias("p"), F.when(literal, text).otherwise(F.coalesce(part(4), part(5))).alias("o"),
        F.when(literal, "literal").when(part(5).isNotNull(), "bnode").otherwise("iri").alias("o_kind"), part(7).alias("datatype"), part(8).alias("lang"),
    )
    return quads, rows.where(~ok)


def read_nquads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_nquads(spark.read.text(path))


def explode_daily_json(df: DataFrame, ident: str, payload: str, fields: list[str]) -> DataFrame:
    """Daily JSON of parallel arrays (``{"daily": {"time": [...], field: [...]}}``) to one row a day."""
    inner = ", ".join(f"{f}: array<double>" for f in fields)
    parsed = F.from_json(payload, f"daily struct<time: array<string>, {inner}>")["daily"]
    zipped = F.arrays_zip(parsed["time"].alias("time"), *(parsed[f].alias(f) for f in fields))
    return df.select(ident, F.explode(zipped).alias("d")).select(ident, F.to_date("d.time").alias("date"), *(F.col(f"d.{f}").alias(f) for f in fields))
