"""Corpus preparation in four stages over the documents table.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet in the shared folder and read again as the next stage's input. The
stages decide by row: ids may be NULL, repeated, or stand with several texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import language, near_dedup, packing, quality
from quadrat.session import cut


ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Texts travel to Python 2,000 at a time, where the session has Spark's own 10,000: batches stand in memory twice on either side."""
    if spark.conf.get(ARROW) == "10000":
        spark.conf.set(ARROW, "2000")


def unused(docs: DataFrame, *stems: str) -> list[str]:
    """The stems after as many underscores as no column name begins like, in any case."""
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any((mark + s).lower() in taken for s in stems):
        mark += "_"
    return [mark + s for s in stems]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier doesn't reject.

    NULL and empty texts have a score like any other and go if it is under the
    bound; a text of any length is read whole; repeated rows share their fate.
    Without labelled rows of both classes nothing is rejected. An empty table
    stays empty. Extra columns are kept, whatever their names.
    """
    short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (score,) = unused(docs, "score")
    return quality.with_scores(docs, labels, score_col=score).where(F.col(score) >= quality.REJECT).drop(score)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told without a narrow margin.

    NULL texts and texts without letters are rejected, and all rows if no row
    has a ``lang`` to learn from. A long text is judged by the sum over its
    pieces; repeated rows share their fate; an empty table stays empty. Extra
    columns are kept, whatever their names.
    """
    short_batches(spark)
    found = unused(docs, "lang_pred", "score", "margin")
    judged = language.with_languages(docs, prefix=found[0].removesuffix("lang_pred"))
    return judged.where(F.col(found[2]) >= language.MIN_MARGIN).drop(*found)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest id, and of its rows any one.

    Groups are found over row keys written with the table. A NULL id comes
    after all ids; NULL texts and texts without words are groups of their own.
    Texts of any length are compared whole; an empty table stays empty. Extra
    columns are kept, whatever their names.
    """
    short_batches(spark)
    (row,) = unused(docs, "row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_dedup.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    kept = rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(first.alias("first")).select(F.col("first")[row].alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences.

    A NULL or empty text is one piece with the end id alone; a long text is cut
    into pieces; NULL and repeated ids and rows are packed like others; an empty
    table gives an empty result. Extra columns are left out.
    """
    short_batches(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL can state the classifiers, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
