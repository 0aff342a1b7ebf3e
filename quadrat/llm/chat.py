"""Chat formatting: collapse cumulative snapshots, then render.

Chat logs often hold a conversation several times, each time a few turns
longer. A conversation that another one continues (or repeats) is dropped;
the maximal ones are rendered.

Every turn gets its place in its conversation, and a prefix hash: the running
sum of 64-bit hashes of (place, role, md5 of the text), kept as four 32-bit
halves of two independent hashes so that no sum overflows. All of this is done
on a narrow table without texts, written once: turns are dealt by ranges of
(conversation, turn, role, md5), so a conversation of any length, or with all
its turns under one number, spreads over tasks; places and sums inside a range
come from a window, across ranges from a window over the (few) range totals. A
conversation is a snapshot if its last prefix hash is a prefix hash of a longer
one: a left anti join on distinct hashes. Of equal conversations the smallest
id stays. Texts are read again at the end, and moved once.

DataFrame operations only. An exactly repeated row counts once. NULL role or
text reads as an empty one, NULL turns come first in their conversation, ties
are ordered by role and md5 of the text, rows without a conversation id take no
part. Texts of any length are rows like others. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.session import cut

_HALVES = ("h0", "h1", "h2", "h3")
_KEY = ("conv_id", "turn", "unnumbered", "role", "digest")


def keyed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns with a key free of NULLs, and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    turn = F.col(turn_col).cast("bigint")
    return turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.coalesce(turn, F.lit(0)).alias("turn"), turn.isNull().alias("unnumbered"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"),
    )


def placed(keys: DataFrame) -> DataFrame:
    """Distinct turns with ``place`` (from 1) and the prefix hash after each."""
    order = F.desc("unnumbered"), "turn", "role", "digest"
    dealt = keys.select(*_KEY).distinct().repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    rows = cut(dealt, "turns")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    across = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    numbered = rows.withColumn("k", F.row_number().over(inside)).join(before, ["conv_id", "part"]).withColumn("place", F.col("before") + F.col("k"))
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    h = [F.xxhash64(F.lit(seed), "place", "role", "digest") for seed in (1, 2)]
    hashed = numbered.withColumns({"h0": low(h[0]), "h1": F.shiftrightunsigned(h[0], 32), "h2": low(h[1]), "h3": F.shiftrightunsigned(h[1], 32)})
    totals = hashed.groupBy("conv_id", "part").agg(*(F.sum(c).alias(c) for c in _HALVES))
    carried = totals.select("conv_id", "part", *(F.coalesce(F.sum(c).over(across), F.lit(0)).alias(f"c{c}") for c in _HALVES))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumns({f"r{c}": F.sum(c).over(running) for c in _HALVES})
        .join(carried, ["conv_id", "part"])
        .select(*_KEY, "place", F.struct(*((F.col(f"r{c}") + F.col(f"c{c}")).alias(c) for c in _HALVES)).alias("prefix"))
    )


def maximal(numbered: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_equal)`` of each conversation that none prolongs; of equals the smallest id."""
    sizes = numbered.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by("prefix", "place").alias("prefix"))
    one = sizes.groupBy("n_turns", "prefix").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    inner = (
        numbered.join(sizes.select("conv_id", "n_turns"), "conv_id").where(F.col("place") < F.col("n_turns"))
        .select(F.col("place").alias("n_turns"), "prefix").distinct()
    )
    return one.join(inner, ["n_turns", "prefix"], "left_anti").select("conv_id", "n_turns", "n_equal")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, n_turns, n_equal, place, role, rendered)``: every turn of the maximal conversations.

    In order of ``place``, the ``rendered`` strings of a conversation are its
    formatted text. They stay one row each, so no conversation has to fit a task.
    """
    whole = keyed(turns, conv_col, turn_col, role_col, text_col)
    numbered = cut(placed(whole), "places")
    kept = numbered.select(*_KEY, "place").join(maximal(numbered), "conv_id")
    texts = whole.groupBy(*_KEY).agg(F.first("text").alias("text"))
    return texts.join(kept, list(_KEY)).select(
        "conv_id", "n_turns", "n_equal", "place", "role", rendered(F.col("role"), F.col("text")).alias("rendered")
    )


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
    WITH t AS (
      SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    ), p AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place FROM t
    ), x AS (
      SELECT *, string_agg(md5(role || chr(0) || text), '/') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM p
    ), s AS (SELECT conv_id, max(place) AS n_turns, arg_max(prefix, place) AS prefix FROM x GROUP BY conv_id),
    one AS (SELECT n_turns, prefix, min(conv_id) AS conv_id, count(*) AS n_equal FROM s GROUP BY n_turns, prefix),
    kept AS (
      SELECT one.* FROM one WHERE NOT EXISTS (
        SELECT 1 FROM x JOIN s ON s.conv_id = x.conv_id WHERE x.place = one.n_turns AND x.place < s.n_turns AND x.prefix = one.prefix)
    )
    SELECT x.conv_id, kept.n_turns, kept.n_equal, x.place, x.role, '<|' || x.role || '|>' || chr(10) || x.text || chr(10) AS rendered
    FROM x JOIN kept ON kept.conv_id = x.conv_id
"""
