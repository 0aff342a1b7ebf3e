"""Ranked lexical search through hashed max-sketches.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z
lower-cased. N, L, n, tf and df are counted over whole texts of all rows. A
term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), its impact in a text
weight * ((10^9 * tf) div (1000 * tf + 8m)) with m = 25 + (75 * n * N) div L,
and a text's score for an item the sum of its terms' impacts, repeats included.
All but the weight's logarithm is integer arithmetic. The plan:

1. a bitmap of fixed size holds the hashes of all item terms; one pass over the
   texts counts N, L and the df of terms that it lets through (pre-aggregated in
   every task);
2. items join the counts and are dealt in blocks of a bounded number of items;
   each block is one more pass over the texts;
3. in that pass the impacts of a text fold into a sketch of ``width`` hashed
   coordinates, each the largest of its terms. Looking up an item's terms in the
   sketches of many texts at once gives upper bounds of their scores. Texts are
   then scored exactly in descending order of the bound, until the bound is
   under the item's k-th best exact score of the task so far;
4. every task hands on its k best for each item, and their best are the result.

No text is shuffled, and a word, a source or a group of copies of any frequency
costs no task more than its own rows.

NULL texts and those without terms count for nothing. Scores of 0 are left out;
equal scores stand by ascending id, a NULL id after all others. Repeated rows
of either table stand each on its own; a repeated ``item_id`` has its ranks once
for each row. Very long texts and items are read whole; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.llm.memory import releasing
from quadrat.session import cut, scratch

K, WIDTH = 10, 4096
ITEMS, TERMS = 1024, 262_144  # of one block, about
BITMAPS = 128  # of 32,768 bits each
_DOCS, _CACHE, _FLUSH = 256, 200_000, 200_000
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


def _slot(term: bytes) -> int:
    return zlib.crc32(term) % (BITMAPS * 32_768)


class Asked(dict):
    """Whether the bitmap has a term, remembered for a bounded number of terms."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= _CACHE:
            self.clear()
        at = _slot(term)
        found = self[term] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return found


def _bytes(df: DataFrame, text_col: str):
    return F.col(text_col).cast("string").cast("binary").alias("text")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, item, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = sorted(Counter(terms_of(text)).items())
            for at in range(0, len(found), 10_000):
                terms, times = zip(*found[at : at + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * len(terms), pa.int64()), pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64()), pa.array(map(_slot, terms), pa.int64())],
                    names=["uid", "item_id", "term", "times", "slot"],
                )


def _bitmap(terms: DataFrame) -> bytes:
    """All slots of item terms as one bitmap of fixed size."""
    parts = terms.groupBy(F.expr("slot div 32768").cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % 32_768).alias("bits"))
    bits = bytearray(BITMAPS * 4096)
    for r in parts.collect():  # at most BITMAPS rows of 4 KiB
        bits[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    return bytes(bits)


def _count(bits: bytes):
    """``(term, df, docs, tokens)``: partial counts; N and L stand at the NULL term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, df, docs, tokens = Asked(bits), Counter(), 0, 0

        def out() -> pa.RecordBatch:
            terms = [None, *df]
            zeros = [0] * len(df)
            return pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.binary()), pa.array([0, *df.values()], pa.int64()), pa.array([docs, *zeros], pa.int64()), pa.array([tokens, *zeros], pa.int64())],
                names=["term", "df", "docs", "tokens"],
            )

        for batch in batches:
            for text in batch.column(0):
                found = terms_of(text.as_py())
                docs, tokens = docs + bool(found), tokens + len(found)
                df.update(filter(asked.__getitem__, set(found)))
                if len(df) >= _FLUSH:
                    yield out()
                    df.clear()
                    docs = tokens = 0
        yield out()

    return run


class Block:
    """Items of one block: distinct terms with weights and coordinates, and each item's lookups."""

    def __init__(self, items: list[tuple[int, int, list[tuple[bytes, int, int]]]], width: int):
        weights = {t: w for _, _, terms in items for t, _, w in terms}
        self.term = {t: i for i, t in enumerate(sorted(weights))}
        self.weight = np.array([weights[t] for t in self.term], np.int64)
        hashed = np.array([zlib.crc32(t, 0x9E3779B9) % width for t in self.term], np.int64)
        used, self.coordinate = np.unique(hashed, return_inverse=True)  # coordinates that no item asks for are never looked up
        self.width = len(used)
        self.items = [(uid, item_id) for uid, item_id, _ in items]
        self.times = [{self.term[t]: c for t, c, _ in terms} for _, _, terms in items]
        looked = [(self.coordinate[list(c)], np.array(list(c.values()), np.int64)) for c in self.times]
        self.at, self.by = (np.concatenate(x) for x in zip(*looked))
        self.starts = np.cumsum([0, *(len(a) for a, _ in looked)])[:-1]
        self.step = max(1, 4_000_000 // max(1, len(self.at)))  # texts that are looked up together

    def impacts(self, text: bytes | None, n_docs: int, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's asked terms, and their impacts."""
        words = terms_of(text)
        get = self.term.get
        found = [(i, c) for t, c in Counter(words).items() if (i := get(t)) is not None]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, tf = np.array(found, np.int64).T
        m = 25 + (75 * len(words) * n_docs) // n_tokens
        return at, self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

    def bounds(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Upper bounds (text, item) of scores: impacts fold into coordinatewise maxima, items look theirs up."""
        sketch = np.zeros((len(texts), self.width), np.int64)
        for row, (at, impact) in zip(sketch, texts):
            order = np.argsort(impact)
            row[self.coordinate[at[order]]] = impact[order]  # of repeated places the last, largest stays
        return np.add.reduceat(sketch[:, self.at] * self.by, self.starts, axis=1)


def _rank(block: Block, n_docs: int, n_tokens: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in block.items]  # (score, -id), the worst first
        least = np.ones(len(heaps), np.int64)
        for batch in batches:
            for start in range(0, len(batch), step := min(_DOCS, block.step)):
                part = batch.slice(start, step)
                ids = [-(x if x is not None else 1 << 63) for x in part.column(0).to_pylist()]
                texts = [block.impacts(t.as_py(), n_docs, n_tokens) for t in part.column(1)]
                bound = block.bounds(texts)
                by_term: dict[int, dict[int, int]] = {}
                for q in np.flatnonzero((bound >= least).any(axis=0)).tolist():
                    rows = np.flatnonzero(bound[:, q] >= least[q])
                    heap, times = heaps[q], block.times[q]
                    for d in rows[np.argsort(-bound[rows, q], kind="stable")].tolist():
                        if len(heap) == k and bound[d, q] < heap[0][0]:
                            break
                        if (own := by_term.get(d)) is None:
                            own = by_term[d] = dict(zip(texts[d][0].tolist(), texts[d][1].tolist()))
                        score = sum(c * own[t] for t, c in times.items() if t in own)
                        if score <= 0:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, (score, ids[d]))
                        elif (score, ids[d]) > heap[0]:
                            heapq.heapreplace(heap, (score, ids[d]))
                    if len(heap) == k:
                        least[q] = heap[0][0]
        rows = [(*block.items[q], None if i == -(1 << 63) else -i, s) for q, heap in enumerate(heaps) for s, i in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["uid", "item_id", "doc_id", "score"])

    return run


def counted(spark: SparkSession, docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """``(term, df, docs, tokens)`` of the terms that items may have; the NULL term has N and L."""
    found = docs.select(_bytes(docs, text_col)).mapInArrow(releasing(_count(_bitmap(terms))), "term binary, df bigint, docs bigint, tokens bigint")
    return cut(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "terms")


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = K, width: int = WIDTH, items_per_block: int = ITEMS, terms_per_block: int = TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item its ``k`` best texts with a score above 0."""
    spark = docs.sparkSession
    out = "uid bigint, item_id bigint, doc_id bigint, score bigint"
    named = items.select(F.col(item_col).cast("bigint").alias("item_id"), _bytes(items, item_text_col))
    numbered = cut(named.select(F.monotonically_increasing_id().alias("uid"), "item_id", "text"), "items")
    terms = cut(numbered.mapInArrow(_item_terms, "uid bigint, item_id bigint, term binary, times bigint, slot bigint"), "item-terms")
    stats = counted(spark, docs, terms, text_col)
    n_docs, n_tokens = stats.where("term is null").select("docs", "tokens").first() or (0, 0)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = terms.join(stats.where("term is not null").select("term", "df"), "term").select("uid", "item_id", F.struct("term", "times", weight.alias("w")).alias("t"))
    asked = weighed.groupBy("uid", "item_id").agg(F.collect_list("t").alias("terms"))
    n, m = terms.agg(F.countDistinct("uid"), F.count(F.lit(1))).first()
    n_blocks = max(1, -(-n // items_per_block), -(-m // terms_per_block))
    blocks = cut(asked.repartition(n_blocks).withColumn("block", F.spark_partition_id()), "item-blocks")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _bytes(docs, text_col))
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    path = scratch(spark, "ranked")
    spark.createDataFrame([], out + ", rank int").write.parquet(path)
    for b in range(n_blocks):  # one pass over the texts for each block of items
        rows = blocks.where(F.col("block") == b).select("uid", "item_id", "terms").collect()  # bounded: the items of one block
        if rows:
            block = Block([(r.uid, r.item_id, [tuple(t) for t in r.terms]) for r in rows], width)
            found = texts.mapInArrow(releasing(_rank(block, n_docs, n_tokens, k)), out)
            found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).write.mode("append").parquet(path)
    return spark.read.schema(out + ", rank int").parquet(path).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
      FROM documents
    ), s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens FROM d WHERE len(t) > 0),
    f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
    b AS (
      SELECT row_number() OVER () AS uid, item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
      FROM benchmark
    ), q AS (SELECT uid, item_id, term, count(*) AS times FROM (SELECT uid, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
    m AS (SELECT rid, doc_id, 25 + (75 * len(t) * n_docs) // n_tokens AS m FROM d, s WHERE len(t) > 0),
    x AS (
      SELECT uid, item_id, rid, doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY ALL
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
