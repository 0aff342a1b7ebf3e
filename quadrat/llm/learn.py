"""What the trained operators share: bounded labelled samples and shipped models.

A model is trained in one task on a sample of at most ``limit`` rows of each
class, drawn by hash order of the id, so it is the same on every run. Only the
label table is ranked; the sampled ids are few, so the texts are not shuffled:
they become features (arrays of numbers) in the tasks that read them, and only
features meet in the training task.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quadrat.llm.memory import releasing


def fold(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``; NULL ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(0).cast("bigint"))


def encoded(rows: DataFrame, encode: Callable[[int, str, str | None, object], bytes]) -> DataFrame:
    """``(_id, text, y)`` to ``(_id, feat, y)``, one row for each (_id, y): whole texts become compact features where they are read."""
    kind = rows.schema["y"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, y = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encode(*r) for r in zip(ids, y, texts)], pa.binary()), batch.column(2)], names=["_id", "feat", "y"]
            )

    found = rows.select("_id", "text", "y").mapInArrow(releasing(run), f"_id bigint, feat binary, y {kind}")
    return found.groupBy("_id", "y").agg(F.min("feat").alias("feat")).select("_id", "feat", "y")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, allowed, limit: int, encode: Callable[[str | None], bytes]
) -> DataFrame:
    """``(_id, feat, y)``: features of at most ``limit`` texts of label 0 and of label 1 among ids that ``allowed`` admits.

    Ids labelled both ways teach nothing. The ids are broadcast: at most
    2 x ``limit`` of them, whatever the size of the tables.
    """
    one = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("bigint").alias("_id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("_y"))
        .where("y = _y").drop("_y")
    )
    one = one.where(allowed("_id"))
    picked = [one.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(limit) for y in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("text"))
    return encoded(texts.join(few, "_id"), lambda _id, y, text: encode(text))


def train(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], dict[str, np.ndarray] | None]) -> bytes | None:
    """Run ``fit`` over the whole (bounded) sample ``(_id, feat, y)`` in one task of an executor; its arrays come back packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], str(r[2])))
        model = fit([r[1] for r in rows], np.array([r[2] for r in rows]))
        if model is not None:
            packed = io.BytesIO()
            np.savez(packed, **model)
            yield pa.RecordBatch.from_arrays([pa.array([packed.getvalue()], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(releasing(run), "model binary").head(1)
    return bytes(got[0]["model"]) if got else None


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def beside(docs: DataFrame, text_col: str, fields: list[StructField], judge: Callable[[], Callable[[list], list[pa.Array]]], size: int = 1_000) -> DataFrame:
    """``docs`` row by row, columns as they are whatever their names, and the ``fields`` that a task's judge finds for texts.

    Columns travel by number: names with dots or in two cases would be looked up as paths or as one.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = judge()
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.slice(start, size)
                more = found(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[f"c{i}" for i in range(len(part.columns) + len(more))])

    kinds = [*docs.schema.fields, *fields]
    numbered = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kinds)])
    plain = docs.toDF(*numbered.names[: len(docs.columns)])
    return plain.mapInArrow(releasing(run), numbered).toDF(*(f.name for f in kinds))


def batches(n: int, size: int, epochs: int, rng, least: int = 1_000) -> Iterator[np.ndarray]:
    """Shuffled row numbers in parts of about ``size``: ``epochs`` passes, or ``least`` parts where rows are few."""
    parts = max(1, n // size)
    for _ in range(max(epochs, -(-least // parts))):
        yield from np.array_split(rng.permutation(n), parts)


def adam(params: dict[str, np.ndarray], grad: Callable, steps: Iterator, rate: float = 3e-3) -> None:
    """Adam on a dictionary of arrays, in place."""
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v2 = {k: np.zeros_like(v) for k, v in params.items()}
    for t, batch in enumerate(steps, 1):
        for k, g in grad(params, batch).items():
            m[k] += 0.1 * (g - m[k])
            v2[k] += 0.001 * (g * g - v2[k])
            params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
