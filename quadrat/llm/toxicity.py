"""Toxicity: a factorization machine over hashed terms.

A text's terms are its lower-cased words and their first four and five
letters, hashed to 2**18 buckets, each counted once. Every bucket that at least
``MIN_DOCS`` sampled texts have, whatever their labels, has a linear weight and
``RANK`` factors, all trained together by AdaGrad, so a pair such as an insult
with a mention of a group has a weight of its own, even if neither tells
anything alone. Soft thresholds (``L1`` on a weight, ``GROUP_L1`` on a bucket's
factors as a whole) set what does not help to zero while training, so the many
neutral terms of a long text add nothing.

Scores see the text only. A NULL or empty text has no terms and gets the
score of the bias; without labelled rows of both classes every score is 0.5.
Repeated rows get equal scores; extra columns are ignored; an empty table gives
an empty result. A text of any length is read whole; it has at most 2**18 terms.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import learn
from quadrat.llm.memory import releasing

BUCKETS, RANK, MIN_DOCS = 1 << 18, 4, 5
RATE, L1, GROUP_L1 = 0.1, 3e-3, 1e-2
LIMIT = 8_000  # training rows of each class, at most
CUTOFF = 0.7
_CACHE = 200_000
_WORD = re.compile(r"\w+")


def buckets(word: str) -> tuple[int, ...]:
    raw = [b"w" + word.encode()]
    for k in (4, 5):
        if len(word) >= k:
            raw.append(b"%d" % k + word[:k].encode())
    return tuple(zlib.crc32(r) % BUCKETS for r in raw)


class Features(dict):
    """word -> the features it has, for a bounded number of words."""

    def __init__(self, column: dict[int, int] | None):
        super().__init__()
        self.column = column

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        found = buckets(word)
        if self.column is not None:
            found = tuple(self.column[b] for b in found if b in self.column)
        if len(word) <= 64:
            self[word] = found
        return found


def features_of(text: str | None, known: Features) -> np.ndarray:
    """Sorted distinct features of a whole text."""
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.array(sorted({b for found in map(known.__getitem__, words) for b in found}), np.int64)


def fit(feats: list[bytes], y: np.ndarray, epochs: int = 12, batch: int = 128) -> dict | None:
    """Train on the distinct terms of texts (sorted 32-bit numbers); terms of zero weight and factors are left out of the model."""
    if len(set(y.tolist())) < 2:
        return None
    rows = [np.frombuffer(f, np.int32) for f in feats]
    count = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    chosen = np.flatnonzero(count >= MIN_DOCS)
    column = np.full(BUCKETS, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    rows = [(c := column[r])[c >= 0] for r in rows]
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    weight = np.where(y == 1, 0.5 * len(y) / n1, 0.5 * len(y) / n0)
    rng = np.random.default_rng(8)
    w0, w, v = 0.0, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), RANK))
    q0, qw, qv = 1e-3, np.full(len(chosen), 1e-3), np.full(len(chosen), 1e-3)
    for at in learn.batches(len(y), batch, epochs, rng):
        row = np.repeat(np.arange(len(at)), [len(rows[i]) for i in at])
        term, spot = np.unique(np.concatenate([rows[i] for i in at]), return_inverse=True)
        vt = v[term]
        x = vt[spot]
        s = np.stack([np.bincount(row, x[:, k], len(at)) for k in range(RANK)], axis=1)
        logit = w0 + np.bincount(row, w[term][spot], len(at)) + 0.5 * ((s * s).sum(axis=1) - np.bincount(row, (x * x).sum(axis=1), len(at)))
        g = weight[at] * (learn.sigmoid(logit) - y[at]) / len(at)
        each = g[row]
        gw = np.bincount(spot, each, len(term))
        gv = np.stack([np.bincount(spot, each * s[row, k], len(term)) for k in range(RANK)], axis=1) - gw[:, None] * vt
        q0 += g.sum() ** 2
        w0 -= RATE * g.sum() / np.sqrt(q0)
        qw[term] += gw * gw
        step = RATE / np.sqrt(qw[term])
        moved = w[term] - step * gw
        w[term] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
        qv[term] += (gv * gv).sum(axis=1) / RANK
        step = (RATE / np.sqrt(qv[term]))[:, None]
        moved = vt - step * gv
        v[term] = moved * np.maximum(0, 1 - step * GROUP_L1 / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12))
    some = (w != 0) | (v != 0).any(axis=1)
    return {"w0": np.array([w0], np.float32), "w": w[some].astype(np.float32), "v": v[some].astype(np.float32), "chosen": chosen[some]}


def scorer(model: dict):
    """A function from a list of texts to probabilities."""
    known = Features({int(b): i for i, b in enumerate(model["chosen"])})
    w0, w, v = (model[k].astype(np.float64) for k in ("w0", "w", "v"))
    square = (v * v).sum(axis=1)

    def one(text):
        f = features_of(text, known)
        s = v[f].sum(axis=0)
        return w0[0] + w[f].sum() + 0.5 * (s @ s - square[f].sum())

    return lambda texts: learn.sigmoid(np.array([one(t) for t in texts], np.float64))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    limit: int = LIMIT, cutoff: float = CUTOFF,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Learns from at most ``limit`` labelled rows of each class whose
    crc32(id) mod 3 is not 1; every row's whole text is scored.
    """
    terms = Features(None)
    encode = lambda text: features_of(text, terms).astype(np.int32).tobytes()
    sample = learn.labelled_sample(docs, labels, label_col, id_col, text_col, lambda c: learn.fold(c, 3) != 1, limit, encode)
    raw = learn.train(sample, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(learn.unpack(raw)) if raw else lambda texts: np.full(len(texts), 0.5)
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.slice(at, 1_000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(part.column(1).to_pylist()))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(releasing(run), f"{id_col} {kind}, score double")
    return scored.select(
        F.col(id_col).alias("doc_id"),
        (learn.fold(id_col, 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= cutoff, 1).otherwise(0).alias("predicted"),
    )


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
