"""Quality classifier: random-indexing vectors, two-layer network, calibrated.

A token contributes two terms: its lower-cased letters (a word) and its shape
(runs of upper case, lower case, digits, and punctuation marks), plus a mark
if it repeats the token before it. Every term owns a sparse ternary index
vector derived from its hash. A word's vector is random indexing proper: the
sum of the index vectors of the terms around it in the training sample, added
to its own. A document is the mean of its words' vectors beside the mean of
its shapes' vectors; a two-layer numpy network scores that, and a temperature
fitted on a held-back part of the sample calibrates the probability.

Scores see the text only. A NULL or empty text is scored like any other (its
vector is zero); without labelled rows of both classes every score is 0.5.
Repeated rows get equal scores; extra columns are ignored. An empty table gives
an empty result. A text of any length is read whole, token by token.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from quadrat.llm import learn

DIM, ROWS, HIDDEN = 64, 1 << 14, 32
LIMIT = 5_000  # training rows of each class, at most
CUTOFF = 0.7
REJECT = 0.5
_CACHE = 200_000
_RUN = re.compile(r"(.)\1+", re.S)


def _shape(token: str) -> str:
    """Runs of kinds of the whole token; of a token of many runs, which kinds it has and about how many runs."""
    runs = _RUN.sub(r"\1", "".join("U" if ch.isupper() else "l" if ch.isalpha() else "d" if ch.isdigit() else ch for ch in token))
    return runs if len(runs) <= 12 else "".join(sorted(set(runs))) + str(len(runs).bit_length())


def _row(kind: bytes, term: str) -> int:
    return 1 + zlib.crc32(term.encode(), zlib.crc32(kind)) % (ROWS - 1)


_LOWER, _TITLE = _row(b"s", "l"), _row(b"s", "Ul")


class Terms(dict):
    """token -> word row * ROWS + shape row, for a bounded number of tokens; row 0 stands for no word."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        word = token.lower()
        if token.isalpha():
            shape = _LOWER if token == word else _TITLE if token[1:] == word[1:] else _row(b"s", _shape(token))
        else:
            shape = _row(b"s", _shape(token))
            word = "".join(filter(str.isalpha, word))
        out = (_row(b"w", word) if word else 0) * ROWS + shape
        if len(token) <= 64:
            self[token] = out
        return out


def index_vectors() -> np.ndarray:
    """Ternary index vector of every row: eight of its DIM entries are +1 or -1."""
    rng = np.random.default_rng(20_077)
    out = np.zeros((ROWS, DIM), np.float32)
    at = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :8]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (ROWS, 8)), axis=1)
    return out


def coded(text: str | None, terms: Terms) -> np.ndarray:
    """One number for each token of a whole text."""
    tokens = text.split() if text else ()
    return np.fromiter(map(terms.__getitem__, tokens), np.int32, len(tokens))


def rows_of(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word rows, shape rows) of a coded text; the shape of a repeated token is row 0."""
    words, shapes = both // ROWS, both & (ROWS - 1)
    if len(both) > 1:
        shapes[1:][both[1:] == both[:-1]] = 0
    return words, shapes


def pooled(words: np.ndarray, shapes: np.ndarray, table: np.ndarray, index: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(2 * DIM, np.float32)
    total = np.concatenate((table[words].sum(axis=0), index[shapes].sum(axis=0)))
    return total / np.float32(len(words))


def context_table(docs: list[tuple[np.ndarray, np.ndarray]], index: np.ndarray) -> np.ndarray:
    """Word vectors by random indexing over a window of one token to either side."""
    table = np.zeros_like(index)
    for words, shapes in docs:
        if len(words) > 1:
            near = index[words] + index[shapes]
            np.add.at(table, words[1:], near[:-1])
            np.add.at(table, words[:-1], near[1:])
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(norm, 1e-6) * np.sqrt(8) + index).astype(np.float32)


def scaled(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised, and held within five deviations, so a term unseen in training cannot outweigh the rest."""
    return np.clip((x - mean) / sd, -5, 5)


def _logits(p: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ p["a"] + p["b"]) @ p["c"] + p["d"]


def fit(feats: list[bytes], y: np.ndarray, epochs: int = 40) -> dict | None:
    """Train on coded texts (32-bit numbers)."""
    if len(set(y.tolist())) < 2:
        return None
    index = index_vectors()
    rows = [rows_of(np.frombuffer(f, np.int32)) for f in feats]
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2:
        held[:] = False
    table = context_table([r for r, h in zip(rows, held) if not h], index)
    x = np.array([pooled(*r, table, index) for r in rows])
    mean, sd = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    x = scaled(x, mean, sd)
    rng = np.random.default_rng(4)
    p = {"a": rng.normal(0, 0.1, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.1, HIDDEN), "d": np.zeros(1)}
    tx, ty = x[~held], y[~held].astype(float)
    weight = np.where(ty == 1, 0.5 / max(ty.mean(), 1e-9), 0.5 / max(1 - ty.mean(), 1e-9))

    def grad(p, at):
        h = np.tanh(tx[at] @ p["a"] + p["b"])
        g = weight[at] * (learn.sigmoid(h @ p["c"] + p["d"]) - ty[at]) / len(at)
        back = g[:, None] * p["c"] * (1 - h * h)
        return {"a": tx[at].T @ back + 1e-4 * p["a"], "b": back.sum(axis=0), "c": h.T @ g + 1e-4 * p["c"], "d": np.array([g.sum()])}

    steps = learn.batches(len(ty), 128, epochs, rng)
    learn.adam(p, grad, steps)
    logit, target = (_logits(p, x[held]), y[held]) if held.any() else (_logits(p, tx), ty)
    scales = np.exp(np.linspace(-1.5, 3, 91))
    loss = [np.mean(np.logaddexp(0, logit / t) - target * logit / t) for t in scales]
    model = {k: v.astype(np.float32) for k, v in p.items()}
    return model | {"table": table, "mean": mean, "sd": sd, "temperature": np.array(scales[int(np.argmin(loss))])}


def scorer(model: dict):
    """A function from a list of texts to probabilities."""
    index, terms = index_vectors(), Terms()

    def run(texts: list[str | None]) -> np.ndarray:
        x = np.array([pooled(*rows_of(coded(t, terms)), model["table"], index) for t in texts]).reshape(-1, 2 * DIM)
        return learn.sigmoid(_logits(model, scaled(x, model["mean"], model["sd"])) / model["temperature"])

    return run


def with_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    limit: int = LIMIT, score_col: str = "score",
) -> DataFrame:
    """``docs`` row by row, all columns as they are, and ``score_col``: a row's score goes with the row, not with its id."""
    terms = Terms()
    encode = lambda text: coded(text, terms).tobytes()
    sample = learn.labelled_sample(docs, labels, label_col, id_col, text_col, lambda c: learn.fold(c, 4) != 2, limit, encode)
    raw = learn.train(sample, fit)

    def judge():
        score = scorer(learn.unpack(raw)) if raw else lambda texts: np.full(len(texts), 0.5)
        return lambda texts: [pa.array(score(texts), pa.float64())]

    return learn.beside(docs, text_col, [StructField(score_col, DoubleType())], judge)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    limit: int = LIMIT, cutoff: float = CUTOFF, reject: float = REJECT,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted, rejected)`` for every row of ``docs``.

    Learns from at most ``limit`` labelled rows of each class whose
    crc32(id) mod 4 is not 2; every row's whole text is scored.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_scores(plain, labels.withColumnRenamed(id_col, "doc_id"), label_col=label_col, limit=limit).drop("text")
    return scored.select(
        "doc_id",
        (learn.fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= cutoff, 1).otherwise(0).alias("predicted"),
        (F.col("score") < reject).alias("rejected"),
    )


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
