"""Language identification by compression.

One raw-content zstandard dictionary is built for each language from a bounded
sample of learned texts: at most ``PER_LANGUAGE`` texts, all letters of each. A
text belongs to the language whose dictionary makes it smallest. Texts and
samples are reduced to lower-cased letters and single blanks first, so case,
digits and marks say nothing. A long text is compressed
in equal pieces of at most ``PIECE`` bytes, each against the dictionaries alone,
and the sizes are added up: a margin says the same of a page and of a book. The
sample is cleaned: each half of a language's texts is judged by dictionaries of
the other halves, and a snippet that another language's makes smaller (a foreign
passage inside a text) is left out of the final ones.

``score`` is 1 - exp(-50 m), m the share by which the second best language is
larger; texts with m under ``MIN_MARGIN`` are marked ``rejected``. A NULL text
or one without letters is ``und`` with score 0 and rejected. Without learned
languages every text is ``und``. Ties go to the first language in name order.
Repeated rows get equal results; extra columns are ignored; an empty table gives
an empty result; a text of any length is read whole. Every language found is
learned; more than ``MAX_LANGUAGES`` values of ``lang`` are an error, since a
worker holds one dictionary for each.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from quadrat.llm import learn

LEVEL, SNIPPET, PIECE = 6, 300, 8 << 10
PER_LANGUAGE = 256  # learned texts of each language, at most, each with all its letters
MAX_LANGUAGES = 128  # more raise an error
MIN_MARGIN = 0.002
_OTHER = re.compile(r"[\W\d_]+")


def _plain(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def letters(text: str | None) -> bytes:
    return _plain(text).encode("utf-8", "replace")


def snippets_of(text: str | None) -> bytes:
    """All letters of a whole text, in equal snippets of at most ``SNIPPET``, one a line."""
    plain = _plain(text)
    n = -(-len(plain) // SNIPPET)
    return b"\n".join(plain[len(plain) * i // n : len(plain) * (i + 1) // n].encode("utf-8", "replace") for i in range(n))


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))
    return out


def sizes(coders: list, text: bytes) -> list[int]:
    """Compressed size by each coder, summed over equal pieces of at most ``PIECE`` bytes (a text's own past must not stand in for the dictionary)."""
    n = max(1, -(-len(text) // PIECE))
    pieces = [text] if n == 1 else [text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n)]
    return [sum(len(c.compress(p)) for p in pieces) for c in coders]


def fit(feats: list[bytes], lang: np.ndarray) -> dict | None:
    """Dictionary bytes for each language of the sample (lines of snippets), in name order.

    Texts of one half are judged by dictionaries of the other, so no snippet is
    found in a dictionary only because it was put there.
    """
    halves: dict[str, tuple[list[bytes], list[bytes]]] = {}
    for feat, name in zip(feats, lang.tolist()):
        if feat:
            own = halves.setdefault(name, ([], []))
            own[sum(map(len, own[0])) > sum(map(len, own[1]))].extend(s + b" " for s in feat.split(b"\n"))
    names = sorted(halves)
    if not names:
        return None
    first = [compressors([b"".join(halves[n][h] or halves[n][1 - h]) for n in names]) for h in (0, 1)]
    final = []
    for i, name in enumerate(names):
        clean = []
        for h in (0, 1):
            for s in halves[name][h]:
                g = sizes(first[1 - h], s)
                if len(g) == 1 or g[i] <= min(g[:i] + g[i + 1 :]):
                    clean.append(s)
        final.append(b"".join(clean or halves[name][0] + halves[name][1]))
    return {"names": np.array(names), "dicts": np.frombuffer(b"".join(final), np.uint8), "ends": np.cumsum([len(d) for d in final])}


def classifier(model: dict | None):
    """A function from a text to (language, score, margin)."""
    if model is None:
        return lambda text: ("und", 0.0, 0.0)
    raw, ends, names = model["dicts"].tobytes(), model["ends"].tolist(), model["names"].tolist()
    coders = compressors([raw[a:b] for a, b in zip([0, *ends], ends)])

    def one(text):
        plain = letters(text)
        if not plain:
            return "und", 0.0, 0.0
        got = sizes(coders, plain)
        best, *rest = sorted(range(len(got)), key=lambda i: (got[i], i))
        margin = (got[rest[0]] - got[best]) / got[rest[0]] if rest else 1.0
        return names[best], float(1 - np.exp(-50 * margin)), margin

    return one


def learned_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """``(_id, feat, y)``: all letters of at most ``per_language`` texts a language outside fold 0, by hash order of the id.

    Distinct ids are counted for each language (one row each, checked); a
    threshold on the id's hash lets slightly more than enough of a language's
    ids through, so however many rows a language has, few are ranked. The
    picked ids are broadcast: at most ``per_language`` x ``MAX_LANGUAGES``.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(lang_col).cast("string").alias("y"), F.col(text_col).cast("string").alias("text"))
    keys = named.where("y is not null and text is not null and _id is not null").select("_id", "y").where(learn.fold("_id", 5) != 0)
    sizes_of = keys.groupBy("y").agg(F.approx_count_distinct("_id").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes_of) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    enough = 1.3 * (per_language + 6 * math.sqrt(per_language)) + 64
    shares = spark.createDataFrame([(r.y, min(1.0, enough / max(r.n, 1)) * (1 << 30)) for r in sizes_of], "y string, share double")
    near = keys.join(F.broadcast(shares), "y").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) <= F.col("share")).select("_id", "y").distinct()
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id"))
    picked = near.withColumn("r", rank).where(F.col("r") <= per_language).drop("r")
    return learn.encoded(named.join(F.broadcast(picked), ["_id", "y"]), lambda _id, y, text: snippets_of(text))


_FOUND = ("lang_pred", StringType()), ("score", DoubleType()), ("margin", DoubleType())


def with_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, prefix: str = "",
) -> DataFrame:
    """``docs`` row by row, all columns as they are, and ``lang_pred``, ``score`` and ``margin`` (names after ``prefix``)."""
    raw = learn.train(learned_sample(docs, id_col, text_col, lang_col, per_language), fit)

    def judge():
        one = classifier(learn.unpack(raw) if raw else None)
        return lambda texts: [pa.array(g, pa.string() if n == "lang_pred" else pa.float64()) for (n, _), g in zip(_FOUND, zip(*map(one, texts)))]

    return learn.beside(docs, text_col, [StructField(prefix + n, kind) for n, kind in _FOUND], judge)


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, margin, rejected)`` for every row of ``docs``.

    Learns from rows whose crc32(id) mod 5 is not 0; predictions see the text only.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    return with_languages(plain, per_language=per_language).select(
        "doc_id",
        (learn.fold("doc_id", 5) == 0).alias("held_out"),
        "lang_pred",
        "score",
        "margin",
        (F.col("margin") < min_margin).alias("rejected"),
    )


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
