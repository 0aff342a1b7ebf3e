"""The pipeline's stages against the operators' own decisions, on rows with doubles, nulls and clashing columns."""

import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "ing", "er", "and", "ou"]) for _ in range(3))
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        t = " ".join(word() for _ in range(60))
        t = t.upper().replace(" ", "!! ") if bad else t
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(500 + i, rows[1][1], "en", "s", 5) for i in range(5)]
    edited = rows[2][1].split()
    edited[0] = "changed"
    rows += [(600, " ".join(edited), "en", "s", 5), (601, None, "en", "s", None), (602, "", None, None, 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
    assert not any(i < 160 and i % 4 == 0 for i in seen[1]) and all(i in seen[1] for i in range(160) if i % 4)
    assert 601 not in seen[2] and 602 not in seen[2]
    assert 1 in seen[3] and 2 in seen[3] and not seen[3] & {500, 501, 502, 503, 504, 600}
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == seen[3]


def test_null_and_repeated_ids(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept, rejected, other = text[7], text[8], text[9]
    rng = random.Random(3)
    fresh = " ".join("".join(rng.choice(["th", "ing", "er", "and", "ou"]) for _ in range(3)) for _ in range(60))
    rows = [(None, fresh, "en", "s", 1), (None, fresh, "en", "s", 1)]  # NULL ids alone: one stays
    rows += [(None, other, "en", "s", 1), (7, kept, "en", "s0", 2), (7, kept, "en", "s1", len(kept))]  # copies of 9 and 7
    rows += [(7, rejected, "en", "s", 1), (7, text[10], "en", "s", 1)]  # other texts under a kept id
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        seen.append(sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    for at in seen[:2]:
        assert at.count((-1, fresh)) == 2 and at.count((-1, other)) == 1 and at.count((7, kept)) == 3
        assert (7, rejected) not in at and (7, text[10]) in at
    assert seen[2].count((-1, fresh)) == 1 and (-1, other) not in seen[2] and (9, other) in seen[2]
    assert [x for i, x in seen[2] if i == 7] == sorted([kept, text[10]]) and (10, text[10]) not in seen[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == [i for i, _ in seen[2]]


def test_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts_and_clashing_columns(spark, sf, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["th", "ing", "er", "and", "ou"]) for _ in range(3))
    book = " ".join(word() for _ in range(150_000))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(900, book, "en", "s", len(book)), (901, book, "en", "s", len(book)), (902, "x" * 2_000_000, "en", "s", 1)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema)).selectExpr("*", "1 AS score", "'c' AS margin", "2 AS component_id", "'p' AS piece")
    more.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), more.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert {r.doc_id for r in docs.where("doc_id in (900, 901)").collect()} == {900}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 900").orderBy("piece").collect()
    assert len(pieces) > 50 and all(r.length == 4096 for r in pieces[:-1]) and [r.start for r in pieces] == [4096 * i for i in range(len(pieces))]


@pytest.mark.parametrize("names", [["_score", "_margin", "_row", "a.b", "a`b", "component_id", "node"], ["_SCORE", "__lang_pred", "_Row", "__row", "_row_at", "n_shingles", "C0"]])
def test_columns_of_any_name_are_kept(spark, sf, names):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = docs.columns
    docs = docs.select("*", *((docs.doc_id + 1000 * (i + 1)).alias(f"m{i}") for i in range(len(names)))).toDF(*plain, *names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = out.toDF(*plain, *(f"m{i}" for i in range(len(names)))).drop("text").collect()
        assert len(got) > 50 and all(r[f"m{i}"] == r.doc_id + 1000 * (i + 1) for r in got for i in range(len(names)))
