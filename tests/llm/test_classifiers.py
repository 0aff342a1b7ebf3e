"""Trained operators: held-out accuracy on made rows, folds, and hostile rows."""

import random
import zlib

import numpy as np
import pytest

from quadrat.llm import language, learn, quality, toxicity

DOCS = "doc_id bigint, text string, lang string, score string, rejected int"


def words(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


STEMS = {"aa": ["thi", "ing", "er", "wou"], "bb": ["ñado", "ción", "que", "los"], "cc": ["ung", "ß", "ver", "schaft"]}


def test_languages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = list(STEMS)[i % 3]
        rows.append((i, words(rng, STEMS[lang], rng.randint(6, 60)).upper() if i % 7 == 0 else words(rng, STEMS[lang], 40), lang, "c", 0))
    rows += [(1000, None, "aa", "c", 0), (1001, "", "aa", "c", 0), (1002, "12 34 !!", "aa", "c", 0), (1003, words(rng, STEMS["bb"], 4000), None, "c", 0), (0, words(rng, STEMS["cc"], 9), "cc", "c", 0), (None, "thiing", None, "c", 0)]
    got = language.languages(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id > 0}
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (1000, 1001, 1002)) and by[1003].lang_pred == "bb"
    truth = {r[0]: r[2] for r in rows[:240]}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id > 0]
    assert len(held) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_margin_of_a_clean_text_does_not_fall_with_its_length():
    rng = random.Random(4)
    names = [n for n in STEMS for _ in range(200)]
    one = language.classifier(language.fit([language.snippets_of(words(rng, STEMS[n], 40)) for i, n in enumerate(names)], np.array(names)))
    for name in STEMS:
        page, book = words(rng, STEMS[name], 1_000), words(rng, STEMS[name], 500_000)
        assert len(book) > 3_000_000 and one(page)[0] == one(book)[0] == name
        assert one(book)[2] > max(language.MIN_MARGIN, one(page)[2] / 2)
    assert len(language.sizes([], b"")) == 0 and one("thiing " * 100_000)[0] == "aa"


def test_no_languages_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None, "c", 0)], DOCS)
    r = language.languages(df).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.languages(df.limit(0)).count() == 0


def labelled(spark, good, bad, n=300):
    rng = random.Random(3)
    rows = [(i, (good if i % 3 else bad)(rng), "x", "c", 0) for i in range(n)]
    labels = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(n)] + [(5, 0, 1), (None, 1, 0), (7, None, None)]
    rows += [(2000, None, "x", "c", 0), (2001, "", "x", "c", 0), (2002, " ".join(good(rng) for _ in range(300)), "x", "c", 0), (1, good(rng), "x", "c", 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality(spark):
    good = lambda rng: words(rng, STEMS["aa"], 60).capitalize() + "."
    bad = lambda rng: rng.choice([words(rng, STEMS["aa"], 40).upper().replace(" ", "!! "), " ".join([words(rng, STEMS["aa"], 1)] * 60), words(rng, STEMS["aa"], 50).replace(" ", " | ")])
    docs, labels = labelled(spark, good, bad)
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and 1 < r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert not next(r for r in got if r.doc_id == 2002).rejected
    none = quality.quality_scores(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in none} == {0.5} and not any(r.rejected for r in none)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    good = lambda rng: words(rng, STEMS["aa"], 60)
    bad = lambda rng: words(rng, STEMS["aa"], 30) + f" scum{rng.choice('abcdefgh')}{rng.randint(0, 99)} " + words(rng, STEMS["aa"], 30)
    docs, labels = labelled(spark, good, bad)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and 1 < r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95


def terms_of(text):
    return toxicity.features_of(text, toxicity.Features(None)).astype(np.int32).tobytes()


def test_terms_that_tell_nothing_alone():
    """Toxic if exactly one of two terms is there: each term is as common among the toxic as among the others."""

    def made(n, seed):
        rng = random.Random(seed)
        some = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(n)]
        return [" ".join(rng.sample(["fine", "calm", "blue", "tall", "wide", "stone", "river"], 4) + ["insult"] * a + ["group"] * b) for a, b in some], np.array([int(a != b) for a, b in some])

    texts, y = made(4_000, 1)
    score = toxicity.scorer(toxicity.fit([terms_of(t) for t in texts], y))
    texts, y = made(1_000, 2)
    got = score(texts)
    assert np.mean(np.sort(got[y == 1])[:, None] > np.sort(got[y == 0])[None, :]) > 0.95


def test_toxicity_score_equals_the_sum_over_pairs():
    texts = [f"insult{i % 3} group{i % 2} word{i % 7} calm" if i % 2 else f"word{i % 7} blue group{i % 3}" for i in range(300)]
    m = toxicity.fit([terms_of(t) for t in texts], np.array([i % 2 for i in range(300)]))
    for text in ["insult1 group1 Calm", "word3", "", None, "unseen words only", texts[0] * 50]:
        of = {int(b): i for i, b in enumerate(m["chosen"])}
        f = sorted({of[b] for w in (text or "").lower().split() for b in toxicity.buckets(w) if b in of})
        z = float(m["w0"][0]) + sum(float(m["w"][i]) for i in f) + sum(float(np.dot(m["v"][i].astype(float), m["v"][j].astype(float))) for i in f for j in f if i < j)
        assert toxicity.scorer(m)([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_quality_score_equals_a_plain_computation():
    rng = random.Random(2)
    good, bad = [words(rng, STEMS["aa"], 30).capitalize() for _ in range(60)], [words(rng, STEMS["aa"], 20).upper() + " " + "!a" * 30 for _ in range(60)]
    m = quality.fit([quality.coded(t, quality.Terms()).tobytes() for t in good + bad], np.array([1] * 60 + [0] * 60), epochs=5)
    index = quality.index_vectors()
    for text in [good[0], bad[0], "", None, "x", "same same same", "Ab1!" * 500, good[1] * 200]:
        tokens, total = (text or "").split(), np.zeros(2 * quality.DIM)
        for k, t in enumerate(tokens):
            word, shape = divmod(quality.Terms()[t], quality.ROWS)
            total += np.concatenate((m["table"][word], index[0 if k and quality.Terms()[tokens[k - 1]] == quality.Terms()[t] else shape]))
        x = np.clip((total / max(1, len(tokens)) - m["mean"]) / m["sd"], -5, 5)
        z = (np.tanh(x @ m["a"] + m["b"]) @ m["c"] + m["d"][0]) / m["temperature"]
        assert quality.scorer(m)([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert quality._shape("Ab1" * 40) != quality._shape("Ab" * 60) and quality._shape("a" * 70 + "B") == "lU"


def test_language_equals_the_smallest_of_plain_compressions():
    import zstandard

    rng = random.Random(5)
    m = language.fit([language.snippets_of(words(rng, STEMS[n], 80)) for n in STEMS for i in range(30)], np.array([n for n in STEMS for _ in range(30)]))
    raw, ends = m["dicts"].tobytes(), m["ends"].tolist()
    for text in [words(rng, STEMS["bb"], 9), words(rng, STEMS["cc"], 5_000), "thi ñado", "", "12", None]:
        plain = language.letters(text)
        n = max(1, -(-len(plain) // language.PIECE))
        size = []
        for a, b in zip([0, *ends], ends):
            held = zstandard.ZstdCompressionDict(raw[a:b], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=language.LEVEL)
            coder = zstandard.ZstdCompressor(dict_data=held, level=language.LEVEL, write_content_size=False, write_dict_id=False)
            size.append(sum(len(coder.compress(plain[len(plain) * k // n : len(plain) * (k + 1) // n])) for k in range(n)))
        want = sorted(STEMS)[int(np.argmin(size))] if plain else "und"
        assert language.classifier(m)(text)[0] == want


def test_seventy_languages_are_all_learned(spark):
    rng = random.Random(6)
    stems = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñöß") for _ in range(4)) for _ in range(8)] for k in range(70)}
    rows = [(i, words(rng, stems[f"l{i % 70:02}"], 40), f"l{i % 70:02}", "c", 0) for i in range(840)]
    got = language.languages(spark.createDataFrame(rows, DOCS)).where("held_out").collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 70:02}" for r in got]) > 0.97 and len({r.lang_pred for r in got}) > 55


def test_snippets_are_all_letters_of_a_text():
    text = " ".join("".join(random.Random(i).sample("abcdefghijkl", 6)) for i in range(20_000))
    got = language.snippets_of(text).decode().split("\n")
    assert "".join(got) == text and max(map(len, got)) <= language.SNIPPET
    assert language.snippets_of("12 !") == language.snippets_of(None) == b"" and b"\n" not in language.snippets_of("a\nb")


def test_dictionaries_hold_whole_texts_but_for_foreign_passages():
    rng = random.Random(7)
    own = [words(rng, STEMS["bb"], 3_000) for _ in range(6)]
    foreign = words(rng, STEMS["cc"], 400)
    mixed = words(rng, STEMS["bb"], 400) + " " + foreign + " " + words(rng, STEMS["bb"], 400)
    other = [words(rng, STEMS["cc"], 3_000) for _ in range(6)]
    m = language.fit([language.snippets_of(t) for t in [*own, mixed, *other]], np.array(["bb"] * 7 + ["cc"] * 6))
    learned, end = m["dicts"].tobytes(), m["ends"].tolist()[0]
    held = b"".join(learned[:end].split(b" "))
    for t in own:
        assert language.letters(t).replace(b" ", b"") in held
    middle = language.letters(foreign).replace(b" ", b"")
    assert middle[len(middle) // 3 : -len(middle) // 3] not in held


def test_pair_of_terms_that_no_additive_model_has():
    rng = random.Random(0)
    texts, y = [], []
    for i in range(1200):
        a, b = i % 2, (i // 2) % 2
        texts.append(" ".join(rng.sample(["fine", "calm", "blue", "tall", "wide"], 3) + ["insult"] * a + ["group"] * b))
        y.append(int(a and b))
    m = toxicity.fit([terms_of(t) for t in texts], np.array(y))
    score = toxicity.scorer(m)
    assert score(["insult group calm"])[0] > 0.7 > 0.5 > max(score(["insult calm", "group calm"]))


def test_samples_are_bounded_and_ignore_conflicts(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(1, "twice")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(4, 1)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    s = learn.labelled_sample(docs, labels, "quality", "doc_id", "text", lambda c: F.lit(True), 10, str.encode)
    got = s.collect()
    assert len(got) == 20 and sum(r.y for r in got) == 10 and 4 not in {r._id for r in got}
    whole = learn.labelled_sample(docs, labels, "quality", "doc_id", "text", lambda c: F.lit(True), 1000, str.encode)
    assert whole.count() == 49


@pytest.mark.parametrize("fit", [quality.fit, toxicity.fit])
def test_one_class_gives_no_model(fit):
    assert fit([b"", b""], np.array([1, 1])) is None
