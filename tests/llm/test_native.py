"""Licence scans and chat formatting against brute force, with hostile rows."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrat.llm import chat, licenses

DOCS = "doc_id bigint, text string, license string"


def brute(text):
    """Dice of every window of a template's bigrams and more, from any word to any other, up to the largest size that can match."""
    w = re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()
    g = list(zip(w, w[1:]))
    hits = []
    for k, t in enumerate(licenses.TEMPLATES.values()):
        bag = Counter(zip(x := re.sub("[^a-z0-9]+", " ", t.lower()).split(), x[1:]))
        n, best = sum(bag.values()), None
        if not bag.keys() & set(g):
            continue
        for i in range(len(g)):
            if len(g) > 2_000 and g[i] not in bag:  # can't be the start of a best window
                continue
            left, common = Counter(bag), 0
            for j in range(i, min(len(g), i + math.floor(n * 1.5 + 1e-9))):
                if left[g[j]] > 0:
                    left[g[j]] -= 1
                    common += 1
                d = 2 * common / (j - i + 1 + n)
                if d >= licenses.THRESHOLD:
                    best = min(best or (1,), (-d, -n, k, i, j - i + 1))
        hits += [best] if best else []
    first = min(hits, default=None)
    return (len(hits), None, -1, 0) if first is None else (len(hits), list(licenses.TEMPLATES)[first[2]], *first[3:])


def test_licences_match_brute_force(spark):
    t = list(licenses.TEMPLATES.values())
    full = licenses.TEMPLATES["MIT-text"]
    words = full.split()
    texts = [
        None, "", " \n ", "word", "licensed under", "MIT", t[0], t[0].upper() + "!!", "prose first\n" + t[10] + "\nmore prose follows here", t[7].replace("version", "Version "),
        " ".join(t[8].split()[:16]) + "\n" + " ".join(t[8].split()[16:]), "the the the the the the the", t[1] + " " + t[11], "x " * 30_000 + "\n" + t[4], t[3].replace("4.0", "4 0"), "lïcence " + t[5],
        "\n".join(f"line {i} of a file" for i in range(60)) + "\n# " + "\n# ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\ncode follows " * 40,
        "copyright of somebody. Released under the MIT License. And prose goes on in the same line for a good while.",
        " ".join(words[:100]), " ".join(words[:60] + ["inserted", "words"] * 9 + words[60:]), full + " " + full, " ".join(reversed(words)), licenses.TEMPLATES["BSD-3-Clause"].replace("3.", "neither 3."),
        " ".join(w + " odd" for w in t[1].split()),
        "This Source Code Form indeed is subject to the terms of the Mozilla Public great License, v. 2.0.",
        "This Source Code Form indeed is subject to the terms of the Mozilla Public great License, v. 2.0. use of the may to to the be for the the code",
        "of the terms of the " + t[12].replace("subject", "very subject") + " of the Mozilla Public terms of the",
    ]
    rows = [(i, x, "clash") for i, x in enumerate(texts)] + [(6, t[0], None), (None, t[0], None)]
    got = licenses.license_matches(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = {i: brute(x) for i, x in enumerate(texts)}
    for r in got:
        assert (r.n_matches, r.license, r.first_word, r.n_bigrams) == want.get(r.doc_id, brute(t[0])), r.doc_id
    by = {r.doc_id: r.license for r in got}
    assert by[16] == "MIT-text" and by[17] == "MIT" and by[19] == "MIT-grant" and by[20] == "MIT-text"
    assert by[24] == by[25] == "MPL-2.0"
    assert licenses.license_matches(spark.createDataFrame([], DOCS)).count() == 0
    assert licenses.license_matches(spark.createDataFrame(rows, DOCS), templates={}).agg(F.sum("n_matches")).first()[0] == 0


def test_licence_plan_is_one_native_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", "b")], DOCS).write.parquet(str(tmp_path / "d"))
    plan = licenses.license_matches(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


TURNS = "conv_id bigint, turn bigint, role string, text string, place int"


def maximal(turns):
    """Brute force: conversations whose turn list no other one continues or repeats."""
    convs = {}
    for c, k, r, x, _ in set(turns):
        if c is not None:
            convs.setdefault(c, []).append((k is not None, k or 0, r or "", hashlib.md5((x or "").encode()).digest(), x or ""))
    lists = {c: [(v[2], v[4]) for v in sorted(vs)] for c, vs in convs.items()}
    return {
        c: l for c, l in lists.items()
        if not any(o != c and m[: len(l)] == l and (len(m) > len(l) or o < c) for o, m in lists.items())
    }


def test_snapshots_collapse(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "ok")]
    rows = [(10 + n, k, *base[k], 7) for n in range(1, 5) for k in range(n)]  # 11..14 grow
    rows += [(3, k, *base[k], 7) for k in range(4)]  # equals 14, smaller id
    rows += [(20, 0, "user", "hi", 7), (20, 1, "assistant", "other", 7)]
    rows += [(30, 0, None, None, 7), (31, None, "user", "", 7), (31, 5, "user", "z", 7), (31, 5, "user", "a", 7)]
    rows += [(3, 0, "user", "hi", 7)] * 3 + [(None, 0, "user", "hi", 7)]
    rows += [(40, k, "user", f"t{k % 9}", 7) for k in range(700)] + [(41, k, "user", f"t{k % 9}", 7) for k in range(650)]
    rows += [(50, None, "user", f"n{k}", 7) for k in range(600)] + [(51, 3, "user", f"n{k}", 7) for k in range(500)]  # all under one number
    rows += [(60, 0, "user", "long " * 300_000, 7), (60, 1, "assistant", "é" * 2_000_000, 7), (61, 0, "user", "long " * 300_000, 7)]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(9)).collect()
    want = maximal(rows)
    assert {r.conv_id for r in got} == set(want) == {3, 20, 30, 31, 40, 50, 51, 60}
    for c, turns in want.items():
        mine = sorted((r.place, r.rendered) for r in got if r.conv_id == c)
        assert mine == [(i, f"<|{a}|>\n{b}\n") for i, (a, b) in enumerate(turns, 1)]
    assert {r.n_equal for r in got if r.conv_id == 3} == {2}
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("order", [0, 1])
def test_turn_order_counts(spark, order):
    a = [(1, 0, "user", "x", 0), (1, 1, "user", "y", 0)]
    b = [(2, 0, "user", "y", 0), (2, 1, "user", "x", 0)] if order else [(2, 0, "user", "x", 0), (2, 1, "user", "y", 0)]
    kept = {r.conv_id for r in chat.format_chats(spark.createDataFrame(a + b, TURNS)).collect()}
    assert kept == ({1, 2} if order else {1})
