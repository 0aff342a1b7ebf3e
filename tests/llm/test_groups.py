"""Near duplicates, top-k search, and components against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from quadrat.llm import hard_negatives, near_dedup, top_k

DOCS = "doc_id bigint, text string, kept string, component_id int"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [None, "", "  \t\n", "one", "one", "ONE", "a b c d", "a b c d e", "\x0b\x0c", "été été été été été été", "x " * 5000]
    for n in (8, 40, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            rows.append(" ".join(base))
            for k in (1, 2, 3, 5):
                for _ in range(5):
                    t = list(base)
                    for _ in range(k):
                        t[rng.randrange(n)] = word()
                    rows.append(" ".join(t))
    return list(enumerate(rows))


@pytest.mark.parametrize("block_nodes,block_shingles", [(1024, 2_000_000), (4, 2_000_000), (1024, 300)])
def test_groups_equal_brute_force(spark, block_nodes, block_shingles):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash", 5) for d, t in rows], DOCS).repartition(3)
    got = near_dedup.near_duplicates(df, block_nodes=block_nodes, block_shingles=block_shingles).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_hot_group_in_many_blocks(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(300):
        t = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 6))):
            t[rng.randrange(150)] = f"q{rng.random()}"
        rows.append((d, " ".join(t)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block_nodes=32).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_empty_table_and_repeated_ids(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(1, "p q r s t u"), (1, "entirely other words in this one here"), (2, "p q r s t u"), (None, "p q r s t u"), (3, "entirely other words in this one here")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.9):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        k = int(400 * 2 * share / (1 + share))
        b = np.concatenate((a[:k], rng.integers(0, 2**63, 400 - k).astype(np.uint64)))
        s = near_dedup.superminhash([a, b], 512)
        assert abs((s[0] == s[1]).mean() - share) < 0.08
    tiny = near_dedup.superminhash([np.array([5], np.uint64), np.array([], np.uint64), np.array([5, 9], np.uint64)], 64)
    assert (tiny[0] >> np.uint64(48)).max() < 64 and sorted((tiny[0] >> np.uint64(48)).tolist()) == list(range(64))
    assert (tiny[1] == np.iinfo(np.uint64).max).all() and (tiny[2] <= tiny[0]).all()


def brute_top(rows, k, every):
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,query_block,slices", [(4096, 512, 2), (16, 3, 2), (16, 3, 5), (7, 2, 1)])
def test_top_k_equals_brute_force(spark, block, query_block, slices):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(90)]
    rows += [(100 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (None, [1.0] * 6), (220, [1.0, 2.0]), (221, [3.0, 1.0]), (240, [0.0] * 6), (260, [9e3] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    got = top_k.exact_top_k(df, k=5, every=10, slices=slices, block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 10)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in top_k.exact_top_k(df).collect()] == [(0, 1, 1, 8192)]
    assert top_k.exact_top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 8])
def test_top_k_of_large_finite_components(spark, block):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 0.2, 4).tolist()) for i in range(60)] + [(100, [1e9, 0.0, -1.0, 0.5]), (101, [-3e7, 2.0, 2e7, 0.0]), (110, [1e300, 0.0, 0.0, 1.5e308]), (120, [2e9, 1.0, 1.0, 1.0])] + [(30, [1e9] * 4)] * 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = top_k.exact_top_k(df, k=4, every=10, block=block, query_block=5).collect()
    most, want = (1 << 63) - 1, []
    whole = [(i, [math.floor(64 * x) if math.isfinite(64 * x) else int(x) * 64 for x in v]) for i, v in rows]
    for i, q in whole:
        if i % 10 == 0:
            best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(q, v)))), j) for j, v in whole if j != i)[:4]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_blocks_under_the_cutoff_are_not_resolved_again(spark):
    """With many candidates the bounds of most blocks fall under the cutoff, and what phase 1 listed is all they add."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(6_000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    settled, again, resolved = top_k.phases(df, "vec_id", "embedding", 3, 300, 64, 2, 512, 100)
    pairs, redone = settled.count() + again.count(), again.count()
    assert pairs >= 20 * 60 and 0 < redone < pairs / 2
    assert max(len(r.best) for r in settled.collect()) <= 3 and resolved.count() == redone
    got = sorted(map(tuple, top_k.exact_top_k(df, k=3, every=300, block=100).collect()))
    q = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    s = q[::300] @ q.T
    s[np.arange(20), np.arange(0, 6_000, 300)] = -(1 << 60)
    want = [(300 * a, r + 1, int(j), int(s[a, j])) for a in range(20) for r, j in enumerate(np.lexsort((np.arange(6_000), -s[a]))[:3])]
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["lists", "positives"])
def test_repeated_blocks_are_not_broadcast(spark, monkeypatch, name):
    """Spark takes a table for as small as it was before its rows were repeated."""
    module, plans = {"lists": top_k, "positives": hard_negatives}[name], {}
    kept = module.cut

    def cut(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(module, "cut", cut)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.2, 6).tolist(), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    if name == "lists":
        got = top_k.exact_top_k(df, k=4, every=5, block=10, query_block=8)
        assert sorted(map(tuple, got.collect())) == brute_top([r[:2] for r in rows], 4, 5)
    else:
        assert hard_negatives.hard_negatives(df, every=5, block=10, anchor_block=8).count() > 0
    assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]
