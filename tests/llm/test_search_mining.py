"""Ranked search, hard negatives and SimHash groups against brute force, with hostile rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quadrat.llm import hard_negatives, ranked_search, simhash

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            if b:
                m = 25 + (75 * sum(b.values()) * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
                if score > 0:
                    found.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


def key(r):
    return [(x is None, x or 0) for x in r]


def search_rows(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "naïve", "日本", "A1", "x_y", "don't"]
    docs = [(None, "w1 w2 w2"), (1, None), (2, ""), (3, " .,;\x00\x7f "), (4, "w1 " * 40_000), (5, "w1 w2"), (5, "w1 w2"), (6, "W1-w2"), (7, "w1 w2 Ünd ünd")]
    docs += [(10 + i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.choice((3, 30, 200))))) for i in range(400)]
    docs += [(1000 + i, "common line of every copy w7") for i in range(60)]
    items = [(0, "w1 w2 w2 w9"), (1, None), (2, "unseen words only"), (3, " ".join(words)), (3, "w7"), (4, "日本 été"), (5, "common copy"), (None, "w250 w251"), (6, "w3 " * 3000)]
    return docs, items


@pytest.mark.parametrize("width,per_block", [(4096, 1024), (8, 2), (1, 1024)])
def test_ranked_search_equals_brute_force(spark, width, per_block):
    docs, items = search_rows()
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id bigint, text string, item_id string, score int").repartition(5)
    i = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id bigint, text string, term string")
    got = ranked_search.ranked_search(d, i, width=width, items_per_block=per_block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(ranked_brute(docs, items), key=key)


def test_ranked_search_of_empty_tables(spark):
    docs, items = search_rows()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert ranked_search.ranked_search(d.limit(0), i).count() == 0
    assert ranked_search.ranked_search(d, i.limit(0)).count() == 0
    assert ranked_search.ranked_search(d.where("doc_id in (1, 2, 3)"), i).count() == 0


def test_sketches_bound_scores():
    rng = random.Random(1)
    items = [(i, i, [(b"t%d" % t, rng.randint(1, 3), rng.randint(0, 9000)) for t in rng.sample(range(500), 12)]) for i in range(40)]
    weights = {}
    items = [(u, i, [(t, c, weights.setdefault(t, w)) for t, c, w in ts]) for u, i, ts in items]
    block = ranked_search.Block(items, 64)
    texts = [" ".join(f"t{rng.randrange(600)}" for _ in range(rng.choice((1, 50, 900)))).encode() for _ in range(30)]
    found = [block.impacts(t, 30, 9000) for t in texts]
    bound = block.bounds(found)
    for d, (at, impact) in enumerate(found):
        own = dict(zip(at.tolist(), impact.tolist()))
        for q, times in enumerate(block.times):
            assert bound[d, q] >= sum(c * own.get(t, 0) for t, c in times.items())


def negatives_brute(rows, every=50, scale=256):
    v = [(i, lab, [math.floor(scale * x) for x in e]) for i, e, lab in rows if i is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, lab, e in v:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f)), i, other) for i, other, f in v if i != a and len(f) == len(e))
        for ps, p, _ in [s for s in scored if s[2] == lab][:5]:
            fit = [s for s in scored if s[2] != lab and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<double>, label int, score string, anchor_id int"


@pytest.mark.parametrize("anchor_block,block", [(512, 4096), (2, 7)])
def test_hard_negatives_equal_brute_force(spark, anchor_block, block):
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.normal(size=6) + (i % 4)).round(2).tolist(), int(i % 4)) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0], i % 2) for i in range(80)]  # one common vector: ties
    rows += [(50, rows[50][1], 2), (60, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (2000, [0.0] * 6, 3), (2050, [1e12, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (2100, [1.0, 2.0], 0), (2101, [1.0, 1.5], 0), (2102, [0.5, 1.0], 1)]
    rows += [(None, [1.0] * 6, 1), (3000, None, 1), (3050, [1.0] * 6, None), (3100, [], 1), (3150, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3200, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 1), (3250, [1.0, math.inf, 1.0, 1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, anchor_block=anchor_block, block=block).collect())
    want = negatives_brute(rows)
    assert len(got) > 50 and got == want


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    lone = spark.createDataFrame([(0, [1.0, 2.0], 1, "c", 1), (1, [1.0, 2.0], 2, "c", 1)], VECTORS)
    assert hard_negatives.hard_negatives(lone).count() == 0  # no positive
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "c", 1)], VECTORS)
    assert hard_negatives.hard_negatives(one).count() == 0  # no anchor


def test_keys_sort_by_anchor_score_side_and_id():
    rows = [(q, a, s, side, i) for q in (0, 3) for a in (0, 2) for s in (-(2**63) + 1, -1, 0, 5, 2**63 - 1) for side in (0, 1) for i in (-4, 0, 9)]
    want = sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))
    assert sorted(rows, key=lambda r: hard_negatives.packed(*r)) == want


def fingerprint(text):
    w = (text or "").translate(LOWER).split(None) if (text or "").isascii() else re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_brute(rows, radius=3):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{prints[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)), key=key)


def texts(seed=2):
    rng = random.Random(seed)
    rows = [None, "", " \t\n\x0b\x0c\r", "one", "ONE", "one two", "one two three", "x " * 30_000, "été été Été", "a b c a b c a b c"]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(300)]
        rows.append(" ".join(base))
        for k in (1, 1, 2, 4, 9):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(300)] = f"q{rng.random()}"
            rows.append(" ".join(t))
    return [(100 + i, t) for i, t in enumerate(rows)] + [(5, rows[12]), (5, rows[20]), (None, rows[12]), (None, "nothing like it in any text"), (7, None)]


@pytest.mark.parametrize("parts,block", [(5, 8192), (6, 3), (4, 8192)])
def test_simhash_groups_equal_brute_force(spark, parts, block):
    rows = texts()
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id bigint, text string, fingerprint string, component_id int").repartition(3)
    got = simhash.near_duplicates(df, parts=parts, block=block).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == simhash_brute(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got})


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
@pytest.mark.parametrize("sides", [False, True])
def test_bit_sliced_forest_equals_brute_force(radius, sides):
    rng = np.random.default_rng(radius)
    prints = set()
    for b in rng.integers(0, 1 << 63, 40):
        for _ in range(9):
            x = int(b)
            for _ in range(rng.integers(0, 8)):
                x ^= 1 << int(rng.integers(0, 64))
            prints.add(x)
    p = np.array(sorted(prints), np.uint64)
    n = len(p)
    group = rng.integers(0, 3, n)
    side = rng.integers(0, 2, n) if sides else np.full(n, 2)

    def components(pairs):
        label = np.arange(n)
        return simhash._joined(label, *np.array(pairs).T).tolist() if pairs else label.tolist()

    want = [(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and (side[i] != side[j] or side[i] == 2) and bin(int(p[i]) ^ int(p[j])).count("1") <= radius]
    got = simhash.forest(p, group, side, radius)
    assert components(got) == components(want) and len(got) < n


def test_pairs_within_the_radius_share_a_bucket(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        rows += [(i, simhash._signed(x)), (i, simhash._signed(y))]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "i int, fp bigint")
    for parts in (4, 5, 6):
        keyed = df.select("i", F.explode(F.array(*simhash.bucket_keys(F.col("fp"), 3, parts))).alias("key"))
        assert keyed.groupBy("i", "key").count().where("count > 1").select("i").distinct().count() == 300
