"""BPE against the tiktoken library, packing against the tokenizers library and its own rules."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from quadrat.llm import bpe, packing  # noqa: E402

DOCS = "doc_id bigint, text string, piece int, n_tokens string"
TEXTS = [
    None, "", " ", "a", "the cat sat", "it's  we'll\t\n\n x", "été ß Ünï 日本語 🙂 ٣٤ क्ष", "\x1c\x1d \x85 　 x", "z" * 3000, "ab" * 2000 + " " * 500, "0123456789" * 50,
    "<|endoftext|> <|startoftext|>", "İstanbul ΣΑΣ ﬁ", "the cat sat",
]


def frame(spark):
    return spark.createDataFrame([(i, t, 9, "clash") for i, t in enumerate(TEXTS)] + [(3, "a", 9, "x"), (None, "q", 9, "x")], DOCS)


def reference():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_equals_the_library(spark):
    enc = reference()
    got = bpe.round_trip(frame(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "q") or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(frame(spark).limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_encode_then_decode_tables(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(frame(spark), path, P.PATTERN)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(ids, path, P.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))


def test_random_pieces_equal_the_library():
    enc, rng = reference(), random.Random(5)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        code = bpe.Coder(f.read(), P.PATTERN)
    alphabet = ["a", "b", "th", "er", " ", "  ", "\n", "é", "日", "'s", "1", "!", "\x1f", "​", "z" * 40]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        assert np.frombuffer(code.encode(t), "<u4").tolist() == enc.encode_ordinary(t)


def test_leftmost_of_equal_pairs_merges_first():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3}
    assert bpe.merge_piece(b"aaa", ranks) == [2, 0] and bpe.merge_piece(b"aaab", ranks) == [2, 0, 1]


def library_ids(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [4096, 16])
def test_packing_keeps_every_rule(spark, capacity):
    got = packing.pack_documents(frame(spark), P.path("word_bpe_49k.json"), capacity).collect()
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "q")]
    want = []
    for i, t in rows:
        ids = [*library_ids(t), 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((i, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for cells in bins.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(w[3] for w in want) // capacity) + 3
    assert packing.pack_documents(frame(spark).limit(0), P.path("word_bpe_49k.json"), capacity).count() == 0


def test_op5_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*TEXTS, "end <|endoftext|> here", "a<|startoftext|>b", "<|EndOfText|>", "日本<|endoftext|>", "<| endoftext |> <|endoftext", "end here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.op5_best_fit_packing(spark, str(tmp_path)).collect()}
    assert tok.encode(texts[len(TEXTS)], add_special_tokens=False).ids == [806, 49407, 763]
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_words_equal_the_library_on_latin_text():
    rng = random.Random(2)
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        code = packing.Packer(f.read())
    alphabet = [*packing._LATIN, "'s", "'LL", "  ", "Ab", "12", "the", "ing"]
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(50))
        assert code.ids(t) == code._direct(t)


def test_genetic_search_is_never_worse_than_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(3):
        size = rng.integers(1200, 2300, 200).tolist()
        first: list = []
        packing.best_fit(first, sorted(range(200), key=lambda i: -size[i]), size, 4096)
        best = packing.evolve(size, 4096, 1, [], 15, 6)[0]
        bins = packing.to_bins(best)
        assert len(bins) <= len(first) and sorted(i for b in bins for i in b) == list(range(200)) and all(sum(size[i] for i in b) <= 4096 for b in bins)


def fewest(size, capacity):
    """Exact optimum: for every set of pieces the fewest bins, and the least fill of the last of them."""
    best = {0: (0, capacity)}
    for mask in range(1, 1 << len(size)):
        options = []
        for i, s in enumerate(size):
            if mask >> i & 1:
                n, f = best[mask ^ 1 << i]
                options.append((n, f + s) if f + s <= capacity else (n + 1, s))
        best[mask] = min(options)
    return best[(1 << len(size)) - 1][0]


def test_small_packings_are_optimal():
    rng = np.random.default_rng(1)
    for k in range(25):
        size = rng.integers(10, 70, 10).tolist()
        assert len(set(packing.evolve(size, 100, k, [], 60, 6)[0])) == fewest(size, 100)


def triplets(n, seed, capacity=1000):
    """Pieces that fill n bins exactly, three to a bin: best fit of the largest first doesn't."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(252, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def test_crossover_finds_what_best_fit_and_mutation_miss(monkeypatch):
    bins = lambda size: len(set(packing.evolve(size, 1000, 1, [], 400, 8)[0]))
    with_it = [bins(triplets(12, seed)) for seed in (0, 4, 5)]
    monkeypatch.setattr(packing, "crossover", lambda a, b, *rest: [list(x) for x in a])
    assert with_it == [13, 13, 13] and [bins(triplets(12, seed)) for seed in (0, 4, 5)] == [14, 14, 14]


def test_emptiest_bins_of_all_problems_are_packed_again(spark):
    rng = random.Random(9)
    rows = [(i, k, 0, rng.choice([1, 7, 30, 4096, rng.randint(1, 1500)]), i) for i in range(4000) for k in (0, 1)] + [(None, 0, 0, 5, 1), (3, 0, 0, 900, 1)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(pieces, group=200).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in got) == sorted((r[0] or -1, r[1], r[3]) for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for cells in bins.values():
        assert [o for o, _ in sorted(cells)] == np.cumsum([0, *(n for _, n in sorted(cells))])[:-1].tolist() and sum(n for _, n in cells) <= 4096
    assert len(bins) <= -(-sum(r[3] for r in rows) // 4096) + 1 and len({b >> 56 for b in bins if b >= 0}) > 1


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 4096, 60).tolist()
    a, b = packing.to_bins(packing.evolve(size, 4096, 1, [], 0, 1)[0]), []
    packing.best_fit(b, list(range(60)), size, 4096)
    child = packing.crossover(a, b, size, 4096, rng)
    assert sorted(i for x in child for i in x) == list(range(60)) and all(sum(size[i] for i in x) <= 4096 for x in child)
