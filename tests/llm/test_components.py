"""Pieces of the corpus operators that stand alone."""

import itertools
import random

import numpy as np

from ledgerloom.llm import golay, lm, packing, quality, wrappers
from ledgerloom.llm.common import components


def test_golay_is_perfect_and_neighbours_share_codewords():
    single, errors = golay.tables()
    assert len(set(errors.tolist())) == 2048
    rnd = random.Random(1)
    for _ in range(300):
        x = rnd.getrandbits(23)
        y = x
        for i in rnd.sample(range(23), rnd.randrange(3)):
            y ^= 1 << i
        a, b = golay.nearby_codewords(np.array([x, y]))
        assert len(set(a)) in (1, 6) and set(a) & set(b)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_trie_probabilities_sum_to_one():
    texts = [b"abracadabra", b"abc abd", b"", b"cabbage"]
    codes = np.concatenate([c for c, _ in lm.gram_codes(texts, 3)])
    chunks = list(lm.gram_codes(texts, 3, 5))
    assert (np.concatenate([c for c, _ in chunks]) == codes).all() and len(codes) == sum(len(t) + 1 for t in texts)
    assert np.bincount(np.concatenate([o for _, o in chunks])).tolist() == [len(t) + 1 for t in texts]
    keys, n = np.unique(codes, return_counts=True)
    levels = lm._levels(keys, n, range(4), [])
    trie = lm.Trie(levels)
    for context in (b"abr", b"zzz", b"xab", b"bra", b"\xff\xff\xff", b"aca"):
        head = int.from_bytes(context, "big") << 8
        p = 10 ** trie.log10(np.array([head | s for s in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9, context


def test_hash_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64))
    table = lm.HashTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1 << 61)) == -1).all()
    assert (lm.HashTable(keys[:0]).find(keys) == -1).all()


def test_plans_hold_every_piece_once():
    rng = np.random.default_rng(2)
    for n in (0, 1, 30, 3000):
        histogram = np.zeros(1025, np.int64)
        for length in rng.integers(1, 1025, n):
            histogram[length] += 1
        plans = packing.plan_histogram(histogram)
        held = np.zeros(1025, np.int64)
        for p in plans:
            assert sum(k * v for k, v in p.counts.items()) <= 1024
            for k, v in p.counts.items():
                held[k] += v * p.copies
        assert (held == histogram).all()
        used, least = sum(p.copies for p in plans), -(-int((histogram * np.arange(1025)).sum()) // 1024)
        assert used <= least * 1.02 + 8


def test_knapsack_is_optimal():
    prices = np.zeros(13)
    prices[[3, 4, 5]] = [4, 5.5, 7]
    best = max(a * 4 + b * 5.5 + c * 7 for a, b, c in itertools.product(range(5), repeat=3) if 3 * a + 4 * b + 5 * c <= 12)
    assert packing.best_pattern(prices, 12) @ prices == best


def test_duplicated_windows_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(50):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(60))]
        got = quality.duplicated_words(words, [3, 5, 8])
        for n, covered in got.items():
            windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            want = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + n)}
            assert set(np.flatnonzero(covered)) == want


def test_wrapper_learns_repetition_and_options():
    pages = ["<nav><li>a<li>b<li>c</nav><article><h1>t</h1><p>x<p>y</article>", "<nav><li>a</nav><article><h1>t</h1><p>x</article><div class='comments'><p>c</div>"]
    import json

    learnt = wrappers.infer([json.dumps(wrappers.fold(wrappers.stream(p)[0])) for p in pages])
    assert '"+"' in learnt and '"?"' in learnt
    for p in pages:
        tokens, texts = wrappers.stream(p)
        assert len(wrappers.Wrapper(learnt).roles(tokens)) == len(texts)
    assert wrappers.extract(pages[0], learnt) == "t\nx\ny" and wrappers.extract(pages[1], learnt) == "t\nx"
