import random
from collections import Counter

import numpy as np
import pytest

from scrollmill.llm import _signature_tree, ngram_join
from scrollmill.llm.ngram_join import ngram_components

from .conftest import frame, words


def sets(rows, k):
    out = []
    for _, t in rows:
        w = words(t)
        out.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]))
    return out


def expected(rows, k, num, den):
    s, parent = sets(rows, k), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s[i]), least.get(root(i)) if s[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_same_as_brute_force(spark, corpus, k, num, den):
    got = Counter(map(tuple, ngram_components(frame(spark, corpus), k, num, den).collect()))
    assert got == expected(corpus, k, num, den)


def test_links_behind_many_equal_buckets(spark):
    """Ten of forty copies are alike only to each other, and all of their early shingles lie in buckets of all forty."""
    base, boiler = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("b", 101), ("p", 26)))
    own = lambda k, n: " ".join(f"o{k}x{i}" for i in range(n))
    rows = [(k, f"{base} {own(k, 3)}" + (f" {boiler}" if k >= 30 else "")) for k in range(40)]
    rows += [(100 + k, f"{own(100 + k, 150)} {boiler}") for k in range(60)]
    got = Counter(map(tuple, ngram_components(frame(spark, rows)).collect()))
    assert got == expected(rows, 5, 4, 5)


def test_empty_table(spark):
    assert ngram_components(frame(spark, [])).collect() == []


def test_links_of_mixed_blocks(spark):
    """Random mixtures of shared blocks, edited a little: many groups that nearly link."""
    rng = random.Random(8)
    blocks = [" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(10, 60))) for _ in range(14)]
    rows = []
    for k in range(160):
        w = " ".join(rng.sample(blocks, rng.randrange(1, 5))).split() if k % 3 or not rows else rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        rows.append((k, " ".join(w)))
    for k, num, den in ((4, 85, 100), (5, 4, 5), (2, 3, 5)):
        assert Counter(map(tuple, ngram_components(frame(spark, rows), k, num, den).collect())) == expected(rows, k, num, den)


def test_links_between_blocks_of_a_tree(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "UNIT", 700)
    got = Counter(map(tuple, ngram_components(frame(spark, corpus), 5, 4, 5).collect()))
    assert got == expected(corpus, 5, 4, 5)


@pytest.mark.parametrize("sizes", [(200, 200), (60, 70), (20, 900)])
def test_trees_find_all_pairs_that_may_link(sizes):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 63, rng.integers(sizes[0], sizes[1], endpoint=True), np.uint64) for _ in range(30)]
    members = [np.unique(np.concatenate([rng.choice(b, len(b) * 95 // 100, replace=False), rng.integers(0, 1 << 63, len(b) // 30, np.uint64)])) for b in base for _ in range(rng.integers(1, 20))]
    n, bitmaps = np.array([len(m) for m in members]), [_signature_tree.bitmap(m) for m in members]
    want = {(a, b) for a in range(len(members)) for b in range(a + 1, len(members)) if 5 * len(np.intersect1d(members[a], members[b])) >= 4 * len(np.union1d(members[a], members[b]))}
    pairs = lambda label, forest=False: {(min(a, b), max(a, b)) for i, j in _signature_tree.pairs(bitmaps, n, label, forest, 4, 5) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    found = pairs(np.arange(len(members)))
    assert want <= found and len(found) < len(members) * (len(members) - 1) / 4
    assert pairs(None) == found
    for label in (None, np.arange(len(members))):
        forest, joined = pairs(label, True), np.arange(len(members))
        assert forest <= found and len(forest) < len(members)
        for a, b in forest:
            joined[joined == joined[b]] = joined[a]
        assert all(joined[a] == joined[b] for a, b in want)
