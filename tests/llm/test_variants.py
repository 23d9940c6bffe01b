import random
import re
from collections import Counter
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from scrollmill.llm import spelling_variants
from scrollmill.llm.spelling_variants import Acceptor, count_words, spelling_variants as variants

from .conftest import LOWER, frame


def is_near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) < len(v):
        u, v = v, u
    return len(u) == len(v) + 1 and any(u[:k] + u[k + 1 :] == v for k in range(len(u)))


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def brute_force(n):
    form = {}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", max_size=7), max_size=40))
def test_composition_tells_each_pair_once(words):
    found = list(Acceptor(sorted(words)).near(99))
    assert len(found) == len(set(found)) == len({frozenset(p) for p in found})
    assert {frozenset(p) for p in found} == {frozenset((u, v)) for u in words for v in words if is_near(u, v)}


def test_acceptor_is_minimal():
    words = [a + b for a in ("ba", "co", "du") for b in ("lling", "nding", "n")]
    a = Acceptor(sorted(words))
    assert a.size[a.start] == 9
    assert len(a.arcs) == len({(a.final[k], *sorted(x.items())) for k, x in enumerate(a.arcs)})
    assert a.arcs[a.arcs[a.start]["b"]]["a"] == a.arcs[a.arcs[a.start]["c"]]["o"]


def vocabulary(rng):
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 6, 7, 7, 8, 12]))) for _ in range(300)]
    words += ["aaaaaa" + "b" * k for k in range(6)] + ["Étrange", "etrange", "étrange", "x" * 150, "x" * 151, "x" * 75 + "y" + "x" * 74, "y" + "x" * 149, "y" * 150]
    return words


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    words = vocabulary(rng)
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.choice([3, 60, 900])))) for k in range(60)]
    rows += [(k, "-".join(w for w in words if len(w) > 99) + "1 漢字" * 3 + " ".join(words)) for k in range(6)]
    rows += [(200, None), (201, ""), (202, "§ 12 漢"), (None, words[0] * 3), rows[0], (203, "longwords " * 150_000)]
    want = counted(rows)
    got = count_words(frame(spark, rows))
    assert {r["word"]: r["n"] for r in got.collect()} == want
    out = variants(frame(spark, rows))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = list(map(tuple, out.collect()))
    assert len(got) == len(want) and set(got) == brute_force(want)
    assert variants(frame(spark, [])).collect() == []
    assert variants(frame(spark, [(1, None), (2, "too few")])).collect() == []


def test_large_classes_are_cut_to_the_same_pairs(spark, monkeypatch):
    """One front and back for a third of all words, and many words of one length."""
    rng = random.Random(6)
    words = {"longfront" + "".join(rng.choice("abcd") for _ in range(5)) + "back" for _ in range(300)} | {"".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8]))) for _ in range(300)}
    n = {w: rng.randrange(5, 10_000) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {(w, sum(is_near(w, v) for v in n)) for w in n}
    want = {(w, k) for w, k in want if k}
    whole = spelling_variants.near_words(table).collect()
    monkeypatch.setattr(spelling_variants, "MOST", 12)
    cut = spelling_variants.near_words(table).collect()
    assert {(r["word"], r["n_near"]) for r in whole} == {(r["word"], r["n_near"]) for r in cut} == want
    assert sorted(whole) == sorted(cut)
