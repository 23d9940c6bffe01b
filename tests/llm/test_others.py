import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scrollmill.llm import decontaminate, embedding_dedup, sharding, toxicity
from scrollmill.llm.chat import DEFAULT, read_back, segments
from scrollmill.llm.decontaminate import FMIndex, find_contamination
from scrollmill.llm.toxicity import fit, score, train

from .conftest import frame, words


# -- sharding
def test_table_is_even_and_moves_little():
    names = [f"s{k}" for k in range(50)]
    table = sharding.lookup_table(names, 5003)
    counts = np.bincount(table, minlength=50)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 5003)
    stayed = table != 49
    assert (table[stayed] == fewer[stayed]).mean() > 0.9


def test_shards_same_as_brute_force(spark, corpus):
    """Slots by the permutations written out, shards taking turns; rows by Spark's own hash of a literal."""
    names, size = [f"shard-{k:05d}" for k in range(7)], 101
    wish = {s: [(xxhash.xxh64_intdigest(s, seed=1) + j * (xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1)) % size for j in range(size)] for s in names}
    owner = {}
    while len(owner) < size:
        for s in names:
            if len(owner) < size:
                owner[next(c for c in wish[s] if c not in owner)] = s
    rows = [r for r in corpus if r[0] is None or r[0] < 20 or r[0] > 160]
    got = Counter(map(tuple, sharding.document_shards(frame(spark, rows), 7, size).collect()))
    slot = {d: spark.sql(f"select pmod(xxhash64(cast({'null' if d is None else d} as bigint)), {size}) as s").first()["s"] for d in {d for d, _ in rows}}
    assert got == Counter((d, len((t or "").encode()), slot[d], owner[slot[d]]) for d, t in rows)


@pytest.mark.parametrize(("shards", "size"), [([], 7), (["a", "a"], 7), (["a"], 8), (list("abc"), 2)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_place(spark, corpus, tmp_path):
    docs = frame(spark, corpus)
    placed = sharding.place(docs, "doc_id", ["a", "b", "c"], 101)
    assert placed.count() == len(corpus) and set(placed.columns) == {*docs.columns, "slot", "shard"}
    table = sharding.lookup_table(["a", "b", "c"], 101)
    by_id = {}
    for r in placed.collect():
        assert r["shard"] == "abc"[table[r["slot"]]] and by_id.setdefault(r["doc_id"], r["slot"]) == r["slot"]
    assert sharding.document_shards(frame(spark, [])).collect() == []
    sharding.write_shards(placed.selectExpr("doc_id", "text", "shard", "n as _SALT"), str(tmp_path / "out"), 2)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(corpus) and {r["_SALT"] for r in out.collect()} == {"n"}


# -- vectors
def test_vectors_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEFT", 30)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(k, (base[k % 60] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])).tolist()) for k in range(240)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] + [1.0] * 15), (304, [None] + [1.0] * 15), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [3.0]), (308, [-3.0]), (0, rows[0][1]), (None, rows[1][1]), (309, [float("inf")] * 16)]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, size int")).collect()

    def ok(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, parent = len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if ok(a) and ok(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = Counter((d, links[i], c := least.get(root(i)), d is not None and d == c) for i, (d, _) in enumerate(rows))
    assert Counter(map(tuple, got)) == want
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# -- decontamination
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=8), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_finds_every_occurrence(runs, phrase):
    text = np.array([x for r in runs for x in [0, *r]])
    index = FMIndex(text, 5)
    row, lo, hi = index.search(np.array([phrase]))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(row) else []
    assert found == [k for k in range(len(text)) if text[k : k + len(phrase)].tolist() == phrase]


ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_contamination_same_as_brute_force(spark, corpus, monkeypatch, block):
    """In one pass, and in passes of a few items each."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    corpus = corpus + [(700, "padding words " * 60_000 + corpus[40][1])]  # longer than a chunk
    texts = {d: t for d, t in corpus if t}
    items = [(1, " ".join(texts[100].split()[20:50])), (2, " ".join(texts[169].split()[500:513])), (3, "one two THREE"), (10, None), (11, " .. "), (None, texts[100]), (2, "naïve, café élan naïve"), (12, "never seen anywhere at all")]
    docs = corpus + [(500, "... One-two/three! and " + items[0][1]), (501, "one two")]
    windows = {}
    for i, t in items:
        w = words(t, ALNUM)
        if i is not None and w:
            m = min(13, len(w))
            for k in range(len(w) - m + 1):
                windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    want = Counter()
    for d, t in docs:
        w, hit, names = words(t, ALNUM), set(), set()
        for p, owners in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    names |= owners
        want[(d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(frame(spark, docs), bench)
    assert Counter(map(tuple, found.drop("spans").collect())) == want
    by_id = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert [b"One-two/three", items[0][1].encode()] == [docs[-2][1].encode()[s["start"] : s["end"]] for s in by_id[500]]
    assert find_contamination(frame(spark, []), bench).collect() == []
    assert find_contamination(frame(spark, docs[:5]), bench.limit(0)).where("n_hit > 0").collect() == []


# -- chat
@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\l", "\\b", "<", "[", "x", "\n", "INST]"]), max_size=12))
def test_escape_is_reversible(parts):
    text = "".join(parts)
    said = DEFAULT.escape(text)
    assert DEFAULT.unescape(said) == text
    assert not any(c in said for c in DEFAULT.controls)


def test_chat(spark):
    own = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", own), (2, 1, "assistant", "b"), (2, 0, "user", None), (3, 0, "assistant", "first"), (3, 1, "odd</s>", "\\x"), (None, 0, "user", "a"), (4, 0, "system", "s"), (4, 0, "system", "s"), (5, None, "user", "n"), (5, 0, "assistant", "é")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, turn_no int, loss string")
    got = {r["conv_id"]: r for r in read_back(segments(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2], r[3] or "") for r in rows if r[0] == c))
        learnt = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert {c: r["in_order"] for c, r in got.items()} == {1: True, 2: True, 3: False, None: True, 4: False, 5: True}
    assert read_back(segments(df.limit(0))).collect() == []


def test_long_conversation(spark):
    rows = [(9, k, ("user", "assistant")[k % 2], f"turn {k} <s>") for k in range(3000)]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, segment int, in_order boolean").repartition(7)
    r = read_back(segments(df)).collect()
    assert len(r) == 1 and r[0]["n_turns"] == 3000 and r[0]["in_order"] and r[0]["loss_sha256"] == hashlib.sha256("".join(t for _, k, _, t in rows if k % 2).encode()).hexdigest()


# -- toxicity
def test_kernel_same_as_brute_force():
    """Weighted triples of letters in order, one by one; and the table of a machine gives the same values as its kernel expansion."""
    rng = np.random.default_rng(3)
    width = toxicity.WIDTH + toxicity.SPAN
    windows = rng.integers(0, 4, (12, width)).astype(np.uint8)

    def triples(w):
        out = Counter()
        for i in range(toxicity.WIDTH):
            for a in range(1, toxicity.SPAN - 1):
                for b in range(1, toxicity.SPAN - a):
                    x, y, z = (int(w[k]) for k in (i, i + a, i + a + b))
                    if x and y and z:
                        out[x << 10 | y << 5 | z] += toxicity.DECAY ** (a + b - 2)
        return out

    counts = [triples(w) for w in windows]
    features = np.zeros((1 << 15, 5), np.float32)
    for k in range(5):
        for place, weight in counts[k].items():
            features[place, k] = weight
    want = [[sum(v * counts[k][p] for p, v in c.items()) for k in range(5)] for c in counts]
    assert np.allclose(toxicity._kernel(windows, features), want, rtol=1e-4)
    alpha = rng.normal(size=5)
    model = toxicity.Model((features @ alpha).astype(np.float32), 0.5, 1.0, 0.0)
    got = [model.sums(np.concatenate([w, np.zeros(width)]).astype(np.int32))[0] for w in windows]
    assert np.allclose(got, np.array(want) @ alpha + 0.5, rtol=1e-3, atol=1e-3)


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("the", "ond", "er", "in", "sha", "tion") for b in ("re", "and", "ly", "ou", "es", "at")]
    bad = ["idiot", "moron", "pathetic", "scum"]
    docs, labels = [], []
    for k in range(400):
        w = rng.choice(plain, 60).tolist()
        if k % 4 == 0:
            w[rng.integers(60)] = bad[k // 4 % 4]
        docs.append((k, " ".join(w[:30]) + ".\n" + " ".join(w[30:])))
        labels.append((k, 1, int(k % 4 == 0)))
    docs += [(1000, None), (1001, ""), (None, "plain there"), (1002, "what an i.diot they are"), (1003, "such a mo ron indeed"), (1002, "what an i.diot they are")]
    d, y = frame(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    model = train(d, y)
    got = {}
    for r in score(d, model).collect():
        assert got.setdefault(r["doc_id"], r["score"]) == r["score"] and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    import zlib

    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.3) == (k % 4 == 0) for k in held]) > 0.97
    assert got[1000] == got[1001] < 0.3 and got[1002] > got[1001] and got[1003] > got[1001]
    assert score(frame(spark, []), model).collect() == []
    nothing = fit(pa.table({"toxic": pa.array([], pa.int32()), "text": pa.array([], pa.string())}), {})
    assert {r["predicted"] for r in score(d, nothing).collect()} <= {0, 1}
    assert score(d, train(d, y.limit(0))).count() == len(docs)
