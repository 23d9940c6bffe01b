import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrollmill.llm import bpe
from scrollmill.llm._tokenizers import encoder, fingerprint
from scrollmill.llm.token_counts import count_tokens

from .conftest import frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
PIECES = ["ab", "a", "the ", "  ", "\n", "é", "'s", "12", "!", "<|endoftext|>", " ", "中文", "\x85", "\t", "\x1c", "\U0001f600", "́", "ǅ", "٣"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_ids_and_decoding_are_the_librarys(parts):
    text, e = "".join(parts), encoder(PATH)
    want = WHOLE.encode(text, add_special_tokens=False).ids
    assert e.encode(text).tolist() == want
    assert e.decode(np.array(want, np.uint32)) == WHOLE.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "the", "é", "中", " ", "aa", "ing"]), min_size=1, max_size=300), st.integers(1, 40))
def test_tree_is_exact(parts, leaf):
    text, e = "".join(parts), encoder(PATH)
    assert bpe.tree([e.merge(p) for p in bpe.halves(text, leaf)], e.tokens, e.merge).tolist() == e.merge(text).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "x's y", " a", "b ", "?! "]), min_size=1, max_size=200), st.integers(4, 40))
def test_tree_of_whole_texts_is_exact(parts, leaf):
    text, e = "".join(parts), encoder(PATH)
    for run in e.special.split(text):
        cut = bpe.safe_halves(run, leaf)
        assert "".join(cut) == run
        assert bpe.tree([e.encode(p) for p in cut], e.tokens, e.encode).tolist() == WHOLE.encode(run, add_special_tokens=False).ids


def test_long_texts_are_cut():
    text, e = "some words, and a few more; " * 2000, encoder(PATH)
    found = list(bpe.pieces(text, e))
    assert {k for k, _ in found} == {bpe.TEXT} and len(found) >= 7 and all(len(p[0]) <= bpe.LEAF for _, p in found)


LONG = [(7, "it's a long, plain text; " * 3000), (8, ("naïve 中文字 " * 3000) + "a b" * 9000), (1, "x" * 20_000), (2, "<|endoftext|>" + "ab'" * 5000 + " tail " + "  " * 4000 + "x"), (3, "中文字" * 3000 + "<|endoftext|>z"), (4, "abcdefghij" * 900), (5, None), (6, "")]


def test_round_trip(spark, corpus):
    rows = corpus + LONG
    want = Counter()
    for d, t in rows:
        ids = WHOLE.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(frame(spark, rows), PATH).collect())) == want
    assert bpe.round_trip(frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_and_cache(spark, corpus, tmp_path, name):
    path, cache = public_tokenizers.path(name), f"file://{tmp_path}"
    e = encoder(path)
    want = Counter((d, len((t or "").encode()), n := len(e.encode(t or "")), n > 512) for d, t in corpus)
    assert Counter(map(tuple, count_tokens(frame(spark, corpus[:30]), path, cache).collect())) <= want
    assert Counter(map(tuple, count_tokens(frame(spark, corpus), path, cache).collect())) == want
    assert Counter(map(tuple, count_tokens(frame(spark, corpus), path, cache).collect())) == want
    stored = spark.read.parquet(f"{cache}/tokenizer={fingerprint(path)}")
    assert stored.count() == len({t or "" for _, t in corpus})  # each text was encoded once
    assert count_tokens(frame(spark, []), path, cache).collect() == []


def test_query_of_two_deliveries(spark):
    from scrollmill.llm.queries import op1_token_counts

    from ..conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: len(WHOLE.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs}
    got = op1_token_counts(spark, DATA).collect()
    assert len(got) == len(docs) and {r["doc_id"]: r["n_tokens"] for r in got} == want
