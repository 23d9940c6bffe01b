import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scrollmill.llm import source_divergence
from scrollmill.llm.source_divergence import divergence, share

from .conftest import LOWER

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, c long, f long, item string"


def brute_force(rows, least, ranks):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        sources = [s for g, s in groups if g == lang]
        kept = [t for t, k in held[lang].items() if k >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        everything = sum(total.values())
        p = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        for s in sources:
            share_of = lambda t, o: p(counts[lang, o][t], total[o])  # noqa: B023, E731
            pairs = sorted((-sum(abs(share_of(t, s) - share_of(t, o)) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            more = [(p(sum(counts[lang, o][t] for o in sources), everything) - share_of(t, s), t.encode()) for t in kept if counts[lang, s][t]]
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(x for x in more if x[0] < 0)[:ranks])}
    return out


@pytest.mark.parametrize("ranks", [50, 5])
def test_same_as_brute_force(spark, monkeypatch, ranks):
    monkeypatch.setattr(source_divergence, "IN_DOCUMENTS", 4)
    monkeypatch.setattr(source_divergence, "RANKS", ranks)
    monkeypatch.setattr(source_divergence, "HELD", 50)
    rng = random.Random(1)
    terms = [f"{a}{b}" for a in ("Bau", "été", "漢", "z", "q") for b in "abcdefghijklmno"]
    rows = [(k, " ".join(rng.choices(terms, [1 / (j + 1) for j in range(len(terms))], k=rng.choice([1, 8, 60]))) + "\t1-x\x7f", rng.choice(["en", "fr", None]), rng.choice(["a", "B", "é", "漢", None, ""])) for k in range(90)]
    rows += [(100, None, "en", "empty"), (101, "only here", "xx", "alone"), (102, "", None, None), rows[0], rows[0], (None, "baua " * 250_000, "en", "a"), (104, "12 34", "yy", "p"), (105, None, "yy", "q")]
    got = [tuple(r) for r in divergence(spark.createDataFrame([(*r, "t", 1, 2, 3, "i") for r in rows], SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(rows, 4, ranks)
    assert {r[4] for r in got if r[0] == "yy"} == {0}
    assert divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = 10**13 + 7, 3 * 10**13 + 1
    got = spark.range(1).select(share(F.lit(n), F.lit(total), F.lit(11))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 55)
    assert spark.range(1).select(share(0, F.lit(0), F.lit(0))).first()[0] is None
