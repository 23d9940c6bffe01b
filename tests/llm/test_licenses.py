import random
import re
from collections import defaultdict

import pytest

from scrollmill.llm.license_scan import BASE, OWN, Template, scan_licenses

from .conftest import LOWER, frame

MIT = next(t.text for t in OWN if t.label == "mit")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base_of(text):
    w = split(text)
    places = [(k, t.label) for t in BASE for k in range(len(w)) if w[k : k + len(t.text.split())] == t.text.split()]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def brute_force(text, templates):
    """Votes one by one, in plain loops."""
    w, labels, best = split(text), set(base_of(text)[4].split(",")) - {""}, 0.0
    for x in templates:
        t = x.text.split(" ")
        k = 2 if len(t) < 6 else 4
        votes = defaultdict(set)
        for p in range(len(w) - k + 1):
            for q in range(len(t) - k + 1):
                if w[p : p + k] == t[q : q + k]:
                    votes[p - q].add(q)
        near, merged = min(len(t) // 8, 12), []
        for d in sorted(votes):
            if merged and d - merged[-1][-1] <= near:
                merged[-1].append(d)
            else:
                merged.append([d])
        for span in merged:
            held = {q + j for d in span for q in votes[d] for j in range(k)}
            start, end = min(d + min(votes[d]) for d in span), max(d + max(votes[d]) + k for d in span)
            own = sum(len({q + j for q in votes[d] for j in range(k)}) for d in span)
            share = len(held) / len(t)
            best = max(best, share)
            if len(held) == len(t) if len(t) < 6 else share >= 0.6 and min(1, own / (end - start)) >= 0.6:
                labels.add(x.label)
    return ",".join(sorted(labels)), best


def texts():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(50)] + "of the license software cc by public gnu mit".split()
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    w = MIT.split()
    out = [some(30) for _ in range(10)] + [f"{some(9)} {t.text.title()}. {some(5)}" for t in BASE + OWN]
    out += ["CC-BY cc, by CC BY nc", "apache license\nApache   LICENSE", "the gnu general public", "cc", "mit license mit license", None, "", " \n", "mit Key license", "Mit License", "MİT license", "gnu general public license version 3", "漢字 cc by 漢字"]
    out += [" ".join(w[:20] + ["own", "words"] + w[20:40] + w[43:]), " ".join(w[:25]), " ".join(w[:50]), f"{some(20)} {MIT.upper()} {some(20)} {MIT}", " ".join(x for a in w for x in (a, "z")), "cc by " * 4000, some(40_000)]
    return out


def test_same_as_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [rows[3], (None, "under the MIT License"), (None, "under the MIT License"), (3, "other row of this doc_id, cc by")]
    out = scan_licenses(frame(spark, rows))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted(map(tuple, out.collect()), key=str)
    want = []
    for i, text in rows:
        labels, score = brute_force(text, BASE + OWN)
        want.append((i, *base_of(text), labels, score))
    assert got == sorted(want, key=str)


def test_labels_of_whole_and_changed_notices(spark):
    w = MIT.split()
    rows = [(0, MIT), (1, " ".join(w[:30] + ["indeed"] + w[30:50] + w[52:])), (2, " ".join(w[:20])), (3, "Licensed under CC BY-NC 4.0."), (4, "GNU Lesser General Public License"), (5, "plain")]
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {0: "mit", 1: "mit", 2: "", 3: "cc-by,cc-by-nc", 4: "lgpl", 5: ""}


def test_other_templates_and_empty_tables(spark):
    assert scan_licenses(frame(spark, [])).collect() == []
    got = scan_licenses(frame(spark, [(1, "my own words here")]), [Template("mine", "own words")]).first()
    assert (got["labels"], got["n_base"], got["first_word"], got["score"]) == ("mine", 0, None, 1.0)
    with pytest.raises(ValueError):
        scan_licenses(frame(spark, []), [Template("x", "one")])


def test_only_built_in_functions(spark):
    plan = scan_licenses(frame(spark, [(1, "cc by")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
