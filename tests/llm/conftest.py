import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n string, `row` int, key string, sig string, ROW_ int, _row int, spans string, label string"


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "n", 1, "k", "s", 2, 3, "x", "y") for i, t in rows], DOCS.replace("ROW_", "link"))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, repeated words, empty, null, one-word and long texts, repeated rows, null ids."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, long = text(300), text(70), text(6000)
    rows = [(k, text(rng.randrange(5, 200))) for k in range(40)]
    rows += [(100 + k, base) for k in range(6)]
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((120 + k, " ".join(w)))
    rows += [(140 + k, f"{text(60)} {passage} {text(80)}") for k in range(8)]
    rows += [(160, None), (161, ""), (162, " \n\t"), (163, "one"), (164, "one"), (165, "One two three"), (166, "one  TWO\nthree"), (167, "go " * 300), (168, "go " * 280), (169, long), (170, long + " tail")]
    rows += [(0, rows[0][1]), (None, base), (None, text(60)), (171, "naïve café élan " * 30)]
    return rows
