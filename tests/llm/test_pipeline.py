"""Each stage on the smallest tables against a plain version; queries with SQL against DuckDB."""

import duckdb
import pytest

import corpus_pipeline
from scrollmill.llm.queries import ORACLES, QUERIES

from ..conftest import DATA
from ..test_oracles import TABLES
from .conftest import words
from .test_ngram import sets


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    from scrollmill.llm._store import settle
    from scrollmill.llm.decontaminate import find_contamination
    from scrollmill.llm.toxicity import score, train

    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(settle(stage(spark, steps[-1], DATA), name))
    told = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    for s in steps[:-1]:
        assert s.columns == columns
    bad = {r["doc_id"] for r in score(docs, train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect() if r["predicted"]}
    assert set(told[1]) == set(told[0]) - bad
    ids = sorted(told[1])
    s = sets([(d, told[1][d]["text"]) for d in ids], 5)
    alike = [(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids[:x]) if s[x] and s[y] and 5 * len(s[x] & s[y]) >= 4 * len(s[x] | s[y])]
    kept = set(told[2])
    assert not any(a in kept and b in kept for a, b in alike)
    assert set(ids) - kept <= {d for pair in alike for d in pair}
    seen = set()
    for d in sorted(told[3]):
        w = words(told[3][d]["text"])
        here = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        assert told[3][d]["n_chars"] == len(told[3][d]["text"])
        assert told[3][d]["text"] == told[2][d]["text"] or len(told[3][d]["text"]) < len(told[2][d]["text"])
        seen |= here
    dirty = {r["doc_id"] for r in find_contamination(steps[3], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect() if r["contaminated"]}
    assert set(told[4]) == set(told[3]) - dirty
    assert set(told[5]) == set(told[4])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    """Rows as Python values: numbers that may be null stay whole numbers."""
    ours, theirs = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    theirs = [tuple(dict(zip(theirs.columns, r, strict=True))[c] for c in ours.columns) for r in theirs.fetchall()]
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, theirs))


def test_stages_on_odd_rows(spark, corpus, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns go through every stage; so does an empty table."""
    from .conftest import frame

    rows = corpus + [(500, "x" * 60_000), (501, "go on " * 40_000)]
    labels = spark.createDataFrame([(k, 1, int(k == 3)) for k in range(40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    passage = " ".join(words(rows[52][1])[60:80])
    spark.createDataFrame([("a", passage, 1), ("b", None, 2), (None, passage, 3), ("c", "", 4)], "item_id string, text string, doc_id int").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (rows, []):
        docs = frame(spark, table)
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = stage(spark, docs, str(tmp_path))
            docs.write.mode("overwrite").parquet(str(tmp_path / f"{len(table)}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{len(table)}-{name}"))
            assert docs.count() <= before
            if name == "ngram_jaccard":
                assert {r["doc_id"] for r in docs.collect()} >= ({160, 161, 162, 163, 500} if table else set())
