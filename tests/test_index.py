import sqlite3

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scrollmill.operators import search as S
from scrollmill.operators.stored_index import BUCKETS, StoredIndex

SCHEMA = "path string, turn long, role string, body string"
ROWS = [
    ("a.md", 0, "user", "How do actors work? Running and jumping"),
    ("a.md", 1, "assistant", "An actor owns its state; actors run."),
    ("b.md", 0, "user", "Actors and States, Łódź café ő"),
    ("c.md", 0, "user", None),
    ("d.md", 0, "user", "the running of the actors in the city"),
    ("d.md", 1, "user", ""),
]
QUERIES = [("actors", {}), ("ACTORS", {}), ("run", {"stemmed": True}), ("the actors", {}), ("of/the", {}), ("act*", {"prefix": True}), ("ru* actor", {"prefix": True, "stemmed": True}), ("cafe o", {}), ("CAFÉ", {}), ("missing", {}), ('"- actors"', {})]


def told(df):
    return sorted((r["path"], r["turn"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture
def index(spark, tmp_path):
    return StoredIndex(spark, f"file://{tmp_path}/index")


def test_same_as_search_over_messages(spark, index):
    assert index.latest() is None and index.search("actors").collect() == []
    rows = spark.createDataFrame(ROWS, SCHEMA)
    index.refresh(rows)
    bodies = rows.withColumn("body", F.coalesce("body", F.lit("")))
    for q, options in QUERIES:
        assert told(index.search(q, **options)) == told(S.bm25(bodies, q, ["path", "turn"], **options)), q
    now = index.latest()
    assert (now.messages, now.words) == (6, sum(len([w for w in (r[3] or "").replace("?", "").replace(";", "").split()]) for r in ROWS))
    with pytest.raises(ValueError):
        index.search(' " ')


def test_refresh_rewrites_changed_buckets_only_and_equals_a_new_index(spark, index, tmp_path):
    many = [(f"n{k}", 0, "user", f"word{k} other{k}") for k in range(200)]
    index.refresh(spark.createDataFrame(ROWS + many, SCHEMA))
    first = index.latest()
    changed = [("a.md", 0, "user", "actors changed"), ("e.md", 0, "user", "new actors")]
    index.refresh(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([("d.md",), ("never.md",)], "path string"))
    second = index.latest()
    moved = {k for k, g in second.held.items() if g == second.name}
    assert moved and all(second.held[k] == first.name for k in first.held.keys() - moved)
    assert len({b for k, b in moved if k == "postings"}) < BUCKETS // 2
    now = [r for r in ROWS + many if r[0] not in ("a.md", "d.md")] + changed
    fresh = StoredIndex(spark, f"file://{tmp_path}/fresh")
    fresh.refresh(spark.createDataFrame(now, SCHEMA))
    for what, by in (("postings", ["term", "path", "turn"]), ("documents", ["path"]), ("terms", ["term"])):
        assert index.read(what).orderBy(by).collect() == fresh.read(what).orderBy(by).collect(), what
    assert (second.messages, second.words) == (fresh.latest().messages, fresh.latest().words)
    for q, options in QUERIES:
        assert told(index.search(q, **options)) == told(fresh.search(q, **options)), q
    # The same refresh again, and one that removes everything.
    index.refresh(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([("d.md",)], "path string"))
    assert told(index.search("actors")) == told(fresh.search("actors"))
    index.refresh(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(r[0],) for r in now], "path string"))
    assert (index.latest().messages, index.latest().words) == (0, 0) and index.search("actors").collect() == [] and index.read("postings").count() == 0


def test_a_pass_that_dies_changes_nothing(spark, index, tmp_path, monkeypatch):
    index.refresh(spark.createDataFrame(ROWS, SCHEMA))
    before, want = index.latest(), told(index.search("actors"))
    write = StoredIndex._write

    def broken(self, rows, path, order):
        if path.endswith("documents"):
            raise OSError("lost")
        write(self, rows, path, order)

    monkeypatch.setattr(StoredIndex, "_write", broken)
    with pytest.raises(OSError):
        index.refresh(spark.createDataFrame([("z.md", 0, "user", "actors")], SCHEMA))
    monkeypatch.undo()
    assert index.latest() == before and told(index.search("actors")) == want
    index.refresh(spark.createDataFrame([("z.md", 0, "user", "actors")], SCHEMA))
    assert len(told(index.search("actors"))) == len(want) + 1
    assert len(index.vacuum()) == 1 and len(told(index.search("actors"))) == len(want) + 1


def test_plan_prunes_buckets_and_positions_are_delta_coded(spark, index, tmp_path):
    index.refresh(spark.createDataFrame(ROWS, SCHEMA))
    plan = index.search("actors run", stemmed=True)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket#" in plan or "PartitionFilters: [bucket#" in plan
    assert "EqualTo(stem,actor)" in plan and "EqualTo(stem,run)" in plan and "PushedFilters" in plan
    file = next(tmp_path.glob("index/*/postings/bucket=*/*.parquet"))
    column = next(c for c in (pq.ParquetFile(file).metadata.row_group(0).column(k) for k in range(7)) if c.path_in_schema.startswith("positions"))
    assert "DELTA_BINARY_PACKED" in column.encodings


def test_same_as_fts5_with_accents(spark, index):
    index.refresh(spark.createDataFrame(ROWS, SCHEMA))
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(path unindexed, turn unindexed, body, tokenize = 'porter unicode61')")
    db.executemany("insert into f values (?, ?, ?)", [(p, t, b or "") for p, t, _, b in ROWS])
    for q in ("actors", "run", "states", "cafe", "o", "the actors"):
        phrase = " ".join(f'"{w}"' for w in q.split())
        want = sorted((p, t, round(s, 6)) for p, t, s in db.execute("select path, turn, bm25(f) from f where f match ?", (phrase,)))
        assert [(p, t, round(s, 6)) for p, t, s in told(index.search(q, stemmed=True))] == want, q
