"""Every archive query with SQL gives the same rows as DuckDB, at the smallest scale."""

import duckdb
import pytest

import scrollmill.plans.library  # noqa: F401
from scrollmill.plans.queries import ORACLES, QUERIES

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("~" if v is None or v != v else repr(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


#: Headings and paragraphs that are cut within a reference, as some pages have them.
CUT = ["Tea &amp;&amp", "Tea &quo", "&lt", "&#x27;a&#x27", "&amp;lt; &amp;quot;&quot", "a && b &", "&ampx; &gt;&gt", "<b>R&amp;D</b> &amp"]


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory):
    import pandas as pd

    d = str(tmp_path_factory.mktemp("cut"))
    pages = [(k, f"https://example.net/{k}", f"<html><body><article><h1>{x}</h1><p>{x}</p></article></body></html>") for k, x in enumerate(CUT)]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(f"{d}/pages.parquet")
    return d


def test_page_turns_of_cut_references(spark, cut_pages):
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from '{cut_pages}/pages.parquet'")
        theirs = c.sql(ORACLES["page_turns"]).df()
    assert len(theirs) == 2 * len(CUT) and rows(QUERIES["page_turns"](spark, cut_pages).toPandas()) == rows(theirs)


def test_page_turns_nested_deeply(spark, tmp_path):
    """Paragraphs with bold text that is never closed lie within each other, 200 and more; what closes behind them is each its own."""
    import pandas as pd

    body = "<h1>T</h1>" + "".join(f"<p><b>open {k}.<br>" + f"<p>closed {k}.</p>" * (k % 3) for k in range(200)) + "<p>x.</p><p>y.</p>"
    pd.DataFrame([(1, "https://example.net/1", f"<html><body><article>{body}</article></body></html>")], columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
        theirs = c.sql(ORACLES["page_turns"]).df()
    assert len(theirs) > 400 and rows(QUERIES["page_turns"](spark, str(tmp_path)).toPandas()) == rows(theirs)


def test_recovered_math_of_cut_references(spark, cut_pages):
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from '{cut_pages}/pages.parquet'")
        theirs = c.sql(ORACLES["recovered_math"]).df()
    assert len(theirs) == len(CUT) and rows(QUERIES["recovered_math"](spark, cut_pages).toPandas()) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
