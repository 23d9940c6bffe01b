import sqlite3

import pytest
from pyspark.sql import functions as F

from scrollmill.functions import text as T
from scrollmill.functions.html import to_markdown
from scrollmill.operators.pages import extract_pages, find_content
from scrollmill.functions.porter import stem
from scrollmill.operators import archive as A
from scrollmill.operators import render as R
from scrollmill.operators import search as S
from scrollmill.sources.files import frame, frames, markdown_folder, richest
from scrollmill.streaming.accumulate import accumulate, upsert_latest

from .conftest import DATA


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("a  b\n\nc", "a b\nc"), ("a b\n   \nc  ", "a b\nc"), ("a\r\nb\tc", "a\nb c"), ("", ""), ("Fix", "Fix"), (None, None)])
def test_normalise(spark, text, want):
    assert one(spark, text, T.normalise) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("# Title", True), ("```\nx", True), ("- item", True), ("1. item", True), ("> quote", True), ("| a | b |", True), ("* * *", True), ("plain prose", False), ("a * b", False), ("", False), (None, False)],
)
def test_looks_like_markdown(spark, text, want):
    assert one(spark, text, T.looks_like_markdown) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [("```swift\nx\n```", ["code", "swift"]), ("~~~\nx", ["code"]), ("```brainfuck\nx", ["code"]), ("| a | b |\n", ["table"]), ("use foo | bar in a pipe", []), ("$x$", ["math"]), ("![alt](image.png)", ["image"]), ("word " * 6000, ["long"])],
)
def test_tags(spark, text, want):
    assert one(spark, text, T.body_tags) == want


@pytest.mark.parametrize(
    ("value", "want"), [("plain", "plain"), ("2026", '"2026"'), ("true", '"true"'), ("", '""'), (" a", '" a"'), ("a: b", '"a: b"'), ("#x", '"#x"'), ('say "x": y', '"say \\"x\\": y"'), ("1.5e3", '"1.5e3"'), ("a#b", "a#b")]
)
def test_quoting(spark, value, want):
    assert one(spark, value, T.quote_if_needed) == want


@pytest.mark.parametrize(("name", "want"), [("a/b:c", "a b c"), ("Just a sentence.", "Just a sentence"), ("..hidden", "hidden"), ("con", "_con"), ("a\nb", "a b"), ("word " * 30, ("word " * 16).strip())])
def test_filenames(spark, name, want):
    assert one(spark, name, T.safe_filename) == want


def test_small_functions(spark):
    assert one(spark, "4.1 KB", T.parse_size) == 4100
    assert one(spark, "An Article — The Site", T.strip_site) == "An Article"
    assert one(spark, "a b", T.encode_url) == "a%20b"
    assert one(spark, "x``y", T.code_span) == "```x``y```"
    assert one(spark, "````", T.fence_width) == 5
    assert one(spark, "perplexity", T.display_name) == "Perplexity"
    assert one(spark, "x.png", T.attachment_kind) == "image"


def test_frontmatter(spark):
    text = '---\ntitle: "A: b"\nwarning: one\nwarning: two\n---\nbody'
    assert one(spark, text, R.parse_frontmatter) == {"title": "A: b", "warning": "one\x01two"}
    assert one(spark, text.replace("\n", "\r\n"), R.parse_frontmatter)["title"] == "A: b"
    assert one(spark, "---\nnever closed", R.parse_frontmatter) is None
    assert one(spark, "---\n---\nx", R.parse_frontmatter) == {}
    assert one(spark, text, R.strip_frontmatter) == "body"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Hello <b>world</b> ok</p>", "Hello **world** ok"),
        ("<ul><li>Parent<ul><li>Child</li></ul>Tail</li><li>Next</li></ul>", "- Parent\n  - Child\n\n  Tail\n- Next"),
        ("<ol start='5'><li>fifth</li><li>sixth</li></ol>", "5. fifth\n6. sixth"),
        ("<table><tr><td>a|b</td><td>c</td></tr></table>", "| a\\|b | c |\n| --- | --- |"),
        ("<table><tr><td></td></tr></table>", None),
        ("<h2>T</h2><p>x &amp; y</p><script>1</script>", "## T\n\nx & y"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p>a &amp b &ampx; &lt;&#x27;&eacute; &quot</p>", "a &amp b &ampx; <'é &quot"),
        ("<p>&nope; &notit; x && y &amp;amp;</p>&copy", "&nope; &notit; x && y &amp;\n\n&copy"),
        ('<a href="/u?a=1&copy=2&amp;b">w&#</a>', "[w&#](/u?a=1&copy=2&b)"),
        ("<pre><code>\ue000 & &am</code></pre>", "```\n\ue000 & &am\n```"),
        ('<a href="javascript:x">t</a> <a href="/u v">w</a>', "t [w](/u%20v)"),
        ("<pre><code class='language-py'>x = 1</code></pre>", "```py\nx = 1\n```"),
        ("", None),
        (None, None),
    ],
)
def test_html(html, want):
    assert to_markdown(html) == want


def test_hostile_html():
    assert to_markdown("<div>" * 3000 + "still here") == "still here"
    assert to_markdown("<div></div>" * 3000) is None


def test_region(spark):
    page = "<nav><a>x</a></nav><article><p>" + "words and more " * 40 + "</p><p>b</p></article>"
    inside = "<aside><article><p>in aside " + "word " * 100 + "</p><button>b</button></article></aside>"
    links = "<div id=a><p>some text here</p></div><div><a href=x>only a link</a></div><td class=sidebar>text</td>"
    rows = [(1, page), (2, "<p></p>"), (3, None), (4, inside), (5, links), (6, "<title>T — Site</title><main>" + "x " * 300 + "</main>"), (7, "<div>" * 300 + "deep")]
    found = {r["page_id"]: r for r in find_content(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    told = {r["page_id"]: r for r in extract_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert found[1]["score"] > 0.5 and found[1]["region"] == 3 and told[1]["markdown"].startswith("words and more")
    assert found[2]["region"] is None and found[3]["region"] is None and not told[2]["ok"] and told[3]["markdown"] is None
    assert found[4]["region"] == 2 and told[4]["markdown"].endswith("word")
    assert told[5]["markdown"] == "some text here" and told[5]["warnings"] == ["The main content region scored 0.60, below 0.6.", "The extracted region is very short."][told[5]["score"] >= 0.6 :]
    assert told[6]["title"] == "T" and told[7]["markdown"] == "deep"


def test_stemmer_and_search_agree_with_fts5(spark):
    texts = [r[0] for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("text").collect()]
    texts += ["running and jumping", "Café actors hopping relational conditionally", "generalizations of oscillators", "the async/await"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, body) values (?, ?)", list(enumerate(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    for q, m in [("the", '"the"'), ("run", '"run"'), ("the that", '"the" "that"'), ("async/await", '"async/await"'), ("await/async", '"await/async"'), ("cafe", '"cafe"')]:
        want = {k: v for k, v in db.execute("select rowid, bm25(f) from f where f match ?", (m,))}
        got = {r["id"]: r["score"] for r in S.bm25(rows, q, ["id"], stemmed=True).collect()}
        assert set(got) == set(want), q
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), q
    with pytest.raises(ValueError):
        S.query_phrases(' "" ')


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("adjustment", "adjust"), ("controll", "control"), ("sky", "sky")])
def test_stem(word, want):
    assert stem(word) == want


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "sub" / "b.MD").write_text("y")
    (tmp_path / "c.txt").write_text("z")
    (tmp_path / ".hidden.md").write_text("h")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00\x01")
    found = {r["path"].rsplit("/", 1)[1]: (r["content"], r["failed"]) for r in markdown_folder(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.md": ("x", False), "b.MD": ("y", False), "bad.md": (None, True)}
    assert markdown_folder(spark, f"file://{tmp_path}/none").count() == 0


def test_frames(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("é",)], "j string").select(frame(F.col("j")).alias("f")).collect()
    data = b"".join(bytes(r["f"]) for r in rows)
    files = spark.createDataFrame([("p", data), ("cut", data[:-1]), ("zero", b"\0\0\0\0"), ("none", b"")], "path string, content binary")
    got = sorted((r["path"], r["frame_no"], r["message"], r["error"]) for r in frames(files).collect())
    assert got == [("cut", 0, '{"a":1}', None), ("cut", 1, None, "cut short"), ("p", 0, '{"a":1}', None), ("p", 1, "é", None), ("zero", 0, None, "empty")]


def test_richest(spark):
    rows = spark.createDataFrame([("# md", "h", "r"), ("plain", "h", "r"), ("plain", None, "r"), ("plain", "", None), (None, None, None)], "p string, h string, r string")
    assert [r[0] for r in rows.select(richest(F.col("p"), F.col("h"), F.col("r"))).collect()] == ["# md", "h", "r", "plain", None]


def test_decisions(spark):
    turn = "conv_id long, turn long, role string, body string"
    base = [(k, 0, "user", "Explain actors") for k in range(1, 6)]
    existing = spark.createDataFrame([*base, (5, 1, "assistant", "x")], turn).withColumn("intact", F.col("conv_id") != 3)
    incoming = [(1, 0, "user", " Explain   actors\n"), (2, 0, "user", "Explain actors"), (2, 1, "assistant", "More"), (3, 0, "user", "Explain actors"), (4, 0, "user", "Other"), (5, 0, "user", "Explain actors"), (6, 0, "user", "New")]
    got = {r["conv_id"]: r["action"] for r in A.decide(existing, spark.createDataFrame(incoming, turn)).collect()}
    assert got == {1: "unchanged", 2: "append", 3: "write_alongside", 4: "write_alongside", 5: "write_alongside", 6: "write_new"}


def test_index_upkeep(spark):
    old = spark.createDataFrame([("/a/1", 1.0, 1), ("/a/2", 1.0, 1), ("/b/1", 1.0, 1)], "path string, mtime double, byte_size long")
    seen = spark.createDataFrame([("/a/1", 1.0000000001, 1), ("/a/3", 2.0, 2)], "path string, mtime double, byte_size long")
    assert [r["path"] for r in A.missing_paths(old, seen, "/a").collect()] == ["/a/2"]
    assert sorted(r["path"] for r in A.replace_by_path(old, seen).collect()) == ["/a/1", "/a/2", "/a/3", "/b/1"]
    assert {r["path"]: r["status"] for r in A.index_delta(old, seen).collect()} == {"/a/1": "unchanged", "/a/2": "removed", "/a/3": "added", "/b/1": "removed"}


def test_styled_lines(spark):
    lines = [("d", 0, "Title", 24.0, True, False, 0.0, 0.0), ("d", 1, "some longer body text here", 12.0, False, False, 0.0, 0.0), ("d", 2, "x = 1", 12.0, False, True, 0.0, 0.0), ("d", 3, "• item", 12.0, False, False, 0.0, 0.0), ("d", 4, "said", 12.0, False, False, 20.0, 20.0)]
    got = R.styled_lines(spark.createDataFrame(lines, "doc string, line_no int, text string, size double, bold boolean, mono boolean, first_indent double, head_indent double"))
    assert [(r["kind"], r["level"]) for r in got.orderBy("line_no").collect()] == [("heading", 1), ("body", None), ("code", None), ("list", None), ("quote", None)]


def test_stream_keeps_latest(spark, tmp_path):
    import random

    rng = random.Random(7)
    rows = [(f"k{k % 40}", n, f"text {n}", k % 40) for n, k in enumerate(rng.choices(range(200), k=400))] + [("", 999, "x", 0), (None, 999, "x", 0)]
    rng.shuffle(rows)
    schema = "key string, seq long, body string, position long"
    for n in range(4):
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = accumulate(stream).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("latest").groupBy("key").agg(F.max_by("body", "sightings").alias("body"), F.max("sightings").alias("n"))
    want = {}
    for key, seq, body, _ in rows:
        if key and seq >= want.get(key, (-1,))[0]:
            want[key] = (seq, body)
    assert {r["key"]: r["body"] for r in got.collect()} == {k: v[1] for k, v in want.items()}
    batch = spark.createDataFrame(rows, schema)
    state = upsert_latest(batch, upsert_latest(batch, None))
    assert {r["key"]: r["body"] for r in state.collect()} == {k: v[1] for k, v in want.items()}


def test_other_models_do_not_match(spark):
    from scrollmill.operators.archive import decide, match_existing

    rows = lambda key, model: spark.createDataFrame([(key, k, "user", f"turn {k}", "web", model, True) for k in range(4)], "conv_id long, turn long, role string, body string, source string, model string, intact boolean")
    file = lambda model: rows(7, model).withColumnRenamed("conv_id", "file")
    assert [tuple(r) for r in match_existing(file("a"), rows(1, "a")).collect()] == [(1, 7, "exact")]
    assert match_existing(file("a"), rows(1, "b")).collect() == []
    assert {r["action"] for r in decide(rows(1, "a"), rows(1, "b").drop("intact")).collect()} == {"write_alongside"}
