import json

from pyspark.sql import functions as F

from scrollmill.operators import saving as V


def test_requests(spark):
    ok = {"version": 1, "id": "a", "action": "saveConversation", "conversation": {"title": "t", "source": "claude", "turns": [{"role": "user", "body": "hi"}]}}
    said = [ok, ok | {"version": 2}, ok | {"action": "dance"}, {"version": 1, "id": "b", "action": "saveConversation"}, {"version": 1, "id": "c", "action": "searchArchive", "query": " "}, {"version": 1, "action": "ping"}]
    rows = spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(said)] + [(6, "{broken"), (7, None)], "k int, message string")
    got = {r["k"]: r["error"] for r in V.read_requests(rows).collect()}
    assert got == {0: None, 1: "unsupportedVersion", 2: "unknownAction", 3: "missingConversation", 4: "missingQuery", 5: "missingId", 6: "malformed", 7: "malformed"}


def test_destinations_and_names(spark):
    rows = spark.createDataFrame([("work", None), (None, "/x"), ("none", None)], "preset string, destination string")
    got = [tuple(r)[2:] for r in V.resolve_destination(rows, {"work": ("/w", "daily")}, ("/d", "separate")).collect()]
    assert got == [("/w", "daily"), ("/x", "separate"), ("/d", "separate")]
    wanted = spark.createDataFrame([("/d", "a.md", 1), ("/d", "a.md", 2), ("/d", "b.md", 3)], "folder string, name string, k int")
    taken = spark.createDataFrame([("/d", "a.md"), ("/d", "a (2).md")], "folder string, name string")
    assert {r["k"]: r["final"] for r in V.free_names(wanted, taken, "k").collect()} == {1: "a (3).md", 2: "a (4).md", 3: "b.md"}


def test_log_and_tool_calls(spark):
    logs = spark.createDataFrame([("p", "one\n")], "path string, content string")
    entries = spark.createDataFrame([("p", 2, "three"), ("p", 1, "two"), ("q", 1, "x")], "path string, seq int, body string")
    assert {r["path"]: r["content"] for r in V.append_log(logs, entries).collect()} == {"p": "one\n\ntwo\n\nthree", "q": "x"}
    call = "struct<name:string,input:string,output:string>"
    rows = spark.createDataFrame([((("run", "ls `x`", "out")),)], f"c {call}").select(F.concat(V.tool_call(F.col("c")), F.lit("\n\nbody")).alias("b"))
    assert [tuple(c) for c in rows.select(V.read_tool_calls(F.col("b")).alias("c")).first()["c"]] == [("run", "ls `x`", "out")]
    att = "array<struct<name:string,kind:string,byteSize:bigint,url:string,inline:boolean>>"
    text = spark.createDataFrame([([("a.png", "image", 10, "http://h/a b", False)],)], f"a {att}").select(V.attachments(F.col("a")).alias("t")).first()["t"]
    assert text == "Attachments:\n\n- `a.png` (image, 10 bytes) <http://h/a%20b>"


def test_plain_data_and_defaults(spark):
    deep = lambda n: '{"a":' + "[" * n + "1" + "]" * n + "}"
    rows = spark.createDataFrame([(1, deep(7)), (2, deep(8)), (3, deep(12)), (4, "{broken"), (5, None), (6, '{"a":[null,"x",true,1.5,{"b c":[[]]}]}'), (7, '{"a":[1,1e999]}')], "id int, message string")
    got = {(r["id"], r["path"], r["error"]) for r in V.plain_data_errors(rows).collect()}
    assert {g for g in got if g[0] < 7} == {(2, "conversation.a" + "[0]" * 8, "nested too deeply"), (3, "conversation.a" + "[0]" * 8, "nested too deeply"), (4, "conversation", "malformed"), (5, "conversation", "malformed")}
    # A number beyond a double does not parse, or is told: either way it does not cross.
    assert {g[0] for g in got} >= {7}
    said = [
        {"source": "unheard of", "turns": [{"role": "user", "body": "hi"}], "confidence": {"score": 7, "complete": True, "strategy": "dom"}},
        {"turns": [{"role": "alien", "body": "hi"}, {"role": "user"}, {"body": "x", "format": "html"}]},
        {"source": "web"},
    ]
    read = V.decode_conversations(spark.createDataFrame([(k, json.dumps(s)) for k, s in enumerate(said)] + [(3, "{"), (4, None)], "k int, message string")).orderBy("k").collect()
    first = read[0]["conversation"]
    assert (first["source"], first["turns"][0]["format"], first["turns"][0]["toolCalls"], first["turns"][0]["attachments"], first["confidence"]["score"], first["confidence"]["warnings"]) == ("unheard of", "markdown", [], [], 1.0, [])
    assert [r["errors"] for r in read] == [[], ["source: missing", "turns[0].role: unknown", "turns[1].body: missing", "turns[2].role: missing"], ["turns: missing"], ["malformed"], ["malformed"]]
    assert read[1]["conversation"]["turns"][2]["format"] == "html"


def test_any_number_of_warnings(spark):
    from scrollmill.operators import render as R

    rows = spark.createDataFrame([(1, [f"w: {k}" for k in range(40)]), (2, []), (3, None)], "path int, w array<string>")
    got = {r["path"]: r["warnings"] for r in R.metadata(rows.select("path", R.frontmatter([("title", F.lit("t"))], F.col("w")).alias("document"))).collect()}
    assert got == {1: [f"w: {k}" for k in range(40)], 2: [], 3: []}


def test_turns_read_back_whatever_they_begin_with(spark):
    from scrollmill.operators import render as R

    hard = ["plain", "Attachments:\n\n- `a` (file)", "Attachments:", "<!-- reasoning -->\n\nx\n\n<!-- /reasoning -->", "<!-- body -->\n\nAttachments:", "<!-- body -->", "```tool\n{}\n```", "````tool\nx\n````\nmore", "a\n\nAttachments:\n\n- `b`"]
    why = [None, "because", "so <!-- /reasoning --> <!-- //x --> end", "<!-- reasoning -->"]
    call, file = "struct<name:string,input:string,output:string>", "struct<name:string,kind:string,byteSize:bigint,url:string>"
    rows = [(n, (b, w, [("run", "ls", "out")] if n % 2 else [], [("f.txt", "file", 3, None)] if n % 3 else [])) for n, (b, w) in enumerate((b, w) for b in hard for w in why)]
    table = spark.createDataFrame(rows, f"n int, t struct<body:string,reasoning:string,toolCalls:array<{call}>,attachments:array<{file}>>")
    for r in table.select("n", "t", R.decode_turn(R.render_turn(F.col("t"))).alias("d")).collect():
        assert {k: r["d"][k] for k in ("body", "reasoning", "toolCalls", "attachments")} == r["t"].asDict(), r["n"]


def test_several_sections_of_one_note(spark):
    from scrollmill.operators import render as R

    notes = spark.createDataFrame([("p", "Mine.\n\n<!-- section:1 -->\n## One\n\nold\n<!-- /section -->\nend"), ("q", None)], "path string, note string")
    sections = spark.createDataFrame([("p", 2, "Two", "b"), ("p", 1, "One", "new"), ("p", 3, "Two", "b and more"), ("q", 5, "Q", "x"), ("q", 6, "Q", "y"), ("r", 7, "R", "z")], "path string, key int, title string, body string")
    out = R.upsert_sections(notes, sections)
    got = {r["path"]: (r["actions"], r["note"]) for r in out.collect()}
    s = lambda key, title, body: f"<!-- section:{key} -->\n## {title}\n\n{body}\n<!-- /section -->"
    assert got["p"] == (["replace", "insert", "replace"], f"Mine.\n\n{s(1, 'One', 'new')}\nend\n\n{s(3, 'Two', 'b and more')}\n")
    assert got["q"] == (["insert", "insert"], f"# q\n\n{s(5, 'Q', 'x')}\n\n{s(6, 'Q', 'y')}\n") and got["r"][1] == f"# r\n\n{s(7, 'R', 'z')}\n"
    again = {r["path"]: (r["actions"], r["note"]) for r in R.upsert_sections(out.select("path", "note"), sections.where("key <> 2")).collect()}
    assert all(set(again[p][0]) == {"unchanged"} and again[p][1] == got[p][1] for p in "pqr")


def test_presets_and_checks(spark, tmp_path):
    good = [{"name": "day", "path": "/d", "behaviour": "daily"}, {"name": "odd", "path": "/o", "behaviour": "dance"}, {"name": "day", "path": "/later", "behaviour": "append"}]
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps([*good, {"name": "no path"}]))
    (tmp_path / "broken.json").write_text("[{")
    read = lambda n: V.read_presets(spark, f"file://{tmp_path}/{n}")
    assert [tuple(r) for r in read("good.json").orderBy("place").collect()] == [(k, *p.values()) for k, p in enumerate(good)]
    assert [read(n).count() for n in ("bad.json", "broken.json", "none.json")] == [0, 0, 0]
    rows = spark.createDataFrame([(1, "day", None), (2, "odd", ""), (3, "unknown", None), (4, None, None), (5, "day", "/own")], "k int, preset string, destination string")
    with_presets = {r["k"]: (r["folder"], r["behaviour"], r["configured"]) for r in V.resolve_presets(rows, read("good.json"), "/default").collect()}
    assert with_presets == {1: ("/d", "daily", True), 2: ("/o", "separate", True), 3: ("/d", "daily", True), 4: ("/d", "daily", True), 5: ("/own", "separate", True)}
    without = V.resolve_presets(rows, read("none.json"), "/default")
    assert {r["k"]: (r["folder"], r["configured"]) for r in without.collect()} == {1: ("/default", False), 2: ("/default", False), 3: ("/default", False), 4: ("/default", False), 5: ("/own", True)}
    there = spark.createDataFrame([("/d", True, True), ("/o", True, False), ("/own", False, True)], "folder string, is_directory boolean, writable boolean")
    told = lambda d: {r["k"]: r["error"] for r in V.check_destinations(d, there).collect()}
    assert told(V.resolve_presets(rows, read("good.json"), "/default")) == {1: None, 2: "unwritable", 3: None, 4: None, 5: "unwritable"}
    assert told(without) == {1: "noDestination", 2: "noDestination", 3: "noDestination", 4: "noDestination", 5: "unwritable"}


def test_stripped_sections_and_definitions(spark):
    from scrollmill.functions.html import to_markdown
    from scrollmill.operators import render as R

    s = lambda key: f"<!-- section:{key} -->\n## T\n\nbody\n<!-- /section -->"
    notes = spark.createDataFrame([("p", f"a\n{s(1)}\nb\n{s(2)}\nc"), ("q", "nothing"), ("r", "<!-- section:1 -->\nnever closed"), ("s", s(1))], "path string, note string")
    keys = spark.createDataFrame([("p", 1), ("p", 2), ("p", 9), ("q", 1), ("r", 1)], "path string, key int")
    assert {r["path"]: r["note"] for r in R.strip_sections(notes, keys).collect()} == {"p": "a\n\nb\n\nc", "q": None, "r": None}
    assert to_markdown("<dl><dt>Term</dt><dd>what <b>it</b>\n means</dd><dt>Next</dt><dd>more</dd></dl><p>after</p>") == "**Term**\n  what **it** means\n**Next**\n  more\n\nafter"
