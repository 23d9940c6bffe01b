import random

import pytest
from pyspark.sql import functions as F

from scrollmill.operators import elements as E

CLAUDE = """<!doctype html><title>Plans - Claude</title><body><main><h1>Plans for\n spring</h1>
<div data-testid="user-message" data-message-id="k1"><p>Which  seeds? \t
Two lines</p><span class="file-chip">+ Add</span><div data-file-name="list.pdf">list.pdf 4.1 KB <a href="/f/list">open</a></div></div>
<div data-testid="assistant-message" data-message-id="k2"><details><summary>Thinking</summary>
   Beans want warm  soil, so wait.
   Peas do not.
</details><p>Peas first.</p><button>Copy</button><div class="tool-call" data-tool="search"> 3 hits </div>
<img src="data:image/png;base64,x" alt="Bed plan"><img src="/far.png" alt="far"><script>track()</script></div>
<div data-testid="narrator" data-message-id="k3"><p>not a turn</p></div>
<div data-testid="user-message-old" data-message-id="k4"><p>old</p></div>
<div data-testid="user-message"><p>no key</p><details>short</details><span class="attachment">3.14 MB</span><span class="attachment">notes.txt notes.txt</span></div>
</main></body>"""
NESTED = '<div role="main"><div data-message-author-role="assistant" data-message-id="1">out <div data-message-author-role="user">in <b>deep</b></div> after</div><div data-message-author-role="tool" data-message-id="3">t</div></div>'
PAGES = [(1, CLAUDE), (2, NESTED), (3, "<p>no turns"), (4, None), (5, ""), (6, '<body><div data-message-author-role="alien">x</div></body>')]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return E.elements(pages).cache()


def adapter(name):
    return next(a for a in E.ADAPTERS if a.name == name)


def test_intervals(nodes):
    rows = nodes.where("page_id = 2").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(rows))) and rows[0]["last"] == len(rows) - 1
    inner = next(r for r in rows if r["attrs"].get("data-message-author-role") == "user")
    assert "".join(r["text"] for r in rows[inner["id"] : inner["last"] + 1] if r["tag"] == E.TEXT) == "in deep"
    assert nodes.where("page_id in (4, 5)").count() == 2


def test_turns_of_a_chat_page(nodes):
    turns = E.known_turns(E.read_turns(nodes.where("page_id = 1"), adapter("claude"))).orderBy("turn").collect()
    assert [(t["turn"], t["role"], t["turn_key"]) for t in turns] == [(0, "user", "k1"), (1, "assistant", "k2"), (2, "user", "index:3")]
    first, second, third = turns
    assert first["body"] == "Which  seeds?\nTwo lines" and first["reasoning"] is None and first["calls"] is None
    assert [tuple(a) for a in first["attachments"]] == [("list.pdf", None, 4100, "/f/list", False)]
    assert second["reasoning"] == "Beans want warm soil, so wait.\nPeas do not."
    assert "Peas first." in second["body"] and "Copy" not in second["body"] and "track" not in second["body"]
    assert [tuple(a) for a in second["attachments"]] == [("Bed plan", "image", None, None, True)]
    assert [tuple(c) for c in second["calls"]] == [("search", None, "3 hits")]
    assert third["reasoning"] is None and [a["name"] for a in third["attachments"]] == ["notes.txt"]


def test_messages_within_messages_belong_to_both(nodes):
    turns = E.known_turns(E.read_turns(nodes.where("page_id = 2"), adapter("chatgpt"))).orderBy("turn").collect()
    assert [(t["role"], t["body"]) for t in turns] == [("assistant", "out in deep after"), ("user", "in deep"), ("user", "t")]


def test_confidence_and_titles(pages, nodes):
    got = {r["page_id"]: (r["ok"], r["score"], r["warnings"]) for r in E.turn_confidence(pages, E.read_turns(nodes, adapter("claude"))).collect()}
    assert got[1] == (True, 0.5, ['Turn 3 had an unrecognised role "user-message-old" and was skipped.', "1 of 4 messages had no recognisable role.", "Messages carry no stable identifier, so a long conversation may be captured with duplicates."])
    assert all(got[k] == (False, 0.0, ["No messages matched. The site layout has probably changed."]) for k in (2, 3, 4, 5))
    got = {r["page_id"]: (r["ok"], r["score"]) for r in E.turn_confidence(pages, E.read_turns(nodes, adapter("chatgpt"))).collect()}
    assert got[2] == (True, 0.7) and got[6] == (False, 0.0)
    names = {r["page_id"]: r["title"] for r in E.titles(nodes, adapter("claude")).collect()}
    assert names == {1: "Plans for\n spring"}
    plain = E.elements(pages.sparkSession.createDataFrame([(1, "<title>Plans - ChatGPT</title><body>x")], "page_id long, html string"))
    assert E.titles(plain, adapter("chatgpt")).first()["title"] == "Plans"


def test_joins_by_place_same_as_brute_force(spark):
    """Random trees: every node's closest selected element, with itself and without, and whether any encloses it."""
    rng = random.Random(3)
    rows = []
    for page in range(12):
        n = rng.choice([1, 5, 40, 120])
        parent = [-1] + [rng.randrange(max(0, k - rng.choice([1, 3, 9])), k) for k in range(1, n)]
        # Renumber in document order.
        kids = {k: [c for c in range(n) if parent[c] == k] for k in range(n)}
        order, last, stack = {}, {}, [(0, False)]
        while stack:
            k, done = stack.pop()
            if done:
                last[k] = len(order) - 1
            else:
                order[k] = len(order)
                stack += [(k, True), *((c, False) for c in kids[k])]
        rows += [(page, order[k], last[k], rng.random() < 0.3) for k in range(n)]
    nodes = spark.createDataFrame(rows, "page_id int, id int, last int, chosen boolean")
    outer = nodes.where("chosen").select("page_id", "id", "last")
    for strict in (False, True):
        got = {(r["page_id"], r["id"]): r["outer"] for r in E.enclosing(nodes, outer, strict=strict).collect()}
        want = {}
        for p, i, _, _ in rows:
            over = [o for q, o, l, c in rows if c and q == p and (o < i or o == i and not strict) and i <= l]
            want[p, i] = max(over, default=None)
        assert got == want
    got = {(r["page_id"], r["id"]): r["any"] for r in nodes.withColumn("any", E.below_any(F.col("chosen"), ["page_id"])).collect()}
    assert got == {(p, i): any(c and q == p and o <= i <= l for q, o, l, c in rows) for p, i, _, _ in rows}
    pairs = {(r["page_id"], r["id"], r["over"]) for r in E.ancestors(outer).collect()}
    assert pairs == {(p, i, o) for p, i, _, c in rows if c for q, o, l, d in rows if d and q == p and o <= i <= l}


MATH = [
    ('<p>Say <span class="katex"><span class="katex-mathml"><math><semantics><mrow><mi>E</mi></mrow><annotation encoding="application/x-tex">E = mc^2</annotation></semantics></math></span><span class="katex-html">E=mc2</span></span> now</p>', "Say $E = mc^2$ now"),
    ('<p><span class="katex-display"><span class="katex"><annotation encoding="application/x-tex"> a </annotation></span></span></p>', "$$ a $$"),
    ('<p>x <script type="math/tex">y^2</script> z</p>', "x $y^2$ z"),
    ('<p>x <mjx-container><mjx-math>drawn</mjx-math></mjx-container>z</p>', "x z"),
    ('<p><math><annotation encoding="application/x-tex">q</annotation></math></p>', "$$ q $$"),
    ('<p>c <span class="katex"><annotation encoding="application/x-tex">a $ b</annotation></span></p>', "c a $ b"),
    ("<p>no math</p>", "no math"),
]


def test_math_as_text_and_in_markdown(spark):
    from scrollmill.functions.html import to_markdown

    pages = spark.createDataFrame([(k, html) for k, (html, _) in enumerate(MATH)], "page_id long, html string")
    nodes = E.recover_math(E.elements(pages))
    texts = nodes.where("tag = '#text'").groupBy("page_id").agg(E._said().alias("t"))
    assert [r["t"] for r in texts.orderBy("page_id").collect()] == [want for _, want in MATH]
    assert [to_markdown(html) for html, _ in MATH] == [want for _, want in MATH]
    assert to_markdown(f'<p><span class="katex"><annotation encoding="application/x-tex">{"a" * 1001}</annotation></span></p>') == "a" * 1001
