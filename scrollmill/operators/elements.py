"""Pages as tables of their elements and texts, and joins by where these stand in the page.

Every node has its number in document order and the last number below it, so a node is below another if its number lies
in that interval. Intervals nest or are apart. Two joins rest on that, each one pass over a page in order:

* whether a node is below any of some elements: the highest end of those that began before it is not before it;
* which of some elements encloses it most closely: the last that began and has not ended; ends give way to what encloses
  them.

A page is parsed once, in the task that reads it. A page is one partition's work, in time that grows with its nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.html import MATH_ALONE, MATH_CLASSES, MATH_SOURCES, MATH_TAGS, flat_nodes
from ..functions.markdown import believed_name, wrapped_math
from ..functions.text import parse_size

TEXT = "#text"
#: Nodes that a task holds before it hands them on, beside those of one page.
HELD = 10_000
_NODE = "id int, last int, tag string, attrs map<string,string>, text string"


def elements(pages: DataFrame, key: str = "page_id", depth: float = math.inf) -> DataFrame:
    """(key, id, last, tag, attrs, text) of every element and text of ``pages(key, html)``; texts have the tag ``#text``.

    A null page has only its root, number 0. What is nested deeper than ``depth``, the root included, lies side by side.
    """
    schema = StructType.fromJson(pages.select(key).schema.jsonValue())
    for f in StructType.fromDDL(_NODE).fields:
        schema.add(f)
    arrow = {"id": pa.int32(), "last": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, nodes = [], []
            for k, html in enumerate(batch.column("html")):
                found = flat_nodes(html.as_py() or "", depth)
                owners += [k] * len(found)
                nodes += found
                if len(nodes) >= HELD or k + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*nodes, strict=True), arrow.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owners)), *columns], [key, *arrow])
                    owners, nodes = [], []

    return pages.select(key, "html").mapInArrow(run, schema)


# -- selectors: what an adapter says of a node, as a condition on tag and attrs ----------------------------------------
@dataclass(frozen=True)
class Selector:
    """One alternative: a tag, a class, or an attribute that is there, equals, begins with or holds a value (in any case of letters)."""

    tag: str | None = None
    css_class: str | None = None
    attribute: str | None = None
    equals: str | None = None
    begins: str | None = None
    holds: str | None = None

    def matches(self) -> Column:
        hit = F.col("tag") != TEXT
        if self.tag is not None:
            hit = hit & (F.col("tag") == self.tag)
        if self.css_class is not None:
            hit = hit & F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), self.css_class)
        if self.attribute is not None:
            value = F.col("attrs")[self.attribute]
            hit = hit & value.isNotNull()
            for test, wanted in ((lambda w: value == w, self.equals), (lambda w: value.startswith(w), self.begins), (lambda w: F.lower(value).contains(w.lower()), self.holds)):
                if wanted is not None:
                    hit = hit & test(wanted)
        return F.coalesce(hit, F.lit(False))


def any_of(selectors: list[Selector]) -> Column:
    out = F.lit(False)
    for s in selectors:
        out = out | s.matches()
    return out


def _attr(name: str, **how: str) -> Selector:
    return Selector(attribute=name, **how)


# What is no part of a turn's body, holds a file, a thought or a call of a tool.
STRIP = [Selector("script"), Selector("style"), Selector("button"), _attr("role", equals="button"), _attr("data-testid", equals="copy-button")]
FILES = [_attr("data-testid", holds="attachment"), _attr("class", holds="attachment"), _attr("data-file-name")]
CARDS = [*FILES, _attr("class", holds="file-chip"), _attr("class", holds="fileCard")]
THOUGHTS = [Selector("details"), _attr("data-testid", holds="thinking"), _attr("class", holds="thinking")]
CALLS = [_attr("data-testid", holds="tool"), _attr("class", holds="tool-call")]


@dataclass(frozen=True)
class Adapter:
    """How the pages of some hosts hold a conversation. roles maps what the role attribute (or, failing that, the tag, if ``by_tag``) says."""

    name: str
    hosts: list[str]
    messages: list[Selector]
    roles: dict[str, str]
    container: list[Selector] = field(default_factory=lambda: [Selector("main"), _attr("role", equals="main"), Selector("body")])
    title: list[Selector] = field(default_factory=lambda: [Selector("h1")])
    key: str = "data-message-id"
    strip: list[Selector] = field(default_factory=lambda: STRIP)
    by_tag: bool = False


# Hosts and attributes of the known chat pages.
_TESTED = [_attr("data-testid", begins="user-message"), _attr("data-testid", begins="assistant-message")]
ADAPTERS = [
    Adapter("claude", ["claude.ai"], _TESTED, {"user-message": "user", "assistant-message": "assistant"}),
    Adapter("chatgpt", ["chatgpt.com", "chat.openai.com"], [_attr("data-message-author-role")], {"user": "user", "assistant": "assistant", "system": "user", "tool": "user"}),
    Adapter("gemini", ["gemini.google.com"], [_attr("data-message-id"), Selector(css_class="conversation-turn"), Selector("user-query"), Selector("model-response")], {"user": "user", "user-query": "user", "model": "assistant", "model-response": "assistant"}),
]


# -- joins by place ----------------------------------------------------------------------------------------------------
def below_any(flag: Column, by: list[str]) -> Column:
    """Whether a node is one of the elements of which ``flag`` is true, or below one, among the nodes with equal ``by``."""
    so_far = Window.partitionBy(*by).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(so_far) >= F.col("id"), F.lit(False))


def enclosing(nodes: DataFrame, outer: DataFrame, key: str = "page_id", strict: bool = False) -> DataFrame:
    """``nodes(key, id, ...)`` with outer: the number of the closest of ``outer(key, id, last)`` that they are below, or are (unless ``strict``); null if none."""
    # What encloses an outer element itself is found in the same order of starts and ends, among outer elements alone.
    ends = outer.select(key, F.col("last").alias("__at"), F.lit(2).alias("__order"), (-F.col("id")).alias("__deep"), F.col("id").alias("__own"), F.lit(-1).alias("__step"))
    starts = outer.select(key, F.col("id").alias("__at"), F.lit(1 if strict else 0).alias("__order"), F.lit(0).alias("__deep"), F.col("id").alias("__own"), F.lit(1).alias("__step"))
    asked = nodes.withColumns({"__at": F.col("id"), "__order": F.lit(0 if strict else 1), "__deep": F.lit(0), "__own": F.lit(None).cast("int"), "__step": F.lit(0)})
    told = asked.unionByName(starts.unionByName(ends), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("__at", "__order", "__deep")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("__level", F.sum("__step").over(so_far))
    # An end leads back to the last start one level further out.
    level = Window.partitionBy(key, "__level").orderBy("__at", "__order", "__deep").rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("__level") > 0, F.last(F.when(F.col("__step") == 1, F.col("__own")), ignorenulls=True).over(level))
    return told.withColumn("outer", found).where("__step = 0").drop("__at", "__order", "__deep", "__own", "__step", "__level")


def ancestors(outer: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, id, over): each of ``outer(key, id, last)`` with itself and every other that it is below. Elements of one kind are few in a page."""
    o = outer.select(key, F.col("id").alias("over"), F.col("last").alias("__until"))
    return outer.select(key, "id").join(o, key).where((F.col("over") <= F.col("id")) & (F.col("id") <= F.col("__until"))).select(key, "id", "over")


def _said(texts: str = "text", order: str = "id") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, texts))), lambda x: x[texts]), "")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# -- turns -------------------------------------------------------------------------------------------------------------
def _messages(nodes: DataFrame, adapter: Adapter, key: str) -> DataFrame:
    """(key, id, last, index, attrs, tag) of the messages below the first container of each page, in order."""
    holder = nodes.where(any_of(adapter.container)).groupBy(key).agg(F.min_by(F.struct("id", "last"), "id").alias("c"))
    found = nodes.where(any_of(adapter.messages)).join(holder, key).where((F.col("id") > F.col("c.id")) & (F.col("id") <= F.col("c.last")))
    return found.select(key, "id", "last", "tag", "attrs", (F.row_number().over(Window.partitionBy(key).orderBy("id")) - 1).alias("index"))


def read_turns(nodes: DataFrame, adapter: Adapter, key: str = "page_id") -> DataFrame:
    """(key, index, role, turn_key, body, reasoning, attachments, calls) of the messages in ``elements``, one row for each message; role is null where it is not known.

    A message's own texts are those below it, those of a message within it too. The body is without page parts and cards of files;
    the reasoning is the first block of thoughts without its label, if it has 20 characters or more; attachments have believable
    names, each once; calls have a name and what they gave. A page without a container or messages has no rows.
    """
    messages = _messages(nodes, adapter, key)
    marked = nodes.where((F.col("tag") == TEXT) | any_of([*adapter.strip, *CARDS, *THOUGHTS, *CALLS, Selector("summary"), Selector("a"), Selector("img")]))
    # Each node with its closest message and, as messages may nest, with those around that one.
    placed = enclosing(marked, messages, key).where("outer is not null")
    placed = placed.join(ancestors(messages, key).select(key, F.col("id").alias("outer"), F.col("over").alias("message")), [key, "outer"]).drop("outer").where("id <> message")
    by = [key, "message"]
    placed = placed.withColumns({"is_text": F.col("tag") == TEXT, "stripped": below_any(any_of([*adapter.strip, *CARDS]), by), "label": below_any(any_of([Selector("summary")]), by)})
    first_thought = F.min(F.when(any_of(THOUGHTS), F.struct("id", "last"))).over(Window.partitionBy(*by))
    placed = placed.withColumn("thought", first_thought)
    in_thought = F.col("is_text") & (F.col("id") > F.col("thought.id")) & (F.col("id") <= F.col("thought.last")) & ~F.col("label")
    bodies = placed.where("is_text").groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("stripped"), F.struct("id", "text")))), lambda x: x["text"]), "").alias("body"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(in_thought, F.struct("id", "text")))), lambda x: x["text"]), "").alias("why"),
    )
    body = _trim(F.regexp_replace(F.replace(F.col("body"), F.lit(" "), F.lit(" ")), r"[ \t]+\n", "\n"))
    lines = F.filter(F.transform(F.split("why", "\n"), lambda x: _trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    why = F.array_join(lines, "\n")
    told = bodies.select(*by, body.alias("body"), F.when(F.length(why) >= 20, why).alias("reasoning"))

    role = F.col("role")
    known = F.create_map(*(F.lit(x) for kv in adapter.roles.items() for x in kv))
    out = messages.join(_roles(nodes, messages, adapter, key), [key, "id"], "left").withColumnRenamed("id", "message").join(told, by, "left")
    out = out.join(_attachments(placed, by), by, "left").join(_calls(placed, by), by, "left")
    return out.select(key, "index", role.alias("said_role"), known[role].alias("role"), F.nullif(F.col("attrs")[adapter.key], F.lit("")).alias("turn_key"), F.coalesce("body", F.lit("")).alias("body"), "reasoning", "attachments", "calls")


def _roles(nodes: DataFrame, messages: DataFrame, adapter: Adapter, key: str) -> DataFrame:
    """(key, id, role): the value that the message's selector reads, on the message itself, as it matches."""
    named = [s.attribute for s in adapter.messages if s.attribute]
    found = [F.nullif(F.col("attrs")[named[0]], F.lit(""))] if named else []
    found += [F.col("attrs")["data-role"], F.col("attrs")["role"]] + ([F.col("tag")] if adapter.by_tag else [])
    return messages.select(key, "id", F.coalesce(*found).alias("role"))


def _attachments(placed: DataFrame, by: list[str]) -> DataFrame:
    """Cards by name or text, the first of a name, then images that the page itself holds."""
    cards = placed.where(any_of(FILES)).select(*by, "id", "last", "attrs")
    inside = placed.where(F.col("is_text") | (F.col("tag") == "a")).select(*by, F.col("id").alias("at"), "tag", "text", F.col("attrs")["href"].alias("href"))
    met = cards.join(inside, by, "left").where(F.col("at").isNull() | ((F.col("at") > F.col("id")) & (F.col("at") <= F.col("last"))))
    said = met.groupBy(*by, "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == TEXT, F.struct("at", "text")))), lambda x: x["text"]), "").alias("said"), F.min_by("href", F.when(F.col("tag") == "a", F.col("at"))).alias("href"))
    told = cards.select(*by, "id", "attrs").join(said, [*by, "id"], "left").withColumn("said", F.coalesce("said", F.lit("")))
    name = believed_name(F.coalesce(F.col("attrs")["data-file-name"], "said"))
    nothing = F.lit(None).cast("string")
    file = told.select(*by, "id", name.alias("name"), nothing.alias("kind"), parse_size(F.replace(F.col("said"), F.lit(","), F.lit(""))).alias("byteSize"), F.nullif(F.coalesce("href", F.col("attrs")["href"]), F.lit("")).alias("url"), F.lit(False).alias("inline"))
    source = F.coalesce(F.col("attrs")["src"], F.lit(""))
    image = placed.where((F.col("tag") == "img") & (source.startswith("data:") | source.startswith("blob:")))
    image = image.select(*by, "id", F.coalesce(F.nullif(_trim(F.coalesce(F.col("attrs")["alt"], F.lit(""))), F.lit("")), F.lit("generated image")).alias("name"), F.lit("image").alias("kind"), F.lit(None).cast("long").alias("byteSize"), nothing.alias("url"), F.lit(True).alias("inline"))
    all_of = file.where("name is not null").unionByName(image)
    first = all_of.groupBy(*by, "name").agg(F.min_by(F.struct("inline", "id", "name", "kind", "byteSize", "url"), F.struct("inline", "id")).alias("f"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(*(f[c].alias(c) for c in ("name", "kind", "byteSize", "url", "inline")))).alias("attachments"))


def _calls(placed: DataFrame, by: list[str]) -> DataFrame:
    calls = placed.where(any_of(CALLS)).select(*by, "id", "last", F.coalesce(F.col("attrs")["data-tool"], F.col("attrs")["data-testid"]).alias("name")).where("name <> ''")
    texts = placed.where("is_text").select(*by, F.col("id").alias("at"), "text")
    met = calls.join(texts, by, "left").where(F.col("at").isNull() | (F.col("at") > F.col("id")) & (F.col("at") <= F.col("last")))
    said = met.groupBy(*by, "id").agg(_said("text", "at").alias("said"))
    told = calls.select(*by, "id", "name").join(said, [*by, "id"], "left")
    g = told.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", "name", F.lit(None).cast("string").alias("input"), _trim(F.coalesce("said", F.lit(""))).alias("output")))).alias("c"))
    return g.select(*by, F.transform("c", lambda c: F.struct(c["name"].alias("name"), c["input"].alias("input"), c["output"].alias("output"))).alias("calls"))


def known_turns(turns: DataFrame, key: str = "page_id") -> DataFrame:
    """Of ``read_turns`` those with a known role, numbered anew; a turn without a key has its place in the page as one."""
    kept = turns.where("role is not null").withColumn("turn_key", F.coalesce("turn_key", F.concat(F.lit("index:"), F.col("index").cast("string"))))
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("index")) - 1).select(key, "turn", "role", "turn_key", "body", "reasoning", "attachments", "calls")


def turn_confidence(pages: DataFrame, turns: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ok, reason, score, warnings) for every row of ``pages(key)`` from ``read_turns``."""
    number = (F.col("index") + 1).cast("string")
    odd = F.when(F.col("role").isNull(), F.struct("index", F.concat(F.lit("Turn "), number, F.lit(' had an unrecognised role "'), F.coalesce("said_role", F.lit("none")), F.lit('" and was skipped.')).alias("w")))
    g = turns.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("role").alias("known"), F.count(F.when(F.col("role").isNotNull(), F.col("turn_key"))).alias("keyed"), F.transform(F.array_sort(F.collect_list(odd)), lambda x: x["w"]).alias("odd"))
    met = pages.select(key).join(g, key, "left")
    reason = F.when(F.col("n").isNull(), "No messages matched. The site layout has probably changed.").when(F.col("known") == 0, "Every message was dropped: no role could be identified.")
    n = F.col("n").cast("string")
    fewer = F.when(F.col("known") < F.col("n"), F.concat((F.col("n") - F.col("known")).cast("string"), F.lit(" of "), n, F.lit(" messages had no recognisable role.")))
    loose = F.when(F.col("keyed") < F.col("n"), "Messages carry no stable identifier, so a long conversation may be captured with duplicates.")
    warnings = F.filter(F.concat("odd", F.array(fewer, loose)), lambda w: w.isNotNull())
    score = F.round(F.lit(1.0) - F.when(fewer.isNotNull(), 0.2).otherwise(0.0) - F.when(loose.isNotNull(), 0.3).otherwise(0.0), 6)
    return met.select(key, reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), score).otherwise(0.0).alias("score"), F.when(reason.isNull(), warnings).otherwise(F.array(reason)).alias("warnings"))


def titles(nodes: DataFrame, adapter: Adapter, key: str = "page_id") -> DataFrame:
    """(key, title): the text of the first title element, else of ``title`` without the product's name."""
    # Fixed value: the names that pages put behind their titles.
    suffix = r"(?i)\s*[-–—|]\s*(Claude|ChatGPT|Gemini).*$"
    wanted = nodes.where(any_of(adapter.title) | (F.col("tag") == "title")).withColumn("own", any_of(adapter.title))
    first = wanted.groupBy(key, "own").agg(F.min_by(F.struct("id", "last"), "id").alias("e"))
    said = nodes.where(F.col("tag") == TEXT).join(first, key).where((F.col("id") > F.col("e.id")) & (F.col("id") <= F.col("e.last"))).groupBy(key, "own").agg(_said().alias("said"))
    g = said.groupBy(key).agg(F.max(F.when(F.col("own"), _trim(F.col("said")))).alias("own"), F.max(F.when(~F.col("own"), _trim(F.regexp_replace("said", suffix, "")))).alias("page"))
    return g.select(key, F.coalesce(F.nullif("own", F.lit("")), "page").alias("title"))


# -- formulas ----------------------------------------------------------------------------------------------------------
def recover_math(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """``nodes`` in which every formula is one text, its source between dollar signs, in place of all that draws it.

    An element that draws a formula gives the first source at or below it, and an empty text if there is none. A source that no
    dollar signs can hold (too long, with a blank line, or with a dollar sign in a line) leaves everything as it was.
    """
    said = lambda name: F.lower(F.coalesce(F.col("attrs")[name], F.lit("")))
    has = lambda text, words: F.greatest(*(text.contains(w) for w in words), F.lit(False))
    told = F.col("attrs")["encoding"].isNotNull() | F.col("attrs")["type"].isNotNull()
    source = said("encoding").contains(MATH_SOURCES[0]) | said("type").contains(MATH_SOURCES[1]) | (F.col("tag") == "annotation") | (F.col("tag") == "math") & told
    drawn = has(said("class"), MATH_CLASSES) | F.col("tag").isin(*MATH_TAGS) | (said("display") == "block")
    marks = nodes.where(F.col("tag") != TEXT).withColumns({"source": source, "drawn": drawn}).where("source or drawn")
    marks = marks.select(key, "id", "last", "source", "drawn", (has(said("class"), MATH_ALONE) | (F.col("tag") == "math")).alias("alone"))
    # What a source itself says, without elements in it: texts of which it is the closest element.
    texts = nodes.where(F.col("tag") == TEXT).select(key, "id", "text")
    own = enclosing(texts, nodes.where(F.col("tag") != TEXT).select(key, "id", "last"), key)
    latex = own.join(marks.where("source").select(key, F.col("id").alias("outer")), [key, "outer"]).groupBy(key, F.col("outer").alias("at")).agg(_said().alias("latex")).where("latex <> ''")
    below = marks.join(latex, key).where((F.col("at") >= F.col("id")) & (F.col("at") <= F.col("last"))).groupBy(key, "id").agg(F.min_by("latex", "at").alias("latex"))
    found = marks.join(below, [key, "id"], "left")
    literal = F.when(F.col("latex").isNotNull(), wrapped_math(F.col("latex"), F.col("alone"))).when(F.col("drawn") & ~F.col("source"), "")
    found = found.withColumn("literal", literal).where("literal is not null").select(key, "id", "literal")
    met = nodes.join(found, [key, "id"], "left").withColumn("gone", below_any(F.col("literal").isNotNull(), [key]))
    # The first of those that lie within each other stays, as a text.
    outermost = F.col("literal").isNotNull() & ~F.coalesce(F.max(F.when(F.col("literal").isNotNull(), F.col("last"))).over(Window.partitionBy(key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)) >= F.col("id"), F.lit(False))
    met = met.withColumn("first", outermost).where("first or not gone")
    return met.select(key, "id", F.when(F.col("first"), F.col("id")).otherwise(F.col("last")).alias("last"), F.when(F.col("first"), TEXT).otherwise(F.col("tag")).alias("tag"), F.when(~F.col("first"), F.col("attrs")).alias("attrs"), F.when(F.col("first"), F.col("literal")).otherwise(F.col("text")).alias("text"))
