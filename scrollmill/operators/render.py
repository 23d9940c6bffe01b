"""Archive documents as text: rendering, reading back, daily notes, styled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .saving import attachments, read_attachments, read_tool_calls, tool_call

HEADINGS = {"user": "## User", "assistant": "## Assistant", "reasoning": "## Reasoning"}


def frontmatter(fields: list[tuple[str, Column]], warnings: Column | None = None) -> Column:
    """A block of ``key: value`` lines; null values are left out, and each of an array of warnings has a line."""
    lines = F.array(*(F.when(v.isNotNull(), F.concat(F.lit(k + ": "), T.quote_if_needed(v))) for k, v in fields))
    if warnings is not None:
        lines = F.concat(lines, F.transform(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: F.concat(F.lit("warning: "), T.quote_if_needed(w))))
    return F.concat(F.lit("---\n"), F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), F.lit("\n---\n"))


def all_fields(title: Column, day: str, platform: Column, turns: Column, model: Column, url: Column, score: Column, complete: Column) -> list[tuple[str, Column]]:
    """Every field of a document but its warnings, in order; a null value is left out."""
    return [("title", F.nullif(title, F.lit(""))), ("date", F.lit(day)), ("platform", platform), ("turns", turns.cast("string")), ("model", model), ("url", T.encode_url(url)), ("extraction", F.format_string("%.2f", score)), ("incomplete", F.when(~complete, "true"))]


def metadata(documents: DataFrame, key: str = "path") -> DataFrame:
    """What the index keeps of a document's frontmatter: (key, title, platform, model, url, day, turns, extraction, incomplete, warnings)."""
    f = parse_frontmatter(F.col("document"))
    named = [f[c].alias(a) for c, a in (("title", "title"), ("platform", "platform"), ("model", "model"), ("url", "url"), ("date", "day"))]
    warnings = F.coalesce(F.split(f["warning"], "\x01", -1), F.array().cast("array<string>"))
    return documents.select(key, *named, f["turns"].cast("int").alias("turns"), f["extraction"].cast("double").alias("extraction"), F.coalesce(f["incomplete"] == "true", F.lit(False)).alias("incomplete"), warnings.alias("warnings"))


def parse_frontmatter(text: Column) -> Column:
    """Map of the block's fields, or null without a closed block at the start. Repeated keys keep all values, joined by U+0001."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    inner = F.regexp_extract(F.concat(unix, F.lit("\n")), r"(?s)\A---\n(.*?\n)?(?:---|\.\.\.)\n", 1)
    lines = F.filter(F.split(inner, "\n"), lambda x: x.contains(":"))
    unquote = lambda v: F.when(v.rlike('^".*"$'), F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), r"\\(.)", "$1")).otherwise(v)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), unquote(F.trim(F.regexp_replace(x, "^[^:]*:", ""))).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), "\x01"))
    return F.when(F.concat(unix, F.lit("\n")).rlike(r"(?s)\A---\n(.*?\n)?(?:---|\.\.\.)\n"), F.map_from_arrays(keys, values))


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?s)\A---\n(.*?\n)?(?:---|\.\.\.)(\n|\z)", "")


def render(messages: DataFrame, platform: str, day: str) -> DataFrame:
    """(conv_id, title, document) from (conv_id, turn, role, body): frontmatter with body hash and fingerprint, title, turns.

    Turns that hold nothing are not written, and the hash is of those that are.
    """
    body = F.regexp_replace(F.col("body"), r"^\s+|\s+$", "")
    kept = messages.where(T.is_populated(F.col("body"))).withColumn("body", body).withColumn("told", T.canonical_turn(F.col("role"), F.col("body")))
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "told")))
    g = kept.groupBy("conv_id").agg(order.alias("turns"))
    told = lambda source, turns: F.concat(F.lit(source + "\x1f"), F.array_join(F.transform(turns, lambda t: t["told"]), ""))
    title = T.first_line(F.coalesce(F.get(F.filter("turns", lambda t: t["role"] == "user"), F.lit(0))["body"], F.lit("")))
    g = g.withColumn("title", title)
    heading = F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv))
    text = F.array_join(F.transform("turns", lambda t: F.concat(heading[t["role"]], F.lit("\n\n"), t["body"])), "\n\n")
    fields = [("title", F.when(F.col("title") != "", F.col("title"))), ("date", F.lit(day)), ("platform", F.lit(platform)), ("turns", F.size("turns").cast("string"))]
    fields += [("body-hash", T.digest(told("web", F.col("turns")))), ("fingerprint", F.substring(T.digest(told(platform.lower(), F.col("turns"))), 1, 16))]
    head = F.when(F.col("title") != "", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"))).otherwise("")
    return g.select("conv_id", "title", F.concat(frontmatter(fields), F.lit("\n"), head, text).alias("document"))


def applied(existing: DataFrame, incoming: DataFrame, platform: str, day: str) -> DataFrame:
    """(conv_id, action, document) of ``archive.decide``: the whole document anew; null where nothing is to be written, or nothing has been said."""
    from .archive import decide

    return decide(existing, incoming).join(render(incoming, platform, day).select("conv_id", "document"), "conv_id", "left").withColumn("document", F.when(F.col("action") != "unchanged", F.col("document")))


#: A role heading alone in its line; a document is cut in front of each.
_HEADING = r"(?m)(?=^ *## (?:User|Assistant|Reasoning) *$)"


def split_turns(documents: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, body) of the sections under role headings; what stands before the first is no turn."""
    parts = F.filter(F.split(strip_frontmatter(F.col("document")), _HEADING), lambda p: p.rlike(r"\A *## (?:User|Assistant|Reasoning) *(?:\n|\z)"))
    turns = F.transform(parts, lambda p: F.struct(F.lower(F.regexp_extract(p, r"\A *## (\w+)", 1)).alias("role"), F.regexp_replace(F.regexp_replace(p, r"\A[^\n]*", ""), r"\A\s+|\s+\z", "").alias("body")))
    return documents.select(key, F.posexplode(F.filter(turns, lambda t: t["body"] != "")).alias("turn", "t")).select(key, "turn", "t.role", "t.body")


def intact(documents: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, body_hash, intact): the hash of the turns read back, and whether it is the recorded one; null without turns."""
    from .archive import body_hashes

    read = body_hashes(split_turns(documents, key).withColumnRenamed(key, "conv_id")).withColumnRenamed("conv_id", key)
    told = documents.select(key, parse_frontmatter(F.col("document"))["body-hash"].alias("recorded"))
    return told.join(read, key, "left").select(key, F.coalesce("n_turns", F.lit(0)).alias("n_turns"), "body_hash", F.coalesce(F.col("recorded") == F.col("body_hash"), F.lit(False)).alias("intact"))


_REASONING = r"(?s)\A<!-- reasoning -->\n\n(.*?)\n\n<!-- /reasoning -->\s*"
_CALLS = r"\A(?:\s*`{3,}tool\n[^\n]*\n`{3,}(?=\n|\z))*\s*"
_ATTACHMENTS = r"\AAttachments:\n\n(?:- [^\n]*(?:\n|\z))*\s*"
_BODY = "<!-- body -->\n\n"
#: What a body must not begin with unless ``_BODY`` stands before it.
_LIKE_DECORATION = r"\A\s*(?:<!-- reasoning -->|<!-- body -->|`{3,}tool\n|Attachments:)"


def render_turn(turn: Column) -> Column:
    """Of a struct with role, body, reasoning, toolCalls and attachments: what decorates the turn, in this order before its body."""
    # One slash more in what could end the block.
    why = F.regexp_replace(turn["reasoning"], "<!-- (/+)", "<!-- /$1")
    reasoning = F.when(F.coalesce(turn["reasoning"], F.lit("")) != "", F.concat(F.lit("<!-- reasoning -->\n\n"), why, F.lit("\n\n<!-- /reasoning -->")))
    calls = F.when(F.size(F.coalesce(turn["toolCalls"], F.array())) > 0, F.array_join(F.transform(turn["toolCalls"], tool_call), "\n"))
    files = F.nullif(attachments(F.coalesce(turn["attachments"], F.array().cast("array<struct<name:string,kind:string,byteSize:bigint,url:string>>"))), F.lit(""))
    body = F.when(turn["body"].rlike(_LIKE_DECORATION), F.concat(F.lit(_BODY), turn["body"])).otherwise(turn["body"])
    return F.concat_ws("\n\n", reasoning, calls, files, body)


def decode_turn(text: Column) -> Column:
    """Inverts ``render_turn``, but for blanks around the body: (reasoning, toolCalls, attachments, body).

    Only what leads a turn is decoration; a fence further on is the speaker's own, and so is what stands behind the body's mark.
    """
    why, rest = F.regexp_replace(F.regexp_extract(text, _REASONING, 1), "<!-- /(/+)", "<!-- $1"), F.regexp_replace(text, _REASONING, "")
    reasoning = F.nullif(why, F.lit(""))
    calls, rest = read_tool_calls(rest), F.regexp_replace(rest, _CALLS, "")
    files, rest = read_attachments(F.regexp_extract(rest, _ATTACHMENTS, 0)), F.regexp_replace(rest, _ATTACHMENTS, "")
    body = F.regexp_replace(F.regexp_replace(rest, r"\A\s*" + _BODY.strip() + r"\n\n", ""), r"\A\s+|\s+\z", "")
    return F.struct(reasoning.alias("reasoning"), calls.alias("toolCalls"), files.alias("attachments"), body.alias("body"))


_END = "<!-- /section -->"


def section(key: Column, title: Column, body: Column) -> Column:
    return F.concat(F.lit("<!-- section:"), key.cast("string"), F.lit(" -->\n## "), title, F.lit("\n\n"), body, F.lit("\n" + _END))


def _comparable(text: Column) -> Column:
    """Without lines of time stamps, which are no change."""
    return T.normalise(F.regexp_replace(text, r"(?m)^<sub>[^\n]*$", ""))


def _let(value: Column, use) -> Column:
    """``use(value)`` with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _upserted(path: Column, note: Column, s: Column) -> Column:
    """(action, note) of one section put into a note."""
    key, title, body = (s[c] for c in ("key", "title", "body"))
    size = len(_END)

    def placed(at: Column) -> Column:
        own = (at["start"] > 0) & (at["end"] > 0)
        grown = ~own & (at["open"] > 0) & (at["close"] > 0)
        new = section(key, title, body)
        skip = F.length(title) + 5
        old = T.normalise(F.substring(note, at["heading"] + skip, at["close"] - at["heading"] - skip))
        held = F.substring(note, at["start"], at["end"] - at["start"] + size)
        action = F.when(own & (_comparable(held) == _comparable(new)), "unchanged").when(own, "replace").when(grown & F.startswith(T.normalise(body), old), "replace").otherwise("insert")
        first, upto = F.when(own, at["start"]).otherwise(at["open"]), F.when(own, at["end"]).otherwise(at["close"]) + size
        gap = F.when(note.endswith("\n\n"), "").when(note.endswith("\n"), "\n").otherwise("\n\n")
        front = F.when(note == "", F.concat(F.lit("# "), path, F.lit("\n\n"))).otherwise(F.concat(note, gap))
        swapped = F.concat(F.substring(note, F.lit(1), first - 1), new, F.substring(note, upto, F.length(note)))
        return _let(action, lambda a: F.struct(a.alias("action"), F.when(a == "unchanged", note).when(a == "replace", swapped).otherwise(F.concat(front, new, F.lit("\n"))).alias("note")))

    start = F.position(F.concat(F.lit("<!-- section:"), key.cast("string"), F.lit(" -->")), note)
    heading = F.position(F.concat(F.lit("\n## "), title, F.lit("\n")), note)
    before = F.substring(note, F.lit(1), heading)
    mark = F.length(before) - F.length(F.substring_index(before, "<!-- section:", -1)) - len("<!-- section:") + 1
    first = F.struct(start.alias("start"), heading.alias("heading"), F.when((heading > 0) & (mark > 0), mark).otherwise(0).alias("open"))
    end = lambda begin, after: F.when(begin > 0, F.position(F.lit(_END), note, after)).otherwise(0)
    return _let(first, lambda f: _let(F.struct(f["start"].alias("start"), end(f["start"], f["start"]).alias("end"), f["heading"].alias("heading"), f["open"].alias("open"), end(f["open"], f["heading"]).alias("close")), placed))


def upsert_sections(notes: DataFrame, sections: DataFrame, path: str = "path", order: str = "key") -> DataFrame:
    """(path, actions, note) of ``notes(path, note)``, which hold others' text as well, with ``sections(path, key, title, body)`` in the given order; one row a note.

    A section lies between its marker and the first end marker behind it. Marked with the key: unchanged if only time stamps
    differ, else replaced in place. Under the heading, with another key, and its body the beginning of the new one: the
    section has grown and is replaced; if not, both stay. Otherwise it is inserted at the end, after a blank line; an empty
    or missing note gets a heading with its path. A section without an end is left as it is. actions has an entry a section.
    """
    told = sections.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), "key", "title", "body"))).alias("s"))
    met = told.join(notes, path, "left")
    begun = F.struct(F.array().cast("array<string>").alias("actions"), F.coalesce("note", F.lit("")).alias("note"))
    done = lambda acc, u: F.struct(F.concat(acc["actions"], F.array(u["action"])).alias("actions"), u["note"].alias("note"))
    folded = F.aggregate("s", begun, lambda acc, s: _let(_upserted(F.col(path).cast("string"), acc["note"], s), lambda u: done(acc, u)))
    return met.select(path, folded.alias("f")).select(path, "f.actions", "f.note")


def strip_sections(notes: DataFrame, keys: DataFrame, path: str = "path") -> DataFrame:
    """(path, note) of ``notes(path, note)`` without the sections that ``keys(path, key)`` names, all else as it stood; null where none of them is in the note.

    Only sections with an end go. A note without a key in ``keys`` has no row.
    """
    wanted = keys.groupBy(path).agg(F.array_sort(F.collect_set(F.col("key").cast("string"))).alias("k"))

    def without(note: Column, key: Column) -> Column:
        start = F.position(F.concat(F.lit("<!-- section:"), key, F.lit(" -->")), note)
        end = F.when(start > 0, F.position(F.lit(_END), note, start)).otherwise(0)
        return _let(F.struct(start.alias("s"), end.alias("e")), lambda at: F.when(at["e"] > 0, F.concat(F.substring(note, F.lit(1), at["s"] - 1), F.substring(note, at["e"] + len(_END), F.length(note)))).otherwise(note))

    left = F.aggregate("k", F.col("note"), without)
    return notes.join(wanted, path).select(path, left.alias("left"), "note").select(path, F.when(F.col("left") != F.col("note"), F.col("left")).alias("note"))


def daily_notes(sections: DataFrame) -> DataFrame:
    """(day, note) from sections(day, key, seq, title, body): of each key the last section, at the place of its first.

    Sections lie between markers, so another pass finds and replaces them.
    """
    latest = sections.groupBy("day", "key").agg(F.min("seq").alias("place"), F.max_by(F.struct("title", "body"), "seq").alias("s"))
    text = F.concat(F.lit("<!-- section:"), F.col("key").cast("string"), F.lit(" -->\n## "), F.col("s.title"), F.lit("\n\n"), F.col("s.body"), F.lit("\n<!-- /section -->"))
    g = latest.select("day", "place", text.alias("t")).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("place", "t"))).alias("x"))
    return g.select("day", F.concat(F.lit("# "), F.col("day"), F.lit("\n\n"), F.array_join(F.transform("x", lambda s: s["t"]), "\n\n"), F.lit("\n")).alias("note"))


def styled_lines(lines: DataFrame, key: str = "doc") -> DataFrame:
    """(key, line_no, kind, level) of (key, line_no, text, size, bold, mono, first_indent, head_indent): heading sizes are ranked against the usual one."""
    sizes = lines.where("trim(text) <> ''").groupBy(key, "size").agg(F.sum(F.length("text")).alias("n"))
    usual = sizes.groupBy(key).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("usual"))
    larger = sizes.join(usual, key).where("size > usual").select(key, "size", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("size"))).alias("rank"))
    met = lines.join(usual, key, "left").join(larger, [key, "size"], "left")
    kind = F.when(F.trim("text") == "", "blank").when(F.col("mono"), "code").when(F.col("rank") <= 6, "heading").when(F.col("text").rlike(r"^\s*([•◦▪\-]|\d+[.)])[\t ]"), "list").when((F.col("first_indent") > 0) & (F.col("first_indent") == F.col("head_indent")), "quote")
    return met.select(key, "line_no", kind.otherwise("body").alias("kind"), F.when(kind == "heading", F.col("rank")).alias("level"))
