"""Scalar functions of text, as expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a code fence may carry to become a tag.
LANGUAGES = """swift python javascript typescript jsx tsx rust go ruby java kotlin c cpp csharp php scala elixir haskell sql bash sh zsh shell
json yaml toml html css r julia matlab perl lua dart vue svelte""".split()
# Known sources and how they are shown.
PLATFORMS = {"claude": "Claude", "chatgpt": "ChatGPT", "gemini": "Gemini", "web": "Web page"}
# Words that YAML reads as something else than text.
YAML_WORDS = ["true", "false", "null", "yes", "no", "on", "off", "~"]

# What counts as a fence, a table row or a block of Markdown; tags must agree, and neither engine's dialect is left.
FENCE = r"(?m)^[ \t]{0,3}(`{3,}|~{3,})"
FENCE_NAME = r"(?m)^[ \t]{0,3}(?:`{3,}|~{3,})[ \t]*([A-Za-z0-9+#_-]+)"
TABLE_ROW = r"(?m)^[ \t]{0,3}\|.*\|.*\|"
# Any of these block forms marks a text as Markdown; a thematic break is spelt out for each of its characters.
MARKDOWN = "(?m)" + "|".join(
    [
        r"^[ \t]{0,3}#{1,6}([ \t]|$)",
        r"^[ \t]{0,3}(`{3,}|~{3,})",
        r"^[ \t]{0,3}([-+*]|[0-9]{1,9}[.)])([ \t]|$)",
        r"^[ \t]{0,3}>",
        r"^[ \t]{0,3}\|.*\|[ \t]*$",
        r"^[ \t]{0,3}(-([ \t]*-){2,}|\*([ \t]*\*){2,}|_([ \t]*_){2,})[ \t]*$",
        r"^[ \t]{0,3}(=+|-+)[ \t]*$",
    ]
)


def normalise(text: Column) -> Column:
    """Line ends to LF, blanks and tabs to one blank, no blank lines or ends; case and punctuation stay. Null stays null."""
    unix = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(unix, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def canonical_turn(role: Column, body: Column, reasoning: Column | None = None, calls: Column | None = None) -> Column:
    out = [F.lit("\x1e"), role, F.lit("\x1f"), F.coalesce(normalise(body), F.lit(""))]
    if reasoning is not None:
        out.append(F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(F.lit("\x1freasoning:"), normalise(reasoning))).otherwise(""))
    if calls is not None:
        told = F.transform(calls, lambda c: F.concat(F.lit("\x1ftool:"), c["name"], F.lit(":"), F.coalesce(normalise(c["input"]), F.lit(""))))
        out.append(F.coalesce(F.array_join(told, ""), F.lit("")))
    return F.concat(*out)


def canonical(source: Column, model: Column, turns: Column) -> Column:
    """turns: array of structs with role, body, reasoning and toolCalls."""
    parts = F.transform(turns, lambda t: canonical_turn(t["role"], t["body"], t["reasoning"], t["toolCalls"]))
    return F.concat(source, F.lit("\x1f"), F.coalesce(model, F.lit("")), F.array_join(parts, ""))


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def short(canonical_text: Column, n: int = 12) -> Column:
    return F.substring(digest(canonical_text), 1, n)


def is_populated(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def looks_like_markdown(text: Column) -> Column:
    return F.coalesce(text.rlike(MARKDOWN), F.lit(False))


def body_tags(body: Column, role: Column | None = None) -> Column:
    """Sorted distinct tags of one text: those that rest on the text alone."""
    named = F.array_intersect(F.transform(F.regexp_extract_all(body, F.lit(FENCE_NAME), 1), F.lower), F.array(*map(F.lit, LANGUAGES)))
    rules = [
        ("code", body.rlike(FENCE)),
        ("math", body.contains("$") | body.contains("\\(")),
        ("table", body.rlike(TABLE_ROW)),
        ("image", body.contains("![")),
        ("long", F.length(body) > 20_000),
    ]
    return F.array_sort(F.array_distinct(F.concat(named, F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull()))))


def conversation_tags(turns: Column) -> Column:
    """Sorted tags of a conversation from its array of turns."""
    everything = F.array_join(F.transform(turns, lambda t: F.coalesce(t["body"], F.lit(""))), "\n")
    rules = [
        ("conversation", F.size(turns) > 0),
        ("tools", F.exists(turns, lambda t: F.size(F.coalesce(t["toolCalls"], F.array())) > 0)),
        ("reasoning", F.exists(turns, lambda t: F.coalesce(t["reasoning"], F.lit("")) != "")),
    ]
    return F.array_sort(F.array_union(body_tags(everything), F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull())))


def first_line(text: Column, n: int = 120) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    return F.trim(F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, n))


def safe_filename(name: Column, cut: int | None = 80) -> Column:
    """Without characters that file systems refuse, blank runs, trailing separators and leading dots; cut at a word; at most 240 bytes."""
    out = F.regexp_replace(name, r'[/:*?"<>|\\]+', " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[\x00-\x1f]", " "), r"\s+", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[ .,_-]+$", ""), r"^\.+", "")
    reserved = F.upper(out).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    out = F.when(reserved, F.concat(F.lit("_"), out)).otherwise(out)
    if cut:
        clipped = F.substring(out, 1, cut)
        out = F.when(F.length(out) <= cut, out).when(clipped.rlike(r"^.+ "), F.regexp_replace(clipped, r" [^ ]*$", "")).otherwise(clipped)
    clipped = F.regexp_replace(F.substring(out, 1, 60), r"[ .,_-]+$", "")
    return F.when(F.octet_length(out) <= 240, out).otherwise(clipped)


def quote_if_needed(value: Column) -> Column:
    """A frontmatter value, quoted where YAML would misread it."""
    odd = (value != F.trim(value)) | value.rlike(r"""^[:#{}\[\],&*?|\-<>=!%@`"'\n\t]""") | value.contains(": ") | value.contains(" #") | value.contains("\n")
    odd = odd | F.lower(value).isin(YAML_WORDS) | value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when((value == "") | odd, quoted).otherwise(value)


def parse_size(text: Column) -> Column:
    """'4.1 KB' to bytes, in decimal units; null if it is no size."""
    unit = F.upper(F.regexp_extract(text, r"(?i)([0-9.]+)\s*([KMG]?)B", 2))
    number = F.try_to_number(F.regexp_extract(text, r"(?i)([0-9.]+)\s*([KMG]?)B", 1), F.lit("999999999D999999")).cast("double")
    return F.round(number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)).cast("long")


def encode_url(url: Column) -> Column:
    return F.when(url.contains(" "), F.replace(url, F.lit(" "), F.lit("%20"))).otherwise(url)


def attachment_kind(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "svg", "heic"), "image").when(ext.isin("pdf", "doc", "docx", "txt", "md", "csv", "xlsx"), "document").when(ext == "", "file").otherwise("code")


def fence_width(text: Column) -> Column:
    """Backticks that a fence around the text needs."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def code_span(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)
    mark = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), " ").otherwise("")
    return F.concat(mark, pad, text, pad, mark)


def strip_site(title: Column) -> Column:
    return F.trim(F.get(F.split(title, r"\s+[—–|]\s+", 2), F.lit(0)))


def display_name(slug: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in PLATFORMS.items() for x in kv))
    return F.coalesce(known[F.lower(slug)], F.concat(F.upper(F.substring(slug, 1, 1)), F.substring(slug, 2, 1_000)))


def is_reliable(score: Column, complete: Column, warnings: Column) -> Column:
    return complete & (score >= 0.75) & (F.size(warnings) == 0)


def clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
