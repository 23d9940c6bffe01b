"""Small rules of Markdown, names and sentences, as expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a math literal at most.
MATH_MOST = 1000


def title(content: Column) -> Column:
    """The first line that holds something, without the marks of a heading; empty if none does."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    heading = F.regexp_extract(first, r"^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)
    return F.when(heading != "", F.trim(heading)).otherwise(first)


def escape_inline(text: Column) -> Column:
    """A backslash before each character that Markdown reads within a line."""
    return F.regexp_replace(text, r"([\\`*\[\]<>])", r"\\$1")


def escape_line_start(line: Column) -> Column:
    """A backslash where a line would begin a heading, quote, list or break; after the number of a numbered list."""
    mark = F.regexp_replace(line, r"^([#>~=+\-])(?=[ \t]|$)", r"\\$1")
    return F.regexp_replace(mark, r"^([0-9]+)(?=[.)]( |$))", r"$1\\")


def wrapped_math(latex: Column, display: Column) -> Column:
    """``$…$`` or ``$$ … $$``; null if it is empty, too long, holds a blank line or, in a line, a dollar sign."""
    trimmed = F.regexp_replace(latex, r"^\s+|\s+$", "")
    fits = (trimmed != "") & (F.length(trimmed) <= MATH_MOST) & ~trimmed.contains("\n\n")
    inline = F.when(~trimmed.contains("$"), F.concat(F.lit("$"), trimmed, F.lit("$")))
    return F.when(fits, F.when(display, F.concat(F.lit("$$ "), trimmed, F.lit(" $$"))).otherwise(inline))


def believed_name(raw: Column) -> Column:
    """The first word, if it has an extension and is no number; null otherwise."""
    token = F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\s*(\S+)", 1)
    stem = F.regexp_extract(token, r"^([^/\\?#]+)\.([A-Za-z0-9]{1,8})$", 1)
    return F.when((stem != "") & ~F.regexp_replace(stem, "[._-]", "").rlike("^[0-9]+$"), token)


def warning_sentence(warnings: Column, score: Column, reliable: float = 0.75) -> Column:
    """The warnings as one sentence, else what the score says."""
    late = F.concat(F.lit("The page had not finished loading all messages when this was saved (confidence "), F.format_string("%.2f", score), F.lit(")."))
    return F.when(F.size(warnings) > 0, F.concat(F.array_join(warnings, "; "), F.lit("."))).when(score < reliable, late).otherwise("Not every message was captured.")


def field_values(joined: Column) -> Column:
    """The values of a repeated frontmatter field, which are kept with U+0001 between them."""
    return F.split(joined, "\x01", -1)


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_stamp(ts: Column) -> Column:
    """In UTC, with its offset written as +0000."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+0000'")


def fallback_name(ts: Column) -> Column:
    """The name of what has no title, by its time."""
    return F.concat(F.lit("clipboard_save_"), F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"))


def typed_name(typed: Column, suggested: Column, clean) -> Column:
    """What was typed, made safe by ``clean``, with the suggestion's extension if it has none; the suggestion if nothing is left; null if that is unusable."""
    cleaned = clean(F.regexp_replace(typed, r"^\s+|\s+$", ""))
    candidate = F.when(cleaned == "", clean(suggested)).otherwise(cleaned)
    own, fallback = F.regexp_extract(candidate, r".\.([^. ]+)$", 1), F.regexp_extract(suggested, r".\.([^. ]+)$", 1)
    return F.when(candidate == "", None).when((own != "") | (fallback == ""), candidate).otherwise(F.concat(candidate, F.lit("."), fallback))
