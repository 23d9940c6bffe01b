"""Markdown as a table of lines, each seen with the line before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a line is by itself; the first that matches.
_KINDS = [
    ("blank", r"^[ \t\r]*$"),
    ("heading", r"^[ \t]{0,3}#{1,6}([ \t]|$)"),
    ("underline", r"^[ \t]{0,3}(=+|-+)[ \t\r]*$"),
    ("item", r"^[ \t]*([-+*]|[0-9]{1,9}[.)])([ \t]|$)"),
    ("quote", r"^[ \t]{0,3}>"),
    ("row", r"^[ \t]{0,3}\|.*\|"),
]


def lines(documents: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """(key, line_no, line, kind, tight) of every line of documents(key, text).

    kind: blank, heading, title (a line of text above an underline), underline, rule (an underline of dashes below anything
    else), item, quote, row or text. An underline of equals signs below anything else is text. tight: of an item, whether the
    line before it belongs to the same list, without a blank line between. A null text has no lines, an empty one a blank line.
    """
    told = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    own = F.lit("text")
    for name, pattern in reversed(_KINDS):
        own = F.when(F.col("line").rlike(pattern), name).otherwise(own)
    by = Window.partitionBy(key).orderBy("line_no")
    seen = told.withColumn("own", own).withColumns({"before": F.lag("own").over(by), "after": F.lead("own").over(by)})
    under = F.col("own") == "underline"
    follows = F.coalesce(F.col("before") == "text", F.lit(False))
    kind = F.when(under & follows, "underline").when(under & F.col("line").rlike(r"^[ \t]{0,3}-{3,}"), "rule").when(under & F.col("line").rlike(r"^[ \t]{0,3}-[ \t\r]*$"), "item").when(under, "text")
    kind = kind.when((F.col("own") == "text") & F.coalesce(F.col("after") == "underline", F.lit(False)), "title").otherwise(F.col("own"))
    tight = F.when(F.col("own") == "item", F.coalesce(F.col("before").isin("item"), F.lit(False)))
    return seen.select(key, "line_no", "line", kind.alias("kind"), tight.alias("tight"))


def outline(documents: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """(key, line_no, level, title) of all headings: of both forms, an underline of equals signs being level 1 and of dashes level 2."""
    by = Window.partitionBy(key).orderBy("line_no")
    told = lines(documents, key, text).withColumn("below", F.lead("line").over(by))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", r"^[ \t]*(#+)", 1))).when(F.trim("below").startswith("="), 1).otherwise(2)
    title = F.when(F.col("kind") == "heading", F.regexp_replace(F.regexp_replace("line", r"^[ \t]*#+[ \t]*", ""), r"[ \t]*#*[ \t\r]*$", "")).otherwise(F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", ""))
    return told.where(F.col("kind").isin("heading", "title")).select(key, "line_no", level.alias("level"), title.alias("title"))
