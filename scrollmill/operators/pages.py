"""The content of a page: every element is measured from the table of its nodes, and the best region is chosen.

Lengths of text are sums over intervals: running sums over the nodes in order, taken at an element and at its last node.
White space counts once between words, so each text knows whether it is parted from the one before; the first text of an
element has no gap before it there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.html import CHROME_CLASSES, CHROME_HINTS, CHROME_TAGS, DEPTH, region_markdown
from ..functions.text import strip_site
from ..sources.store import settle
from .elements import TEXT, elements

# Weights of a region's score and its bounds, as results must agree.
LINKS, PROSE, LENGTH, HINT, MOST_PROSE, SURE, DOUBTFUL, SHORT = 50, 30, 20, 40, 6, 0.5, 0.6, 400
_ROW = "__page"


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def _joined(order: str = "id") -> Column:
    return _squeezed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), ""))


def _score(text: Column, links: Column, prose: Column, hints: Column) -> Column:
    """How much a region looks like an article, 0 to 1; null without text."""
    value = (1 - links / text) * LINKS + F.least(prose, F.lit(MOST_PROSE)) / MOST_PROSE * PROSE + F.least(F.log10(text + 1) / 5, F.lit(1.0)) * LENGTH - hints * HINT
    return F.when(text > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / 100)))


def _attr(name: str) -> Column:
    return F.lower(F.coalesce(F.col("attrs")[name], F.lit("")))


def is_chrome() -> Column:
    """Of a node: a page part that is never content."""
    role = F.coalesce(F.col("attrs")["role"], F.lit(""))
    named = F.arrays_overlap(F.split(_attr("class"), r"\s+"), F.array(*map(F.lit, sorted(CHROME_CLASSES))))
    return (F.col("tag") != TEXT) & (F.col("tag").isin(*sorted(CHROME_TAGS)) | named | role.isin("navigation", "banner", "contentinfo", "search") | (F.coalesce(F.col("attrs")["aria-hidden"], F.lit("")) == "true"))


def hints() -> Column:
    """Of class and id, how many name a part that is seldom content."""
    pattern = "|".join(h.replace("-", r"\-") for h in CHROME_HINTS)
    return _attr("class").rlike(pattern).cast("int") + _attr("id").rlike(pattern).cast("int")


def _events(nodes: DataFrame, key: str) -> DataFrame:
    """Starts of all nodes and ends of elements in their order, with what a text has of words and white space, and level: the page parts that are open there."""
    text = F.col("text")
    told = nodes.select(key, "id", "last", "tag", is_chrome().alias("chrome"), hints().alias("hints"), F.when(F.col("tag") == TEXT, F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0))).alias("words"), F.length(F.regexp_replace(text, r"(?U)\s+", "")).alias("letters"), text.rlike(r"(?U)^\s").alias("lead"), text.rlike(r"(?U)\s$").alias("tail"))
    starts = told.withColumns({"at": F.col("id"), "end": F.lit(0), "deep": F.lit(0)})
    ends = told.where(F.col("tag") != TEXT).withColumns({"at": F.col("last"), "end": F.lit(1), "deep": -F.col("id"), "words": F.lit(None).cast("int")})
    both = starts.unionByName(ends)
    own = F.col("chrome").cast("int")
    upto = Window.partitionBy(key).orderBy("at", "end", "deep").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(((F.col("end") == 0) & (F.col("tag") != TEXT)).cast("int")).over(upto) - 1
    return both.withColumns({"level": F.sum(own * (1 - 2 * F.col("end"))).over(upto) + own * F.col("end"), "number": number})


def _sized(events: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """``events`` with, at the ends of elements, the length of their squeezed text as ``name``, and that of links and the number of paragraphs with text below; counted among nodes with equal ``by``.

    Every sum is a running one, taken at the end less at the start, so a page costs what it takes to put its nodes in order.
    """
    order = Window.partitionBy(*by).orderBy("at", "end", "deep")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("end"), F.desc("deep")).rowsBetween(Window.unboundedPreceding, -1)
    one = Window.partitionBy(key, "id").orderBy("end")
    solid = F.coalesce(F.col("words") > 0, F.lit(False))
    # A text with words and the blank ones behind it are one group; whether white space ends it is known to the next.
    told = events.withColumn("group", F.sum(solid.cast("int")).over(upto))
    told = told.withColumn("ends", F.max(F.when(F.col("words").isNotNull(), F.col("tail"))).over(Window.partitionBy(*by, "group")))
    told = told.withColumn("gap", F.when(solid, (F.col("lead") | F.coalesce(F.lag("ends").over(order), F.lit(False))).cast("long")))
    told = told.withColumns({"sum": F.coalesce(F.sum(F.col("letters") + F.col("words") - 1 + F.col("gap")).over(upto), F.lit(0)), "next": F.last(F.when(solid, F.struct("id", "gap")), ignorenulls=True).over(back)})
    # The first text of an element has no gap before it there.
    first = F.when(F.lag("next.id").over(one) <= F.col("last"), F.lag("next.gap").over(one))
    told = told.withColumn(name, F.when(F.col("end") == 1, F.when(first.isNull(), 0).otherwise(F.col("sum") - F.lag("sum").over(one) - first)))
    of = lambda tag: (F.col("end") == 1) & (F.col("tag") == tag)
    told = told.withColumns({"links": F.sum(F.when(of("a"), F.col(name)).otherwise(0)).over(upto), "prose": F.sum((of("p") & (F.col(name) > 0)).cast("long")).over(upto)})
    sums = {f"{name}_{c}": F.when(F.col("end") == 1, F.col(c) - F.lag(c).over(one)) for c in ("links", "prose")}
    return told.withColumns(sums).drop("group", "ends", "gap", "sum", "next", "links", "prose")


def measured(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, id, last, tag, number, hints, whole, whole_links, whole_prose, clean, clean_links, clean_prose, inner) of all elements.

    Lengths of squeezed text, of that of links below, and paragraphs with text: of all that is below, and without page parts in it;
    inner: articles and mains below. All is one order of a page's nodes: a single shuffle.
    """
    told = _sized(_sized(_events(nodes, key), [key], key, "whole"), [key, "level"], key, "clean")
    upto = Window.partitionBy(key).orderBy("at", "end", "deep").rowsBetween(Window.unboundedPreceding, 0)
    one = Window.partitionBy(key, "id").orderBy("end")
    told = told.withColumn("inner", F.sum(((F.col("end") == 0) & F.col("tag").isin("article", "main")).cast("int")).over(upto))
    told = told.withColumns({"inner": F.col("inner") - F.lag("inner").over(one), "number": F.lag("number").over(one)}).where("end = 1")
    return told.select(key, "id", "last", "tag", "number", "hints", "whole", "whole_links", "whole_prose", "clean", "clean_links", "clean_prose", "inner")


def _regions(nodes: DataFrame, key: str) -> DataFrame:
    """(key, region, score, length, title) of each page; region is the number of the element among elements, null where none has text."""
    met = measured(nodes, key)
    own = _score(F.col("clean"), F.col("clean_links"), F.col("clean_prose"), F.col("hints"))
    sure = F.when(F.col("tag").isin("article", "main") & (own >= SURE), F.struct(F.when(F.col("tag") == "article", 0).otherwise(1).alias("rank"), F.lit(0.0).alias("minus"), "id", "number", own.alias("score"), F.col("whole").alias("length")))
    plain = _score(F.col("whole"), F.col("whole_links"), F.col("whole_prose"), F.col("hints"))
    other = F.when(F.col("tag").isin("div", "section", "td") & (F.col("whole") > 0) & (F.col("inner") == 0), F.struct(F.lit(2).alias("rank"), (-plain).alias("minus"), "id", "number", plain.alias("score"), F.col("whole").alias("length")))
    best = met.groupBy(key).agg(F.min(F.coalesce(sure, other)).alias("best"))
    heads = nodes.where(F.col("tag").isin("h1", "title")).groupBy(key, "tag").agg(F.min_by(F.struct("id", "last"), "id").alias("h")).select(key, F.col("tag").alias("of"), "h")
    said = nodes.where(F.col("tag") == TEXT).join(heads, key).where((F.col("id") > F.col("h.id")) & (F.col("id") <= F.col("h.last"))).groupBy(key, "of").agg(_joined().alias("said"))
    # A heading without text is one still.
    said = heads.join(said, [key, "of"], "left").groupBy(key).agg(F.max(F.when(F.col("of") == "h1", F.coalesce("said", F.lit("")))).alias("h1"), F.max(F.when(F.col("of") == "title", F.coalesce("said", F.lit("")))).alias("page"))
    return best.join(said, key, "left").select(key, F.col("best.number").alias("region"), F.col("best.score").alias("score"), F.col("best.length").alias("length"), strip_site(F.coalesce("h1", "page", F.lit(""))).alias("title"))


def _numbered(pages: DataFrame) -> DataFrame:
    """Rows with a number of their own, written once, so that what is read from them finds its page again, whatever ids repeat."""
    return settle(pages.withColumn(_ROW, F.monotonically_increasing_id()), "pages")


def find_content(pages: DataFrame) -> DataFrame:
    """``pages(html, ...)`` with region (the number of the element), score, length and title; region is null where no element has text.

    The first article, then the first main, that scores ``SURE`` without chrome; else the best div, section or td that holds
    neither, scored with all that it holds, the first of equal ones. Repeated and null ids do no harm; a null page has no region.
    """
    held = _numbered(pages)
    nodes = settle(elements(held, _ROW, DEPTH), "elements")
    return held.join(_regions(nodes, _ROW), _ROW).select(*pages.columns, "region", "score", "length", "title")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages(html, ...)`` without html, with ok, title, score, warnings and the region's markdown."""
    found = find_content(pages)
    ok = F.col("region").isNotNull()
    doubt = F.when(F.col("score") < DOUBTFUL, F.concat(F.lit("The main content region scored "), F.format_string("%.2f", "score"), F.lit(", below 0.6.")))
    short = F.when(F.col("length") < SHORT, "The extracted region is very short.")
    warnings = F.filter(F.array(doubt, short), lambda w: w.isNotNull())
    kept = [c for c in pages.columns if c != "html"]
    told = found.select(*kept, ok.alias("ok"), F.when(ok, F.col("title")).alias("title"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(ok, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"), "html", "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = [region_markdown(h, k) for h, k in zip(batch.column("html").to_pylist(), batch.column("region").to_pylist(), strict=True)]
            yield batch.drop_columns(["html", "region"]).append_column("markdown", pa.array(written, pa.string()))

    return told.mapInArrow(run, StructType([*told.drop("html", "region").schema.fields, StructField("markdown", StringType())]))
