"""How the sources of a language differ in their terms, by count cells.

Many terms of a group share the same count there and in the whole language. So terms are counted by such cells, shares and
their differences are worked out once a cell, and cells are ranked by their values and by how many terms stand in the cells
above. Only terms of cells that reach the reported ranks are looked up and put in order. Differences of two sources are
summed over their cells too; terms that a source lacks come in by subtraction.

All arithmetic is of integers and decimals, so results are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, settle, small_batches, tidy

#: Documents of a language that must hold a term; ranks of terms that are told.
IN_DOCUMENTS, RANKS = 30, 50
#: Parts per unit of a share, and what is added to each count.
UNIT, ADDED = 1_000_000_000, 5
#: Terms that a task counts before it hands them on, and bytes of a text that it cuts into terms at once.
HELD, PIECE = 400_000, 1 << 20
#: UTF-8: a-z and all bytes of further letters stay, A-Z become a-z, all else a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    data = text.translate(LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in the group and documents of it that hold the term; nulls are read as ""."""
    small_batches(docs.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def told() -> pa.RecordBatch:
            rows = [(*g, t.decode(), n, held[t]) for g, (counts, held) in groups.items() for t, n in counts.items()]
            groups.clear()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "source", "term", "n", "docs"])

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                found: Counter[bytes] = Counter()
                for part in _terms(text.as_py()):
                    found.update(part)
                counts, documents = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(counts)
                for t, n in found.items():
                    counts[t] += n
                    documents[t] += 1
                held += len(counts)
                if held >= HELD:
                    yield told()
                    held = 0
        yield told()

    none = F.lit("")
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), none).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), none).cast("binary").alias("text"))
    counted = read.mapInArrow(tidy(tally), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)), exactly; null where no term is kept."""
    wide = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("decimal(19,0)")
    above = F.lit(UNIT).cast("decimal(11,0)") * (wide(count) + wide(ADDED))
    below = wide(total) + wide(ADDED) * wide(terms)
    return F.when(terms > 0, 1 + F.call_function("div", above, below))


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(lang, source, text, ...)``.

    A term is kept in a language if ``IN_DOCUMENTS`` of its documents hold it. Part pair: every other source of the language,
    by the summed difference of the shares of all kept terms. Part term: kept terms that are more frequent in the source than
    in the language, by that difference, up to rank ``RANKS``. Ranks go by falling value and then by the item's bytes.

    Null lang, source and text are read as "". Repeated rows count each; a group without terms has its pairs; a source alone in
    its language has none. Other columns are not read. An empty table gives no rows.
    """
    group, spread = ["lang", "source"], ["lang", "term"]
    counts = settle(count_terms(docs), "terms")
    known = counts.groupBy(*spread).agg(F.sum("docs").alias("docs"), F.sum("n").alias("c")).where(F.col("docs") >= IN_DOCUMENTS).select(*spread, "c")
    kept = settle(counts.select(*group, "term", "n").join(known, spread), "kept")
    discard(counts)

    # One row a group: occurrences and number of its kept terms, those of its language, and the share of a term that it lacks.
    vocabulary = kept.groupBy(*spread).agg(F.first("c").alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("c").alias("all"))
    held = kept.groupBy(*group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    none = F.lit("")
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), none).alias(c) for c in group)).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = names.join(held, group, "left").join(vocabulary, "lang", "left").select(*group, *map(zero, ("total", "held", "terms", "all")))
    groups = settle(groups.withColumn("lacking", F.coalesce(share(0, F.col("total"), F.col("terms")), F.lit(0).cast("long"))), "groups")

    # Parts that are used twice are written: a row for each two sources, and one for each cell.
    pairs = _pairs(kept, groups, group)
    terms = _top_terms(kept, groups, group)
    return pairs.unionByName(terms)


def _pairs(kept: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    number = F.count(F.lit(1)).alias("k")
    of = groups.select(*group, "total", "held", "terms", "lacking")
    other = of.select("lang", *(F.col(c).alias(f"o_{c}") for c in ("source", "total", "held", "lacking")))
    both = of.join(other, "lang").where("source <> o_source")
    # All terms of the one as if the other lacked them.
    alone = kept.groupBy(*group, "n").agg(number).join(both, group).withColumn("f", F.abs(share(F.col("n"), F.col("total"), F.col("terms")) - F.col("o_lacking")))
    alone = settle(alone.groupBy(*group, "o_source").agg(F.sum(F.col("f") * F.col("k")).alias("alone")), "alone")
    # Cells of two counts of one term, once for each two sources; what the parts before said of such terms is taken back.
    a, b = kept.select("lang", "term", "source", "n"), kept.select("lang", "term", F.col("source").alias("o_source"), F.col("n").alias("o_n"))
    cells = a.join(b, ["lang", "term"]).where("source < o_source").groupBy(*group, "o_source", "n", "o_n").agg(number).join(both, [*group, "o_source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("o_n"), F.col("o_total"), F.col("terms"))
    more = F.abs(p - q) - F.abs(p - F.col("o_lacking")) - F.abs(q - F.col("lacking")) + F.abs(F.col("lacking") - F.col("o_lacking"))
    met = settle(cells.groupBy(*group, "o_source").agg(F.sum(more * F.col("k")).alias("met")), "met")
    met = met.unionByName(met.select("lang", F.col("o_source").alias("source"), F.col("source").alias("o_source"), "met"))
    back = alone.select("lang", F.col("o_source").alias("source"), F.col("source").alias("o_source"), F.col("alone").alias("back"))
    key = [*group, "o_source"]
    value = (F.col("terms") - F.col("held") - F.col("o_held")) * F.abs(F.col("lacking") - F.col("o_lacking"))
    for c in ("alone", "back", "met"):
        value = value + F.coalesce(F.col(c), F.lit(0))
    told = both.join(alone, key, "left").join(back, key, "left").join(met, key, "left").select(*group, F.lit("pair").alias("part"), F.col("o_source").alias("item"), value.cast("long").alias("value"))
    return told.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")))


def _top_terms(kept: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    cells = kept.groupBy(*group, "n", "c").agg(F.count(F.lit(1)).alias("k")).join(groups, group)
    f = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("c"), F.col("all"), F.col("terms"))
    cells = settle(cells.withColumn("f", f).where("f > 0").select(*group, "n", "c", "k", "f"), "cells")
    # Cells of one value are one step; the first ``RANKS`` steps hold as many terms at least, and those above a step fill the ranks before it.
    steps = cells.groupBy(*group, "f").agg(F.sum("k").alias("k"))
    falling = Window.partitionBy(*group).orderBy(F.desc("f"))
    steps = steps.withColumn("step", F.row_number().over(falling)).where(F.col("step") <= RANKS)
    steps = steps.withColumn("before", F.coalesce(F.sum("k").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < RANKS)
    wanted = cells.join(steps.select(*group, "f", "before"), [*group, "f"]).select(*group, "n", "c", "f", "before")
    placed = kept.join(wanted, [*group, "n", "c"])
    inside = F.row_number().over(Window.partitionBy(*group, "f").orderBy("term"))
    # Within a step no more terms than there are ranks can be told, whatever it holds.
    placed = placed.withColumn("i", inside).where(F.col("i") <= RANKS).withColumn("rank", (F.col("before") + F.col("i")).cast("int")).where(F.col("rank") <= RANKS)
    return placed.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"), "rank")
