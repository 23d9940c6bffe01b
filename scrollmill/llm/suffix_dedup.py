"""Repeated passages by sparse suffix arrays.

Of every window of ``WIDTH`` words, the least of its hashed ``GRAM``-word grams (the leftmost, if several) is its
anchor. Only the suffixes that start at anchors are kept, about one in twenty; equal windows have their anchors
at equal places. The suffixes are sorted by their next words, in blocks of 10, 15 and 25, and each is compared
with its neighbours: that bounds how far to the right any other suffix agrees with it. Suffixes with enough
agreement are extended: windows around the anchor, to the left and right as far as the bound allows, are
compared whole, and all but the first occurrence of a window are repeats. Overlapping repeats are one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._store import free_name, settle, small_batches, tidy

WIDTH, GRAM = 50, 10
#: Ends of the blocks of words by which suffixes are sorted.
BLOCKS = (10, 25, 50)
#: Row keys up to this number are broadcast (8 bytes each).
BROADCAST_IDS = 500_000


def _anchors(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts whose words start at ``at``: anchors, and the first and last window start of each."""
    g = T.grams(hashes, GRAM)
    n = len(hashes) - WIDTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts = np.arange(n)
    owner = np.searchsorted(at, starts, "right") - 1
    starts = starts[starts + WIDTH <= at[owner + 1]]
    if not len(starts):
        return starts, starts, starts
    view = np.lib.stride_tricks.sliding_window_view(g, WIDTH - GRAM + 1)
    least = np.concatenate([view[a : a + 65_536].argmin(1) for a in range(0, len(view), 65_536)])
    anchor = starts + least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return anchor[first], starts[first], starts[last]


def _spread(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = T._power(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return total, inverse


def _range(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from start to end."""
    return T.mix((total[end] - total[start]) * inverse[start]).view(np.int64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in T.chunks(batch.column("text")):
            w = T.words(chunk)
            anchor, first, _ = _anchors(w.hash, w.at)
            if not len(anchor):
                continue
            doc = np.searchsorted(w.at, anchor, "right") - 1
            stop = w.at[doc + 1]
            total, inverse = _spread(w.hash)
            keys = []
            for a, b in zip((0, *BLOCKS), BLOCKS, strict=False):
                whole = anchor + b <= stop
                keys.append(pa.array(_range(total, inverse, np.minimum(anchor + a, stop), np.minimum(anchor + b, stop)), mask=~whole))
            rows = pa.array(doc + chunk.first)
            yield pa.RecordBatch.from_arrays(
                [*keys, batch.column("row").take(rows), pa.array((anchor - w.at[doc]).astype(np.int32)), pa.array((anchor - first).astype(np.int32))], ["b0", "b1", "b2", "row", "at", "reach"]
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around the anchors of each text whose part right of the anchor is within the bound."""
    for batch in batches:
        kept = batch.column("anchors").to_pylist()
        for chunk in T.chunks(batch.column("text")):
            w = T.words(chunk)
            total, inverse = _spread(w.hash)
            rows, starts = [], []
            anchor, first, last = _anchors(w.hash, w.at)
            owner = np.searchsorted(w.at, anchor, "right") - 1
            edge = np.searchsorted(owner, np.arange(chunk.rows + 1))
            for r in range(chunk.rows):
                here = slice(edge[r], edge[r + 1])
                known = np.array([(x["at"], x["within"]) for x in kept[chunk.first + r]], np.int64).reshape(-1, 2)
                known = known[np.argsort(known[:, 0])]
                places = anchor[here] - w.at[r]
                i = np.minimum(np.searchsorted(known[:, 0], places), len(known) - 1)
                within = np.where(known[i, 0] == places, known[i, 1], 0)
                lo, hi = first[here], np.minimum(last[here], anchor[here] - (WIDTH - within))
                n = np.maximum(0, hi - lo + 1)
                starts.append(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
                rows.append(np.full(int(n.sum()), r))
            start, row = np.concatenate(starts), np.concatenate(rows)
            take = pa.array(row + chunk.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_range(total, inverse, start, start + WIDTH)), batch.column("doc_id").take(take), batch.column("row").take(take), pa.array((start - w.at[row]).astype(np.int32))], ["window", "doc_id", "row", "start"]
            )


def row_key() -> Column:
    """Tells rows apart by doc_id and text; rows that repeat both are one."""
    return F.xxhash64("text", "doc_id")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", row_key())


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is in ``ids``, which is distinct; without a shuffle while it is small."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "row", how)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, start, end, first_row, first_doc_id, first_start) for each repeated passage of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, numbered from 0. A window of 50 words repeats if it also
    occurs before, in the order doc_id (nulls last), row key, position; in one text or in another, overlapping or not. A span
    (start to end, end excluded) is a union of repeating windows that overlap or touch. first_* is where the span's first
    window occurs first. Texts of fewer than 50 words, null and empty ones have no spans. Rows that repeat both doc_id and
    text count as one row. Other columns are left out. No repeats or no rows give no rows.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    suffixes = keyed.select("row", "text").mapInArrow(tidy(_suffixes), "b0 long, b1 long, b2 long, row long, at int, reach int")
    order = Window.partitionBy("b0").orderBy("b1", "b2")

    def agrees(*names: str) -> Column:
        out = F.lit(False)
        for near in (F.lag, F.lead):
            both = F.lit(True)
            for c in names:
                both = both & (near(c).over(order) == F.col(c))
            out = out | F.coalesce(both, F.lit(False))
        return out

    neighbour = F.lag("row").over(order).isNotNull() | F.lead("row").over(order).isNotNull()
    within = F.when(agrees("b1", "b2"), WIDTH).when(agrees("b1"), BLOCKS[2] - 1).when(neighbour, BLOCKS[1] - 1).otherwise(0)
    compared = suffixes.select("row", "at", "reach", within.alias("within")).where(F.col("reach") >= WIDTH - F.col("within"))
    anchors = settle(compared.groupBy("row").agg(F.collect_list(F.struct("at", "within")).alias("anchors")), "anchors")
    texts = _only(keyed, anchors.select("row")).dropDuplicates(["row"])
    windows = texts.join(anchors, "row").select("doc_id", "row", "text", "anchors").mapInArrow(tidy(_windows), "window long, doc_id long, row long, start int")
    first = Window.partitionBy("window").orderBy(F.col("doc_id").asc_nulls_last(), "row", "start")
    earliest = F.first(F.struct("doc_id", "row", "start")).over(first.rowsBetween(Window.unboundedPreceding, 0))
    repeats = windows.select("doc_id", "row", "start", earliest.alias("f")).where((F.col("f.row") != F.col("row")) | (F.col("f.start") != F.col("start")))
    by_row = Window.partitionBy("row").orderBy("start")
    gap = F.coalesce(F.col("start") > F.lag("start").over(by_row) + WIDTH, F.lit(True)).cast("int")
    spans = repeats.withColumn("gap", gap).withColumn("span", F.sum("gap").over(by_row))
    spans = spans.groupBy("row", "span").agg(F.any_value("doc_id").alias("doc_id"), F.min("start").alias("start"), (F.max("start") + WIDTH).alias("end"), F.min_by("f", "start").alias("f"))
    return spans.select("row", "doc_id", "start", "end", F.col("f.row").alias("first_row"), F.col("f.doc_id").alias("first_doc_id"), F.col("f.start").alias("first_start"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without its repeated passages; a row of which no word is left goes, and n_chars, if there, is counted anew.

    What lies between words stays as it was. Rows without repeats, null texts among them, are unchanged.
    """
    row, held = free_name("_row", docs.columns), free_name("_spans", docs.columns)
    spans = repeated_spans(docs).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("start", "end")).alias(held))
    spans = settle(spans, "spans")
    keyed = docs.withColumn(row, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")))
    ids = spans.select(row)
    few = ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    cut = keyed.join(ids, row, "left_semi").join(spans, row).drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.get_field_index("text"), []
            spans = batch.column(held).to_pylist()
            for chunk in T.chunks(batch.column("text")):
                w = T.words(chunk)
                for r in range(chunk.rows):
                    out, done = [], chunk.at[r]
                    left = w.at[r + 1] - w.at[r]
                    for s in sorted(spans[chunk.first + r], key=lambda s: s["start"]):
                        a, b = w.at[r] + s["start"], w.at[r] + s["end"]
                        out.append(chunk.data[done : w.start[a]].tobytes())
                        done, left = w.end[b - 1], left - (b - a)
                    out.append(chunk.data[done : chunk.at[r + 1]].tobytes())
                    texts.append(b"".join(out).decode() if left else None)
            batch = batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([held])
            yield batch.filter(pa.array([t is not None for t in texts]))

    rest = keyed.join(ids, row, "left_anti").drop(row)
    cut = cut.mapInArrow(tidy(run), cut.drop(held).schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.unionByName(cut)
