"""N-gram Jaccard join: documents whose sets of k-word shingles are alike, exactly, and their components.

Signature trees find the pairs. A node has the OR of its members' bitmaps, their least bit count and the range of
their sizes; two nodes are walked together, and a pair of nodes goes as soon as no pair below it can overlap enough.
One tree over a corpus would have all bits set near its root, so Spark first deals the sets to groups: with all
shingles in one fixed order, rare before frequent, two sets that link share one of their first ``n - ceil(t * n) + 1``.
Of the sets that share such a shingle the least is their lead, and each lead has a tree of all sets that it leads:
whatever may link stands in one tree at least.

Trees are walked three times. The first time each set is in one tree, and only a forest of pairs is told, enough to
join what may link. Their exact counts give components. The second time, trees that hold more than one component tell
a forest that joins these, by the likest pairs; the third time, all pairs of components that are still different which
their bitmaps don't rule out. Every link between different sets is then either
verified or joins two members of a component already, so components are exact, and no group is written out as pairs.
Equal sets are one class from the start.

Hot shingles: counts over all documents put those at the end of the order, so that they index a set only if little
else is in it. Sets that one of them leads are found by a minimum that is combined before the shuffle and at most
``FREQUENT`` rows long. The order decides the cost and never the result. Trees of more than ``BLOCK`` sets are dealt
to blocks, and pairs of blocks that lie in one component are left out.

Shingles are told apart by 64-bit hashes, within two sets that are compared; sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _signature_tree as S
from . import _text as T
from ._graph import components
from ._groups import grouped
from ._store import discard, settle, small_batches, tidy

#: Members of a block of a tree.
BLOCK = 8192
#: Shingles of the sets that a task compares at once.
UNIT = 500_000
#: Frequent shingles whose place in the order is looked up: their number bounds what is broadcast (1.6 MB).
FREQUENT = 100_000
#: Ids up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for chunk in T.chunks(batch.column("text")):
        w = T.words(chunk)
        for a, b in zip(w.at[:-1], w.at[1:], strict=True):
            yield T.shingle_set(w.hash[a:b], k)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Of a whole set, 128 bits: equal sets have equal signatures."""
    n = np.array([len(s)], np.uint64)
    one = (s * T.mix(np.arange(1, len(s) + 1, dtype=np.uint64))).sum(dtype=np.uint64, keepdims=True) + n * np.uint64(T.STEP)
    two = T.mix(s ^ np.uint64(T.STEP)).sum(dtype=np.uint64, keepdims=True) + n
    a, b = T.mix(np.concatenate([one, two])).view(np.int64).tolist()
    return a, b


def _count_frequent(k: int):
    keep = 65_536

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, set()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            new, n = new[n > 1], n[n > 1]
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            if len(both) > keep:
                top = np.sort(np.argpartition(total, -keep)[-keep:])
                both, total = both[top], total[top]
            return both, total

        for batch in batches:
            for s in _sets(batch, k):
                if not len(s) or (sig := _signature(s)) in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(sig)
                waiting.append(s)
                size += len(s)
                if size > 2_000_000:
                    keys, counts = merged()
                    waiting, size = [], 0
        keys, counts = merged()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    return run


def _describe(k: int, num: int, den: int, frequent):
    """Size, signature, prefix (its rare and its frequent shingles) and bitmap of each text; the last three only for the first text of a signature in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(frequent.value, np.int64).view(np.uint64)
        by_key = np.argsort(hot)
        hot_sorted = hot[by_key]
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sizes, one, two, rare, late, bitmaps = [], [], [], [], [], []
            for s in _sets(batch, k):
                n = len(s)
                sig = _signature(s) if n else (None, None)
                sizes.append(n), one.append(sig[0]), two.append(sig[1])
                if not n or sig in seen:
                    rare.append(None), late.append(None), bitmaps.append(None)
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(sig)
                p, first, last = n - -(-num * n // den) + 1, s, s[:0]
                if len(hot):
                    at = np.searchsorted(hot_sorted, s)
                    at[at == len(hot)] = 0
                    is_hot = hot_sorted[at] == s
                    if is_hot.any():
                        first, last = s[~is_hot], s[is_hot][np.argsort(by_key[at[is_hot]], kind="stable")]
                rare.append(first[:p].view(np.int64)), late.append(last[: max(0, p - len(first))].view(np.int64))
                bitmaps.append(S.bitmap(s))
            keys = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, one, two)), pa.array(rare, keys), pa.array(late, keys), pa.array(bitmaps, pa.binary())],
                ["doc_id", "n", "s1", "s2", "rare", "late", "bitmap"],
            )

    return run


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, sets = [], [], []
            for s in _sets(batch, k):
                if len(s):
                    a, b = _signature(s)
                    one.append(a), two.append(b), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sets, pa.binary())], ["s1", "s2", "shingles"])

    return run


def _walks(labelled: bool, forest: bool, num: int, den: int):
    """(lead, part, a, b) from the trees of each (lead, one, two); the pairs of a part have ``UNIT`` shingles or little more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["lead", "one", "two"]):
            if t.num_rows < 2:
                continue
            sid, n, block = (t.column(c).to_numpy() for c in ("sid", "n", "block"))
            label = t.column("comp").to_numpy() if labelled else None
            lead, one, two = (t.column(c)[0].as_py() for c in ("lead", "one", "two"))
            size, part = 0, 0
            for i, j in S.pairs(t.column("bitmap").to_pylist(), n, label, forest, num, den):
                if one != two:
                    ok = block[i] != block[j]
                    i, j = i[ok], j[ok]
                total = size + np.cumsum(n[i] + n[j])
                parts = part + total // UNIT
                if len(i):
                    part, size = int(parts[-1]), int(total[-1] % UNIT)
                    here = [pa.array(np.full(len(i), v), pa.int64()) for v in (lead, one, two)]
                    yield pa.RecordBatch.from_arrays([*here, pa.array(parts), pa.array(np.minimum(sid[i], sid[j])), pa.array(np.maximum(sid[i], sid[j]))], ["lead", "one", "two", "part", "a", "b"])

    return run


def _counted(num: int, den: int):
    """The pairs of each unit whose sets are alike; the unit's sets come ahead of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["unit"]):
            shingles, a, b = t.column("shingles").to_pylist(), t.column("a").to_pylist(), t.column("b").to_pylist()
            sets = {x: np.frombuffer(s, np.uint64) for x, s in zip(a, shingles, strict=True) if s is not None}
            found = []
            for x, y, s in zip(a, b, shingles, strict=True):
                if s is None:
                    few, many = sorted((sets[x], sets[y]), key=len)
                    common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                    if common * (num + den) >= (len(few) + len(many)) * num:
                        found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def _narrowed(df: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join with distinct ids, without a shuffle of ``df`` while they are few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def _verified(docs: DataFrame, told: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of sets that are alike, by exact counts. Only the texts that are asked for are cut again, and a unit gets each set once."""
    asked = pairs.select("unit", F.explode(F.array("a", "b")).alias("rid")).distinct()
    ids = settle(asked.select("rid").distinct(), "ids")
    names = settle(_narrowed(told.select("rid", "doc_id", "s1", "s2"), ids, "rid", "left_semi"), "names")
    one = names.select(F.col("doc_id").alias("one")).distinct()
    few = one.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(one) if few else one, F.col("doc_id").eqNullSafe(F.col("one")), "left_semi")
    sets = texts.select("text").mapInArrow(tidy(_shingles(k)), "s1 long, s2 long, shingles binary")
    asked = settle(asked.join(names.drop("doc_id"), "rid").select("unit", "rid", "s1", "s2"), "asked")
    met = _narrowed(sets, asked, ["s1", "s2"], "inner")
    rows = met.select("unit", F.lit(0).alias("is_pair"), F.col("rid").alias("a"), F.lit(0).cast("long").alias("b"), "shingles")
    rows = rows.unionByName(pairs.select("unit", F.lit(1).alias("is_pair"), "a", "b", F.lit(None).cast("binary").alias("shingles")))
    links = settle(rows.repartition("unit").sortWithinPartitions("unit", "is_pair").mapInArrow(tidy(_counted(num, den)), "a long, b long"), "links")
    discard(ids, names, asked)
    return links


def _told_pairs(rows: DataFrame, told: DataFrame, labelled: bool, forest: bool, num: int, den: int) -> DataFrame:
    """(unit, a, b) from the trees of ``rows(lead, one, two, block, sid, comp)``, one pair once."""
    leaf = told.where("bitmap is not null").select(F.col("rid").alias("sid"), "n", "bitmap")
    members = rows.join(leaf, "sid").repartition("lead", "one", "two").sortWithinPartitions("lead", "one", "two")
    found = members.mapInArrow(tidy(_walks(labelled, forest, num, den)), "lead long, one long, two long, part long, a long, b long")
    unit = F.xxhash64("lead", "one", "two", "part")  # units that fall together are only compared at once
    return found.select(unit.alias("unit"), "a", "b").dropDuplicates(["a", "b"])


def _blocks(rows: DataFrame, apart: bool) -> DataFrame:
    """``rows(lead, sid, comp)`` with the pairs (one, two) of blocks that a member is compared in.

    ``apart``: all pairs of blocks but those within one component; otherwise each block by itself, with the lead in all.
    A component of more members than a block has blocks of its own.
    """
    sizes = rows.groupBy("lead").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.where(F.col("members") > BLOCK)
    small = rows.join(large.select("lead"), "lead", "left_anti").withColumns({"one": F.lit(0).cast("long"), "two": F.lit(0).cast("long"), "block": F.lit(0).cast("long")})
    rows = rows.join(large, "lead")
    own = rows.groupBy("lead", "comp").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") > BLOCK)
    rows = rows.join(own, ["lead", "comp"], "left")
    number = lambda of, n: F.pmod(F.xxhash64(of), F.ceil(F.col(n) / BLOCK))
    rows = rows.withColumn("block", F.when(F.col("own").isNull(), number("comp", "members")).otherwise(F.xxhash64("comp", number("sid", "own"))))
    if apart:
        there = rows.select("lead", "block", F.when(F.col("own").isNotNull(), F.col("comp")).alias("all")).distinct()
        met = there.toDF("lead", "one", "x").join(there.toDF("lead", "two", "y"), "lead").where("one <= two and (x is null or y is null or x <> y)").select("lead", "one", "two")
        sides = met.withColumn("block", F.col("one")).unionByName(met.where("one < two").withColumn("block", F.col("two")))
        out = rows.join(sides, ["lead", "block"])
    else:
        rows = rows.where("sid <> lead")
        heads = rows.select("lead", "block").distinct().withColumns({"sid": F.col("lead"), "comp": F.col("lead")})
        out = rows.select("lead", "block", "sid", "comp").unionByName(heads).withColumns({"one": F.col("block"), "two": F.col("block")})
    return small.unionByName(out.select(small.columns))


def ngram_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; two rows link when their shingle sets have
    ``den * intersection >= num * union``. component_id is the least doc_id that links reach.

    Null and blank texts have no shingles and link with nothing: component_id is their own doc_id. Fewer than
    k words are one shingle. Repeated rows give one result each. Rows with a null doc_id are compared like others
    and never name a component; one that reaches no doc_id has a null component_id. Other columns are left out.
    An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    frequent = docs.select("text").mapInArrow(tidy(_count_frequent(k)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 32").orderBy(F.desc("n"), "key").limit(FREQUENT)
    hot = [r["key"] for r in frequent.collect()][::-1]
    shared = spark.sparkContext.broadcast(np.array(hot, np.int64).tobytes())
    told = docs.mapInArrow(tidy(_describe(k, num, den, shared)), "doc_id long, n long, s1 long, s2 long, rare array<long>, late array<long>, bitmap binary")
    told = settle(told.withColumn("rid", F.monotonically_increasing_id()), "sets")

    # A set that several tasks have met is known by its least row.
    held = told.where("bitmap is not null")
    classes = settle(told.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("bitmap").isNotNull(), F.col("rid"))).alias("sid"), F.count("bitmap").alias("held")), "classes")
    again = held.select("rid", "s1", "s2").join(classes.where("held > 1"), ["s1", "s2"]).where("rid <> sid").select("rid")
    once = _narrowed(held.select("rid", "rare", "late"), settle(again, "again"), "rid", "left_anti")

    rare = once.select(F.explode("rare").alias("key"), F.col("rid").alias("sid"))
    by_key = Window.partitionBy("key")
    led = rare.withColumn("lead", F.min("sid").over(by_key)).where("sid <> lead").select("lead", "sid")
    late = once.select(F.explode("late").alias("key"), F.col("rid").alias("sid"))
    leads = late.groupBy("key").agg(F.min("sid").alias("lead"), F.max("sid").alias("last")).where("lead < last").select("key", "lead")
    led = led.unionByName(late.join(F.broadcast(leads), "key").where("sid <> lead").select("lead", "sid"))
    groups = settle(led.distinct(), "groups")

    home = groups.groupBy("sid").agg(F.min("lead").alias("lead")).select("lead", "sid")
    home = home.unionByName(home.select("lead", F.col("lead").alias("sid")).distinct()).withColumn("comp", F.col("sid"))
    told_pairs = settle(_told_pairs(_blocks(home, False), told, False, True, num, den), "pairs")
    links = _verified(docs, told, told_pairs, k, num, den)
    comps = settle(components(links, "a", "b"), "components")
    asked = told_pairs.select("a", "b")
    for forest in (True, False):
        label = comps.select(F.col("node").alias("sid"), F.col("component").alias("comp"))
        rows = groups.join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        leads = label.select(F.col("sid").alias("lead"), F.col("comp").alias("lead_comp"))
        rows = settle(rows.join(leads, "lead", "left").withColumn("lead_comp", F.coalesce("lead_comp", "lead")), "rows")
        mixed = rows.where("comp <> lead_comp").select("lead").distinct()
        rest = rows.join(mixed, "lead", "left_semi")
        rest = settle(rest.select("lead", "sid", "comp").unionByName(rest.select("lead", F.col("lead").alias("sid"), F.col("lead_comp").alias("comp")).distinct()), "rest")
        if not rest.limit(1).count():
            break
        told_pairs = settle(_told_pairs(_blocks(rest, True), told, True, forest, num, den).join(asked, ["a", "b"], "left_anti").select("unit", "a", "b"), "pairs")
        if told_pairs.limit(1).count():
            asked, links = asked.unionByName(told_pairs.select("a", "b")), links.unionByName(_verified(docs, told, told_pairs, k, num, den))
            comps = settle(components(links, "a", "b"), "components")
        discard(rows, rest)

    reached = classes.join(comps.withColumnRenamed("node", "sid"), "sid")
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = reached.join(least, "component").select("s1", "s2", "component_id")
    names = classes.join(reached, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component_id", "least").alias("component_id"))
    out = told.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(names, ["s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
