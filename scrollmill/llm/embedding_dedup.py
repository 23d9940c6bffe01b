"""Vectors with a cosine of at least a threshold, by a subspace pigeonhole join.

Unit vectors with cosine c are at a squared distance of 2 - 2c. A rotation is cut into blocks of
coordinates, and each block gets a share of the greatest allowed squared distance, in proportion to the
variance of its coordinates: two vectors that link are within the share in one block at least. In each
block a grid over its first two coordinates, with cells as wide as the share's root, deals the vectors to
cells and to half of the neighbouring cells, so two vectors in reach meet once. There, distances in the
block pick candidates, and cosines in double precision decide. A pair belongs to its first block in reach.

The rotation is that of the principal components of a bounded sample, dealt to the blocks by turns; any
rotation gives the same links. Equal vectors are one class. A cell's vectors are split into lists of
``LEFT``, and the others pass each list in chunks, so no task holds a cell. Links are counted and reduced
to spanning edges where they are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import settle

BLOCKS, LEFT, CHUNK, SAMPLE = 4, 16_384, 512, 5_000
#: Of the neighbouring cells those that come later; a pair of cells meets once.
_LATER = ((1, 0), (1, 1), (0, 1), (1, -1))


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


class Blocks:
    """Rotation, blocks and shares for one dimension."""

    def __init__(self, sample: np.ndarray, dim: int, threshold: float, blocks: int = BLOCKS):
        if len(sample) > 1:
            variance, axes = np.linalg.eigh(sample.T @ sample / len(sample) - np.outer(sample.mean(0), sample.mean(0)))
            variance, axes = np.maximum(variance[::-1], 1e-6), axes[:, ::-1]
        else:
            variance, axes = np.ones(dim), np.eye(dim)
        n = max(1, min(blocks, dim // 2))
        turns = [np.arange(b, dim, n) for b in range(n)]
        self.rotation = np.ascontiguousarray(axes[:, np.concatenate(turns)])
        self.cuts = np.concatenate([[0], np.cumsum([len(t) for t in turns])])
        share = np.array([variance[t].sum() for t in turns])
        self.reach2 = (2 - 2 * threshold) * share / share.sum() + 1e-12

    def part(self, rotated: np.ndarray, b: int) -> np.ndarray:
        return rotated[:, self.cuts[b] : self.cuts[b + 1]]

    def cells(self, rotated: np.ndarray, b: int) -> np.ndarray:
        two = self.part(rotated, b)[:, :2]
        out = np.zeros((len(rotated), 2), np.int32)
        out[:, : two.shape[1]] = np.floor(two / np.sqrt(self.reach2[b]))
        return out


def _raw(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles, and null for those that cannot link."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            x = None if not v or any(c is None for c in v) else np.array(v, np.float64)
            ok = x is not None and np.isfinite(x).all() and 0 < (x * x).sum() < np.inf
            out.append((x + 0.0).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "raw"])


class Plans:
    """A plan for each dimension: of the sample's vectors where it has some."""

    def __init__(self, sample: list[bytes], threshold: float):
        by_dim: dict[int, list[bytes]] = {}
        for x in sample:
            by_dim.setdefault(len(x) // 8, []).append(x)
        self.threshold = threshold
        self.made = {d: Blocks(_unit(np.frombuffer(b"".join(xs)).reshape(-1, d)), d, threshold) for d, xs in by_dim.items()}

    def __getitem__(self, dim: int) -> Blocks:
        return self.made.get(dim) or Blocks(np.zeros((0, dim)), dim, self.threshold)


def _dealt(shared):
    """Each class to its cell in each block (as home), and to the earlier neighbouring cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) // 8 for x in batch.column("raw").to_pylist()])
            for dim in np.unique(lengths).tolist():
                rows, plan = batch.filter(pa.array(lengths == dim)), shared.value[dim]
                rotated = _unit(_raw(rows.column("raw"))) @ plan.rotation
                for b in range(len(plan.reach2)):
                    cell = plan.cells(rotated, b)
                    for k, (dx, dy) in enumerate(((0, 0), *_LATER)):
                        same = [pa.array(np.full(rows.num_rows, v, np.int32)) for v in (dim, b)]
                        place = [pa.array(cell[:, 0] - dx), pa.array(cell[:, 1] - dy), pa.array(np.full(rows.num_rows, k == 0))]
                        yield pa.RecordBatch.from_arrays([*same, *place, *(rows.column(c) for c in ("id", "size", "raw"))], ["dim", "block", "x", "y", "home", "id", "size", "raw"])

    return run


def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each part that the links a-b join."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


class _List:
    """A list of a cell's vectors, which meets itself and then others in chunks."""

    def __init__(self, rows: pa.Table, plan: Blocks, b: int, threshold: float):
        self.plan, self.b, self.threshold = plan, b, threshold
        self.side = self._side(rows)
        self.label = np.arange(rows.num_rows)

    def _side(self, rows: pa.Table) -> tuple[np.ndarray, ...]:
        unit = _unit(_raw(rows.column("raw")))
        rotated = unit @ self.plan.rotation
        return rows.column("id").to_numpy(), rows.column("size").to_numpy(), unit, rotated, self.plan.part(rotated, self.b).astype(np.float32)

    def meet(self, rows: pa.Table | None) -> pa.RecordBatch:
        """(id, links, to): links of each vector that are found here, and edges that join what the links join."""
        own, plan, b = rows is None, self.plan, self.b
        ids, sizes, unit, rotated, part = self.side
        ids2, sizes2, unit2, rotated2, part2 = self.side if own else self._side(rows)
        n, shift = len(ids), 0 if own else len(ids)
        links = np.zeros(len(ids2) + shift, np.int64)
        before = np.concatenate([self.label, np.arange(n, n + len(ids2) if not own else n)])
        label = before.copy()
        for at in range(0, len(ids2), CHUNK):
            y = part2[at : at + CHUNK]
            near = (part * part).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * part @ y.T <= plan.reach2[b] + 1e-4
            if own:
                near &= np.arange(n)[:, None] < np.arange(at, at + len(y))[None, :]
            i, j = np.nonzero(near)
            for c in range(0, len(i), 100_000):
                p, q = i[c : c + 100_000], j[c : c + 100_000] + at
                ok = np.einsum("ij,ij->i", unit[p], unit2[q]) >= self.threshold
                p, q = p[ok], q[ok]
                gap = (rotated[p] - rotated2[q]) ** 2
                reached = np.stack([plan.part(gap, k).sum(1) <= plan.reach2[k] for k in range(b + 1)])
                mine = reached[b] & ~reached[:b].any(0)
                p, q = p[mine], q[mine]
                np.add.at(links, p, sizes2[q])
                np.add.at(links, q + shift, sizes[p])
                label = _labels(label, p, q + shift)
        self.label = label[:n].copy()
        names = ids if own else np.concatenate([ids, ids2])
        some, moved = np.flatnonzero(links), np.flatnonzero(label != before)
        to = np.concatenate([np.zeros(len(some), np.int64), names[label[moved]]])
        return pa.RecordBatch.from_arrays(
            [pa.array(names[np.concatenate([some, moved])]), pa.array(np.concatenate([links[some], np.zeros(len(moved), np.int64)])), pa.array(to, mask=np.arange(len(to)) < len(some))], ["id", "links", "to"]
        )


def _met(shared, threshold: float):
    keys = ["dim", "block", "x", "y", "list", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None

        def ready() -> _List:
            return _List(pa.Table.from_batches(waiting), shared.value[now[0]], now[1], threshold)

        for batch in batches:
            columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
            cut = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                *key, left = columns[:, a].tolist()
                if key != now:
                    if waiting:
                        yield ready().meet(None)
                    now, waiting, held = key, [], None
                if left:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if waiting:
                    held, waiting = ready(), []
                    yield held.meet(None)
                if held:
                    yield held.meet(pa.Table.from_batches([batch.slice(a, b - a)]))
        if waiting:
            yield ready().meet(None)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, ...)``.

    n_links: other rows with a cosine of at least ``threshold``, in double precision; component_id: the least vec_id
    that links reach, itself included; kept: whether that is the row's own. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, nor do vectors of different length. Repeated rows are linked with each
    other. A row with a null vec_id is compared like others and names no component. Other columns are left out. No rows give none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    told = rows.mapInArrow(_valid, "vec_id long, raw binary").withColumn("id", F.when(F.col("raw").isNotNull(), F.xxhash64("raw")))
    told = settle(told, "vectors")
    classes = settle(told.where("raw is not null").groupBy("id").agg(F.any_value("raw").alias("raw"), F.count(F.lit(1)).alias("size")), "classes")
    sample = [bytes(r["raw"]) for r in classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("raw").collect()]
    plans = spark.sparkContext.broadcast(Plans(sample, threshold))

    cell = ["dim", "block", "x", "y"]
    dealt = classes.mapInArrow(_dealt(plans), "dim int, block int, x int, y int, home boolean, id long, size long, raw binary")
    # Only cells beyond one list are told: no more of them than vectors by LEFT, a block.
    crowded = dealt.where("home").groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / LEFT).cast("int").alias("lists")).where("lists > 1")
    lists = F.coalesce("lists", F.lit(1))
    dealt = dealt.join(F.broadcast(crowded), cell, "left").withColumn("own", F.pmod(F.xxhash64("id"), lists).cast("int"))
    dealt = dealt.withColumn("list", F.explode(F.sequence(F.lit(0), lists - 1))).where("not home or list <= own")
    dealt = dealt.select(*cell, "list", (F.col("home") & (F.col("list") == F.col("own"))).alias("left"), "id", "size", "raw")
    by_list = dealt.repartition(*cell, "list").sortWithinPartitions(*cell, "list", F.desc("left"))
    met = settle(by_list.mapInArrow(_met(plans, threshold), "id long, links long, to long"), "met")

    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(met.where("to is not null").select("id", "to"), "id", "to").select(F.col("node").alias("id"), F.col("component").alias("c"))
    of_class = classes.select("id", "size").join(links, "id", "left").join(comps, "id", "left")
    of_class = of_class.select("id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("c", "id").alias("c"))
    named = settle(told.select("vec_id", "id").join(of_class, "id", "left"), "named")
    least = named.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("least"))
    component = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    out = named.join(least, "c", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
