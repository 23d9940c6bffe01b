"""Turns as they are read from pages: roles, selections, windows that overlap, stop rules and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Part of a window's height that one step moves on; the step where a window has no height.
STEP_FACTOR, STEP_LEAST = 0.6, 400
#: Passes without progress after which loading is believed done; seconds without progress, and in all, before giving up.
STABLE_PASSES, IDLE_S, MOST_S = 3, 15, 300
#: Confidence of a selection whose turns all have keys of their own, and of another.
KEYED, UNKEYED = 0.9, 0.7


def map_roles(turns: DataFrame, roles: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Turns with a known role, mapped, and a row (conv_id, turn, warning) for each of the others, which are dropped rather than guessed."""
    known = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv))
    mapped = turns.withColumn("mapped", known[F.col("role")])
    said = F.concat(F.lit("Turn "), (F.col("turn") + 1).cast("string"), F.lit(' had an unrecognised role "'), F.coalesce("role", F.lit("none")), F.lit('" and was skipped.'))
    return mapped.where("mapped is not null").withColumn("role", F.col("mapped")).drop("mapped"), mapped.where("mapped is null").select("conv_id", "turn", said.alias("warning"))


def adapter_for(host: Column, adapters: list[tuple[str, list[str]]]) -> Column:
    """The first adapter of which a host name is the page's, or a parent of it; null if none is."""
    found = F.lit(None).cast("string")
    for name, hosts in reversed(adapters):
        hit = F.lit(False)
        for h in hosts:
            hit = hit | (host == h) | host.endswith("." + h)
        found = F.when(hit, name).otherwise(found)
    return found


def selected_turns(turns: DataFrame, ranges: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body) of the turns that a range (conv_id, from, to) of the joined text meets, whole. An empty range meets none."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    ends = F.sum(F.length("body").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    placed = turns.withColumn("end", ends).withColumn("start", F.col("end") - F.length("body"))
    met = placed.join(ranges, "conv_id").where((F.col("from") < F.col("to")) & (F.col("start") <= F.col("to")) & (F.col("end") >= F.col("from")))
    return met.select("conv_id", "turn", "role", "body")


def selection_confidence(turns: DataFrame, keyed: Column) -> DataFrame:
    """(conv_id, n, score) of a selection."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.when(F.min(keyed), KEYED).otherwise(UNKEYED).alias("score"))


def first_per_name(rows: DataFrame, owner: str, name: str, order: str, values: list[str]) -> DataFrame:
    """Of the rows of an owner that bear one name, the first; combined before the shuffle."""
    return rows.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(owner, name).agg(F.min_by(F.struct(order, *values), order).alias("v")).select(owner, name, "v.*")


def distinct_in_order(rows: DataFrame, owner: str, value: str, order: str) -> DataFrame:
    """(owner, values) without repeats, each at the place of its first; only distinct values are gathered."""
    first = rows.groupBy(owner, value).agg(F.min(order).alias("at"))
    return first.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def step(height: Column) -> Column:
    return F.when(height > 0, F.greatest(F.floor(height * STEP_FACTOR), F.lit(1))).otherwise(STEP_LEAST).cast("long")


def windowed_walk(rows: DataFrame, key: str, place: str, height: int) -> DataFrame:
    """(key, window, place) of every row that a walk in overlapping windows sees; the last windows end at the end.

    A window starts at each multiple of the step; the walk ends with the first that reaches the last row.
    """
    size = rows.groupBy(key).agg((F.max(place) + 1).alias("n"))
    move = max(int(height * STEP_FACTOR), 1) if height > 0 else STEP_LEAST
    last = F.ceil(F.greatest(F.col("n") - height, F.lit(0)) / move)
    seen = F.sequence(F.greatest(F.ceil((F.col(place) - height + 1) / move), F.lit(0)), F.least(F.floor(F.col(place) / move), last))
    held = F.greatest(F.ceil((F.col(place) - height + 1) / move), F.lit(0)) <= F.least(F.floor(F.col(place) / move), last)
    return rows.join(size, key).where(held).select(key, place, F.explode(seen).alias("window"))


def verdicts(passes: DataFrame, key: str) -> DataFrame:
    """(key, passes, found, reason, complete) from passes(key, pass, at, added), at in seconds from the start.

    Passes are read until one of these stops the harvest: ``stabilised``, the ``STABLE_PASSES``-th pass in turn that adds nothing;
    ``idleTimeout``, a pass more than ``IDLE_S`` after the last progress; ``maxTimeout``, one later than ``MOST_S``. Otherwise the
    content was ``exhausted``. Only exhausted and stabilised harvests are complete.
    """
    by = Window.partitionBy(key).orderBy("pass")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    told = passes.withColumn("progress", F.coalesce(F.max(F.when(F.col("added") > 0, F.col("at"))).over(before), F.lit(0)))
    told = told.withColumn("group", F.count(F.when(F.col("added") > 0, 1)).over(upto))
    told = told.withColumn("barren", F.sum((F.col("added") == 0).cast("int")).over(Window.partitionBy(key, "group").orderBy("pass").rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.when(F.col("at") > MOST_S, "maxTimeout").when((F.col("added") == 0) & (F.col("at") - F.col("progress") > IDLE_S), "idleTimeout").when(F.col("barren") >= STABLE_PASSES, "stabilised")
    told = told.withColumn("stop", stop).withColumn("over", F.coalesce(F.count("stop").over(before), F.lit(0)) > 0).where("not over")
    g = told.groupBy(key).agg(F.count(F.lit(1)).alias("passes"), F.sum("added").cast("long").alias("found"), F.coalesce(F.max("stop"), F.lit("exhausted")).alias("reason"))
    return g.withColumn("complete", F.col("reason").isin("exhausted", "stabilised"))
