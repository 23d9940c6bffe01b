"""Identity, tags, names and index upkeep of the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def body_hashes(messages: DataFrame, source: str = "web") -> DataFrame:
    """(conv_id, n_turns, body_hash): digest of the source, no model and the turns in order."""
    told = messages.select("conv_id", "turn", T.canonical_turn(F.col("role"), F.col("body")).alias("x"))
    joined = told.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda s: s["x"]), "").alias("x"))
    return joined.select("conv_id", "n_turns", T.digest(F.concat(F.lit(f"{source}\x1f"), F.col("x"))).alias("body_hash"))


def duplicate_groups(rows: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(fingerprint, n, first) of fingerprints that several rows have; empty ones never group.

    Equal rows are first counted, so only keys of real groups are brought together.
    """
    known = rows.where(F.col(fingerprint) != "")
    big = known.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")
    return big


def duplicate_members(rows: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Membership as rows (fingerprint, key), for groups of any size."""
    return rows.where(F.col(fingerprint) != "").join(duplicate_groups(rows, key, fingerprint).select(fingerprint), fingerprint, "left_semi").select(fingerprint, key)


def collision_names(names: DataFrame, by: str, order: str) -> DataFrame:
    """``names`` with final: the name, or ``name (n)`` from the second holder on, n from 2 in the given order."""
    n = numbered(names, by, order)
    n = n.withColumn("final", F.when(F.col("__n") == 1, F.col(by)).otherwise(F.concat(F.col(by), F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))))
    return n.drop("__n")


#: Ranges of the order into which the holders of one name are dealt.
RANGES = 64


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with __n, the place in ``order`` among equal ``by``. A numeric order is cut into ranges, so that no key is one task's work."""
    if not dict(rows.dtypes)[order].startswith(("bigint", "int", "smallint", "tinyint", "double", "float", "decimal")):
        return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    cuts = rows.agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)]).alias("c")).first()["c"] or []
    cut = rows.withColumn("__r", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(order))) if cuts else F.lit(0))
    upto = Window.partitionBy(by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(by, "__r").agg(F.count(F.lit(1)).alias("k")).withColumn("__before", F.coalesce(F.sum("k").over(upto), F.lit(0))).drop("k")
    inside = cut.withColumn("__i", F.row_number().over(Window.partitionBy(by, "__r").orderBy(order)))
    key = before.select(F.col(by).alias("__by"), F.col("__r").alias("__range"), "__before")
    met = inside.join(key, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__r") == F.col("__range")))
    return met.withColumn("__n", F.col("__i") + F.col("__before")).drop("__by", "__range", "__r", "__i", "__before")


def index_delta(known: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """(key, status): unchanged where times differ by less than a microsecond and sizes are equal, else added, changed or removed."""
    old, new = known.select(key, F.col("mtime").alias("m0"), F.col("byte_size").alias("s0")), seen.select(key, F.col("mtime").alias("m1"), F.col("byte_size").alias("s1"))
    status = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "removed").when((F.abs(F.col("m0") - F.col("m1")) < 1e-6) & (F.col("s0") == F.col("s1")), "unchanged").otherwise("changed")
    return old.join(new, key, "full").select(key, status.alias("status"))


def pass_report(delta: DataFrame, unreadable: DataFrame, key: str = "path") -> DataFrame:
    """One row of counters of a pass: indexed, unchanged, removed, failed (added or changed, but unreadable) and total, which is indexed and unchanged."""
    met = delta.join(unreadable.select(key, F.lit(True).alias("bad")), key, "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    new = F.col("status").isin("added", "changed")
    g = met.agg(F.count_if(new & ~F.col("bad")).alias("indexed"), F.count_if(F.col("status") == "unchanged").alias("unchanged"), F.count_if(F.col("status") == "removed").alias("removed"), F.count_if(new & F.col("bad")).alias("failed"))
    return g.withColumn("total", F.col("indexed") + F.col("unchanged"))


def refreshed(old: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """The index after a pass over all that is there now: rows of paths that are gone go, those of paths that were seen are replaced."""
    return replace_by_path(remove_paths(old, old.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti"), key), seen, key)


def replace_by_path(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The next generation of a table: new rows, and the old ones of other paths."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove_paths(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def missing_paths(known: DataFrame, seen: DataFrame, folder: str, key: str = "path") -> DataFrame:
    """Known paths of the folder that this pass has not seen; other folders' paths are never missing."""
    return known.where(F.col(key).startswith(folder.rstrip("/") + "/")).join(seen.select(key), key, "left_anti").select(key)


def _turn_digest(messages: DataFrame) -> Column:
    """Of role and normalised body, and of source and model where the table has them: only conversations of one source and model are alike."""
    of = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "model") if c in messages.columns]
    return T.digest(F.concat_ws("\x1f", *of, T.canonical_turn(F.col("role"), F.col("body"))))


def prefix_hashes(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n, hash) for each number n of leading turns, so heads can be met by equality."""
    told = messages.select(key, "turn", _turn_digest(messages).alias("x"))
    place = told.select(key, "x", F.row_number().over(Window.partitionBy(key).orderBy("turn")).alias("n"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # Sums of placed hashes grow with the head, one step a turn, and two of them name it.
    part = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)")).over(w).cast("string")
    return place.select(key, "n", F.concat_ws(":", part("x", "n"), part("n", "x")).alias("hash"))


def decide(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(conv_id, action) of a save: existing and incoming are (conv_id, turn, role, body), existing also intact boolean.

    No existing turns: write_new. Not intact: write_alongside. The same turns after normalising: unchanged. Existing turns
    are the head of more incoming ones: append. Else write_alongside.
    """
    e, i = prefix_hashes(existing), prefix_hashes(incoming)
    last = e.groupBy("conv_id").agg(F.max_by(F.struct("n", "hash"), "n").alias("e"))
    intact = existing.groupBy("conv_id").agg(F.min("intact").alias("intact"))
    size = i.groupBy("conv_id").agg(F.max("n").alias("m"))
    met = size.join(last, "conv_id", "left").join(intact, "conv_id", "left")
    met = met.join(i.select(F.col("conv_id").alias("c"), "n", "hash"), (F.col("conv_id") == F.col("c")) & (F.col("e.n") == F.col("n")) & (F.col("e.hash") == F.col("hash")), "left")
    action = F.when(F.col("e").isNull(), "write_new").when(~F.col("intact"), "write_alongside").when(F.col("hash").isNotNull() & (F.col("m") == F.col("n")), "unchanged")
    return met.select("conv_id", action.when(F.col("hash").isNotNull() & (F.col("m") > F.col("n")), "append").otherwise("write_alongside").alias("action"))


def match_existing(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(conv_id, file, how): for each incoming conversation the best existing file: exact, then prefix, then edited; then by name.

    existing(file, turn, role, body), incoming(conv_id, turn, role, body). Edited: as many turns, at least half of them equal in place.
    """
    e, i = prefix_hashes(existing, "file"), prefix_hashes(incoming)
    # Of files with the same turns the least is enough.
    last = e.groupBy("file").agg(F.max_by(F.struct("n", "hash"), "n").alias("e")).groupBy("e.n", "e.hash").agg(F.min("file").alias("file"))
    size = i.groupBy("conv_id").agg(F.max("n").alias("m"))
    heads = i.join(last, ["n", "hash"]).join(size, "conv_id").select("conv_id", "file", F.when(F.col("n") == F.col("m"), 0).otherwise(1).alias("rank"))
    # Edited: one conversation for each content on either side. Of n turns half must be equal, so one of any n // 2 + 1 of them is:
    # pairs meet at the rarest of those, and only then is every place compared.
    whole = i.join(size, "conv_id").where("n = m").select("conv_id", "n", "hash")
    ours = whole.groupBy("n", "hash").agg(F.min("conv_id").alias("conv_id"))
    told = lambda d, k: d.select(k, F.count(F.lit(1)).over(Window.partitionBy(k)).alias("n"), "turn", _turn_digest(d).alias("x"))
    old = told(existing.join(last.select("file"), "file", "left_semi"), "file")
    new = told(incoming.join(ours.select("conv_id"), "conv_id", "left_semi"), "conv_id")
    place = ["n", "turn", "x"]
    # Of one or two turns a single equal one is enough, and then the least file that has it.
    least = old.where("n <= 2").groupBy(place).agg(F.min("file").alias("file"))
    brief = new.where("n <= 2").join(least, place).groupBy("conv_id").agg(F.min("file").alias("file"))
    rare = F.row_number().over(Window.partitionBy("conv_id").orderBy("often", "turn"))
    many = old.where("n > 2")
    few = new.where("n > 2").join(many.groupBy(place).agg(F.count(F.lit(1)).alias("often")), place, "left").withColumn("often", F.coalesce("often", F.lit(0)))
    pairs = few.withColumn("r", rare).where("r <= floor(n / 2) + 1").join(many, place).select("conv_id", "file").distinct()
    same = pairs.join(new, "conv_id").join(many, [*place, "file"]).groupBy("conv_id", "file", "n").agg(F.count(F.lit(1)).alias("same")).where("2 * same >= n")
    same = same.select("conv_id", "file").unionByName(brief)
    same = same.join(ours.select("conv_id", "hash", "n"), "conv_id").select("n", "hash", "file").join(whole, ["n", "hash"]).select("conv_id", "file", F.lit(2).alias("rank"))
    best = heads.unionByName(same).groupBy("conv_id").agg(F.min(F.struct("rank", "file")).alias("b"))
    return best.select("conv_id", "b.file", F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("edited")), F.col("b.rank") + 1).alias("how"))


def accumulate_latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last sighting of each key; combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"), F.count(F.lit(1)).alias("sightings")).select(*keys, "sightings", "v.*")


def idle_sessions(rows: DataFrame, key: str, ts: str, idle_s: int) -> DataFrame:
    """(key, started, ended, n) of stretches without a gap longer than idle_s seconds."""
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w)) > idle_s * 1_000_000).cast("int"), F.lit(1))
    cut = rows.select(key, ts, new.alias("new")).withColumn("s", F.sum("new").over(w))
    return cut.groupBy(key, "s").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n")).drop("s")


def extraction_confidence(messages: DataFrame) -> DataFrame:
    """(conv_id, score, reliable): 1, less 0.2 if a role has no mapping and 0.3 if a turn has no key."""
    g = messages.groupBy("conv_id").agg(F.count_if(~F.col("role").isin("user", "assistant", "reasoning")).alias("odd"), F.count_if(F.col("body") == "").alias("bare"))
    score = T.clamp(F.lit(1.0) - F.when(F.col("odd") > 0, 0.2).otherwise(0.0) - F.when(F.col("bare") > 0, 0.3).otherwise(0.0))
    return g.select("conv_id", F.round(score, 6).alias("score"), ((F.col("odd") == 0) & (F.col("bare") == 0) & (score >= 0.75)).alias("reliable"))
