"""Requests, destinations and the text forms of tool calls and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import CONVERSATION, REQUEST, TURN
from ..sources.store import exists
from .archive import numbered

VERSION = 1
ACTIONS = ("saveConversation", "searchArchive", "ping")
BEHAVIOURS = ("separate", "daily", "append")
ROLES = ("user", "assistant", "reasoning")
#: Parts of a turn that are lists, and their types.
TURN_ARRAYS = [("toolCalls", "array<struct<name:string,input:string,output:string>>"), ("attachments", "array<struct<name:string,kind:string,byteSize:bigint,url:string,inline:boolean>>")]


def read_requests(messages: DataFrame) -> DataFrame:
    """``messages(message, ...)`` with request and error: null, or what is wrong. The id is kept even of a message that does not parse."""
    met = messages.withColumn("request", F.from_json("message", REQUEST, {"mode": "PERMISSIVE"}))
    r = F.col("request")
    bad = F.get_json_object("message", "$.version").isNull() & F.get_json_object("message", "$.id").isNull()
    error = F.when(F.col("message").isNull() | bad, "malformed").when(r["version"].isNull() | (r["version"] != VERSION), "unsupportedVersion").when(F.coalesce(r["id"], F.lit("")) == "", "missingId")
    error = error.when(r["action"].isNull() | ~r["action"].isin(*ACTIONS), "unknownAction").when((r["action"] == "saveConversation") & r["conversation"].isNull(), "missingConversation")
    error = error.when((r["action"] == "searchArchive") & (F.trim(F.coalesce(r["query"], F.lit(""))) == ""), "missingQuery")
    return met.withColumn("id", F.coalesce(r["id"], F.get_json_object("message", "$.id"))).withColumn("error", error)


#: Levels of a message that may cross: the value itself is level 0.
DEEPEST = 8


def plain_data_errors(messages: DataFrame, key: str = "id", label: str = "conversation") -> DataFrame:
    """(key, path, error) of every value of ``messages(key, message)`` that can't cross: JSON that does not parse, values below level ``DEEPEST``, numbers that are not finite.

    Values are taken apart level by level; a message without a fault has no row, and a null one is malformed.
    """
    spark = messages.sparkSession
    level = messages.select(key, F.lit(label).alias("path"), F.try_parse_json("message").alias("v"), F.col("message"))
    found = level.where("v is null").select(key, "path", F.lit("malformed").alias("error"))
    level = level.where("v is not null").select(key, "path", "v")
    for depth in range(DEEPEST + 2):
        if depth > DEEPEST:
            return found.unionByName(level.select(key, "path", F.lit("nested too deeply").alias("error")))
        number = F.try_variant_get("v", "$", "double")
        found = found.unionByName(level.where(number.isNotNull() & (F.isnan(number) | (F.abs(number) == float("inf")))).select(key, "path", F.lit("not a finite number").alias("error")))
        below = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = below.select(key, F.concat("path", F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))).alias("path"), F.col("value").alias("v"))
    return found


def decode_conversations(messages: DataFrame) -> DataFrame:
    """``messages(message, ...)`` with conversation and errors: fields that may be absent have their defaults, others are told by their path.

    A turn without a format is Markdown, and one without calls or attachments has none; a score is brought into 0 to 1, and absent
    warnings are none. Sources that are not known stay as they are. Needed are a source, turns, and of each turn a known role and a body.
    """
    met = messages.withColumn("conversation", F.from_json("message", CONVERSATION))
    c = F.col("conversation")
    none = lambda field: F.array().cast(dict(TURN_ARRAYS)[field])
    turn = lambda t: t.withField("format", F.coalesce(t["format"], F.lit("markdown"))).withField("toolCalls", F.coalesce(t["toolCalls"], none("toolCalls"))).withField("attachments", F.coalesce(t["attachments"], none("attachments")))
    sure = c["confidence"].withField("score", T.clamp(c["confidence"]["score"])).withField("warnings", F.coalesce(c["confidence"]["warnings"], F.array().cast("array<string>")))
    whole = c.withField("turns", F.transform(c["turns"], turn)).withField("confidence", F.when(c["confidence"].isNotNull(), sure))
    at = lambda k, what: F.concat(F.lit("turns["), k.cast("string"), F.lit("]." + what))
    role = lambda t, k: F.when(t["role"].isNull(), at(k, "role: missing")).when(~t["role"].isin(*ROLES), at(k, "role: unknown"))
    each = F.flatten(F.transform(F.coalesce(c["turns"], F.array().cast(f"array<{TURN}>")), lambda t, k: F.array(role(t, k), F.when(t["body"].isNull(), at(k, "body: missing")))))
    said = F.filter(F.concat(F.array(F.when(c["source"].isNull(), "source: missing"), F.when(c["turns"].isNull(), "turns: missing")), each), lambda e: e.isNotNull())
    wrong = F.when(F.try_parse_json("message").isNull(), F.array(F.lit("malformed"))).otherwise(said)
    return met.withColumn("errors", wrong).withColumn("conversation", whole)


def resolve_destination(requests: DataFrame, presets: dict[str, tuple[str, str]], default: tuple[str, str]) -> DataFrame:
    """Adds folder and behaviour: of a known preset, else of an explicit path (always separate), else the default."""
    known = F.lit(None).cast("struct<folder:string,behaviour:string>")
    for name, (folder, behaviour) in sorted(presets.items()):
        known = F.when(F.col("preset") == name, F.struct(F.lit(folder).alias("folder"), F.lit(behaviour if behaviour in BEHAVIOURS else "separate").alias("behaviour"))).otherwise(known)
    own = F.when(F.coalesce("destination", F.lit("")) != "", F.struct(F.col("destination").alias("folder"), F.lit("separate").alias("behaviour")))
    found = F.coalesce(known, own, F.struct(F.lit(default[0]).alias("folder"), F.lit(default[1]).alias("behaviour")))
    return requests.withColumn("folder", found["folder"]).withColumn("behaviour", found["behaviour"])


PRESETS = "name string, path string, behaviour string"


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(place, name, path, behaviour) of a file with a JSON array of presets, in its order; none if the file is missing or any of it is no preset."""
    none = spark.createDataFrame([], f"place int, {PRESETS}")
    if not exists(spark, path):
        return none
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':') for c in PRESETS.split(', '))}>>").alias("p"))
    good = held.where(F.col("p").isNotNull() & ~F.exists("p", lambda x: x["name"].isNull() | x["path"].isNull() | x["behaviour"].isNull()))
    return good.select(F.posexplode("p").alias("place", "x")).select("place", "x.*")


def resolve_presets(requests: DataFrame, presets: DataFrame, default: str | None) -> DataFrame:
    """``requests(preset, destination, ...)`` with folder, behaviour and configured: of the path that they name (a file a conversation), else of their preset, else of the first preset, else the default folder.

    A behaviour that is not known is a file a conversation. configured is false for the default folder. Of presets with one name
    the first counts.
    """
    kind = F.when(F.col("behaviour").isin(*BEHAVIOURS), F.col("behaviour")).otherwise("separate")
    of = presets.groupBy("name").agg(F.min_by(F.struct(F.col("path").alias("folder"), kind.alias("behaviour")), "place").alias("__named"))
    first = presets.agg(F.min_by(F.struct(F.col("path").alias("folder"), kind.alias("behaviour")), "place").alias("__first"))  # one row
    met = requests.join(of.withColumnRenamed("name", "preset"), "preset", "left").crossJoin(F.broadcast(first))
    own = F.when(F.coalesce("destination", F.lit("")) != "", F.struct(F.col("destination").alias("folder"), F.lit("separate").alias("behaviour")))
    found = F.coalesce(own, "__named", "__first")
    folder = F.coalesce(found["folder"], F.lit(default))
    return met.withColumns({"folder": folder, "behaviour": F.coalesce(found["behaviour"], F.lit("separate")), "configured": found.isNotNull()}).drop("__named", "__first")


def check_destinations(requests: DataFrame, folders: DataFrame) -> DataFrame:
    """``requests(folder, configured, ...)`` with error, from folders(folder, is_directory, writable) that are there: null, or what is wrong.

    ``noDestination``: nothing is configured and the default folder is not there; it is not made unasked. ``unwritable``: a folder
    that is configured is missing, is none, or can't be written.
    """
    there = folders.groupBy("folder").agg(F.min(F.col("is_directory") & F.col("writable")).alias("__good"))
    error = F.when(F.col("__good").isNull() & ~F.col("configured"), "noDestination").when(~F.coalesce("__good", F.lit(False)), "unwritable")
    return requests.join(there, "folder", "left").withColumn("error", error).drop("__good")


def file_name(title: Column, day: Column, behaviour: Column, log: str = "log") -> Column:
    """The title's name, the day's note, or the log; a title that leaves nothing is named by the day."""
    name = F.coalesce(F.nullif(T.safe_filename(title), F.lit("")), day)
    return F.concat(F.when(behaviour == "daily", day).when(behaviour == "append", F.lit(log)).otherwise(name), F.lit(".md"))


def free_names(wanted: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """wanted(folder, name, ...) with final, free of collisions with each other and with taken(folder, name)."""
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    base = taken.select("folder", F.regexp_replace("name", r"( \(\d+\))?(\.[^.]*)?$", "").alias("stem"), F.coalesce(F.try_to_number(F.regexp_extract("name", r" \((\d+)\)(\.[^.]*)?$", 1), F.lit("9999")).cast("int"), F.lit(1)).alias("n"))
    highest = base.groupBy("folder", "stem").agg(F.max("n").alias("highest"))
    # Many files may want one name of one folder: their numbers are given range by range of the order.
    wanted = numbered(wanted.withColumn("__wish", F.struct("folder", "name")), "__wish", order).drop("__wish")
    rows = wanted.withColumn("stem", stem).withColumn("ext", ext).join(highest, ["folder", "stem"], "left")
    n = F.col("__n") + F.coalesce("highest", F.lit(0))
    return rows.withColumn("final", F.when(n == 1, F.col("name")).otherwise(F.concat("stem", F.lit(" ("), n.cast("string"), F.lit(")"), "ext"))).drop("stem", "ext", "highest", "__n")


def fan_out(files: DataFrame, folders: list[str], taken: DataFrame, order: str) -> DataFrame:
    """Each of files(name, ...) once for every folder, with final: the first folder keeps the name, the others give one that is free there."""
    each = files.withColumn("folder", F.explode(F.array(*map(F.lit, folders))))
    rest = free_names(each.where(F.col("folder") != folders[0]), taken, order)
    return each.where(F.col("folder") == folders[0]).withColumn("final", F.col("name")).unionByName(rest.select(*each.columns, "final"))


def append_log(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """The next generation of logs(path, content) after entries(path, seq, body), in order of arrival; nothing is dropped as a repeat."""
    new = entries.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("x")).select("path", F.array_join(F.transform("x", lambda e: e["body"]), "\n\n").alias("new"))
    joined = logs.join(new, "path", "full")
    return joined.select("path", F.concat_ws("\n\n", F.regexp_replace("content", r"\s+$", ""), "new").alias("content"))


def tool_call(call: Column) -> Column:
    """A call as a fenced JSON object with sorted keys."""
    json = F.to_json(F.struct(call["input"].alias("input"), call["output"].alias("output"), call["name"].alias("tool")))
    fence = F.repeat(F.lit("`"), T.fence_width(json))
    return F.concat(fence, F.lit("tool\n"), json, F.lit("\n"), fence)


def read_tool_calls(body: Column) -> Column:
    """The calls of the leading fences of a body."""
    lead = F.regexp_extract(body, r"(?s)\A((?:\s*`{3,}tool\n[^\n]*\n`{3,})*)", 1)
    parsed = F.transform(F.regexp_extract_all(lead, F.lit(r"`{3,}tool\n([^\n]*)\n`{3,}"), 1), lambda j: F.from_json(j, "input string, output string, tool string"))
    return F.transform(parsed, lambda c: F.struct(c["tool"].alias("name"), c["input"].alias("input"), c["output"].alias("output")))


def attachments(items: Column) -> Column:
    """A list of attachments: name, kind, size in bytes and link where known."""
    line = lambda a: F.concat(F.lit("- "), T.code_span(a["name"]), F.lit(" ("), a["kind"], F.coalesce(F.concat(F.lit(", "), a["byteSize"].cast("string"), F.lit(" bytes")), F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit(" <"), T.encode_url(a["url"]), F.lit(">")), F.lit("")))
    return F.when(F.size(items) > 0, F.concat(F.lit("Attachments:\n\n"), F.array_join(F.transform(items, line), "\n"))).otherwise("")


def read_attachments(block: Column) -> Column:
    """The attachments of such a list, in order."""
    line = r"- (`+) ?(.*?) ?\1 \(([^,)]*)(?:, ([0-9]+) bytes)?\)(?: <([^>\n]*)>)?"
    group = lambda x, k: F.nullif(F.regexp_extract(x, line, k), F.lit(""))
    lines = F.filter(F.split(block, "\n"), lambda x: x.startswith("- "))
    return F.transform(lines, lambda x: F.struct(group(x, 2).alias("name"), group(x, 3).alias("kind"), group(x, 4).cast("long").alias("byteSize"), group(x, 5).alias("url")))


def describe(action: Column) -> Column:
    """What a save did, in words."""
    return F.when(action == "write_new", "Saved").when(action == "append", "Appended new messages").when(action == "unchanged", "Already up to date").otherwise("Saved beside the existing file")
