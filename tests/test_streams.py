import json
import random
import struct
from datetime import datetime, timedelta

import pytest

from scrollmill.operators import harvest as H
from scrollmill.sources.files import FRAME_LIMIT, frames
from scrollmill.streaming.frames import stream_frames
from scrollmill.streaming.harvest import stream_verdicts


def run(spark, source, schema, make, name, cp, out):
    """What is there now, to the end, as files; another call goes on from the same checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).queryName(name).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_frames_cut_anywhere_and_a_restart(spark, tmp_path):
    rng = random.Random(2)
    frame = lambda text: struct.pack("<I", len(text.encode())) + text.encode()
    whole = {f"s{k}": b"".join(frame(json.dumps({"n": n, "x": "é" * rng.randrange(60)})) for n in range(rng.randrange(1, 12))) for k in range(6)}
    whole |= {"zero": frame("a") + b"\0\0\0\0" + frame("b"), "long": frame("a") + struct.pack("<I", FRAME_LIMIT + 1) + b"x", "cut": frame("a") + frame("bcd")[:-1], "stub": b"\x05\0", "none": b""}
    rows = []
    for name, data in whole.items():
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(9)))})
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:])] or [b""]
        rows += [(name, k, p, k == len(parts) - 1) for k, p in enumerate(parts)]
    rows += rng.sample(rows, 8) + [(None, 0, b"x", True)]
    rng.shuffle(rows)
    schema = "stream string, seq long, data binary, last boolean"
    source, cp, out = (f"file://{tmp_path}/{n}" for n in ("in", "cp", "out"))
    for n in range(5):
        spark.createDataFrame(rows[n::8], schema).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, schema, stream_frames, "frames", cp, out)
    for n in range(5, 8):
        spark.createDataFrame(rows[n::8], schema).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, schema, stream_frames, "frames", cp, out)
    told = lambda df, key: sorted(((r[key], r["frame_no"], r["message"], r["error"]) for r in df.collect()), key=str)
    want = told(frames(spark.createDataFrame(list(whole.items()), "path string, content binary")), "path")
    assert told(spark.read.parquet(out), "stream") == want


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_of_a_stream_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for k in range(25):
        at = 0
        for n in range(1, rng.randrange(2, 14)):
            rows.append((f"h{k}", n, at, rng.choice([0, 0, 1, 4]), start + timedelta(seconds=at + k)))
            at += rng.choice([1, 3, 10, 20, 120])
    rows += [("busy", n, 110 * (n - 1), 1, start + timedelta(seconds=110 * n)) for n in range(1, 7)]
    schema = "key string, pass long, at long, added long, ts timestamp"
    table = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, H.verdicts(table, "key").select("key", "passes", "found", "reason", "complete").collect()))
    assert {w[3] for w in want} == {"exhausted", "stabilised", "idleTimeout", "maxTimeout"}
    sent = rows + rng.sample(rows, 10)
    rng.shuffle(sent)
    source, cp, out = (f"file://{tmp_path}/{n}" for n in ("in", "cp", "out"))
    make = lambda s: stream_verdicts(s, "2 hours")
    for n in range(3):
        spark.createDataFrame(sent[n::5], schema).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, schema, make, "verdicts", cp, out)
    for n in range(3, 5):
        spark.createDataFrame(sent[n::5], schema).coalesce(1).write.mode("append").parquet(source)
    # A later harvest moves the watermark beyond all others.
    for k in (10, 20):
        spark.createDataFrame([("late", 1, 0, 1, start + timedelta(hours=k))], schema).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, schema, make, "verdicts", cp, out)
    got = sorted(map(tuple, spark.read.parquet(out).where("key <> 'late'").select("key", "passes", "found", "reason", "complete").collect()))
    assert got == want


def version(conv, seq, said):
    return [(conv, seq, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(said)]


BATCH = "conv_id long, seq long, turn long, role string, body string"


def kept(archive):
    files = {r["file"]: r["sightings"] for r in archive.read("files").collect()}
    turns = {}
    for r in archive.read("turns").orderBy("file", "turn").collect():
        turns.setdefault(r["file"], []).append(r["body"])
    assert files.keys() == turns.keys()
    return {f: (files[f], turns[f]) for f in files}


def test_saved_once_however_often_delivered(spark, tmp_path, monkeypatch):
    from scrollmill.streaming.saving import SavedArchive

    archive = SavedArchive(spark, f"file://{tmp_path}/saved")
    batches = [
        version(1, 0, ["a", "b"]) + version(2, 0, ["x"]),
        version(1, 0, ["a ", "b", "c"]) + version(1, 1, ["a", "b"]) + version(3, 5, ["n"]),
        version(1, 0, ["a", "other"]) + version(2, 0, ["x"]),
        version(1, 0, ["a", "other", "more"]) + version(1, 1, ["a", "other", "more"]),
    ]
    send = lambda n: archive.save(spark.createDataFrame(batches[n], BATCH), n)
    assert archive.latest() is None and send(0) is not None
    assert kept(archive) == {"1.md": (1, ["a", "b"]), "2.md": (1, ["x"])}
    assert send(0) is None
    first = archive.latest()
    send(1)
    # Grown in place; the shorter version beside it; and again what is there.
    assert kept(archive) == {"1.md": (2, ["a ", "b", "c"]), "1 (2).md": (1, ["a", "b"]), "2.md": (1, ["x"]), "3.md": (1, ["n"])}
    assert any(g == first.name for g in archive.latest().held.values())
    send(2), send(3)
    want = {"1.md": (2, ["a ", "b", "c"]), "1 (2).md": (1, ["a", "b"]), "1 (3).md": (3, ["a", "other", "more"]), "2.md": (2, ["x"]), "3.md": (1, ["n"])}
    assert kept(archive) == want
    for n in (3, 1, 0, 2):
        assert send(n) is None
    assert kept(archive) == want and archive.latest().upto == {"": 4} and not archive.latest().others
    # A batch that dies before its manifest, then once more; and batches that come before their turn.
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, f=type(spark).createDataFrame: (_ for _ in ()).throw(OSError("lost")) if "kind" in str(schema) else f(self, data, schema))
    with pytest.raises(OSError):
        archive.save(spark.createDataFrame(version(2, 0, ["x", "y"]), BATCH), 4)
    monkeypatch.undo()
    assert kept(archive) == want
    archive.save(spark.createDataFrame(version(2, 0, ["x", "y"]), BATCH), 6)
    assert archive.save(spark.createDataFrame(version(2, 0, ["x", "y"]), BATCH), 6) is None
    assert archive.latest().others == {("", 6)} and kept(archive)["2.md"] == (3, ["x", "y"])
    archive.save(spark.createDataFrame([], BATCH), 4), archive.save(spark.createDataFrame([], BATCH), 5)
    assert archive.latest().upto == {"": 7}


def test_saved_from_a_stream_with_a_restart(spark, tmp_path):
    from scrollmill.streaming.saving import SavedArchive

    archive, calls = SavedArchive(spark, f"file://{tmp_path}/saved"), []

    def save(batch, n):
        calls.append(n)
        archive.save(batch, n)
        archive.save(batch, n)
        if calls == [0, 1]:
            raise OSError("the driver dies after it has saved")

    def go():
        stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        q = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001  the query's own failure
            pass

    for n in range(3):
        spark.createDataFrame(version(1, 0, ["a", "b", "c"][: n + 1]), BATCH).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    go(), go()
    assert calls == [0, 1, 1, 2] and kept(archive) == {"1.md": (3, ["a", "b", "c"])}
