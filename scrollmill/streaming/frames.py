"""Length-prefixed messages out of chunks of a stream that are cut anywhere."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import FRAME_LIMIT

SCHEMA = "stream string, frame_no long, message string, error string"


class _Frames(StatefulProcessor):
    """State of a stream: the number of its next chunk and next frame, what has arrived of an open frame, and chunks that are ahead.

    An open frame is kept as the parts that came, and these are put together once it is whole, so a long frame in many chunks
    is copied once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "chunk long, frame long, have long, need long, closed boolean")
        self.parts = handle.getListState("parts", "data binary")
        self.ahead = handle.getMapState("ahead", "seq long", "data binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunk, frame, have, need, closed = self.place.get() if self.place.exists() else (0, 0, 0, 4, False)
        for batch in rows:
            if not len(batch):
                continue
            for seq, data, last in zip(batch["seq"], batch["data"], batch["last"], strict=True):
                if seq >= chunk and not closed:  # delivered before: known already
                    self.ahead.updateValue((int(seq),), (bytes(data) if data is not None else b"", bool(last)))
        out = []
        while not closed and self.ahead.containsKey((chunk,)):
            data, last = self.ahead.getValue((chunk,))
            self.ahead.removeKey((chunk,))
            chunk += 1
            if data:
                self.parts.appendValue((data,))
                have += len(data)
            if have >= need:
                held = b"".join(p[0] for p in self.parts.get())
                at = 0
                while at + 4 <= have:
                    n = struct.unpack_from("<I", held, at)[0]
                    if n == 0 or n > FRAME_LIMIT:
                        out.append((key[0], frame, None, "empty" if n == 0 else "too long"))
                        closed = True
                        break
                    if at + 4 + n > have:
                        break
                    out.append((key[0], frame, held[at + 4 : at + 4 + n].decode("utf-8", "replace"), None))
                    at, frame = at + 4 + n, frame + 1
                held = held[at:]
                have = len(held)
                need = 4 if have < 4 else 4 + struct.unpack_from("<I", held)[0]
                self.parts.put([(held,)]) if held and not closed else self.parts.clear()
            if last and not closed:
                if have:
                    out.append((key[0], frame, None, "cut short"))
                closed = True
        if closed:
            self.parts.clear()
            self.ahead.clear()
        self.place.update((chunk, frame, have, need, closed))
        yield pd.DataFrame(out, columns=["stream", "frame_no", "message", "error"])

    def close(self) -> None:
        pass


def stream_frames(chunks: DataFrame) -> DataFrame:
    """(stream, frame_no, message, error) of a stream of chunks(stream, seq, data binary, last boolean), as ``sources.files.frames`` of the whole bytes.

    Chunks are numbered from 0 and may be cut at any byte, come in any order and more than once; each message is told once, as
    soon as it is whole. A length of 0 or beyond the limit ends a stream with an error row, and so does its last chunk where a
    frame is open. Rows with a null stream or seq are left out. Needs the RocksDB state store.
    """
    known = chunks.where("stream is not null and seq is not null").selectExpr("stream", "seq", "data", "coalesce(last, false) as last")
    return known.groupBy("stream").transformWithStateInPandas(_Frames(), SCHEMA, outputMode="Append", timeMode="None")
