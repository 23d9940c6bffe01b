"""Keyed accumulation of repeated, unordered sightings: the last one of each key stays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Latest(StatefulProcessor):
    """State of a key: order and value of its latest sighting, and its first position."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("latest", "seq long, body string, position long, sightings long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, body, position, n = self.held.get() if self.held.exists() else (-1, None, None, 0)
        for batch in rows:
            n += len(batch)
            at = batch["seq"].idxmax()
            position = int(batch["position"].min()) if position is None else min(position, int(batch["position"].min()))
            if int(batch["seq"][at]) >= seq:
                seq, body = int(batch["seq"][at]), batch["body"][at]
        self.held.update((seq, body, position, n))
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "body": [body], "position": [position], "sightings": [n]})

    def close(self) -> None:
        pass


def accumulate(stream: DataFrame) -> DataFrame:
    """Updates (key, seq, body, position, sightings) of a stream of (key, seq, body, position); null and empty keys are ignored.

    Needs the RocksDB state store. A later correction replaces an earlier partial one whatever the order of arrival.
    """
    known = stream.where("key is not null and key <> ''")
    return known.groupBy("key").transformWithStateInPandas(_Latest(), "key string, seq long, body string, position long, sightings long", outputMode="Update", timeMode="None")


def upsert_latest(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """The same for foreachBatch: the next state from the last one and a batch; delivering a batch twice changes nothing but sightings."""
    from ..operators.archive import accumulate_latest

    rows = batch.where("key is not null and key <> ''").select("key", "seq", "body", "position")
    rows = rows if state is None else state.select("key", "seq", "body", "position").unionByName(rows)
    return accumulate_latest(rows, ["key"], ["seq"], ["seq", "body", "position"])
