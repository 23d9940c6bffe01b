"""Verdicts of harvests while their passes stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.harvest import IDLE_S, MOST_S, STABLE_PASSES

SCHEMA = "key string, passes long, found long, reason string, complete boolean"


class _Verdicts(StatefulProcessor):
    """State of a harvest: where it stands, and passes that came before one that is still missing. A timer ends a harvest that has gone silent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, passes long, found long, progress long, barren long, reason string")
        self.ahead = handle.getMapState("ahead", "number long", "at long, added long")
        self.timer = handle.getValueState("timer", "at long")

    def _advance(self, place: tuple, holes: bool) -> tuple:
        """Take the passes that are next in turn; with ``holes`` also those behind a missing one."""
        number, passes, found, progress, barren, reason = place
        waiting = sorted((k[0], *v) for k, v in self.ahead.iterator())
        for k, at, added in waiting:
            if reason is not None or k != number and not holes:
                break
            self.ahead.removeKey((k,))
            number, passes, found = k + 1, passes + 1, found + added
            if at > MOST_S:
                reason = "maxTimeout"
            elif added > 0:
                progress, barren = at, 0
            else:
                barren += 1
                reason = "idleTimeout" if at - progress > IDLE_S else "stabilised" if barren >= STABLE_PASSES else None
        return number, passes, found, progress, barren, reason

    def _told(self, key, place: tuple) -> pd.DataFrame:
        _, passes, found, _, _, reason = place
        return pd.DataFrame({"key": [key[0]], "passes": [passes], "found": [found], "reason": [reason], "complete": [reason in ("exhausted", "stabilised")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place = self.place.get() if self.place.exists() else (1, 0, 0, 0, 0, None)
        done, latest = place[5] is not None, 0
        for batch in rows:
            if not len(batch):
                continue
            latest = max(latest, int(batch["ts"].astype("datetime64[ms]").astype("int64").max()))
            for number, at, added in zip(batch["number"], batch["at"], batch["added"], strict=True):
                if number >= place[0] and not done:
                    self.ahead.updateValue((int(number),), (int(at), int(added)))
        if not latest:
            return
        place = self._advance(place, holes=False)
        self.place.update(place)
        if place[5] is not None and not done:
            self.ahead.clear()
            yield self._told(key, place)
        # One timer a key, moved on as passes come: silent for longer than the absolute limit, it is over.
        due = latest + MOST_S * 1000
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or due > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place = self.place.get()
        if place[5] is None:
            place = self._advance(place, holes=True)
            yield self._told(key, place if place[5] is not None else (*place[:5], "exhausted"))
        for state in (self.place, self.ahead, self.timer):
            state.clear()

    def close(self) -> None:
        pass


def stream_verdicts(passes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(key, passes, found, reason, complete) of a stream of passes(key string, pass, at, added, ts), one row a harvest, as ``operators.harvest.verdicts``.

    Passes are numbered from 1, at is in seconds from the start of the harvest, ts is the time of the pass. A rule's verdict is
    told with the pass that meets it; a harvest without one is told as exhausted once the watermark, ``delay`` behind the
    latest ts, is ``MOST_S`` beyond its last pass, and its state goes. Passes may come in any order and more than once.
    """
    known = passes.where("key is not null").withWatermark("ts", delay).withColumnRenamed("pass", "number")
    return known.groupBy("key").transformWithStateInPandas(_Verdicts(), SCHEMA, outputMode="Append", timeMode="EventTime")
