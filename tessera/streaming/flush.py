"""Saving of edited settings on a timer and at the end of a session, as a stream with keyed state and timers.

Edits wait in the state of their session, the last one of each date and field for each interval. A timer at
the interval's end saves them; an unload saves all that waits at once. By event time the rows saved are the
same however the stream is cut into batches: the watermark fires the timers, and what an unload
saves early counts for the end of its own interval, or for the unload if that is earlier. By
processing time a timer fires an interval after the first edit that waits, also while no edits arrive.

Defined results: equal times are in the order of seq; edits after the watermark are dropped, as everywhere in
event time; what neither a timer nor an unload has saved stays in the state, where waiting() reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVERY_MS = 10_000
SAVED = "key string, saved_ms long, date_iso string, field string, value double"
EDITS = ("key", "at", "seq", "kind", "date_iso", "field", "value")


class Flush(StatefulProcessor):
    """A session's cells are one list, read and written once a batch; its one timer is at the earliest time that one is due."""

    def __init__(self, every: int = EVERY_MS, by_event: bool = True) -> None:
        self.every, self.by_event = every, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "due long, date_iso string, field string, at long, seq long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.held()
        timer = self.earliest(held)
        unload = []
        for pdf in rows:
            due = self.due(held, timerValues)
            for at, seq, kind, date_iso, field, value in zip(*[pdf[c].tolist() for c in EDITS[1:]], strict=True):
                if kind == "unload":
                    unload.append(at)
                elif kind == "edit":
                    cell = (due(at), date_iso, field)
                    if cell not in held or held[cell][:2] <= (at, seq):
                        held[cell] = (at, seq, None if pd.isna(value) else value)
        if unload:
            last = max(unload)
            when = (lambda due, at: min(due, *[u for u in unload if u >= at])) if self.by_event else (lambda due, at: last)
            yield from self.saved(key, held, lambda due, at: at <= last, when)
        self.keep(held, timer)

    def due(self, held: dict, now: Any) -> Callable[[int], int]:
        """When an edit is saved at the latest: the end of its interval, or an interval after the first that waits."""
        if self.by_event:
            return lambda at: -(-at // self.every) * self.every
        first = self.earliest(held) or now.getCurrentProcessingTimeInMs() + self.every
        return lambda at: first

    def held(self) -> dict:
        return {e[:3]: e[3:] for e in self.waiting.get()}

    def earliest(self, held: dict) -> int | None:
        return min((cell[0] for cell in held), default=None)

    def keep(self, held: dict, timer: int | None) -> None:
        """Store what waits, and move the timer."""
        if held:
            self.waiting.put([(*cell, *entry) for cell, entry in held.items()])
        else:
            self.waiting.clear()
        due = self.earliest(held)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def saved(self, key: Any, held: dict, which: Any, when: Any) -> Iterator[pd.DataFrame]:
        """Take out of held what is to be saved."""
        out = [(cell, entry) for cell, entry in held.items() if which(cell[0], entry[0])]
        for cell, _ in out:
            del held[cell]
        if out:
            yield pd.DataFrame([(key[0], when(cell[0], entry[0]), cell[1], cell[2], entry[2]) for cell, entry in out], columns=["key", "saved_ms", "date_iso", "field", "value"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Save all that is due by now, not by the timer alone."""
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else expiredTimerInfo.getExpiryTimeInMs()
        held = self.held()
        yield from self.saved(key, held, lambda due, at: due <= now, lambda due, at: due)
        self.keep(held, None)

    def close(self) -> None:
        pass


def flushed(edits: DataFrame, every: int = EVERY_MS, late: str | None = "10 seconds") -> DataFrame:
    """SAVED of a stream of edits (EDITS: at a timestamp, kind edit or unload). late: how long edits are waited for; None counts processing time."""
    rows = edits.withWatermark("at", late) if late else edits
    # The column of the watermark stays a timestamp; the processor counts in milliseconds.
    rows = rows.select("key", F.unix_millis("at").alias("at"), *EDITS[2:], F.col("at").alias("event_time"))
    mode = "EventTime" if late else "ProcessingTime"
    return rows.groupBy("key").transformWithStateInPandas(Flush(every, bool(late)), SAVED, "Append" if late else "Update", mode)


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """SAVED of what the state of an ended query still holds: the final save at the end of the input. saved_ms is when it was due."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()
    return state.select("key.key", F.col("list_element.due").alias("saved_ms"), "list_element.date_iso", "list_element.field", "list_element.value")
