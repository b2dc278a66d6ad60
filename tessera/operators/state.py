"""Display settings as an append-only log: latest values, merges, undo and redo, debounce, capped histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SETTINGS

MOST_HISTORY = 200
MOST_COOKIE_ENTRIES = 25
DEBOUNCE_MS = 200


def latest(log: DataFrame, keys: list[str], values: list[str], seq: str = "seq") -> DataFrame:
    """The last value that is not null of each column, by key: later partial updates are merged into earlier ones."""
    merged = [F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(seq))).alias(v) for v in values]
    return log.groupBy(*keys).agg(*merged)


def settings_by_date(rows: DataFrame, combo: str) -> DataFrame:
    """(date_iso, settings) of a combo's row (combo_id, settings: a map by date); no rows if there is none. Missing fields stay missing."""
    return rows.filter(F.col("combo_id") == combo).select(F.explode("settings").alias("date_iso", "settings"))


def with_defaults(settings: DataFrame) -> DataFrame:
    """Missing settings take their defaults."""
    return settings.withColumns({k: F.coalesce(F.col(k), F.lit(v).cast(kind)) if k in settings.columns else F.lit(v).cast(kind) for k, (kind, v) in SETTINGS.items()})


def save(settings: DataFrame, path: str) -> None:
    """Append updates (combo_id, date_iso, settings, seq) to the log."""
    settings.write.mode("append").parquet(path)


def hydrated(stored: DataFrame, held: DataFrame, enabled: DataFrame, same_combo: bool = True, values: tuple[str, ...] = tuple(SETTINGS)) -> DataFrame:
    """Settings by date: stored ones (missing fields as defaults), else those held for enabled dates of the same combo, else defaults."""
    stored = with_defaults(stored) if set(values) == set(SETTINGS) else stored
    kept = held.join(enabled, "date_iso", "left_semi") if same_combo else held.limit(0)
    one = stored.select("date_iso", F.struct(*values).alias("stored"))
    two = kept.select("date_iso", F.struct(*values).alias("held"))
    base = F.struct(*[F.lit(SETTINGS[v][1]).cast(SETTINGS[v][0]).alias(v) if v in SETTINGS else F.lit(None).alias(v) for v in values])
    joined = enabled.select("date_iso").distinct().join(one, "date_iso", "full").join(two, "date_iso", "full")
    return joined.select("date_iso", F.coalesce("stored", "held", base).alias("s")).select("date_iso", "s.*")


def batches(log: DataFrame, key: list[str], batch: str, seq: str) -> DataFrame:
    """Numbers runs of entries that follow each other with one batch id; entries without one stand alone."""
    order = Window.partitionBy(*key).orderBy(seq)
    starts = F.coalesce((F.lag(batch).over(order) != F.col(batch)), F.lit(True)) | F.col(batch).isNull()
    return log.withColumn("run", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def capped(log: DataFrame, key: list[str], seq: str, most: int = MOST_HISTORY) -> DataFrame:
    """The last entries of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))
    return log.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def recent(entries: DataFrame, updated: str, name: str, most: int = MOST_COOKIE_ENTRIES) -> DataFrame:
    """The entries updated last; a missing time counts as 0."""
    return entries.orderBy(F.desc(F.coalesce(F.col(updated), F.lit(0))), name).limit(most)


def debounced(log: DataFrame, key: list[str], at: str, millis: int = DEBOUNCE_MS, *ties: str) -> DataFrame:
    """Entries that no other of their key follows within the time: what a debounced save writes. Equal times are in the order of ties."""
    following = F.lead(at).over(Window.partitionBy(*key).orderBy(at, *ties))
    gap = (F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1000
    return log.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= millis)).drop("_gap")


def unseen(results: DataFrame, applied: DataFrame) -> DataFrame:
    """Results of dates that were not applied in this run, the smallest one a date."""
    left = results.join(applied.select("date_iso"), "date_iso", "left_anti")
    return left.groupBy("date_iso").agg(F.min(F.struct(*[c for c in left.columns if c != "date_iso"])).alias("row")).select("date_iso", "row.*")


class History:
    """Undo and redo stacks of one session; entries are (date, before, after, batch)."""

    def __init__(self) -> None:
        self.values: dict[str, dict[str, float]] = {}
        self.undo: list[tuple[str, dict, dict, str | None]] = []
        self.redo: list[tuple[str, dict, dict, str | None]] = []

    def change(self, date: str, update: dict[str, float], batch: str | None) -> None:
        before = self.values.get(date, {})
        after = before | update
        self.values[date] = after
        if batch is None and (all(k == "progress" for k in update) or after == before):
            return
        self.undo.append((date, before, after, batch))
        self.redo.clear()
        del self.undo[:-MOST_HISTORY]

    def move(self, source: list, target: list, side: int) -> None:
        first = None
        while source and (first is None or (first[3] is not None and source[-1][3] == first[3])):
            entry = source.pop()
            first = first or entry
            target.append(entry)
            self.values[entry[0]] = entry[side]

    def act(self, kind: str, date: str, update: dict[str, float], batch: str | None) -> None:
        if kind == "undo":
            self.move(self.undo, self.redo, 1)
        elif kind == "redo":
            self.move(self.redo, self.undo, 2)
        else:
            self.change(date, update, batch)


def replay(actions: DataFrame) -> DataFrame:
    """Final settings (key, date_iso, field, value) of sessions of actions (key, seq, kind, date_iso, field, value, batch).

    Sessions are streamed in order: a task holds the stacks, which are capped, and the values of one session, not its actions.
    """

    def finals(key: str | None, history: History) -> pd.DataFrame:
        rows = [(key, d, f, v) for d, fields in sorted(history.values.items()) for f, v in sorted(fields.items())]
        return pd.DataFrame(rows, columns=["key", "date_iso", "field", "value"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, history = None, None
        for pdf in batches:
            for row in pdf.itertuples():
                if history is None or row.key != key:
                    if history:
                        yield finals(key, history)
                    key, history = row.key, History()
                history.act(row.kind, row.date_iso, {} if row.field is None else {row.field: row.value}, row.batch)
        if history:
            yield finals(key, history)

    columns = ("key", "seq", "kind", "date_iso", "field", "value", "batch")
    return actions.select(*columns).repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key string, date_iso string, field string, value double")
