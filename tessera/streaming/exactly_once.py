"""Import of a stream of files whose tables do not depend on how it is cut into batches, ordered or repeated.

1. Parsed files go to a table, content included, by Spark's file sink, which takes every batch once.
2. A second query reads (sop_uid, path) of the importable ones from it. Keyed state holds, for each SOP UID,
   the first path so far. What a batch changes goes to a log: files ingested, duplicates, and those that a
   smaller path has made duplicates. A batch that is run again replaces what it wrote.
3. The tables are those of the batch import, with each file's last status and the order of the paths. Only rows
   of changed keys pass the state; contents never do.

Defined results: a path is one file, however often it arrives (of different contents any); SOP UIDs that were
stored before the stream are all duplicates; files without a SOP UID are errors, as in the batch import.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest
from . import stateful

CHANGES = "sop_uid string, path string, status string"
#: The path of what was stored before: below every other.
STORED = ""


class FirstFile(StatefulProcessor):
    """Of the files of one SOP UID the one with the smallest path is ingested."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "path string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.first.get()
        before = held[0] if held else None
        paths = {p for pdf in rows for p in pdf["path"]}
        first = min(paths if before is None else paths | {before})
        if first != before:
            self.first.update((first,))
            paths |= {before} - {None}
        told = sorted(paths)
        yield pd.DataFrame({"sop_uid": key[0], "path": told, "status": ["ingested" if p == first else "duplicate" for p in told]})

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.first.update((STORED,))

    def close(self) -> None:
        pass


def import_stream(parsed: DataFrame, path: str, instances: DataFrame | None = None) -> None:
    """Import what a stream of parsed files holds now. Called again with the same path, it goes on where it ended. instances: stored before the first call."""
    spark = parsed.sparkSession
    first = parsed.writeStream.format("parquet").option("path", f"{path}/files").option("checkpointLocation", f"{path}/checkpoints/files").trigger(availableNow=True).start()
    first.awaitTermination()
    held = T.StructType([f for f in parsed.schema.fields if f.name != "content"])
    files = spark.readStream.schema(held).parquet(f"{path}/files")
    keyed = files.filter(ingest.reason(files).isNull()).select("sop_uid", "path").groupBy("sop_uid")
    stored = instances.select("sop_uid").distinct().groupBy("sop_uid") if instances is not None else None
    changes = keyed.transformWithStateInPandas(FirstFile(), CHANGES, "Update", "none", stored)
    stateful.start(changes, stateful.batches_to(f"{path}/changes"), f"{path}/checkpoints/changes").awaitTermination()


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """(path, status): the last of every importable file."""
    log = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{path}/changes")
    return log.groupBy("path").agg(F.max_by("status", "batch").alias("status"))


def imported(spark: SparkSession, path: str, studies: DataFrame, series: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    """The tables after the import so far, of those that were stored before it."""
    files = spark.read.parquet(f"{path}/files").dropDuplicates(["path"]).drop("file_seq").withColumn("file_seq", F.col("path"))
    files = files.withColumn("reason", ingest.reason(files))
    told = files.join(statuses(spark, path), "path", "left")
    unfit = F.when(F.col("reason").isin(*ingest.ERRORS), "error").when(F.col("reason").isNotNull(), "skipped")
    return ingest.tables_after(told.withColumn("status", F.coalesce(unfit, "status")), studies, series, instances)
