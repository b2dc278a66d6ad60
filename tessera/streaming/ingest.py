"""Extension: files and settings as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the tags of files that arrive in a folder."""
    found = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.with_tags(found.select(F.xxhash64("path").alias("file_seq"), "path", "content"))


def import_each(parsed: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every micro-batch of parsed files to store; with once, what is there now and then end."""
    writer = parsed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def settled(events: DataFrame, key: list[str], at: str, gap: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Sessions of edits that follow each other within a gap, with their last value: a debounced save."""
    return events.withWatermark(at, late).groupBy(*key, F.session_window(at, gap)).agg(F.max_by("value", at).alias("value"), F.count("*").alias("edits"))
