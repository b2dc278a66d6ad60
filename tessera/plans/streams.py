"""Registered queries of the streaming operators, over tables cut into batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import driver_tables as tables
from ..sources.workspace import shared_folder
from ..streaming import exactly_once, flush, stateful
from .panels import IMPORT, import_files
from .registry import query

PARTS = 3


def in_batches(rows: DataFrame, part: Column, path: str, turns: list[int]) -> DataFrame:
    """A stream of rows cut into PARTS files, which arrive in the given turns, one a batch."""
    for n, k in enumerate(turns):
        rows.filter(part == k).coalesce(1).write.parquet(f"{path}/in/turn={n}")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/turn=*")


def in_turns(rows: DataFrame, part: str, path: str, turns: list[int], run: Callable[[DataFrame], None]) -> None:
    """Rows as a stream that is run once a turn, as soon as the rows of its part have arrived, in files of any number: one batch a turn."""
    spark = rows.sparkSession
    rows.write.partitionBy(part).parquet(f"{path}/parts")
    told = rows.drop(part)
    parts = spark.read.schema(rows.schema).parquet(f"{path}/parts")
    for n, k in enumerate(turns):
        parts.filter(F.col(part) == k).select(told.columns).write.parquet(f"{path}/in/turn={n}")
        run(spark.readStream.schema(told.schema).parquet(f"{path}/in/turn=*"))


def streamed(spark: SparkSession, d: str, turns: list[int]) -> dict[str, DataFrame]:
    """The import of parts, as in the batch queries, as a stream."""
    files = import_files(spark, d)
    files = files.withColumn("path", F.concat(F.lit("scan/f"), F.lpad(F.col("file_seq").cast("string"), 12, "0")))
    instances = ingest.instance_rows(files.filter("sop_uid < 300").dropDuplicates(["sop_uid"])).drop("file_seq")
    series = ingest.series_rows(files.filter("series_uid < 10").withColumn("series_number", F.lit(-1.0)).withColumn("series_description", F.lit("old"))).drop("file_seq").distinct()
    path = shared_folder(spark, "import")
    exactly_once.import_stream(in_batches(files, F.pmod(F.xxhash64("path"), F.lit(PARTS)), path, turns), path, instances)
    return exactly_once.imported(spark, path, ingest.study_rows(files.limit(0)).drop("file_seq"), series, instances)


FORTH, BACK_TWICE = [0, 1, 2], [2, 1, 0, 0, 2]


@query(
    IMPORT + """, rows AS (SELECT sop::VARCHAR AS sop_uid, k::INT AS instance_number FROM j WHERE status = 'ingested' UNION ALL SELECT DISTINCT sop::VARCHAR, NULL FROM f WHERE sop < 300)
SELECT fed, sop_uid, instance_number FROM rows, (VALUES ('forth'), ('back and again')) t(fed)"""
)
def stream_instances(spark: SparkSession, d: str) -> DataFrame:
    """The instances after a streamed import, once in order and once backwards with parts fed again: those of the batch import."""
    out = None
    for fed, turns in (("forth", FORTH), ("back and again", BACK_TWICE)):
        rows = streamed(spark, d, turns)["instances"].select(F.lit(fed).alias("fed"), "sop_uid", F.when(F.col("sop_uid") >= 300, F.col("instance_number")).alias("instance_number"))
        out = rows if out is None else out.union(rows)
    return out


@query(
    IMPORT + """, new AS (SELECT series, max(k) AS k, arg_max(name, k) AS name FROM j WHERE status = 'ingested' GROUP BY 1), again AS (SELECT series, min(k) AS k, arg_min(name, k) AS name FROM j WHERE status = 'duplicate' GROUP BY 1),
old AS (SELECT DISTINCT series, -1 AS k, 'old' AS name FROM f WHERE series < 10), ids AS (SELECT series FROM new UNION SELECT series FROM again UNION SELECT series FROM old)
SELECT ids.series::VARCHAR AS series_uid, coalesce(new.k, old.k, again.k)::INT AS series_number, coalesce(new.name, old.name, again.name) AS series_description FROM ids LEFT JOIN new USING (series) LEFT JOIN old USING (series) LEFT JOIN again USING (series)"""
)
def stream_series(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, BACK_TWICE)["series"].select("series_uid", "series_number", "series_description")


#: An interval of an hour, as the events are hours apart.
HOUR_MS = 3_600_000


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS t, event_id AS seq, 'd' || event_id % 3 AS date_iso, event_type AS field, value::DOUBLE AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND user_id % 4 > 0 AS unload FROM events),
u AS (SELECT key, max(t) FILTER (WHERE unload) AS gone FROM e GROUP BY 1), c AS (SELECT *, (ceil(t / 3600000.0) * 3600000)::BIGINT AS due FROM e JOIN u USING (key) WHERE NOT unload)
SELECT key, least(due, coalesce(gone, due))::BIGINT AS saved_ms, date_iso, field, arg_max(value, (t, seq)) AS value FROM c GROUP BY 1, 2, 3, 4, due"""
)
def settings_flush(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits that are saved every hour and at the unload, the last event of most users; what is left at the end of the input is saved from the state. Events come in three parts, by time."""
    e = tables.read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("user_id").alias("user"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("date_iso"), F.col("event_type").alias("field"), F.col("value").cast("double").alias("value"))
    last = e.groupBy("key").agg(F.max(F.struct("at", "seq")).alias("last")).select("key", F.col("last.seq").alias("last_seq"))
    ends = e.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    third = F.floor((F.unix_millis("at") - F.unix_millis("low")) * PARTS / (F.unix_millis("high") - F.unix_millis("low") + 1))
    e = e.join(last, "key").join(F.broadcast(ends)).withColumn("part", third).withColumn("kind", F.when((F.col("seq") == F.col("last_seq")) & (F.col("user") % 4 > 0), "unload").otherwise("edit")).select(*flush.EDITS, "part")
    path = shared_folder(spark, "flush")

    def run(edits: DataFrame) -> None:
        stateful.start(flush.flushed(edits, HOUR_MS, "1 day"), stateful.batches_to(f"{path}/saved"), f"{path}/checkpoint").awaitTermination()

    in_turns(e, "part", path, FORTH, run)
    log = spark.read.schema(flush.SAVED).parquet(f"{path}/saved/batch=*")
    return log.unionByName(flush.waiting(spark, f"{path}/checkpoint"))
