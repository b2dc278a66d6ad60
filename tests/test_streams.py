import datetime
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import ingest
from tessera.plans.panels import import_files
from tessera.plans.streams import in_batches, in_turns
from tessera.streaming import exactly_once, flush, stateful


def tables(spark):
    return [spark.createDataFrame([], s) for s in (schemas.STUDIES, schemas.SERIES, schemas.INSTANCES)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_streamed_import_equals_the_batch_import(spark, data, tmp_path):
    """Backwards, with a part fed again, in two calls, and with the last batch run once more after it was lost from the checkpoint."""
    files = import_files(spark, data).filter("file_seq <= 120").withColumn("path", F.concat(F.lit("scan/f"), F.lpad(F.col("file_seq").cast("string"), 6, "0")))
    files = files.withColumn("sop_uid", F.when(F.col("file_seq") % 10 != 0, (F.col("file_seq") % 40).cast("string")).otherwise(""))
    want = ingest.imported(files, *tables(spark))
    path, part = str(tmp_path), F.pmod(F.col("file_seq"), F.lit(3))
    exactly_once.import_stream(in_batches(files, part, f"{path}/one", [2, 1]), path)
    assert exactly_once.imported(spark, path, *tables(spark))["instances"].count() <= want["instances"].count()
    for n, k in enumerate([0, 2]):  # more arrives in the folder that the stream reads
        files.filter(part == k).coalesce(1).write.parquet(f"{path}/one/in/turn={n + 2}")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/one/in/turn=*")
    exactly_once.import_stream(stream, path)
    for again in (False, True):
        if again:
            last = max(glob.glob(f"{path}/checkpoints/changes/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
            os.remove(last)
            os.remove(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc"))
            exactly_once.import_stream(stream, path)
        got = exactly_once.imported(spark, path, *tables(spark))
        for name in ("instances", "series", "studies", "instance_blobs"):
            assert rows(got[name]) == rows(want[name]), name
        assert rows(got["files"].groupBy("status").count()) == rows(want["files"].groupBy("status").count())


def test_files_of_stored_instances_are_duplicates(spark, data, tmp_path):
    files = import_files(spark, data).filter("file_seq <= 30").withColumn("path", F.lpad(F.col("file_seq").cast("string"), 6, "0"))
    stored = ingest.instance_rows(files.filter("file_seq <= 10")).drop("file_seq")
    exactly_once.import_stream(in_batches(files, F.lit(0), f"{tmp_path}/in", [0]), str(tmp_path), stored)
    got = exactly_once.imported(spark, str(tmp_path), *tables(spark)[:2], stored)
    assert rows(got["files"].filter("status = 'duplicate'").select("file_seq")) == [(f"{k:06d}",) for k in range(1, 11)]
    assert got["instances"].count() == 30  # 11 stored and 20 new, of which file 19 is unreadable


def edits(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, start + datetime.timedelta(seconds=at), seq, kind, d, f, v, part) for k, at, seq, kind, d, f, v, part in rows], "key string, at timestamp, seq long, kind string, date_iso string, field string, value double, part int")


CASES = [
    ("a", 1.0, 1, "edit", "d1", "zoom", 1.0, 0), ("a", 2.0, 2, "edit", "d1", "zoom", 2.0, 0), ("a", 2.0, 3, "edit", "d1", "zoom", 3.0, 0), ("a", 9.5, 4, "edit", "d2", "pan", 4.0, 0),
    ("a", 12.0, 5, "edit", "d1", "zoom", 5.0, 1), ("a", 13.0, 6, "unload", None, None, None, 1), ("b", 11.0, 7, "edit", "d1", "zoom", None, 1), ("b", 31.0, 8, "edit", "d1", "zoom", 8.0, 2), ("b", 20.0, 9, "edit", "d1", "zoom", 9.0, 1),
]
#: Saved at the end of each interval of ten seconds or at the unload; the last edit of b waits for a timer that never fires.
SAVED = [("a", 10.0, "d1", "zoom", 3.0), ("a", 10.0, "d2", "pan", 4.0), ("a", 13.0, "d1", "zoom", 5.0), ("b", 20.0, "d1", "zoom", 9.0), ("b", 40.0, "d1", "zoom", 8.0)]


@pytest.mark.parametrize("cut", [("part", [0, 1, 2]), (0, [0])])
def test_edits_are_saved_on_timers_at_the_unload_and_at_the_end(spark, tmp_path, cut):
    events = edits(spark, CASES)
    part = F.col("part") if cut[0] == "part" else F.lit(cut[0])
    saved = flush.flushed(in_batches(events, part, str(tmp_path), cut[1]), late="1 second")
    stateful.start(saved, stateful.batches_to(f"{tmp_path}/saved"), f"{tmp_path}/checkpoint").awaitTermination()
    log = spark.read.schema(flush.SAVED).parquet(f"{tmp_path}/saved/batch=*")
    left = flush.waiting(spark, f"{tmp_path}/checkpoint")
    begin = 1_704_067_200_000
    shown = lambda df: [(r.key, (r.saved_ms - begin) / 1000, r.date_iso, r.field, r.value) for r in df.collect()]
    assert sorted(shown(log) + shown(left)) == SAVED
    assert shown(left) == SAVED[-1:]


def test_edits_wait_for_processing_time(spark, tmp_path):
    """By processing time an edit waits for its interval, and an unload saves what waits."""
    events = edits(spark, [c for c in CASES if c[0] == "a"] + [("c", 1.0, 20, "edit", "d1", "zoom", 7.0, 1)])
    saved = flush.flushed(in_batches(events, F.col("part"), str(tmp_path), [0, 1]), every=3_600_000, late=None)
    query = stateful.start(saved, stateful.batches_to(f"{tmp_path}/saved"), f"{tmp_path}/checkpoint", once=False, every="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            done = [p["numInputRows"] for p in query.recentProgress]
            if sum(done) == 7:
                break
    finally:
        query.stop()
    log = spark.read.schema(flush.SAVED).parquet(f"{tmp_path}/saved/batch=*")
    assert rows(log.select("key", "date_iso", "field", "value")) == [("a", "d1", "zoom", 5.0), ("a", "d2", "pan", 4.0)]
    assert rows(flush.waiting(spark, f"{tmp_path}/checkpoint").select("key", "value")) == [("c", 7.0)]


def test_the_state_has_no_more_parts_than_tasks_run_at_once(spark, tmp_path):
    """One batch a turn, however many files it arrives in, with the state in few parts whatever the session's shuffles."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        run = lambda e: stateful.start(flush.flushed(e, late="1 second"), stateful.batches_to(f"{tmp_path}/saved"), f"{tmp_path}/checkpoint").awaitTermination()
        in_turns(edits(spark, CASES).repartition(3), "part", str(tmp_path), [0, 1, 2], run)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(glob.glob(f"{tmp_path}/checkpoint/state/0/[0-9]*")) == spark.sparkContext.defaultParallelism
    log = spark.read.schema(flush.SAVED).parquet(f"{tmp_path}/saved/batch=*").unionByName(flush.waiting(spark, f"{tmp_path}/checkpoint"))
    assert sorted((r.key, (r.saved_ms - 1_704_067_200_000) / 1000, r.date_iso, r.field, r.value) for r in log.collect()) == SAVED
