"""Starting queries with keyed state, and sinks that take a batch once however often it is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Spark's provider for the state of transformWithState.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batches_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes every micro-batch to its own folder, in place of what an earlier run of the same batch left."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def start(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Hand every micro-batch of rows to sink, with state in RocksDB; with once, what is there now and then end (by processing time, not before the last timer)."""
    spark: SparkSession = rows.sparkSession
    # Each part of the state starts a store and a Python worker in every batch, however few its keys: no more parts than tasks run at once.
    parts = min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism)
    settings = {PROVIDER: ROCKSDB, PARTITIONS: str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():  # a query keeps the settings that it was started with, and its checkpoint the number of parts
            spark.conf.set(k, v)
        writer = rows.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
