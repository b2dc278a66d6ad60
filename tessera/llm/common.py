"""Shared pieces: materialised intermediates, checked broadcasts and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a side with a few narrow columns is broadcast (some 200 bytes a row in memory: up to 100 MB).
BROADCAST_ROWS = 500_000

#: Bytes of text in an Arrow batch that goes to Python, where the session sets none; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that a task decodes of a Parquet file at a time, where the session sets none: Spark's 4,096 are arrays of tens of MB of texts, which the heap grows for.
READ_ROWS = 256
READ_SETTING = "spark.sql.parquet.columnarReaderBatchSize"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode, and an error on a cluster."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return _own_dir


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"


def bound(spark: SparkSession, setting: str, most: int) -> None:
    """Sets a bound of what a task holds of long texts at a time in a session without it."""
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, most)


def materialize(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and survives lost executors."""
    bound(df.sparkSession, READ_SETTING, READ_ROWS)
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def in_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow() with batches that are bounded by bytes too, so that long texts don't add up: sets READ_SETTING and BATCH_SETTING in a session without them."""
    bound(df.sparkSession, READ_SETTING, READ_ROWS)
    bound(df.sparkSession, BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def discard(*dfs: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in dfs:
        path, df.written_to = getattr(df, "written_to", None), None
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast if a count shows that it has few rows; else Spark joins it by shuffle. For materialised narrow tables."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_row(df: DataFrame) -> DataFrame:
    """df with a number for each row, to be materialised before use. Rows of one partition share the bits above 33."""
    return df.withColumn("row", F.monotonically_increasing_id())


def repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(row, copy) of those of the materialised rows that follow another row of equal keys; copy counts from 1.

    Copies are counted by partition first and numbered within theirs, so a key that many rows have is
    never in one task. The numbers of one key are 1, 2, ... however the rows are dealt over partitions.
    """
    part = F.shiftright("row", 33)
    cells = rows.groupBy(*keys, part.alias("part")).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(earlier, F.lit(0)))
    cells = materialize(cells.filter("n + before > 1").select(*keys, "part", "before"), "repeats")
    spread = rows.select(*keys, "row", part.alias("part")).join(small(cells), [*keys, "part"])
    at = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("row"))
    return spread.select("row", (F.col("before") + at - 1).alias("copy")).filter("copy > 0")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The materialised rows with copy: 0 for the first row of equal keys, and 1, 2, ... for the others."""
    again = materialize(repeats(rows, keys), "copies")
    return rows.join(small(again), "row", "left").withColumn("copy", F.coalesce("copy", F.lit(0)).cast("long"))


def digests(docs: DataFrame) -> dict[str, Column]:
    """t1 and t2: 128 bits that stand for the text of a row, null texts included."""
    return {f"t{k}": F.xxhash64(F.lit(100 + k), docs["text"], docs["text"].isNull()) for k in (1, 2)}


def without(docs: DataFrame, gone: DataFrame, by_id: bool = False, how: str = "left_anti") -> DataFrame:
    """The rows of docs, all columns, whose text (with by_id, whose doc_id and text) is not that of a row of gone (t1, t2, doc_id)."""
    gone = small(materialize(gone.select(*[F.col(c).alias(f"gone_{c}") for c in ("t1", "t2", *(["doc_id"] if by_id else []))]).distinct(), "gone"))
    same = [d == gone[f"gone_{k}"] for k, d in digests(docs).items()]
    if by_id:
        same.append(docs["doc_id"].cast("long").eqNullSafe(gone["gone_doc_id"]))
    return docs.join(gone, same, how)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges(a, b); component is the smallest id reachable.

    Rounds of contraction: each node takes its smallest neighbour as parent (ids fall along
    parents, so there are no cycles), pointer jumping finds the roots, and edges are rewritten
    between roots until none is left. Only minima are aggregated, so a node of any degree is
    combined map-side; nothing but row counts comes to the driver.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    result = None
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parents = materialize(both.groupBy("id").agg(F.least("id", F.min("other")).alias("root")), "parents")
        while True:
            up = parents.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = materialize(parents.join(up, "root").select("id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jump")
            moved = jumped.filter("moved").limit(1).count()
            discard(parents)
            parents = jumped
            if not moved:
                break
        parents = parents.select("id", "root")
        if result is None:
            result = parents
        else:
            step = parents.select(F.col("id").alias("component"), F.col("root").alias("later"))
            result = materialize(result.withColumnRenamed("root", "component").join(step, "component", "left").select("id", F.coalesce("later", "component").alias("root")), "labels")
        left = parents.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = parents.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        between = edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        fewer = materialize(between, "edges")
        discard(edges)
        edges = fewer
        if not edges.limit(1).count():
            return result.select("id", F.col("root").alias("component"))
