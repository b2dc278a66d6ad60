"""Folders that all executors share, for what a job writes between its steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_own: str | None = None
_within: str | None = None

#: Whether Spark deletes the shuffle files of a query at its end.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder in local mode, and an error on a cluster."""
    global _own
    if _within:
        return f"{_within}/{what}-{uuid.uuid4().hex}"
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own = _own or f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        given = _own
    return f"{given.rstrip('/')}/tessera/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, what: str) -> Iterator[None]:
    """For steps that are over when it ends: folders that are asked for within are below one, which is deleted then; shuffle files go with each query."""
    global _within
    outer, kept = _within, spark.conf.get(CLEANED, None)
    _within = shared_folder(spark, what)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        gone, _within = _within, outer
        spark.conf.set(CLEANED, kept) if kept is not None else spark.conf.unset(CLEANED)
        delete(spark, gone)
