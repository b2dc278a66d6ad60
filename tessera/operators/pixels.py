"""Statistics of images of any size, given as rows of pixels: exact percentiles by refining histograms, without sorting pixels.

Each percentile is a value of the image at a rank. A histogram over the range that still holds the rank is
counted map-side, so an image of any size sends a row for each bin and task; the bin with the rank becomes the next range,
bounded by its own smallest and largest pixels. A range of one value is the answer. Both ends of a range fall in different bins,
so every round narrows it; with BINS bins the 24 bits of a float take two or three.

Pixels are read once a round and never shuffled: open ranges, one for each percentile of an image, are
broadcast up to RANGES of them, and joined by shuffle beyond.

Defined results: nulls, NaN and infinities are no pixels; images without pixels have no row; a percentile is the pixel at the floor of count times
share, counted from 0, as for images in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import shared_folder

BINS = 4096
RANGES = 200_000
SHARES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def written(rows: DataFrame, what: str) -> DataFrame:
    path = shared_folder(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def few(ranges: DataFrame) -> DataFrame:
    """The written ranges, to be broadcast after a count of them."""
    return F.broadcast(ranges) if ranges.limit(RANGES + 1).count() <= RANGES else ranges


def statistics(pixels: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """image, mean, stddev (of the population), min, max and a column for each share, of pixels (image, value)."""
    shares = SHARES if shares is None else shares
    pixels = pixels.select("image", F.col("value").cast("double").alias("value")).filter(F.abs("value") < float("inf"))
    base = written(pixels.groupBy("image").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"), F.min("value").alias("min"), F.max("value").alias("max")), "pixel-statistics")
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("share"), F.least(F.floor(F.col("n") * v), F.col("n") - 1).alias("rank")) for k, v in shares.items()]))
    # rank is counted within the range from low to high.
    ranges = base.select("image", named.alias("s"), F.col("min").alias("low"), F.col("max").alias("high")).select("image", "s.share", "s.rank", "low", "high")
    found = ranges.filter("low = high").select("image", "share", F.col("low").alias("value"))
    ranges = written(ranges.filter("low < high"), "pixel-ranges")
    while ranges.limit(1).count():
        place = F.least(F.floor((F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1)).cast("int")
        inside = pixels.join(few(ranges), "image").filter("value BETWEEN low AND high").withColumn("bin", place)
        bins = inside.groupBy("image", "share", "rank", "bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        # At most BINS rows for a percentile: the bins below the rank are counted off.
        listed = bins.groupBy("image", "share", "rank").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "low", "high"))).alias("bins"))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("struct<bin:int,n:bigint,low:double,high:double>").alias("hit"))
        step = lambda acc, b: F.when(acc["hit"].isNotNull(), acc).when(acc["before"] + b["n"] > F.col("rank"), F.struct(acc["before"].alias("before"), b.alias("hit"))).otherwise(F.struct((acc["before"] + b["n"]).alias("before"), acc["hit"].alias("hit")))
        told = listed.select("image", "share", "rank", F.aggregate("bins", start, step).alias("t"))
        ranges = written(told.select("image", "share", (F.col("rank") - F.col("t.before")).alias("rank"), "t.hit.low", "t.hit.high"), "pixel-ranges")
        found = found.union(ranges.filter("low = high").select("image", "share", F.col("low").alias("value")))
        ranges = ranges.filter("low < high")
    wide = found.groupBy("image").agg(*[F.max(F.when(F.col("share") == k, F.col("value"))).alias(k) for k in shares])
    return base.join(wide, "image").select("image", "mean", "stddev", "min", "max", *shares)
