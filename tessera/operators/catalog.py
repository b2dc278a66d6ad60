"""Studies, series and instances: lists, counts, the comparison matrix and positions of slices.

Counts are taken before joins, so what is joined has a row a series, not an instance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def series_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("series_uid").agg(F.count("*").alias("instance_count"))


def counted_series(series: DataFrame, instances: DataFrame) -> DataFrame:
    """The series that have instances, with their number."""
    return series.join(series_counts(instances), "series_uid")


def reclassified(series: DataFrame) -> DataFrame:
    """Series whose stored plane, weight and sequence are completed from their texts."""
    told = text.classified(text.classification_text(F.col("series_description"), F.col("protocol_name"), F.col("sequence_name")))
    stored = {"plane": "plane", "weight": "weight", "sequence_type": "sequence"}
    return series.withColumn("told", told).withColumns({c: F.coalesce(text.present(F.col(c)), F.col(f"told.{k}")) for c, k in stored.items()}).drop("told")


def study_list(studies: DataFrame, counted: DataFrame, with_series: bool = False) -> DataFrame:
    """All studies, newest first, with the number of their series and instances (0 if none)."""
    details = [F.array_sort(F.collect_list(F.struct("series_number", "series_uid", "plane", "weight", "sequence_type", "instance_count"))).alias("series")] if with_series else []
    per_study = counted.groupBy("study_uid").agg(F.count("*").alias("series_count"), F.sum("instance_count").alias("total_instances"), *details)
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("series_count", "total_instances")}
    return studies.join(per_study, "study_uid", "left").withColumns(zero).orderBy(F.desc("study_date"), "study_uid")


def found(rows: DataFrame, what: str) -> DataFrame:
    """rows, as they are read; an error if there are none. The check is one row wide and joins as a constant."""
    some = rows.select(F.lit(1)).limit(1).agg(F.count("*").alias("n"))
    known = some.select(F.when(F.col("n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what} not found")).cast("boolean")).alias("known"))
    return known.join(rows, F.col("known"), "left").drop("known")


def study_detail(study_uid: str, studies: DataFrame, series: DataFrame, instances: DataFrame) -> DataFrame:
    """The instances of one study with its and their series' columns, in order; no row if it is unknown or empty."""
    study = studies.filter(F.col("study_uid") == study_uid)
    own = series.filter(F.col("study_uid") == study_uid).drop("study_uid")
    return study.join(instances.filter(F.col("study_uid") == study_uid), "study_uid").join(own, "series_uid").orderBy("series_number", "series_uid", "instance_number")


def series_detail(series_uid: str, series: DataFrame, instances: DataFrame, study_uid: str | None = None) -> DataFrame:
    """The instances of one series in order; no row if it belongs to another study."""
    own = series.filter(F.col("series_uid") == series_uid)
    own = own if study_uid is None else own.filter(F.col("study_uid") == study_uid)
    return own.drop("study_uid").join(instances.filter(F.col("series_uid") == series_uid), "series_uid").orderBy("instance_number")


def dated_series(counted: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """Series with their combo and date, from studies or their own study_date; those of studies without a date go."""
    dated = counted if studies is None else counted.drop("study_date").join(studies.select("study_uid", "study_date"), "study_uid")
    dated = dated.filter(text.present(F.col("study_date")).isNotNull())
    parts = F.col("plane"), F.col("weight"), F.col("sequence_type")
    return dated.select("series_uid", "study_uid", "plane", "weight", "sequence_type", "instance_count", text.combo_id(*parts).alias("combo_id"), text.combo_label(*parts).alias("label"), text.iso_date(F.col("study_date")).alias("date_iso"))


def comparison_matrix(dated: DataFrame) -> DataFrame:
    """Of every combo and date the series with most instances; of equals the one with the smallest uid.

    An aggregate, not a ranking window: a combo and date of any size is combined before the shuffle. What is kept of it
    is the order alone, which tells the series and its count: each part of the input sends it for nearly every combo and date.
    """
    order = F.struct((-F.col("instance_count")).alias("fewer"), "series_uid", "study_uid")
    best = dated.groupBy("combo_id", "date_iso").agg(F.min(order).alias("best"))
    return best.select("combo_id", "date_iso", "best.study_uid", "best.series_uid", (-F.col("best.fewer")).alias("instance_count"))


def pivoted(matrix: DataFrame, dates: list[str]) -> DataFrame:
    """A column of series for each of the given dates."""
    return matrix.groupBy("combo_id").pivot("date_iso", dates).agg(F.first(F.struct("study_uid", "series_uid", "instance_count")))


def combos(dated: DataFrame) -> DataFrame:
    """Every combo with its parts and number of dates, by plane and first series."""
    first = F.min(F.struct("series_uid", "plane", "weight", "sequence_type", "label")).alias("first")
    found = dated.groupBy("combo_id").agg(first, F.countDistinct("date_iso").alias("date_count"))
    found = found.select("combo_id", "first.plane", "first.weight", F.col("first.sequence_type").alias("sequence"), "first.label", "date_count", F.col("first.series_uid").alias("first_series"))
    return found.orderBy(F.coalesce("plane", F.lit("")), "first_series")


def planes(counted: DataFrame) -> DataFrame:
    """Planes of series with instances, also of those without a date."""
    return counted.select("plane").filter(text.present(F.col("plane")).isNotNull()).distinct().orderBy("plane")


def dates(dated: DataFrame) -> DataFrame:
    return dated.select("date_iso").distinct().orderBy("date_iso")


def positions(instances: DataFrame, *order: str) -> DataFrame:
    """Position from 0 of every instance in its series."""
    return instances.withColumn("position", F.row_number().over(Window.partitionBy("series_uid").orderBy(*order)) - 1)


def instance_at(instances: DataFrame, series_uid: str, index: int) -> DataFrame:
    """The instance at a position of a series; an index out of range raises an error."""
    own = positions(instances.filter(F.col("series_uid") == series_uid), "instance_number", "sop_uid").filter(F.col("position") == index)
    return own.agg(F.first("sop_uid").alias("sop_uid")).select(F.coalesce("sop_uid", F.raise_error(F.lit("index out of range")).cast("string")).alias("sop_uid"))
