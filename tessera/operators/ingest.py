"""Import of image files: status of every file, rows of studies, series and instances, and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text

#: Extensions of files that are no images.
SKIPPED = (
    ".txt", ".md", ".json", ".xml", ".html", ".htm", ".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".log", ".csv", ".ini", ".cfg", ".conf", ".ds_store", ".gitignore", ".gitkeep",
)
#: Reasons that are errors; files of the others are skipped.
ERRORS = ("not-dicom", "missing-uids")
#: Fixed value: beginning of the class of secondary captures.
SECONDARY = "1.2.840.10008.5.1.4.1.1.7"


def skipped_name(path: Column) -> Column:
    """Hidden files, and files of an extension that is no image's."""
    name = F.lower(text.basename(path))
    return name.startswith(".") | F.regexp_extract(name, r"(\.[^.]*)$", 1).isin(*SKIPPED)


def reason(files: DataFrame) -> Column:
    """Why a parsed file is not imported, by the first rule that holds; null for importable ones."""
    c = {n: files[n] for n in ("path", "error", "pixel_length", "rows", "columns", "sop_class", "study_uid", "series_uid", "sop_uid")}
    shown = c["pixel_length"].isNotNull() & (c["pixel_length"] != 0) & (c["rows"] > 0) & (c["columns"] > 0)
    unnamed = text.present(c["study_uid"]).isNull() | text.present(c["series_uid"]).isNull() | text.present(c["sop_uid"]).isNull()
    return (
        F.when(skipped_name(c["path"]), "extension")
        .when(c["error"].isNotNull(), "not-dicom")
        .when(~F.coalesce(shown, F.lit(False)), "non-displayable")
        .when(F.coalesce(c["sop_class"].startswith(SECONDARY), F.lit(False)), "secondary-capture")
        .when(unnamed, "missing-uids")
    )


def judged(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files with status (ingested, duplicate, skipped, error) and reason; of files with one SOP UID the first counts."""
    why = files.withColumn("reason", reason(files))
    rank = F.row_number().over(Window.partitionBy("sop_uid", F.col("reason").isNull(), F.when(F.col("reason").isNotNull(), F.col("file_seq"))).orderBy("file_seq"))
    why = why.withColumn("rank", rank).join(stored.select("sop_uid", F.lit(True).alias("known")).distinct(), "sop_uid", "left")
    again = F.col("reason").isNull() & ((F.col("rank") > 1) | F.col("known").isNotNull())
    status = F.when(F.col("reason").isin(*ERRORS), "error").when(F.col("reason").isNotNull(), "skipped").when(again, "duplicate").otherwise("ingested")
    return why.withColumn("status", status).drop("rank", "known")


def summary(files: DataFrame, samples: int = 3) -> DataFrame:
    """Counts by status, and the first error messages."""
    told = F.concat_ws(": ", text.basename(F.col("path")), F.coalesce("error", "reason"))
    errors = files.filter(F.col("status") == "error").select("file_seq", told.alias("message")).orderBy("file_seq").limit(samples)
    shown = errors.agg(F.transform(F.array_sort(F.collect_list(F.struct("file_seq", "message"))), lambda e: e["message"]).alias("error_samples"))
    counts = files.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ingested", "duplicate", "skipped", "error")])
    return counts.join(F.broadcast(shown))


def megabytes(files: DataFrame) -> DataFrame:
    return files.agg((F.sum(F.length("content")) / 1048576).alias("megabytes"))


def instance_rows(files: DataFrame) -> DataFrame:
    whole = [F.col(c).cast("int").alias(c) for c in ("instance_number", "rows", "columns")]
    return files.select("sop_uid", "series_uid", "study_uid", *whole, "slice_location", "image_position_patient", "image_orientation_patient", "pixel_spacing", "slice_thickness", "window_center", "window_width", "file_seq")


def series_rows(files: DataFrame) -> DataFrame:
    """Series of files, classified by their texts; the plane falls back on the orientation."""
    told = text.classified(text.classification_text(F.col("series_description"), F.col("protocol_name"), F.col("sequence_name")))
    described = F.coalesce(text.present(F.col("series_description")), F.lit("No Description"))
    plane = F.coalesce("told.plane", geometry.plane_from_orientation(text.number_list(F.col("image_orientation_patient"))))
    return files.withColumn("told", told).select(
        "series_uid", "study_uid", described.alias("series_description"), F.col("series_number").cast("int").alias("series_number"), "modality", "protocol_name", "sequence_name",
        plane.alias("plane"), F.col("told.weight").alias("weight"), F.col("told.sequence").alias("sequence_type"), "file_seq",
    )


def study_rows(files: DataFrame) -> DataFrame:
    described = F.coalesce(text.present(F.col("study_description")), F.lit("No Description"))
    return files.select("study_uid", "study_date", described.alias("study_description"), "patient_name", "patient_id", "modality", "accession_number", "file_seq")


def upserted(old: DataFrame, new: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """old with the last new row of every key in place of its own; keys that neither has come from fallback's first row."""
    columns = old.columns

    def one(rows: DataFrame, pick) -> DataFrame:
        return rows.groupBy(key).agg(pick(F.struct(*columns), "file_seq").alias("row")).select("row.*")

    last = one(new, F.max_by)
    filling = one(fallback.join(old, key, "left_anti").join(new, key, "left_anti"), F.min_by)
    return old.join(last, key, "left_anti").unionByName(last.select(*columns)).unionByName(filling.select(*columns))


def imported(files: DataFrame, studies: DataFrame, series: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    """The tables after an import of parsed files; importing them again changes nothing."""
    return tables_after(judged(files, instances), studies, series, instances)


def tables_after(told: DataFrame, studies: DataFrame, series: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    """The tables after an import of files whose status is told; file_seq is their order."""
    new, known = told.filter(F.col("status") == "ingested"), told.filter(F.col("status") == "duplicate")
    return {
        "studies": upserted(studies, study_rows(new), study_rows(known), "study_uid"),
        "series": upserted(series, series_rows(new), series_rows(known), "series_uid"),
        "instances": instances.unionByName(instance_rows(new).select(*instances.columns)),
        "instance_blobs": new.select("sop_uid", "content"),
        "files": told,
    }
