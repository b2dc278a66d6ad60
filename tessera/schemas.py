"""Tables of an imaging catalog, and the defaults of display settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

STUDIES = "study_uid string, study_date string, study_description string, patient_name string, patient_id string, modality string, accession_number string"
SERIES = "series_uid string, study_uid string, series_description string, series_number int, modality string, protocol_name string, sequence_name string, plane string, weight string, sequence_type string"
INSTANCES = (
    "sop_uid string, series_uid string, study_uid string, instance_number int, rows int, columns int, slice_location double, image_position_patient string, "
    "image_orientation_patient string, pixel_spacing string, slice_thickness double, window_center double, window_width double"
)
INSTANCE_BLOBS = "sop_uid string, content binary"

#: Fixed defaults of the settings of a panel.
SETTINGS = {
    "offset": ("double", 0.0), "reverse_slice_order": ("boolean", False), "zoom": ("double", 1.0), "rotation": ("double", 0.0), "brightness": ("double", 100.0), "contrast": ("double", 100.0),
    "pan_x": ("double", 0.0), "pan_y": ("double", 0.0), "affine00": ("double", 1.0), "affine01": ("double", 0.0), "affine10": ("double", 0.0), "affine11": ("double", 1.0), "progress": ("double", 0.0),
}
PANEL_SETTINGS = "combo_id string, date_iso string, " + ", ".join(f"{k} {kind}" for k, (kind, _) in SETTINGS.items()) + ", seq bigint"

TABLES = {"studies": STUDIES, "series": SERIES, "instances": INSTANCES, "instance_blobs": INSTANCE_BLOBS, "panel_settings": PANEL_SETTINGS}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the tables that do not exist, and add columns that older ones lack."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")
        have = set(spark.table(f"{database}.{name}").columns)
        missing = [c.strip() for c in schema.split(",") if c.split()[0] not in have]
        if missing:
            spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({', '.join(missing)})")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    """Delete all stored data."""
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
