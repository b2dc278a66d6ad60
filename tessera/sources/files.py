"""Files of an import: paths, folders and ZIP members, and the tags of DICOM files."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as file_systems
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encapsulated
from .workspace import shared_folder

FILES = "file_seq long, path string, content binary"
#: Tasks for each core that files are dealt over.
TASKS = 4


def listed(folder: str) -> list[str]:
    """All files below a folder, also those whose names Spark's readers skip."""
    return sorted(os.path.join(d, name) for d, _, names in os.walk(folder) for name in names)


def system_of(path: str) -> tuple[file_systems.FileSystem, str]:
    """pyarrow's file system of a path or URI, and the path in it."""
    if path.startswith("/"):
        return file_systems.LocalFileSystem(), path
    if path.startswith("file:"):
        return file_systems.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return file_systems.FileSystem.from_uri(path)


def opened(path: str):
    """A file for ranged reads, where the task runs."""
    system, where = system_of(path)
    return system.open_input_file(where)


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows that stand for long work, over all tasks."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * TASKS)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Narrow rows with file_seq: 0, 1, ... in the order given, whatever their number.

    They are sorted by ranges and written; rows of each range are counted, and the counts' prefix sum and a row's place in its range make its number.
    """
    path = shared_folder(rows.sparkSession, "numbered")
    rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    held = rows.sparkSession.read.parquet(path)
    part = F.shiftrightunsigned("_id", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.broadcast(counts.select("_part", before.alias("_before")))  # one row for each range of the sort
    placed = held.withColumn("_part", part).join(firsts, "_part")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("file_seq"))


def named(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file_seq, path) of the files of a folder, in the order of their paths, or of a list of paths, in its order. No content is read.

    Spark's listing skips empty files and names with a leading . or _; those of a list are taken too.
    """
    if isinstance(paths, str):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        return numbered(found.select("path"), "path").select("file_seq", "path")
    return spark.createDataFrame(list(enumerate(paths)), "file_seq long, path string")


def with_contents(names: DataFrame) -> DataFrame:
    """(file_seq, path, content) of files (file_seq, path), read where the tasks run by pyarrow's file systems: a shared folder, HDFS, S3 or GCS."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                with opened(row.path) as f:
                    yield pd.DataFrame({"file_seq": [row.file_seq], "path": [row.path], "content": [f.read()]})

    return dealt(names.select("file_seq", "path")).mapInPandas(load, FILES)


def scan(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file_seq, path, content) of the files of a folder or a list. Names are numbered first, and contents read last: no exchange carries them."""
    return with_contents(named(spark, paths))


def is_archive(paths: list[str]) -> bool:
    """Whether an import is one ZIP file."""
    return len(paths) == 1 and paths[0].lower().endswith(".zip")


#: Names of the tags that an import reads.
TAGS = {
    (0x0010, 0x0010): "patient_name", (0x0010, 0x0020): "patient_id", (0x0020, 0x000D): "study_uid", (0x0008, 0x0020): "study_date", (0x0008, 0x1030): "study_description",
    (0x0008, 0x0050): "accession_number", (0x0008, 0x0060): "modality", (0x0020, 0x000E): "series_uid", (0x0008, 0x103E): "series_description", (0x0018, 0x1030): "protocol_name",
    (0x0018, 0x0024): "sequence_name", (0x0020, 0x0011): "series_number", (0x0008, 0x0016): "sop_class", (0x0008, 0x0018): "sop_uid", (0x0020, 0x0013): "instance_number",
    (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0020, 0x1041): "slice_location", (0x0020, 0x0032): "image_position_patient", (0x0020, 0x0037): "image_orientation_patient",
    (0x0028, 0x0030): "pixel_spacing", (0x0018, 0x0050): "slice_thickness", (0x0028, 0x1050): "window_center", (0x0028, 0x1051): "window_width",
}
NUMBERS = ("series_number", "instance_number", "rows", "columns", "slice_location", "slice_thickness", "window_center", "window_width")
TEXTS = tuple(n for n in TAGS.values() if n not in NUMBERS)
#: Fixed values of the format.
LONG_FORM = frozenset((b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT"))
BINARY = {b"US": "<H", b"SS": "<h", b"UL": "<I", b"SL": "<i", b"FL": "<f", b"FD": "<d"}
IMPLICIT = b"1.2.840.10008.1.2"
PARSED = "error string, pixel_length long, " + ", ".join(f"{n} string" for n in TEXTS) + ", " + ", ".join(f"{n} double" for n in NUMBERS)


def number_of(value: bytes, vr: bytes | None) -> float:
    """A tag's first value as a number; 0 if there is none."""
    form = BINARY.get(vr or b"")
    if form and len(value) >= struct.calcsize(form):
        found = float(struct.unpack_from(form, value)[0])
        return found if found == found and abs(found) != float("inf") else 0.0
    text = value.decode("latin-1").split("\\")[0].strip(" \0")
    try:
        found = float(text)
        return found if found == found and abs(found) != float("inf") else 0.0
    except ValueError:
        if vr is None and len(value) in (2, 4):
            return float(struct.unpack("<H" if len(value) == 2 else "<I", value)[0])
        return 0.0


def elements(data: bytes) -> Iterator[tuple[tuple[int, int], bytes | None, int, int]]:
    """(tag, VR or None, first byte, length) of the top-level elements, little-endian, explicit or implicit."""
    at = 132 if data[128:132] == b"DICM" else 0
    explicit, syntax = data[at + 4 : at + 6].isalpha() and data[at + 4 : at + 6].isupper(), b""
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        told = explicit or group == 2
        if told:
            vr = data[at + 4 : at + 6]
            if vr in LONG_FORM:
                (length,), head = struct.unpack_from("<I", data, at + 8), 12
            else:
                (length,), head = struct.unpack_from("<H", data, at + 6), 8
        else:
            vr = None
            (length,), head = struct.unpack_from("<I", data, at + 4), 8
        first = at + head
        if length == 0xFFFFFFFF:
            if (group, element) == (0x7FE0, 0x0010):
                yield (group, element), vr, first, len(data) - first
                return
            end = data.find(b"\xfe\xff\xdd\xe0\0\0\0\0", first)
            if end < 0:
                raise ValueError("sequence without end")
            at = end + 8
            continue
        if first + length > len(data):
            raise ValueError("element beyond the end of the file")
        yield (group, element), vr, first, length
        if (group, element) == (0x0002, 0x0010):
            syntax = data[first : first + length].rstrip(b" \0")
        at = first + length
        if group == 2 and at + 2 <= len(data) and struct.unpack_from("<H", data, at)[0] != 2:
            explicit = syntax != IMPLICIT


def parsed(data: bytes) -> dict:
    """The named tags of a file; error says why it is no DICOM file."""
    row = dict.fromkeys(TEXTS, "") | dict.fromkeys(NUMBERS, 0.0) | {"error": None, "pixel_length": None}
    try:
        count = 0
        for tag, vr, first, length in elements(data):
            count += 1
            if tag == (0x7FE0, 0x0010):
                row["pixel_length"] = length
            name = TAGS.get(tag)
            if name in NUMBERS:
                row[name] = number_of(data[first : first + length], vr)
            elif name:
                row[name] = data[first : first + length].decode("utf-8", "replace").strip(" \0")
        if not count:
            row["error"] = "no elements"
    except (ValueError, struct.error) as e:
        row["error"] = str(e)
    return row


def with_tags(files: DataFrame) -> DataFrame:
    """(file_seq, path, content and PARSED) of files."""
    columns = ["error", "pixel_length", *TEXTS, *NUMBERS]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pd.DataFrame([parsed(c) for c in pdf["content"]], columns=columns)
            rows["pixel_length"] = rows["pixel_length"].astype("Int64")
            yield pd.concat([pdf.reset_index(drop=True), rows], axis=1)

    return files.select("file_seq", "path", "content").mapInPandas(parse, f"{FILES}, {PARSED}")


def image(data: bytes) -> np.ndarray:
    """The samples of all frames of an image, 8 or 16 bits each: plain, run-length coded or lossless JPEG. ValueError for others."""
    tags = {t: (f, n) for t, _, f, n in elements(data)}
    value = lambda t: data[tags[t][0] : sum(tags[t])] if t in tags else b""
    number = lambda t, form, usual: int(number_of(value(t), form)) if t in tags else usual
    if (0x7FE0, 0x0010) not in tags:
        raise ValueError("no pixel data")
    syntax, (first, length) = value((0x0002, 0x0010)).rstrip(b" \0"), tags[(0x7FE0, 0x0010)]
    width = 1 if number((0x0028, 0x0100), b"US", 16) == 8 else 2
    kind = np.dtype("u1" if width == 1 else "<i2" if number((0x0028, 0x0103), b"US", 0) else "<u2")
    if syntax in encapsulated.PLAIN:
        return np.frombuffer(data, kind, length // width, first)
    if syntax != encapsulated.RUN_LENGTH and syntax not in encapsulated.LOSSLESS_JPEG:
        raise ValueError("pixels of another compression")
    n, samples = number((0x0028, 0x0010), b"US", 0) * number((0x0028, 0x0011), b"US", 0), number((0x0028, 0x0002), b"US", 1)
    found = []
    for frame in encapsulated.frames(data, first, max(1, number((0x0028, 0x0008), b"IS", 1))):
        found.append(encapsulated.run_length(frame, n, samples, width) if syntax == encapsulated.RUN_LENGTH else encapsulated.lossless_jpeg(frame))
        if len(found[-1]) != n * samples:
            raise ValueError("pixels do not fit the image")
    return np.concatenate(found).astype(kind.newbyteorder("=").str.replace("i", "u")).view(kind.newbyteorder("="))


def pixels(content: Column) -> Column:
    """The pixel data of 8- or 16-bit images as an array of ints; null for what is no image, broken or of a compression that image() does not know."""

    @F.pandas_udf("array<int>")
    def decode(values: pd.Series) -> pd.Series:
        out = []
        for data in values:
            try:
                out.append(None if data is None else image(data).astype(np.int32))
            except (ValueError, struct.error):
                out.append(None)
        return pd.Series(out, dtype=object)

    return decode(content)
