"""Export of studies: a manifest, and one ZIP of metadata and files for each study."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import INSTANCES

#: Bytes of members that one ZIP holds at most; a larger study becomes several parts.
PART_BYTES = 256 << 20


def study_folder(date: Column, description: Column) -> Column:
    return F.concat(F.coalesce(text.present(date), F.lit("unknown_date")), F.lit("_"), text.safe_filename(description))


def series_folder(number: Column, description: Column) -> Column:
    return F.concat(text.zero_padded(number, 2), F.lit("_"), text.safe_filename(description))


def file_name(number: Column, sop_uid: Column) -> Column:
    return F.concat(text.zero_padded(number, 4), F.lit("_"), sop_uid, F.lit(".dcm"))


def manifest(study_uids: list[str], at: str) -> str:
    return json.dumps({"exportedAt": at, "studyIds": study_uids, "version": 1}, indent=2)


#: Fields of an instance in an export, without its file; what is not known is told as null.
METADATA = tuple(tuple(c.split()) for c in INSTANCES.split(", "))
WITH_NULLS = {"ignoreNullFields": "false"}


def metadata(instances: DataFrame) -> list[Column]:
    return [F.col(c) if c in instances.columns else F.lit(None).cast(kind).alias(c) for c, kind in METADATA]


def met(left: DataFrame, right: DataFrame, by: str | None, key: str) -> DataFrame:
    """The inner join on key; with by, on by and key, of rows that are dealt by it: grouped where they are, for Spark would shuffle both sides of a join by all its keys."""
    if by is None:
        return left.join(right, key)
    sides = [df.filter(F.col(by).isNotNull() & F.col(key).isNotNull()) for df in (left, right)]
    packed = [F.struct(*[F.col(c) for c in df.columns if c not in (by, key)]) for df in (left, right)]
    none = [F.lit(None).cast(df.select(p.alias("p")).schema["p"].dataType) for df, p in zip(sides, packed, strict=True)]
    both = sides[0].select(by, key, packed[0].alias("one"), none[1].alias("other")).union(sides[1].select(by, key, none[0].alias("one"), packed[1].alias("other")))
    found = both.groupBy(by, key).agg(F.collect_list("one").alias("one"), F.collect_list("other").alias("other"))
    return found.withColumn("one", F.explode("one")).withColumn("other", F.explode("other")).select(by, key, "one.*", "other.*")


def entries(studies: DataFrame, series: DataFrame, instances: DataFrame, blobs: DataFrame, by: str | None = None) -> DataFrame:
    """(study_uid, path, content) of all members; uids in the folder names keep equal names apart.

    by: a column of all of them that tells studies apart as study_uid does. Where their rows are dealt by it, in equally many
    parts, they meet without another shuffle. It is no field of the members.
    """
    dealt = [by] if by else []
    fields = lambda df: F.struct(*[c for c in df.columns if c != by])
    folder = F.concat(study_folder(F.col("study_date"), F.col("study_description")), F.lit("_"), F.col("study_uid"))
    kept = studies.withColumn("folder", folder)
    per_study = kept.select("study_uid", F.concat("folder", F.lit("/study.json")).alias("path"), F.to_json(fields(studies)).cast("binary").alias("content"))
    named = series.join(kept.select(by or "study_uid", "folder"), by or "study_uid").withColumn("folder", F.concat("folder", F.lit("/"), series_folder(F.col("series_number"), F.col("series_description")), F.lit("_"), F.col("series_uid")))
    per_series = named.select("study_uid", F.concat("folder", F.lit("/series.json")).alias("path"), F.to_json(fields(series)).cast("binary").alias("content"))
    placed = met(instances, named.select(*dealt, "series_uid", "folder"), by, "series_uid")
    listed = placed.groupBy(*dealt, "study_uid", "folder").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("instance_number", "sop_uid", F.struct(*metadata(instances)).alias("told")))), lambda e: e["told"]), WITH_NULLS).cast("binary").alias("content"))
    per_list = listed.select("study_uid", F.concat("folder", F.lit("/instances.json")).alias("path"), "content")
    files = met(placed, blobs, by, "sop_uid").select("study_uid", F.concat("folder", F.lit("/"), file_name(F.col("instance_number"), F.col("sop_uid"))).alias("path"), "content")
    return per_study.unionByName(per_series).unionByName(per_list).unionByName(files)


def zipped(members: DataFrame) -> DataFrame:
    """(study_uid, part, archive): ZIPs of the members of each study, in parts of bounded size."""
    before = F.sum(F.length("content")).over(Window.partitionBy("study_uid").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = members.withColumn("part", F.floor((before - F.length("content")) / PART_BYTES).cast("int"))
    sorted_ = dealt.repartition("study_uid", "part").sortWithinPartitions("study_uid", "part", "path")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, buffer, archive = None, None, None
        for pdf in batches:
            for row in pdf.itertuples():
                if key != (row.study_uid, row.part):
                    if archive:
                        archive.close()
                        yield pd.DataFrame({"study_uid": [key[0]], "part": [key[1]], "archive": [buffer.getvalue()]})
                    key, buffer = (row.study_uid, row.part), io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=6)
                archive.writestr(row.path, row.content)
        if archive:
            archive.close()
            yield pd.DataFrame({"study_uid": [key[0]], "part": [key[1]], "archive": [buffer.getvalue()]})

    return sorted_.select("study_uid", "part", "path", "content").mapInPandas(pack, "study_uid string, part int, archive binary")
