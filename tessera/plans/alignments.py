"""Registered queries of registration and of the alignment of dates, on images drawn from the embeddings under known maps and contrasts.

An image is a sum of waves whose strengths and phases come from a vector, so it can be drawn under any map
exactly, and the true map is known to SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registration as registrations
from ..operators import alignment
from ..sources import driver_tables as tables
from ..sources import files
from .registry import query

SIDE = 24
#: Waves over the side of an image, to the right and down.
WAVES = ((0.7, 0.3), (-0.4, 0.9), (1.1, -0.6), (0.2, 1.4), (1.6, 0.5), (-1.2, 1.1), (0.5, -1.7), (1.9, 1.3))
RIGHT, DOWN = np.array(WAVES).T[:, :, None]
CONTRASTS = ("same", "scaled", "inverted", "gamma")
#: Pixels by which a map that is found may differ from the true one, on average over the corners.
NEAR = 0.5
#: Neighbouring ids that are numbered together.
CHUNK = 65_536


def waves(vectors: pd.Series, maps: pd.Series) -> pd.Series:
    """Images of vectors; that of a vector which is null, too short or holds a null has no numbers."""
    y, x = np.mgrid[0:SIDE, 0:SIDE].reshape(2, -1) - (SIDE - 1) / 2
    shown = []
    for vector, (a00, a01, a10, a11, tx, ty) in zip(vectors, maps, strict=True):
        known = np.full(2 * len(WAVES), np.nan, np.float32)
        if vector is not None:
            first = np.asarray(vector[: len(known)], dtype=np.float32)
            known[: len(first)] = first
        strength, phase = 0.5 + np.abs(known[: len(WAVES)]).astype(float), np.float32(20) * known[len(WAVES) :]
        u, v = (a00 * x + a01 * y + tx) / SIDE, (a10 * x + a11 * y + ty) / SIDE
        with np.errstate(invalid="ignore", over="ignore"):
            total = strength @ np.cos(2 * np.pi * (RIGHT * u + DOWN * v) + phase.astype(float)[:, None])
            shown.append((0.5 + total / (2 * strength.sum())).astype(np.float32))
    return pd.Series(shown, dtype=object)


def drawn(rows: DataFrame, name: str, vector: str, a: list[Column], t: list[Column]) -> DataFrame:
    """rows with the image of a vector, with the value at A y + t (about the centre) at every pixel y, within [0, 1]."""
    return rows.withColumn(name, F.pandas_udf(waves, "array<float>")(F.col(vector), F.array(*[x.cast("double") for x in (*a, *t)])))


def turned(k: Column) -> tuple[list[Column], list[Column]]:
    """A map by number: up to 8 degrees, 9 percent and 2 pixels."""
    angle, zoom = F.radians((k % 17 - 8).cast("double")), 1 + (k % 7 - 3) * 0.03
    return [zoom * F.cos(angle), -zoom * F.sin(angle), zoom * F.sin(angle), zoom * F.cos(angle)], [(k % 5 - 2).cast("double"), (k % 3 - 1) * 1.5]


def moved_back(a: list[Column], t: list[Column]) -> tuple[list[Column], list[Column]]:
    d = a[0] * a[3] - a[1] * a[2]
    b = [a[3] / d, -a[1] / d, -a[2] / d, a[0] / d]
    return b, [-(b[2 * k] * t[0] + b[2 * k + 1] * t[1]) for k in (0, 1)]


def recoloured(pixels: Column, k: Column) -> Column:
    """One of CONTRASTS by number; without a number of one, pixels without values."""
    kinds = [lambda v: v, lambda v: v * 0.4 + 0.3, lambda v: 1 - v, lambda v: F.pow(v, F.lit(2.2))]
    of = lambda kind: F.transform(pixels, lambda v: kind(v).cast("float"))
    return F.coalesce(*[F.when(k % len(kinds) == i, of(kind)) for i, kind in enumerate(kinds)], of(lambda v: F.lit(None)))


def numbered(vectors: DataFrame) -> DataFrame:
    """vectors (label, vec_id) with the position from 0 in their label and their number n; sorted within chunks of ids, so no task sorts a whole label."""
    vectors = vectors.withColumn("chunk", F.floor(F.col("vec_id") / CHUNK))
    own = Window.partitionBy("label")
    chunks = vectors.groupBy("label", "chunk").agg(F.count("*").alias("held"))
    chunks = chunks.select("label", "chunk", (F.sum("held").over(own.orderBy("chunk")) - F.col("held")).alias("before"), F.sum("held").over(own).alias("n"))
    within = F.row_number().over(Window.partitionBy("label", "chunk").orderBy("vec_id")) - 1
    return vectors.withColumn("within", within).join(chunks, ["label", "chunk"]).withColumn("position", (F.col("before") + F.col("within")).cast("int")).drop("chunk", "before", "within")


def identity() -> tuple[list[Column], list[Column]]:
    return [F.lit(v) for v in (1.0, 0.0, 0.0, 1.0)], [F.lit(0.0), F.lit(0.0)]


@query(f"SELECT vec_id, {list(CONTRASTS)}[vec_id % 4 + 1] AS contrast, true AS registered, true AS near FROM embeddings")
def registered_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's image registered to itself under a known map and another contrast."""
    k = F.col("vec_id")
    a, t = turned(k)
    e = files.dealt(tables.read(spark, d, "embeddings").select("vec_id", "embedding"))
    e = drawn(drawn(e, "fixed", "embedding", *identity()), "seen", "embedding", *moved_back(a, t)).withColumn("moving", recoloured(F.col("seen"), k))
    e = e.select("vec_id", registrations.registration("fixed", "moving").alias("m"))
    # What was found brings moving onto fixed: the inverse of the map that moving was drawn under.
    b, s = moved_back(a, t)
    half = (SIDE - 1) / 2
    gap = []
    for x in (-half, half):
        for y in (-half, half):
            apart = [(F.col(f"m.m{i}0") - b[2 * i]) * x + (F.col(f"m.m{i}1") - b[2 * i + 1]) * y + F.col(f"m.t{'xy'[i]}") - s[i] for i in (0, 1)]
            gap.append(F.hypot(*apart))
    contrast = F.get(F.array(*map(F.lit, CONTRASTS)), (k % 4).cast("int"))
    return e.select("vec_id", contrast.alias("contrast"), "m.registered", (sum(gap) / 4 < NEAR).alias("near"))


@query(
    """WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), b AS (SELECT label, n, floor((n - 1) / 2.0 + 0.5) AS start FROM s)
SELECT label::VARCHAR AS date_iso, start::INT AS best_slice_index, true AS registered, start - floor(0.5 * greatest(0, n - 1) + 0.5) AS offset, true AS zoom_near, true AS rotation_near, true AS pan_near, label % 4 = 2 AS inverted FROM b"""
)
def align_dates(spark: SparkSession, d: str) -> DataFrame:
    """Every label a date, whose slice at the reference's place is the reference under a map and a contrast of its own, among slices of other images."""
    e = tables.read(spark, d, "embeddings").select("label", "vec_id", "embedding")
    first = e.agg(F.min_by("embedding", "vec_id").alias("first"))
    rows = numbered(e).withColumn("start", alignment.start_slice(F.lit(1), F.lit(3), F.col("n"))).join(F.broadcast(first))
    k = F.col("label")
    own = F.when(F.col("position") == F.col("start"), F.col("first")).otherwise(F.col("embedding"))
    slices = rows.select(k.cast("string").alias("date_iso"), "position", "label", own.alias("own"))
    pixels = lambda rows: drawn(rows, "seen", "own", *moved_back(*turned(k * 3 + 1))).withColumn("pixels", recoloured(F.col("seen"), k)).drop("seen")
    shape = F.struct(*[F.lit(v).alias(c) for c, v in {"zoom": 1.0, "rotation": 0.0, "pan_x": 0.0, "pan_y": 0.0, "affine00": 1.0, "affine01": 0.0, "affine10": 0.0, "affine11": 1.0}.items()])
    reference = drawn(first, "pixels", "first", *identity()).select("pixels", F.lit(1).alias("index"), F.lit(3).alias("count"), F.lit(0.5).alias("progress"), shape.alias("geometry"), F.lit(100.0).alias("brightness"), F.lit(100.0).alias("contrast"))
    done = alignment.aligned_dates(reference, slices, 16, pixels=pixels).withColumn("label", F.col("date_iso").cast("long"))
    k = F.col("label") * 3 + 1
    (b, s), near = moved_back(*turned(k)), lambda c, v, most: F.abs(F.col(c) - v) < most
    pan = near("pan_x", s[0] / SIDE, NEAR / SIDE) & near("pan_y", s[1] / SIDE, NEAR / SIDE)

    return done.select(
        "date_iso", "best_slice_index", "registered", "offset", near("zoom", F.sqrt(b[0] * b[3] - b[1] * b[2]), 0.04).alias("zoom_near"), near("rotation", -(k % 17 - 8), 1.5).alias("rotation_near"), pan.alias("pan_near"), (F.col("label") % 4 == 2).alias("inverted"),
    )
