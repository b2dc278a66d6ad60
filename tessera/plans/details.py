"""Registered queries of smaller pieces: resampling, steps of controls, metadata, stored keys, masks, geometry and settings of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, images, numbers, resampling
from ..operators import alignment, export, pixels, state
from ..sources import driver_tables as tables
from ..sources import key_values
from .panels import EVENTS, SIX, events
from .registry import STATS, query, sql_stats


@query(
    """WITH s AS (SELECT vec_id, embedding AS e, [8, 16, 4][vec_id % 3 + 1] AS w, [8, 4, 16][vec_id % 3 + 1] AS h, [12, 5][vec_id // 3 % 2 + 1] AS s FROM embeddings),
f AS (SELECT *, floor(w * least(s / w, s / h) + 0.5)::INT AS cw, floor(h * least(s / w, s / h) + 0.5)::INT AS ch FROM s), p AS (SELECT *, unnest(range(cw * ch)) AS i FROM f), q AS (SELECT *, i % cw AS x, i // cw AS y FROM p),
c AS (SELECT *, greatest(0.0, least(w - 1.0, (x + 0.5) * w / cw - 0.5)) AS sx, greatest(0.0, least(h - 1.0, (y + 0.5) * h / ch - 0.5)) AS sy FROM q), k AS (SELECT *, unnest(range(w * h)) AS j FROM c),
v AS (SELECT vec_id, s, (y + (s - ch) // 2) * s + x + (s - cw) // 2 AS pos, e[j + 1]::DOUBLE
  * CASE WHEN cw < w THEN greatest(0.0, least((x + 1.0) * w / cw, j % w + 1) - greatest(x * w / cw, j % w)) * cw / w ELSE greatest(0.0, 1 - abs(sx - j % w)) END
  * CASE WHEN ch < h THEN greatest(0.0, least((y + 1.0) * h / ch, j // w + 1) - greatest(y * h / ch, j // w)) * ch / h ELSE greatest(0.0, 1 - abs(sy - j // w)) END AS value FROM k)
SELECT vec_id, s::INT AS size, round(sum(value), 4) + 0.0 AS total, round(sum(value * pos), 3) + 0.0 AS moment FROM v GROUP BY 1, 2"""
)
def resampled_grids(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as square, wide and tall images on larger and smaller grids."""
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    k = F.col("vec_id")
    e = tables.read(spark, d, "embeddings").select("vec_id", "embedding", of((8, 16, 4), k % 3).alias("w"), of((8, 4, 16), k % 3).alias("h"), of((12, 5), F.floor(k / 3) % 2).alias("size"))
    e = e.select("vec_id", "size", resampling.on_grid("embedding", "w", "h", "size").alias("g"))
    return e.select("vec_id", "size", (F.round(images.total(F.col("g")), 4) + 0.0).alias("total"), (F.round(images.total(F.transform("g", lambda x, i: x.cast("double") * i)), 3) + 0.0).alias("moment"))


@query(EVENTS + " SELECT event_id, round(least(10.0, greatest(0.1, v / 20 + (a - 3) * 0.01)), 6) AS zoom, round(least(200.0, greatest(0.0, v + a - 3)), 6) AS brightness, round(least(200.0, greatest(0.0, 100 - v + a - 3)), 6) AS contrast FROM e")
def step_controls(spark: SparkSession, d: str) -> DataFrame:
    v, steps = F.col("v"), F.col("a") - 3
    return events(spark, d).select("event_id", SIX(numbers.stepped("zoom", v / 20, steps)).alias("zoom"), SIX(numbers.stepped("brightness", v, steps)).alias("brightness"), SIX(numbers.stepped("contrast", 100 - v, steps)).alias("contrast"))


@query(
    """SELECT l_orderkey, l_linenumber, '{"sop_uid":"' || l_partkey || '","series_uid":"' || l_suppkey || '","study_uid":null,"instance_number":' || l_linenumber || ',"rows":' || CASE WHEN l_linenumber % 2 = 0 THEN 'null' ELSE '512' END
  || ',"columns":null,"slice_location":null,"image_position_patient":null,"image_orientation_patient":null,"pixel_spacing":null,"slice_thickness":null,"window_center":null,"window_width":null}' AS told FROM lineitem"""
)
def instance_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Exported fields of instances of which most are not known; the file is not among them."""
    items = tables.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("sop_uid"), F.col("l_suppkey").cast("string").alias("series_uid"), F.col("l_linenumber").cast("int").alias("instance_number"),
        F.when(F.col("l_linenumber") % 2 != 0, F.lit(512)).alias("rows"), F.lit("file").cast("binary").alias("content"),
    )
    return items.select("l_orderkey", "l_linenumber", F.to_json(F.struct(*export.metadata(items)), export.WITH_NULLS).alias("told"))


KEYS = """WITH k AS (SELECT ['app:', 'ui:', 'seen:'][c_custkey % 3 + 1] || c_custkey AS key, '{"n":' || c_custkey || '}' AS json FROM customer)"""


@query(KEYS + """ SELECT key, json FROM k WHERE key NOT LIKE 'app:%' AND key NOT IN ('ui:1', 'seen:2') UNION ALL SELECT 'seen:2', '{"planes":["Axial"],"speed":2}'""")
def key_writes(spark: SparkSession, d: str) -> DataFrame:
    """Keys deleted by name and by their beginning, and one written."""
    k = F.col("c_custkey")
    kept = tables.read(spark, d, "customer").select(F.concat(F.get(F.array(*map(F.lit, ("app:", "ui:", "seen:"))), (k % 3).cast("int")), k.cast("string")).alias("key"), F.to_json(F.struct(k.alias("n"))).alias("json"))
    return key_values.written(key_values.without(kept, ["ui:1"], ["app:"]), "seen:2", F.struct(F.array(F.lit("Axial")).alias("planes"), F.lit(2).alias("speed")))


@query("""SELECT c_custkey, 'state=' || url_encode('{"name":"' || c_name || ' of ' || c_mktsegment || '","n":' || c_custkey || '}') AS pair, c_custkey % 5 = 0 AS archive FROM customer""")
def cookie_writes(spark: SparkSession, d: str) -> DataFrame:
    """Cookies of JSON, and whether lists of one file are archives."""
    k = F.col("c_custkey")
    value = F.struct(F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("name"), k.alias("n"))
    name = F.lower(F.when(k % 5 == 0, F.lit("Scan.ZIP")).otherwise(F.lit("scan.zip.txt")))
    return tables.read(spark, d, "customer").select("c_custkey", key_values.cookie_pair("state", value).alias("pair"), name.endswith(".zip").alias("archive"))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 10 / 10.0 AS s, c_custkey % 7 / 7.0 AS e FROM customer),
b AS (SELECT k, CASE WHEN k % 3 > 0 THEN s WHEN k % 2 = 0 THEN 0.25 END AS s, CASE WHEN k % 3 > 0 THEN e WHEN k % 2 = 0 THEN 0.75 END AS e, CASE WHEN k % 3 > 0 THEN CASE WHEN k % 4 IN (2) THEN 2 ELSE 1 END WHEN k % 2 = 0 THEN 4 END AS speed FROM c)
SELECT k AS c_custkey, CASE WHEN s IS NOT NULL THEN round(least(s, 1.0), 6) END AS loop_start, CASE WHEN s IS NOT NULL THEN round(least(1.0, greatest(e, least(s, 1.0) + 0.01)), 6) END AS loop_end, speed::INT AS loop_speed FROM b"""
)
def playback_state(spark: SparkSession, d: str) -> DataFrame:
    """Loops stored locally, else in a cookie, else not at all."""
    k = F.col("c_custkey")
    local = F.to_json(F.struct((k % 10 / 10).alias("loopStart"), (k % 7 / 7).alias("loopEnd"), (k % 4).alias("loopSpeed")))
    jar = F.when(k % 2 == 0, F.lit('{"loopStart": 0.25, "loopEnd": 0.75, "loopSpeed": 4}')).otherwise(F.lit('{"loopStart": "0.25"}'))
    found = key_values.playback_of(key_values.json_of(F.when(k % 3 > 0, local).otherwise(F.lit('{"loopStart":'))), key_values.json_of(jar))
    return tables.read(spark, d, "customer").select("c_custkey", found.alias("p")).select("c_custkey", SIX(F.col("p.loop_start")).alias("loop_start"), SIX(F.col("p.loop_end")).alias("loop_end"), "p.loop_speed")


@query(
    """WITH p AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN vec_id % 2 = 0 THEN floor(abs(embedding[i // 4 * 4 + 1]::DOUBLE) * 255) ELSE floor(abs(embedding[i + 1]::DOUBLE) * 255) END) AS b FROM embeddings),
s AS (SELECT *, b[1] = b[2] AND b[1] = b[3] AND b[33] = b[34] AND b[33] = b[35] AND b[61] = b[62] AND b[61] = b[63] AS grey FROM p), q AS (SELECT *, unnest(range(16)) AS i FROM s)
SELECT vec_id, round(sum(CASE WHEN grey THEN b[i * 4 + 1] ELSE 0.299 * b[i * 4 + 1] + 0.587 * b[i * 4 + 2] + 0.114 * b[i * 4 + 3] END / 255 * (i + 1)), 4) AS total FROM q GROUP BY 1"""
)
def grey_pixels(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.floor(F.abs(F.get("embedding", i.cast("int")).cast("double")) * 255)
    rgba = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.col("vec_id") % 2 == 0, at(F.floor(i / 4) * 4)).otherwise(at(i)))
    e = tables.read(spark, d, "embeddings").select("vec_id", rgba.alias("b")).select("vec_id", images.grey(F.col("b")).alias("g"))
    return e.select("vec_id", F.round(images.total(F.transform("g", lambda x, i: x.cast("double") * (i + 1))), 4).alias("total"))


PANEL = EVENTS + ", g AS (SELECT event_id, a, n, v, 0.5 + a / 4.0 AS zoom, v * 3 - 200 AS rotation, a / 4.0 - 0.75 AS pan_x, n / 20.0 - 0.3 AS pan_y FROM e)"


def panels(spark: SparkSession, d: str, shear: float) -> DataFrame:
    a, n, v = F.col("a"), F.col("n"), F.col("v")
    values = {"zoom": 0.5 + a / 4, "rotation": v * 3 - 200, "pan_x": a / 4 - 0.75, "pan_y": n / 20 - 0.3, "affine00": F.lit(1.0), "affine01": F.lit(shear), "affine10": F.lit(0.0), "affine11": F.lit(1.0)}
    return events(spark, d).select("event_id", "a", "n", "v", F.struct(*[x.cast("double").alias(k) for k, x in values.items()]).alias("g"))


@query(
    PANEL + """, c AS (SELECT *, unnest([10.0, 60.0, 10.0, 60.0]) AS x, unnest([20.0, 20.0, 80.0, 80.0]) AS y FROM g), u AS (SELECT *, (x - 50 - pan_x * 100) / zoom AS p, (y - 50 - pan_y * 100) / zoom AS q, radians(-rotation) AS t FROM c),
w AS (SELECT *, cos(t) * p - sin(t) * q AS p2, sin(t) * p + cos(t) * q AS q2 FROM u), z AS (SELECT event_id, p2 - 0.2 * q2 + 50 AS cx, q2 + 50 AS cy FROM w),
m AS (SELECT event_id, greatest(0.0, least(100.0, min(cx))) AS x0, greatest(0.0, least(100.0, max(cx))) AS x1, greatest(0.0, least(100.0, min(cy))) AS y0, greatest(0.0, least(100.0, max(cy))) AS y1 FROM z GROUP BY 1)
SELECT event_id, round(x0 / 100, 6) AS x, round(y0 / 100, 6) AS y, round((x1 - x0) / 100, 6) AS width, round((y1 - y0) / 100, 6) AS height FROM m"""
)
def screen_masks(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle drawn on moved, turned, zoomed and sheared panels, as a mask of the unmoved image."""
    p = panels(spark, d, 0.2).select("event_id", geometry.screen_mask(*map(F.lit, (10.0, 20.0, 50.0, 60.0, 100.0, 100.0)), F.col("g")).alias("m"))
    return p.select("event_id", *[SIX(F.col(f"m.{k}")).alias(k) for k in ("x", "y", "width", "height")])


@query(
    PANEL + """ SELECT event_id, round(zoom, 6) AS zoom, round(rotation + 180 - 360 * floor((rotation + 180) / 360) - 180, 4) AS rotation, round(greatest(-1.0, least(1.0, pan_x)), 6) AS pan_x, round(pan_y, 6) AS pan_y,
  round(zoom * cos(radians(rotation)), 6) AS m00, round(-zoom * sin(radians(rotation)), 6) AS m01, round(pan_y * 64, 6) AS ty FROM g"""
)
def panel_maps(spark: SparkSession, d: str) -> DataFrame:
    """Panel geometry as an affine map about the centre, and back."""
    p = panels(spark, d, 0.0).select("event_id", geometry.panel_affine(F.col("g"), F.lit(64.0)).alias("m"))
    p = p.select("event_id", "m", geometry.panel_geometry(F.col("m.a"), F.col("m.t"), F.lit(64.0)).alias("b"))
    return p.select("event_id", SIX(F.col("b.zoom")).alias("zoom"), (F.round("b.rotation", 4) + 0.0).alias("rotation"), SIX(F.col("b.pan_x")).alias("pan_x"), SIX(F.col("b.pan_y")).alias("pan_y"), SIX(F.col("m.a.m00")).alias("m00"), SIX(F.col("m.a.m01")).alias("m01"), SIX(F.col("m.t.y")).alias("ty"))


@query(
    EVENTS + """, s AS (SELECT *, 2.0 / (1 + a) AS k, 1 - 2 * (0.3 - 2.0 / (1 + a) * (v / 100)) AS c FROM e)
SELECT event_id, a - floor(n / 13.0 * last + 0.5) AS offset_, CASE WHEN abs(c) < 1e-10 THEN 100 ELSE floor(greatest(0.0, least(200.0, k / c * 100)) + 0.5) END::DOUBLE AS brightness,
  CASE WHEN abs(c) < 1e-10 THEN 100 ELSE floor(greatest(0.0, least(200.0, c * 100)) + 0.5) END::DOUBLE AS contrast, 1.25 AS zoom, n / 13.0 AS progress, false AS reverse_slice_order FROM s"""
)
def aligned_panels(spark: SparkSession, d: str) -> DataFrame:
    """All settings of aligned panels, from statistics, slices and geometry."""
    a, n, v = F.col("a"), F.col("n"), F.col("v")
    stats = lambda mean, spread: F.struct(mean.cast("double").alias("mean"), spread.cast("double").alias("stddev"))
    shape = F.struct(*[F.lit(x).alias(k) for k, x in {"zoom": 1.25, "rotation": 0.0, "pan_x": 0.0, "pan_y": 0.0, "affine00": 1.0, "affine01": 0.0, "affine10": 0.0, "affine11": 1.0}.items()])
    s = alignment.aligned_settings(stats(F.lit(0.3), F.lit(0.2)), stats(v / 100, 0.1 * (1 + a)), a, n, n / 13, shape)
    return events(spark, d).select("event_id", s.alias("s")).select("event_id", F.col("s.offset").alias("offset_"), "s.brightness", "s.contrast", "s.zoom", "s.progress", "s.reverse_slice_order")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN value::DOUBLE END, 1.0) AS zoom, coalesce(CASE WHEN event_id % 4 > 0 THEN value::DOUBLE END, 100.0) AS brightness, 100.0 AS contrast, false AS reverse_slice_order, 0.0 AS progress FROM events")
def default_settings(spark: SparkSession, d: str) -> DataFrame:
    """Stored settings with missing fields, as values of their types."""
    value = F.col("value").cast("double")
    stored = tables.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, value).alias("zoom"), F.when(F.col("event_id") % 4 > 0, value).alias("brightness"))
    return state.with_defaults(stored).select("event_id", "zoom", "brightness", "contrast", "reverse_slice_order", "progress")


@query(f"WITH s AS (SELECT vec_id, {sql_stats('embedding')} FROM embeddings) SELECT vec_id, {', '.join(f'round({k}::DOUBLE, 6) AS {k}' for k in STATS)} FROM s")
def pixel_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of images that come as rows of pixels."""
    rows = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.explode("embedding").alias("value"))
    return pixels.statistics(rows).select(F.col("image").alias("vec_id"), *[F.round(k, 6).alias(k) for k in STATS])


@query(
    """WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high, list_sort(list(l_extendedprice)) AS v FROM lineitem)
SELECT round(mean, 4) AS mean, low::DOUBLE AS min, high::DOUBLE AS max, v[floor(n * 0.1)::INT + 1]::DOUBLE AS p10, v[floor(n * 0.5)::INT + 1]::DOUBLE AS p50, v[floor(n * 0.9)::INT + 1]::DOUBLE AS p90 FROM s"""
)
def large_image(spark: SparkSession, d: str) -> DataFrame:
    """All prices as the pixels of one image: no task holds it."""
    rows = tables.read(spark, d, "lineitem").select(F.lit(1).alias("image"), F.col("l_extendedprice").alias("value"))
    return pixels.statistics(rows).select(F.round("mean", 4).alias("mean"), "min", "max", "p10", "p50", "p90")
