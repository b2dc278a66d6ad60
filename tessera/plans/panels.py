"""More registered queries: imports and exports, selections, controls of panels, geometry, stored state and alignment results.

Each applies the library's functions to a driver table, with the same in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, images, numbers, text
from ..operators import alignment, catalog, export, ingest, selection, state
from ..sources import driver_tables as tables
from ..sources import key_values
from .registry import MAPS, SERIES, counted, dated, edits, first_combo, maps, matrix, query

SIX = lambda c: F.round(c, 6) + F.lit(0.0)  # noqa: E731  (adding zero makes -0 and 0 equal)


def events(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "events").select("event_id", F.col("value").cast("double").alias("v"), (F.col("event_id") % 7).cast("int").alias("a"), (F.col("event_id") % 13).cast("int").alias("n"))


EVENTS = "WITH e AS (SELECT event_id, value::DOUBLE AS v, (event_id % 7)::INT AS a, (event_id % 13)::INT AS n, greatest((event_id % 13)::INT - 1, 0) AS last FROM events)"


@query(
    EVENTS + """, w AS (SELECT *, least(last, greatest(0, least(last, greatest(0, floor(a / 7.0 * last + 0.5))) + a - 3)) AS wheel, (v / 50 - 0.25) - floor(v / 50 - 0.25) AS phase, greatest(0.0, least(1.0, a / 5.0 - 0.2)) AS first FROM e)
SELECT event_id, round(CASE WHEN n > 1 THEN greatest(0.0, least(1.0, (a - 1) / (n - 1))) ELSE 0 END, 6) AS at, round(CASE WHEN n > 1 THEN wheel / last ELSE 0 END, 6) AS wheel, round(first, 6) AS loop_start,
  round(least(1.0, greatest(least(1.0, a / 9.0), first + 0.01)), 6) AS loop_end, round(0.25 + CASE WHEN phase > 0.5 THEN 1 - phase ELSE phase END, 6) AS bounce, round((120 - v) / 200, 6) AS pan,
  round((v + a * 0.25 + 180) - 360 * floor((v + a * 0.25 + 180) / 360) - 180, 6) AS turned, greatest(30, 150 - 30 * a) AS pause, greatest(64.0, floor(least(v * 10, 300.0) - 16)) AS side, least(30, greatest(0, trunc(v - 50)))::INT AS whole FROM w"""
)
def panel_controls(spark: SparkSession, d: str) -> DataFrame:
    a, n, v = F.col("a"), F.col("n"), F.col("v")
    loop = numbers.loop_bounds(a / 5 - 0.2, a / 9)
    return events(spark, d).select(
        "event_id", SIX(numbers.progress_at(a, n, F.lit(1))).alias("at"), SIX(numbers.wheel_progress(a / 7, n, a - 3)).alias("wheel"), SIX(loop["start"]).alias("loop_start"), SIX(loop["end"]).alias("loop_end"),
        SIX(numbers.ping_pong(v / 50, F.lit(0.25), F.lit(0.75))).alias("bounce"), SIX(numbers.centred_pan(F.lit(0.1), F.lit(200), v)).alias("pan"), SIX(numbers.stepped_rotation(v, a)).alias("turned"),
        numbers.repeat_interval(a * 3).alias("pause"), numbers.viewer_size(v * 10, F.lit(300.0), 16.0, 64.0).cast("double").alias("side"), numbers.clamp_int(v - 50, F.lit(0), F.lit(30)).alias("whole"),
    )


@query(
    EVENTS + """, c AS (SELECT event_id, a + 1 AS items, unnest(range(1, a + 2)) AS cols FROM e), r AS (SELECT *, ceil(items / cols) AS lines FROM c),
s AS (SELECT *, least((1200 - (cols - 1) * 8.0) / cols, (800 - lines * 24 - (lines - 1) * 8.0) / lines) AS size FROM r)
SELECT event_id, cols::INT AS cols, floor(greatest(100, least(size, 776.0)))::BIGINT AS cell FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY size DESC, cols) = 1"""
)
def panel_grid(spark: SparkSession, d: str) -> DataFrame:
    g = numbers.grid_layout(F.col("a") + 1, F.lit(1200.0), F.lit(800.0), 8.0, 24.0)
    return events(spark, d).select("event_id", g.alias("g")).select("event_id", "g.cols", F.col("g.cell_size").cast("long").alias("cell"))


@query(
    """SELECT p_partkey, p_brand || ' ' || p_type AS label, regexp_replace(regexp_replace(printf('%.2f', p_size * 0.25 - 3), '\\.00$', ''), '(\\.\\d)0$', '\\1') AS turned, p_size + p_partkey + 70.5 AS listed, -(p_size + 0.5) AS metric, 2 AS samples,
  p_name AS decoded, concat_ws('; ', CASE WHEN p_size % 2 > 0 THEN (p_size % 2) || ' skipped' END, CASE WHEN p_size % 3 > 0 THEN (p_size % 3) || ' failed' END, CASE WHEN p_partkey % 5 = 0 THEN 'first error: ' || p_name END) AS problem FROM part"""
)
def part_texts(spark: SparkSession, d: str) -> DataFrame:
    size, key, name = F.col("p_size"), F.col("p_partkey"), F.col("p_name")
    listed = text.number_list(F.concat(size.cast("string"), F.lit("\\"), key.cast("string"), F.lit(".5,x  7e1\\")))
    metric = text.last_metric(F.concat(F.lit("Metric: "), size.cast("string"), F.lit("\nelse 3\nMETRIC = -"), size.cast("string"), F.lit(".5")), F.lit("done"))
    return tables.read(spark, d, "part").select(
        "p_partkey", text.sequence_label(F.col("p_brand"), F.col("p_type")).alias("label"), text.rotation_text(size * 0.25 - 3).alias("turned"), images.total(listed).alias("listed"),
        metric["final_metric"].alias("metric"), metric["samples"].alias("samples"), text.uri_decoded(text.uri_encoded(name)).alias("decoded"), text.import_problem(size % 3, size % 2, F.when(key % 5 == 0, name)).alias("problem"),
    )


@query(
    """SELECT c_custkey, c_name AS named, NULL::VARCHAR AS missing, CASE WHEN c_custkey % 2 = 0 THEN 'Axial' END AS plane, 'x' || c_custkey AS seq_id, 'd1,d3' AS dates, CASE c_custkey % 3 WHEN 0 THEN 'overlay' WHEN 1 THEN 'grid' END AS mode,
  'd' || c_custkey AS day, CASE WHEN c_custkey % 4 > 0 THEN c_custkey + 0.5 END AS speed FROM customer"""
)
def stored_state(spark: SparkSession, d: str) -> DataFrame:
    """Cookies, filters and overlay state with fields of wrong types."""
    k = F.col("c_custkey")
    key = k.cast("string")
    jar = F.concat(F.lit("a=1; name="), text.uri_encoded(F.col("c_name")), F.lit("; name=other; x"))
    filters = key_values.filters(key_values.json_of(F.concat(F.lit('{"plane": '), F.when(k % 2 == 0, '"Axial"').otherwise("7"), F.lit(', "seqId": "x'), key, F.lit('", "enabledDates": ["d1", 2, "d3", null]}'))))
    mode = F.when(k % 3 == 0, "overlay").when(k % 3 == 1, "grid").otherwise("both")
    overlay = key_values.overlay(key_values.json_of(F.concat(F.lit('{"viewMode": "'), mode, F.lit('", "overlayDate": "d'), key, F.lit('", "playSpeed": '), F.when(k % 4 > 0, F.concat(key, F.lit(".5"))).otherwise('"fast"'), F.lit("}"))))
    return tables.read(spark, d, "customer").select(
        "c_custkey", key_values.cookie(jar, "name").alias("named"), key_values.cookie(jar, "missing").alias("missing"), filters["plane"].alias("plane"), filters["seq_id"].alias("seq_id"),
        F.array_join(filters["enabled_dates"], ",").alias("dates"), overlay["view_mode"].alias("mode"), overlay["overlay_date"].alias("day"), overlay["play_speed"].alias("speed"),
    )


STORED = ["1995-03-05T00:00:00", "never", "1996-07-01T00:00:00"]


@query(SERIES + f"SELECT 'default' AS kind, date_iso FROM enabled UNION ALL SELECT 'stored', date_iso FROM dates WHERE date_iso IN {tuple(STORED)} UNION ALL SELECT 'all', date_iso FROM dates WHERE date_iso IN (SELECT date_iso FROM matrix JOIN first_combo USING (combo_id))")
def enabled_dates(spark: SparkSession, d: str) -> DataFrame:
    """The default, a stored, an empty, all and no dates."""
    found, all_dates = matrix(spark, d), catalog.dates(dated(spark, d))
    kinds = {"default": selection.enabled_dates(all_dates, None), "stored": selection.enabled_dates(all_dates, STORED), "empty": selection.enabled_dates(all_dates, []), "all": selection.selectable_dates(all_dates, found, first_combo(found)), "none": selection.no_dates(all_dates)}
    return reduce(DataFrame.union, [x.select(F.lit(kind).alias("kind"), "date_iso") for kind, x in kinds.items()])


@query(
    SERIES + f""", own AS (SELECT combo_id, list_sort(list(date_iso)) AS held, count(*) AS n FROM matrix GROUP BY 1)
SELECT combo_id, held[-1] AS newest, CASE WHEN list_contains(held, '{STORED[0]}') THEN '{STORED[0]}' ELSE held[-1] END AS active, CASE WHEN list_contains(held, '{STORED[0]}') THEN list_position(held, '{STORED[0]}')::INT - 1 END AS place FROM own"""
)
def active_panels(spark: SparkSession, d: str) -> DataFrame:
    held = matrix(spark, d).groupBy("combo_id").agg(F.sort_array(F.collect_set("date_iso")).alias("held"))
    stored = F.lit(STORED[0])
    return held.select("combo_id", selection.active_panel(F.col("held")).alias("newest"), selection.active_panel(F.col("held"), stored).alias("active"), selection.place_of(F.col("held"), stored).alias("place"))


@query(SERIES + "SELECT combo_id, " + ", ".join(f"max(CASE WHEN date_iso = '{x}' THEN series_uid END) AS d{i}" for i, x in enumerate(STORED)) + " FROM matrix GROUP BY 1")
def matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    return catalog.pivoted(matrix(spark, d), STORED).select("combo_id", *[F.col(f"`{x}`.series_uid").alias(f"d{i}") for i, x in enumerate(STORED)])


@query(SERIES + "SELECT study_uid, string_agg(series_uid || '=' || instance_count, ',' ORDER BY series_number, series_uid) AS series FROM counted GROUP BY 1")
def study_series(spark: SparkSession, d: str) -> DataFrame:
    listed = catalog.study_list(tables.studies(spark, d), counted(spark, d), with_series=True).filter("series_count > 0")
    return listed.select("study_uid", F.array_join(F.transform("series", lambda s: F.concat_ws("=", s["series_uid"], s["instance_count"].cast("string"))), ",").alias("series"))


STUDY = "000000000001"


@query(SERIES + f"SELECT c.series_uid, i.l_linenumber AS instance_number, c.series_number, c.plane, i.l_partkey AS part FROM instance i JOIN counted c USING (series_uid) WHERE i.study_uid = '{STUDY}'")
def study_instances(spark: SparkSession, d: str) -> DataFrame:
    found = catalog.found(catalog.study_detail(STUDY, tables.studies(spark, d), tables.series(spark, d), tables.instances(spark, d).drop("price")), "study")
    return found.select("series_uid", "instance_number", "series_number", "plane", "part")


@query(SERIES + "SELECT l_linenumber AS instance_number, l_partkey AS part, 'own' AS kind FROM instance WHERE series_uid = (SELECT min(series_uid) FROM instance)")
def series_instances(spark: SparkSession, d: str) -> DataFrame:
    """The first series, asked for with its study, and with another, to which it does not belong."""
    series, instances = tables.series(spark, d), tables.instances(spark, d)
    first = instances.agg(F.min("series_uid").alias("series_uid")).first()["series_uid"]
    own = catalog.found(catalog.series_detail(first, series, instances.drop("study_uid"), first.split(".")[0]), "series").withColumn("kind", F.lit("own"))
    other = catalog.series_detail(first, series, instances.drop("study_uid"), "none").withColumn("kind", F.lit("other"))
    return own.union(other).select("instance_number", "part", "kind")


@query(
    SERIES + """, listed AS (SELECT plane FROM combos UNION SELECT plane FROM counted UNION SELECT 'Other')
SELECT plane, row_number() OVER (ORDER BY plane = 'Other', plane)::INT AS place, plane = (SELECT min(plane) FROM listed WHERE plane <> 'Other') AS is_default, coalesce(labels, '') AS labels
FROM listed LEFT JOIN (SELECT plane, string_agg(label, ',' ORDER BY label DESC) AS labels FROM combos WHERE plane = 'ASIA' GROUP BY 1) USING (plane)"""
)
def plane_choices(spark: SparkSession, d: str) -> DataFrame:
    """All planes in order, the default one, and the combos of one plane in theirs."""
    found = catalog.combos(dated(spark, d))
    blank = found.limit(1).withColumn("plane", F.lit(" "))
    listed = selection.plane_list(catalog.planes(counted(spark, d)), found.unionByName(blank))
    order = F.struct((F.col("plane") == "Other").alias("other"), F.col("plane").alias("plane"))
    placed = listed.agg(F.array_sort(F.collect_list(order)).alias("all")).select(F.posexplode("all").alias("at", "p")).select("p.plane", (F.col("at") + 1).alias("place"))
    labels = selection.combos_of_plane(found, "ASIA").groupBy("plane").agg(F.array_join(F.reverse(F.array_sort(F.collect_list("label"))), ",").alias("labels"))
    default = selection.default_plane(listed).withColumnRenamed("plane", "chosen")
    return placed.join(F.broadcast(default)).join(labels, "plane", "left").select("plane", "place", (F.col("plane") == F.col("chosen")).alias("is_default"), F.coalesce("labels", F.lit("")).alias("labels"))


def import_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as parsed files: several of one SOP UID, series and study."""
    k, size = F.col("p_partkey"), F.col("p_size")
    blank = [F.lit("").alias(c) for c in ("study_date", "patient_name", "patient_id", "modality", "accession_number", "protocol_name", "sequence_name", "image_position_patient", "image_orientation_patient", "pixel_spacing")]
    zero = [F.lit(0.0).alias(c) for c in ("slice_location", "slice_thickness", "window_center", "window_width")]
    return tables.read(spark, d, "part").select(
        k.alias("file_seq"), F.concat(F.lit("scan/f"), k.cast("string")).alias("path"), F.when(k % 19 == 0, "unreadable").alias("error"), F.lit(8).cast("long").alias("pixel_length"), F.lit(2.0).alias("rows"), F.lit(2.0).alias("columns"),
        F.lit("1.2.840.10008.5.1.4.1.1.4").alias("sop_class"), (size % 7).cast("string").alias("study_uid"), size.cast("string").alias("series_uid"), (k % 700).cast("string").alias("sop_uid"), k.cast("double").alias("series_number"),
        k.cast("double").alias("instance_number"), F.col("p_name").alias("series_description"), F.concat(F.lit("study of "), k.cast("string")).alias("study_description"), F.col("p_name").cast("binary").alias("content"), *blank, *zero,
    )


def imported_parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """An import into tables that hold SOP UIDs below 300, and series below 10."""
    files = import_files(spark, d)
    instances = ingest.instance_rows(files.filter("sop_uid < 300").dropDuplicates(["sop_uid"])).drop("file_seq")
    series = ingest.series_rows(files.filter("series_uid < 10").withColumn("series_number", F.lit(-1.0)).withColumn("series_description", F.lit("old"))).drop("file_seq").distinct()
    studies = ingest.study_rows(files.limit(0)).drop("file_seq")
    return ingest.imported(files, studies, series, instances)


IMPORT = """WITH f AS (SELECT p_partkey AS k, p_size AS series, p_size % 7 AS study, p_partkey % 700 AS sop, p_name AS name, p_partkey % 19 = 0 AS bad FROM part),
j AS (SELECT *, CASE WHEN bad THEN 'error' WHEN sop < 300 OR row_number() OVER (PARTITION BY sop, bad ORDER BY k) > 1 THEN 'duplicate' ELSE 'ingested' END AS status FROM f)"""


@query(
    IMPORT + """, new AS (SELECT series, max(k) AS k, arg_max(name, k) AS name FROM j WHERE status = 'ingested' GROUP BY 1), again AS (SELECT series, min(k) AS k, arg_min(name, k) AS name FROM j WHERE status = 'duplicate' GROUP BY 1),
old AS (SELECT DISTINCT series, -1 AS k, 'old' AS name FROM f WHERE series < 10), ids AS (SELECT series FROM new UNION SELECT series FROM again UNION SELECT series FROM old)
SELECT ids.series::VARCHAR AS series_uid, coalesce(new.k, old.k, again.k)::INT AS series_number, coalesce(new.name, old.name, again.name) AS series_description FROM ids LEFT JOIN new USING (series) LEFT JOIN old USING (series) LEFT JOIN again USING (series)"""
)
def import_series(spark: SparkSession, d: str) -> DataFrame:
    return imported_parts(spark, d)["series"].select("series_uid", "series_number", "series_description")


@query(IMPORT + ", new AS (SELECT study, max(k) AS k FROM j WHERE status = 'ingested' GROUP BY 1), again AS (SELECT study, min(k) AS k FROM j WHERE status = 'duplicate' GROUP BY 1) SELECT coalesce(new.study, again.study)::VARCHAR AS study_uid, 'study of ' || coalesce(new.k, again.k) AS study_description FROM new FULL JOIN again USING (study)")
def import_studies(spark: SparkSession, d: str) -> DataFrame:
    return imported_parts(spark, d)["studies"].select("study_uid", "study_description")


@query(IMPORT + " SELECT sop::VARCHAR AS sop_uid, k::INT AS instance_number FROM j WHERE status = 'ingested' UNION ALL SELECT DISTINCT sop::VARCHAR, NULL FROM f WHERE sop < 300")
def import_instances(spark: SparkSession, d: str) -> DataFrame:
    """The instances after an import; of those stored before, whose first file is arbitrary here, no number."""
    rows = imported_parts(spark, d)["instances"]
    return rows.select("sop_uid", F.when(F.col("sop_uid") >= 300, F.col("instance_number")).alias("instance_number"))


@query(
    IMPORT + """ SELECT count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'duplicate') AS duplicate, 0::BIGINT AS skipped, count(*) FILTER (status = 'error') AS error,
  (SELECT string_agg('f' || k || ': unreadable', ' / ' ORDER BY k) FROM (SELECT k FROM j WHERE status = 'error' ORDER BY k LIMIT 3)) AS samples, (SELECT round(sum(strlen(name)) / 1048576, 9) FROM f) AS megabytes FROM j"""
)
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    told = imported_parts(spark, d)["files"]
    size = ingest.megabytes(import_files(spark, d)).select(F.round("megabytes", 9).alias("megabytes"))
    return ingest.summary(told).join(F.broadcast(size)).select("ingested", "duplicate", "skipped", "error", F.array_join("error_samples", " / ").alias("samples"), "megabytes")


SAFE = lambda c: f"coalesce(nullif(substr(trim(regexp_replace({c}, '[\\\\/:\"*?<>|]+', '_', 'g')), 1, 80), ''), 'unknown')"
PAD = lambda c, n: f"CASE WHEN length({c}::VARCHAR) < {n} THEN lpad({c}::VARCHAR, {n}, '0') ELSE {c}::VARCHAR END"


@query(
    SERIES + f""", s AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS study_uid, strftime(o_orderdate, '%Y%m%d') || '_' || {SAFE('o_orderpriority')} || '_' || lpad(o_orderkey::VARCHAR, 12, '0') AS folder FROM orders),
e AS (SELECT c.series_uid, c.study_uid, folder || '/' || {PAD('series_number', 2)} || '_' || {SAFE('plane')} || '_' || c.series_uid AS folder FROM counted c JOIN s USING (study_uid))
SELECT study_uid, folder || '/study.json' AS path FROM s UNION ALL SELECT study_uid, folder || '/series.json' FROM e UNION ALL SELECT study_uid, folder || '/instances.json' FROM e
UNION ALL SELECT i.study_uid, folder || '/' || {PAD('l_linenumber', 4)} || '_' || l_orderkey || '.' || l_linenumber || '.dcm' FROM instance i JOIN e USING (series_uid)"""
)
def export_paths(spark: SparkSession, d: str) -> DataFrame:
    return export.entries(**tables.exported(spark, d), by="number").select("study_uid", "path")


@query(
    """WITH p AS (SELECT vec_id, vec_id % 5 / 8.0 + 0.05 AS x, vec_id % 3 / 8.0 AS y, vec_id % 4 / 8.0 AS w, unnest(range(64)) AS i FROM embeddings)
SELECT vec_id, count(*) FILTER (i % 8 >= floor(x * 8) AND i % 8 < ceil((x + w) * 8) AND i // 8 >= floor(y * 8) AND i // 8 < ceil((y + 0.3) * 8)) AS n FROM p GROUP BY 1"""
)
def masked_pixels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    mask = F.struct((k % 5 / 8 + 0.05).alias("x"), (k % 3 / 8).alias("y"), (k % 4 / 8).alias("width"), F.lit(0.3).alias("height"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: images.excluded(i, F.lit(8), F.col("mask")))
    return tables.read(spark, d, "embeddings").select("vec_id", mask.alias("mask")).select("vec_id", F.size(inside).cast("long").alias("n"))


@query(
    MAPS + """ SELECT vec_id, 1.0 AS one, 0.0 AS zero, round(a1, 6) AS back, round(a2 * x1 + b2 * y1 + x2, 6) AS chained, round(x1 - 3.5 + a1 * 3.5 + b1 * 3.5, 6) AS about, round(3.5 + x1 - (a1 * 3.5 + b1 * 3.5), 6) AS plain,
  round(c1, 6) AS css_b, round(x1 + 3.5 + x2 - 3.5 - (a1 * 2.0 + b1 * 1.0) + 2.0, 6) AS told FROM m"""
)
def affine_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Inverses, chains, maps about a point, decomposition and back, and maps from parameter lists."""
    m = maps(spark, d)
    a, b, centre = F.col("one.a"), F.col("one.b"), geometry.vector(3.5, 3.5)
    text_of = lambda *values: F.array(*[F.format_string("%.12f", v) for v in values])
    shifted = {"TransformParameters": text_of(a["m00"], a["m01"], a["m10"], a["m11"], b["x"] + F.col("two.b.x"), b["y"]), "CenterOfRotationPoint": text_of(F.lit(2.0), F.lit(1.0)), "Transform": F.array(F.lit("AffineTransform"))}
    parameters = F.to_json(F.array(F.create_map(*[x for k, v in shifted.items() for x in (F.lit(k), v)])))
    m = m.select("vec_id", "one", "two", geometry.inverse(a).alias("inverse"), geometry.decomposed(a).alias("d"), parameters.alias("json"))
    same = geometry.product(F.col("inverse"), a)
    back = geometry.recomposed(F.col("d.rotation"), F.col("d.zoom"), F.col("d.residual"))
    return m.select(
        "vec_id", SIX(same["m00"]).alias("one"), SIX(same["m01"]).alias("zero"), SIX(back["m00"]).alias("back"), SIX(geometry.chain(F.array("one", "two"))["b"]["x"]).alias("chained"),
        SIX(geometry.about_origin(F.col("one"), centre)["t"]["x"]).alias("about"), SIX(geometry.from_origin(a, b, centre)["b"]["x"]).alias("plain"), SIX(geometry.css_arguments(a)["b"]).alias("css_b"),
        SIX(geometry.affine_of_json(F.col("json"))["b"]["x"]).alias("told"),
    )


@query(
    MAPS + """, g AS (SELECT *, a1 * d1 - b1 * c1 AS det FROM m), p AS (SELECT vec_id, g.*, unnest(range(64)) AS i FROM g), q AS (SELECT *, i % 8 - 3.5 - x1 AS u, i // 8 - 3.5 - y1 AS v FROM p),
s AS (SELECT vec_id, i, (d1 * u - b1 * v) / det + 3.5 AS sx, (-c1 * u + a1 * v) / det + 3.5 AS sy FROM q), t AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, unnest([0, 1, 2, 3]) AS k FROM s),
w AS (SELECT vec_id, i, x0 + k % 2 AS x, y0 + k // 2 AS y, CASE WHEN k % 2 = 1 THEN sx - x0 ELSE 1 - (sx - x0) END * CASE WHEN k // 2 = 1 THEN sy - y0 ELSE 1 - (sy - y0) END AS weight FROM t),
z AS (SELECT w.vec_id, i, sum(CASE WHEN x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 THEN embedding[(y * 8 + x)::INT + 1]::DOUBLE * weight ELSE 0 END) AS value FROM w JOIN embeddings USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, round(sum(value), 4) AS total, round(sum(value * i), 3) AS moment FROM z GROUP BY 1"""
)
def warp_totals(spark: SparkSession, d: str) -> DataFrame:
    m = maps(spark, d).join(tables.read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    a, b = F.col("one.a"), F.col("one.b")
    m = m.select("vec_id", images.warp("embedding", F.lit(8), a["m00"], a["m01"], a["m10"], a["m11"], b["x"], b["y"]).alias("w"))
    return m.select("vec_id", (F.round(images.total(F.col("w")), 4) + 0.0).alias("total"), (F.round(images.total(F.transform("w", lambda x, i: x.cast("double") * i)), 3) + 0.0).alias("moment"))


RESULTS = """WITH r AS (SELECT event_id AS date_iso, (event_id % 9)::INT AS best, value::DOUBLE AS offset_, event_id % 13 AS n FROM events WHERE event_type = 'view'), s AS (SELECT event_id AS date_iso, event_id % 2 = 0 AS turned FROM events WHERE event_id % 3 > 0)"""


def alignment_results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = tables.read(spark, d, "events")
    results = e.filter("event_type = 'view'").select(F.col("event_id").alias("date_iso"), (F.col("event_id") % 9).cast("int").alias("best_slice_index"), F.col("value").cast("double").alias("offset"), F.lit(False).alias("reverse_slice_order"))
    settings = e.filter("event_id % 3 > 0").select(F.col("event_id").alias("date_iso"), (F.col("event_id") % 2 == 0).alias("reverse_slice_order"))
    return results, settings, e.filter("event_id % 5 > 0").select(F.col("event_id").alias("date_iso"), (F.col("event_id") % 13).alias("instance_count"))


@query(
    RESULTS + """ SELECT date_iso, best AS best_slice_index, round(offset_ + CASE WHEN coalesce(turned, false) AND date_iso % 5 > 0 AND n > 0 THEN n - 1 - 2 * best ELSE 0 END, 6) AS shifted, coalesce(turned, false) AS reverse_slice_order FROM r LEFT JOIN s USING (date_iso)"""
)
def applied_alignment(spark: SparkSession, d: str) -> DataFrame:
    done = alignment.applied_results(*alignment_results(spark, d))
    return done.select("date_iso", "best_slice_index", SIX(F.col("offset")).alias("shifted"), "reverse_slice_order")


@query(RESULTS + " SELECT round(avg(offset_), 6) AS average FROM r")
def average_score(spark: SparkSession, d: str) -> DataFrame:
    return alignment.average_score(alignment_results(spark, d)[0], "offset").select(SIX(F.col("average")).alias("average"))


@query(RESULTS + ", a AS (SELECT date_iso % 50 AS day, min(best) AS best FROM r GROUP BY 1) SELECT day AS date_iso, best FROM a WHERE day % 4 > 0")
def unseen_results(spark: SparkSession, d: str) -> DataFrame:
    results = alignment_results(spark, d)[0].select((F.col("date_iso") % 50).alias("date_iso"), F.col("best_slice_index").alias("best"))
    return state.unseen(results, results.filter("date_iso % 4 = 0"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date_iso, arg_max(value, event_id)::DOUBLE AS zoom FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY 1")
def settings_by_date(spark: SparkSession, d: str) -> DataFrame:
    """The stored map of the first user's settings, as rows."""
    last = edits(spark, d).groupBy("combo", "date_iso").agg(F.max_by("value", "event_id").cast("double").alias("zoom"))
    rows = last.groupBy(F.col("combo").cast("string").alias("combo_id")).agg(F.map_from_entries(F.collect_list(F.struct("date_iso", F.struct("zoom").alias("settings")))).alias("settings"))
    first = str(tables.read(spark, d, "events").agg(F.min("user_id")).first()[0])
    return state.settings_by_date(rows, first).select("date_iso", "settings.zoom")


@query(
    EVENTS + """ SELECT event_id, CASE WHEN a > 1 THEN a WHEN n > 1 THEN n WHEN a + n > 8 THEN a + n ELSE 1 END::INT AS shown, CASE WHEN n > 0 THEN least(n - 1, greatest(0, floor(a / 6.0 * (n - 1) + 0.5)))::INT ELSE 0 END AS start FROM e"""
)
def shown_slices(spark: SparkSession, d: str) -> DataFrame:
    a, n = F.col("a"), F.col("n")
    shown = selection.shown_count(a, F.array(F.lit(1), n), F.array(F.lit(0), F.when(a + n > 8, a + n).otherwise(F.lit(1))))
    return events(spark, d).select("event_id", shown.alias("shown"), alignment.start_slice(a, F.lit(7), n).alias("start"))


@query(
    """WITH p AS (SELECT label, vec_id, list_min(a)::DOUBLE AS la, list_max(a)::DOUBLE AS ha, list_min(embedding)::DOUBLE AS lb, list_max(embedding)::DOUBLE AS hb, unnest(list_zip(a, embedding)) AS p FROM embeddings, (SELECT embedding AS a FROM embeddings ORDER BY vec_id LIMIT 1)),
z AS (SELECT label, vec_id, least(7, greatest(0, floor((p[1]::DOUBLE - la) / (ha - la) * 8)))::INT AS i, least(7, greatest(0, floor((p[2]::DOUBLE - lb) / (hb - lb) * 8)))::INT AS j, count(*) OVER (PARTITION BY vec_id)::DOUBLE AS n FROM p),
ea AS (SELECT vec_id, sum(-(c / n) * ln(c / n)) AS h FROM (SELECT vec_id, i, n, count(*) AS c FROM z GROUP BY ALL) GROUP BY 1), eb AS (SELECT vec_id, sum(-(c / n) * ln(c / n)) AS h FROM (SELECT vec_id, j, n, count(*) AS c FROM z GROUP BY ALL) GROUP BY 1),
eab AS (SELECT label, vec_id, sum(-(c / n) * ln(c / n)) AS h FROM (SELECT label, vec_id, i, j, n, count(*) AS c FROM z GROUP BY ALL) GROUP BY 1, 2),
o AS (SELECT label, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY label) AS n, round((ea.h + eb.h) / eab.h, 9) AS score FROM ea JOIN eb USING (vec_id) JOIN eab USING (vec_id) WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
s AS (SELECT *, floor((n - 1) / 2.0 + 0.5)::INT AS start FROM o), f AS (SELECT s.*, t.score AS first, sign(s.k - s.start) AS side, abs(s.k - s.start) AS far FROM s JOIN s t ON t.label = s.label AND t.k = s.start),
l AS (SELECT *, score < lag(score, 1, first) OVER (PARTITION BY label, side ORDER BY far) AS falls FROM f WHERE side <> 0), g AS (SELECT *, falls AND lag(falls, 1, false) OVER (PARTITION BY label, side ORDER BY far) AS over FROM l),
c AS (SELECT label, side, min(far) AS cut FROM g WHERE over GROUP BY 1, 2), v AS (SELECT label, k, score, 2 * far - CASE WHEN side < 0 THEN 1 ELSE 0 END AS visit FROM g LEFT JOIN c USING (label, side) WHERE far <= coalesce(cut, far) UNION ALL SELECT label, k, score, 0 FROM f WHERE side = 0)
SELECT label, first(k ORDER BY score DESC, visit)::INT AS best_index, round(max(score), 6) AS best_score, count(*)::INT AS slices_checked FROM v GROUP BY 1"""
)
def slice_search_result(spark: SparkSession, d: str) -> DataFrame:
    """Of every label the slice most like the first image of all, in the order of vec_id, by scores of nine decimals."""
    e = tables.read(spark, d, "embeddings")
    slices = e.select("label", F.col("vec_id").alias("position"), F.col("embedding").alias("pixels"))
    told = alignment.scored(slices, e.agg(F.min_by("embedding", "vec_id").alias("reference_pixels")), 8).withColumn("score", F.round("score", 9))
    return alignment.best_slices(told, "label", 1, 3).select("label", "best_index", F.round("best_score", 6).alias("best_score"), "slices_checked")


@query("SELECT vec_id AS key, ['forward', 'reverse', 'forward-inverse', 'reverse-inverse'][vec_id % 4 + 1] AS label, 0.0 AS mad FROM embeddings")
def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    """Images resampled by one of the four candidates, each told by its label."""
    m = maps(spark, d).join(tables.read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").withColumn("maps", F.array("one", "two"))
    own = F.get(geometry.transform_candidates(F.col("maps")), (F.col("vec_id") % 4).cast("int"))["std"]
    m = m.withColumn("own", geometry.about_origin(own, geometry.vector(3.5, 3.5)))
    a, t = F.col("own.a"), F.col("own.t")
    resampled = images.warp("embedding", F.lit(8), a["m00"], a["m01"], a["m10"], a["m11"], t["x"], t["y"])
    rows = m.select(F.col("vec_id").alias("key"), F.col("embedding").alias("moving"), F.lit(8).alias("size"), "maps", resampled.alias("resampled"))
    return alignment.chosen_candidate(rows).select("key", "label", SIX(F.col("mad")).alias("mad"))
