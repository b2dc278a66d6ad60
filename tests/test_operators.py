import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import geometry, images
from tessera.operators import alignment, catalog, export, ingest, selection, state
from tessera.sources import archives, driver_tables, files, key_values
from tessera.streaming import ingest as streams


def element(group, number, vr, value):
    value = value if isinstance(value, bytes) else value.encode()
    value += b" " * (len(value) % 2)
    if vr in ("OW", "SQ"):
        return struct.pack("<HH2s2xI", group, number, vr.encode(), len(value)) + value
    return struct.pack("<HH2sH", group, number, vr.encode(), len(value)) + value


def dicom(study="1.1", series="1.2", sop="1.3", text="CORO MPRAGE", orientation="1\\0\\0\\0\\1\\0", kind="1.2.840.10008.5.1.4.1.1.4", pixels=b"\1\0" * 4, number="2"):
    body = element(2, 0x10, "UI", "1.2.840.10008.1.2.1\0") + element(8, 0x16, "UI", kind) + element(8, 0x18, "UI", sop) + element(8, 0x20, "DA", "20240101") + element(8, 0x60, "CS", "MR") + element(8, 0x1030, "LO", "Test Study")
    body += element(8, 0x103E, "LO", text) + element(0x20, 0xD, "UI", study) + element(0x20, 0xE, "UI", series) + element(0x20, 0x11, "IS", "1") + element(0x20, 0x13, "IS", number) + element(0x20, 0x37, "DS", orientation)
    body += element(0x28, 0x10, "US", struct.pack("<H", 2)) + element(0x28, 0x11, "US", struct.pack("<H", 2)) + element(0x28, 0x1050, "DS", "40\\80")
    return b"\0" * 128 + b"DICM" + body + (element(0x7FE0, 0x10, "OW", pixels) if pixels else b"")


def empty(spark):
    return [spark.createDataFrame([], s) for s in (schemas.STUDIES, schemas.SERIES, schemas.INSTANCES)]


def test_tags():
    row = files.parsed(dicom())
    assert (row["rows"], row["columns"], row["window_center"], row["pixel_length"], row["sop_uid"], row["error"]) == (2, 2, 40, 8, "1.3", None)
    assert files.parsed(b"no dicom file at all, only text, but long enough to be read")["error"]
    implicit = b"".join(struct.pack("<HHI", g, e, len(v)) + v for g, e, v in ((8, 0x18, b"1.3 "), (0x28, 0x10, struct.pack("<H", 64))))
    assert files.parsed(implicit)["rows"] == 64


def test_import_export_and_import_again(spark, tmp_path):
    files_ = {
        "a.dcm": dicom(), "_IM1": dicom(sop="1.4", number="1"), "copy.dcm": dicom(), ".hidden": b"x", "A.JSON": b"{}", "bad.dcm": b"garbage", "flat.dcm": dicom(sop="1.5", pixels=b""),
        "capture.dcm": dicom(sop="1.6", kind=ingest.SECONDARY), "none.dcm": dicom(sop=""), "plane": dicom(series="1.9", sop="1.7", text="x"),
    }
    for name, content in files_.items():
        (tmp_path / name).write_bytes(content)
    parsed = files.with_tags(files.scan(spark, files.listed(str(tmp_path)))).cache()
    out = ingest.imported(parsed, *empty(spark))
    told = {r.path.rsplit("/", 1)[-1]: (r.status, r.reason) for r in out["files"].collect()}
    assert told["_IM1"] == ("ingested", None) and told["plane"][0] == "ingested" and sorted([told["a.dcm"][0], told["copy.dcm"][0]]) == ["duplicate", "ingested"]
    assert (told[".hidden"], told["A.JSON"], told["bad.dcm"]) == (("skipped", "extension"), ("skipped", "extension"), ("error", "not-dicom"))
    assert (told["flat.dcm"], told["capture.dcm"], told["none.dcm"]) == (("skipped", "non-displayable"), ("skipped", "secondary-capture"), ("error", "missing-uids"))
    series = {r.series_uid: (r.plane, r.weight, r.sequence_type) for r in out["series"].collect()}
    assert series == {"1.2": ("Coronal", "T1", "MPRAGE"), "1.9": ("Axial", None, None)}
    s = ingest.summary(out["files"]).first()
    assert (s.ingested, s.duplicate, s.skipped, s.error) == (3, 1, 4, 2) and len(s.error_samples) == 2
    again = ingest.imported(parsed, out["studies"], out["series"], out["instances"])
    for t in ("studies", "series", "instances"):
        assert sorted(map(repr, again[t].collect())) == sorted(map(repr, out[t].collect()))
    members = export.entries(out["studies"], out["series"], out["instances"], out["instance_blobs"])
    packed = export.zipped(members).collect()
    (tmp_path / "out.zip").write_bytes(packed[0].archive)
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        names = z.namelist()
    assert len(packed) == 1 and sum(n.endswith(".dcm") for n in names) == 3 and "20240101_Test Study_1.1/study.json" in names
    back = files.with_tags(archives.unzipped(files.named(spark, [str(tmp_path / "out.zip")])))
    assert ingest.imported(back, *empty(spark))["instances"].count() == 3
    assert files.is_archive(["a.ZIP"]) and not files.is_archive(["a.zip", "b"])


def rows(spark):
    studies = spark.createDataFrame([("s1", "20240101"), ("s2", "20240301"), ("s3", ""), ("s4", "20240201")], "study_uid string, study_date string")
    series = spark.createDataFrame(
        [("a", "s1", 1, "Axial", "T1", None), ("b", "s1", 2, "Axial", "T1", None), ("c", "s2", 1, "Axial", "T1", None), ("d", "s2", 2, "Coronal", "T2", "SE"), ("e", "s3", 1, "Sagittal", None, None), ("f", "s4", 1, "", None, ""), ("g", "s1", 3, "Axial", "T1", None)],
        "series_uid string, study_uid string, series_number int, plane string, weight string, sequence_type string",
    )
    instances = spark.createDataFrame([(f"{s}{i}", s, n) for s, n_ in {"a": 1, "b": 5, "c": 2, "d": 1, "e": 1, "f": 1}.items() for i, n in enumerate([2, 1, 1, 4, 5][:n_])], "sop_uid string, series_uid string, instance_number int")
    return studies, series, instances


def test_catalog(spark):
    studies, series, instances = rows(spark)
    counted = catalog.counted_series(series, instances)
    dated = catalog.dated_series(counted, studies)
    m = {(r.combo_id, r.date_iso): (r.series_uid, r.instance_count) for r in catalog.comparison_matrix(dated).collect()}
    assert m == {("axial-t1", "2024-01-01T00:00:00"): ("b", 5), ("axial-t1", "2024-03-01T00:00:00"): ("c", 2), ("coronal-t2-se", "2024-03-01T00:00:00"): ("d", 1), ("unknown", "2024-02-01T00:00:00"): ("f", 1)}
    assert [r.plane for r in catalog.planes(counted).collect()] == ["Axial", "Coronal", "Sagittal"]
    assert [(r.combo_id, r.date_count) for r in catalog.combos(dated).collect()] == [("unknown", 1), ("axial-t1", 2), ("coronal-t2-se", 1)]
    assert [(r.study_uid, r.series_count, r.total_instances) for r in catalog.study_list(studies, counted).collect()] == [("s2", 2, 3), ("s4", 1, 1), ("s1", 2, 6), ("s3", 1, 1)]
    assert catalog.instance_at(instances, "b", 0).first().sop_uid == "b1" and catalog.instance_at(instances, "a", 0).first().sop_uid == "a0"
    with pytest.raises(Exception, match="out of range"):
        catalog.instance_at(instances, "a", 1).collect()
    assert catalog.pivoted(catalog.comparison_matrix(dated), ["2024-01-01T00:00:00"]).count() == 3
    tie = spark.createDataFrame([("c", "d", "s", x, 1) for x in ("z", "y")], "combo_id string, date_iso string, study_uid string, series_uid string, instance_count long")
    assert catalog.comparison_matrix(tie).first().series_uid == "y"


def test_selection(spark):
    studies, series, instances = rows(spark)
    dated = catalog.dated_series(catalog.counted_series(series, instances), studies)
    combos, dates = catalog.combos(dated), catalog.dates(dated)
    assert selection.default_plane(selection.plane_list(catalog.planes(dated), combos)).first().plane == "Axial"
    assert [r.plane for r in selection.plane_list(dated.select("plane").limit(0), combos).collect()] == ["Axial", "Coronal", "Other"]
    assert [r.combo_id for r in selection.combos_of_plane(combos, "Other").collect()] == ["unknown"]
    count = lambda stored: selection.enabled_dates(dates, stored).count()
    assert (count(None), count([]), count(["2024-01-01T00:00:00", "1999"])) == (3, 0, 1)
    matrix = catalog.comparison_matrix(dated)
    assert [r.series_uid for r in selection.cells(dates, matrix, "axial-t1").collect()] == ["c", None, "b"]
    current = spark.createDataFrame([("axial-t1", "Coronal"), ("coronal-t2-se", "Axial"), ("nothing", "Nowhere")], "current_id string, new_plane string")
    assert {r.current_id: r.combo_id for r in selection.best_match(combos, current).collect()} == {"axial-t1": "coronal-t2-se", "coronal-t2-se": "axial-t1", "nothing": "unknown"}
    days = spark.createDataFrame([(1, d) for d in ("2024-01-01", "2024-01-03", "2024-01-05", "2024-01-06")] + [(2, "2024-01-01")], "k int, date_iso string")
    assert [r.nearest for r in selection.nearest_dates(days, ["k"]).orderBy("k", "date_iso").collect()] == ["2024-01-03", "2024-01-01", "2024-01-06", "2024-01-05", None]
    long = days.withColumn("date_iso", F.concat("date_iso", F.lit("T00:00:00")))
    assert [r.nearest and r.nearest[:10] for r in selection.nearest_dates(long, ["k"], strict=True).orderBy("k", "date_iso").collect()] == ["2024-01-03", "2024-01-01", "2024-01-03", "2024-01-05", None]
    one = spark.range(1).select(selection.toggled(F.array(F.lit("b"), F.lit("a")), F.lit("b")).alias("x"), selection.toggled(F.array(F.lit("b")), F.lit("a")).alias("y"), selection.shown_count(F.lit(1), F.array(F.lit(1), F.lit(7)), F.array(F.lit(3))).alias("n")).first()
    assert (one.x, one.y, one.n) == (["a"], ["a", "b"], 7)


def test_settings(spark, tmp_path):
    log = spark.createDataFrame([("c", "d1", 2.0, None, 1), ("c", "d1", None, 3.0, 2), ("c", "d1", 4.0, None, 3)], "combo_id string, date_iso string, zoom double, rotation double, seq long")
    path = str(tmp_path / "log")
    state.save(log, path)
    merged = state.with_defaults(state.latest(spark.read.parquet(path), ["combo_id", "date_iso"], ["zoom", "rotation"])).first()
    assert (merged.zoom, merged.rotation, merged.brightness) == (4.0, 3.0, 100.0)
    zoom = lambda *r: spark.createDataFrame(list(r), "date_iso string, zoom double")
    enabled = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "date_iso string")
    got = {r.date_iso: r.zoom for r in state.hydrated(zoom(("d1", 5.0), ("d9", 6.0)), zoom(("d1", 7.0), ("d2", 8.0), ("d8", 9.0)), enabled, values=("zoom",)).collect()}
    assert got == {"d1": 5.0, "d2": 8.0, "d3": 1.0, "d9": 6.0}
    assert {r.date_iso: r.zoom for r in state.hydrated(zoom(("d1", 5.0)), zoom(("d2", 8.0)), enabled, same_combo=False, values=("zoom",)).collect()} == {"d1": 5.0, "d2": 1.0, "d3": 1.0}


def test_undo(spark):
    acts = [("edit", "d", "zoom", 1.0, None), ("edit", "d", "zoom", 1.0, None), ("edit", "d", "progress", 0.5, None), ("edit", "d", "zoom", 2.0, "b"), ("edit", "e", "zoom", 3.0, "b"), ("undo",), ("redo",), ("undo",), ("undo",), ("redo",)]
    table = [("k", i, *(a + (None,) * (5 - len(a)))) for i, a in enumerate(acts)]
    got = state.replay(spark.createDataFrame(table, "key string, seq long, kind string, date_iso string, field string, value double, batch string")).collect()
    assert {(r.date_iso, r.field): r.value for r in got} == {("d", "zoom"): 1.0}
    h = state.History()
    for i in range(300):
        h.act("edit", "d", {"zoom": float(i)}, None)
    assert len(h.undo) == state.MOST_HISTORY


def test_search_rule(spark):
    def find(scores, start, stop=2):
        df = spark.createDataFrame([(scores, start)], "s array<double>, i int")
        return tuple(df.select(alignment.searched(F.col("s"), F.col("i"), stop).alias("r")).first().r)

    assert find([1.0, 2.0, 3.0, 4.0, 5.0], 0) == (4, 5.0, 5)
    assert find([9.0, 0.0, 1.0, 2.0, 3.0, 2.5, 2.0, 1.0, 9.0], 4) == (4, 3.0, 5)
    assert find([1.0, 1.0, 1.0], 1) == (1, 1.0, 3) and find([1.0, 2.0], 1) == (1, 2.0, 2)
    assert find([], 0) == (0, 0.0, 0)


def test_candidates_and_settings(spark):
    ramp = [x / 15 for _ in range(16) for x in range(16)]
    shift = geometry.affine(geometry.matrix(1, 0, 0, 1), geometry.vector(2, -1))
    moved = images.warped(ramp, 16, (1, 0, 0, 1), (2, -1)).tolist()
    df = spark.createDataFrame([(1, ramp, moved)], "key int, moving array<float>, resampled array<float>").withColumn("size", F.lit(16)).withColumn("maps", F.array(shift))
    best = alignment.chosen_candidate(df).first()
    assert best.label == "forward" and best.mad == 0
    r = spark.range(1).select(alignment.reversed_offset(F.lit(0), F.lit(2), F.lit(10), F.lit(True)).alias("o"), alignment.slice_offset(F.lit(7), F.lit(10), F.lit(0.5)).alias("s")).first()
    assert (r.o, r.s) == (5, 2)


def test_key_values(spark):
    t = spark.createDataFrame([("app:a", '{"n": 1}'), ("app:b", "{"), ("x", "1")], "key string, json string")
    assert key_values.stored(t, "app:b").first().value is None and key_values.stored(t, "app:a").first().value is not None
    assert [r.key for r in key_values.without(t, ["x"], ["app:a"]).collect()] == ["app:b"]
    assert key_values.written(t, "x", F.struct(F.lit(2).alias("v"))).filter("key = 'x'").first().json == '{"v":2}'
    c = spark.range(1).select(key_values.cookie(F.lit("a=1; b=x%20y=z; b=2"), "b").alias("c"), key_values.playback(F.parse_json(F.lit('{"loopStart":0.1,"loopEnd":0.4,"loopSpeed":2}'))).alias("p"), key_values.playback(F.parse_json(F.lit('{"loopStart":"0"}'))).alias("q")).first()
    assert c.c == "x y=z" and tuple(c.p) == (0.1, 0.4, 2) and c.q is None


def test_tables(spark):
    schemas.create_tables(spark, "imaging_test")
    schemas.create_tables(spark, "imaging_test")
    assert spark.table("imaging_test.panel_settings").columns[-1] == "seq"
    schemas.drop_tables(spark, "imaging_test")
    spark.sql("DROP DATABASE imaging_test CASCADE")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.dcm").write_bytes(dicom(sop=f"9.{i}"))
    seen = []
    q = streams.import_each(streams.watch(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r.sop_uid for r in df.select("sop_uid").collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == ["9.0", "9.1", "9.2"]


def test_unknown_studies_raise(spark):
    none = spark.createDataFrame([(1,)], "a int")
    assert catalog.found(none, "study").count() == 1
    with pytest.raises(Exception, match="study not found"):
        catalog.found(none.filter("a = 2"), "study").collect()


def test_series_are_counted_in_parts_of_bounded_rows(spark, data, monkeypatch):
    """More line items make more parts, not larger ones, and the parts do not change what is counted."""
    whole = {tuple(r) for r in driver_tables.counted_series(spark, data).collect()}
    monkeypatch.setattr(driver_tables, "PART_ROWS", 500)
    counted = driver_tables.counted_series(spark, data)
    sizes = [r["count"] for r in counted.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 1000
    assert {tuple(r) for r in counted.collect()} == whole
    assert max(r["count"] for r in driver_tables.series(spark, data).groupBy(F.spark_partition_id()).count().collect()) < 1000


def test_matrix_sends_a_series_once(spark):
    """Of a combo and date only the order is kept, which holds the uid once and tells the count; of equal counts the smallest uid, whatever its study."""
    rows = [("c", "d1", "s2", "b", 3), ("c", "d1", "s1", "c", 3), ("c", "d1", "s0", "d", 2), ("c", "d2", "s3", "e", 1)]
    dated = spark.createDataFrame(rows, "combo_id string, date_iso string, study_uid string, series_uid string, instance_count long")
    found = catalog.comparison_matrix(dated)
    assert sorted(map(tuple, found.collect())) == [("c", "d1", "s2", "b", 3), ("c", "d2", "s3", "e", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    kept = next(line for line in plan.splitlines() if "min(" in line)
    assert kept.split("min(")[1].count("series_uid#") == 1
