import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry, images, numbers, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def each(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.y for r in spark.createDataFrame(rows, f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_planes(spark):
    told = {"AX-2": "Axial", "COR-1": "Coronal", "SAG-3": "Sagittal", "SAGIT T2": "Sagittal", "CORO T1": "Coronal", "TRA-1": "Axial", "TRANSVERSE": "Axial", "TAX-1": "Axial", "T1 POST CONTRAST": "Axial", "Series 1": None, None: None, "": None}
    assert each(spark, list(told), text.plane_of) == list(told.values())


def test_weights_and_sequences(spark):
    told = {"T1-MPRAGE": "T1", "AX-2_T2": "T2", "T1W": "T1", "MPRAGET1": "T1", "T10": None, "T10T1": None, "": None}
    assert each(spark, list(told), text.weight_of) == list(told.values())
    told = {"SS-FSE": "SSFSE", "SS_FSE": "SSFSE", "Series 1": None, "FLAIR TFE": "TFE", "localizer": "Localizer", "AX SE": "SE", "se3": "SE", "MPRAGE": "MPRAGE", "DWI2": "DWI", "XDWIX": None}
    assert each(spark, list(told), text.sequence_of) == list(told.values())
    got = each(spark, ["MPRAGE", "FLAIR", "CORO MPRAGE"], text.classified)
    assert [(r.plane, r.weight, r.sequence) for r in got] == [(None, "T1", "MPRAGE"), (None, "T2", "FLAIR"), ("Coronal", "T1", "MPRAGE")]


def test_labels_and_names(spark):
    r = one(spark, a=text.combo_id(F.lit("Axial"), F.lit("T1 W"), F.lit(None)), b=text.combo_id(F.lit(""), F.lit(None), F.lit("")), c=text.combo_label(F.lit(None), F.lit(""), F.lit(None)), d=text.sequence_label(F.lit("T1"), F.lit("SE")), e=text.classification_text(F.lit(""), F.lit("b"), F.lit("c")))
    assert tuple(r) == ("axial-t1-w", "unknown", "Unknown", "T1 SE", "b | c")
    assert each(spark, ["20240101", "202401", "20241399", None, ""], text.iso_date) == ["2024-01-01T00:00:00", "202401", "2024-13-99T00:00:00", None, ""]
    assert each(spark, ["20240101", "", None, "2024-01-02T00:00:00"], text.short_date) == ["2024-01-01", "Unknown date", "Unknown date", "2024-01-02"]
    assert each(spark, ["2024-01-01T00:00:00", None, "x"], text.long_date) == ["Jan 1, 2024", "Unknown Date", "Unknown Date"]
    assert each(spark, ["2024-01-02", "2024-01-02T00:00:00", "x"], text.utc_millis) == [1704153600000, None, None]
    assert each(spark, [0.0, 12.5, 12.25, -3.1], text.rotation_text, "double") == ["0", "12.5", "12.25", "-3.1"]
    assert each(spark, ["a/b:c", "  ", "", "x" * 90], text.safe_filename) == ["a_b_c", "unknown", "unknown", "x" * 80]
    assert each(spark, [3, 12, 123], lambda c: text.zero_padded(c, 2), "int") == ["03", "12", "123"]
    assert each(spark, ["a\\b/c.dcm", "x"], text.basename) == ["c.dcm", "x"]
    assert each(spark, ["1\\0.5, -2 x 3a", ""], text.number_list) == [[1.0, 0.5, -2.0, 3.0], []]
    assert each(spark, ["a b&c"], text.uri_encoded) == ["a%20b%26c"] and each(spark, ["a%20b", "%zz"], text.uri_decoded) == ["a b", None]
    got = one(spark, m=text.last_metric(F.lit("metric 1 2.5\nother 9\nMetric: -3e-1"), F.lit("x"))).m
    assert (got.final_metric, got.samples) == (-0.3, 2)


def test_numbers(spark):
    assert each(spark, [190.0, -190.0, 180.0, 0.0, 540.0], numbers.normal_rotation, "double") == [-170, 170, -180, 0, -180]
    r = one(spark, a=numbers.clamp(F.lit(5), 0, 3), b=numbers.clamp_int(F.lit(-2.2), 0, 4), c=numbers.half_up(F.lit(-2.5)), d=numbers.wheel_progress(F.lit(0.5), F.lit(10), F.lit(1)), e=numbers.slice_index(F.lit(10), F.lit(0.5), F.lit(0)), f=numbers.instance_index(F.lit(2), F.lit(10), F.lit(True)))
    assert (r.a, r.b, r.c, round(r.d, 9), r.e, r.f) == (3, 0, -2, round(6 / 9, 9), 5, 7)
    b = one(spark, b=numbers.loop_bounds(F.lit(0.5), F.lit(0.2)), t=numbers.loop_bounds(F.lit(1.0), F.lit(1.0)), p=numbers.ping_pong(F.lit(1.3), F.lit(0.0), F.lit(1.0)), g=numbers.grid_layout(F.lit(4), F.lit(800.0), F.lit(800.0), 10.0, 20.0), v=numbers.repeat_interval(F.lit(20)), c=numbers.centred_pan(F.lit(0.0), F.lit(100.0), F.lit(25.0)))
    assert (b.b.start, b.b.end, b.t.end, b.g.cols, b.v, b.c) == (0.5, 0.51, 1.0, 2, 30, 0.25) and abs(b.p - 0.7) < 1e-12


@given(st.floats(-1e4, 1e4))
@settings(max_examples=30, deadline=None)
def test_rotation_is_periodic(spark, x):
    r = one(spark, a=numbers.normal_rotation(F.lit(x))).a
    assert -180 <= r < 180 and min((r - x) % 360, 360 - (r - x) % 360) < 1e-6


def test_affine_round_trips(spark):
    m = geometry.matrix(1.2, 0.3, -0.1, 0.9)
    d = geometry.decomposed(m)
    r = one(spark, back=geometry.recomposed(d["rotation"], d["zoom"], d["residual"]), same=geometry.composed(geometry.inverted(geometry.affine(m, geometry.vector(3, 4))), geometry.affine(m, geometry.vector(3, 4))))
    assert all(abs(a - b) < 1e-8 for a, b in zip(r.back, (1.2, 0.3, -0.1, 0.9), strict=True))
    assert all(abs(a - b) < 1e-9 for a, b in zip((*r.same.a, *r.same.b), (1, 0, 0, 1, 0, 0), strict=True))
    with pytest.raises(Exception, match="singular"):
        one(spark, x=geometry.inverse(geometry.matrix(1, 2, 2, 4)))


def test_panel_round_trip(spark):
    g = F.struct(*[F.lit(v).alias(k) for k, v in {"zoom": 1.5, "rotation": 30.0, "pan_x": 0.1, "pan_y": -0.2, "affine00": 1.0, "affine01": 0.0, "affine10": 0.0, "affine11": 1.0}.items()])
    view = geometry.panel_affine(g, F.lit(256))
    back = one(spark, b=geometry.panel_geometry(view["a"], view["t"], F.lit(256))).b
    assert all(abs(a - b) < 1e-9 for a, b in zip(back, (1.5, 30.0, 0.1, -0.2, 1, 0, 0, 1), strict=True))


def test_transform_parameters(spark):
    entry = lambda p: '{"Transform":["AffineTransform"],"TransformParameters":[%s],"CenterOfRotationPoint":["0","0"]}' % ",".join(f'"{x}"' for x in p)
    both = f"[{entry([1, 0, 0, 1, 1, 0])},{entry([1, 0, 0, 1, 0, 2])}]"
    r = one(spark, a=geometry.affine_of_json(F.lit(f"[{entry([1, 0, 0, 1, 2, 3])}]")), b=geometry.affine_of_json(F.lit(both)))
    assert tuple(r.a.b) == (2, 3) and tuple(r.b.b) == (1, 2)
    for bad in ('[{"Transform":["Euler"]}]', f"[{entry([1, 0])}]", f"[{entry(['x', 0, 0, 1, 0, 0])}]"):
        with pytest.raises(Exception, match="expected AffineTransform|bad TransformParameters"):
            one(spark, a=geometry.affine_of_json(F.lit(bad)))


def test_orientation_and_mask(spark):
    assert each(spark, [[1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, -1.0], [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], [1.0]], geometry.plane_from_orientation, "array<double>") == ["Axial", "Coronal", "Sagittal", None]
    g = F.struct(*[F.lit(v).alias(k) for k, v in {"zoom": 2.0, "rotation": 0.0, "pan_x": 0.0, "pan_y": 0.0, "affine00": 1.0, "affine01": 0.0, "affine10": 0.0, "affine11": 1.0}.items()])
    m = one(spark, m=geometry.screen_mask(*map(F.lit, (0.0, 0.0, 100.0, 50.0, 100.0, 100.0)), g)).m
    assert tuple(m) == (0.25, 0.25, 0.5, 0.25)


def lcg(seed, n):
    out = []
    for _ in range(n):
        seed = (1664525 * seed + 1013904223) % 2**32
        out.append(0.0 if (seed >> 8) / 2**24 < 0.5 else 1.0)
    return out


def information(spark, a, b, bins=32, **more):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(images.mutual_information(F.col("a"), F.col("b"), bins, **more).alias("m")).first().m


def test_mutual_information(spark):
    pattern = [float(i % 8 < 4) for i in range(4096)]
    same = information(spark, pattern, pattern)
    assert same.mi > 0.1 and 1.8 < same.nmi < 2.2 and same.pixels_used == 4096
    a, b = lcg(123, 2048), lcg(999, 2048)
    far = information(spark, a, b)
    assert far.mi < same.mi and 0.8 < far.nmi < 1.3
    assert abs(far.mi - information(spark, b, a).mi) < 1e-6
    for x, y in (([], []), ([1.0], [1.0, 2.0]), ([1.0] * 9, [2.0] * 9)):
        assert tuple(information(spark, x, y)) == (0, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        information(spark, a, b, 3)
    odd = information(spark, [0.0, 1.0, math.nan, math.inf], [0.0, 1.0, 0.5, 0.2], 4)
    assert odd.pixels_used == 4
    mask = F.struct(*[F.lit(v).alias(k) for k, v in {"x": 0.0, "y": 0.0, "width": 0.5, "height": 1.0}.items()])
    assert information(spark, [float(i) for i in range(16)], [float(i) for i in range(16)], 4, mask=mask, size=F.lit(4)).pixels_used == 8


def test_statistics_and_mapping(spark):
    r = one(spark, s=images.statistics(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))), d=images.displayed(F.array(F.lit(0.5), F.lit(2.0)), F.lit(100.0), F.lit(100.0)), g=images.grey(F.array(*map(F.lit, [10, 10, 10, 255, 20, 20, 20, 255]))), c=images.grey(F.array(*map(F.lit, [255, 0, 0, 255]))))
    assert (r.s.p10, r.s.p50, r.s.p90, r.s.mean) == (1, 3, 4, 2.5) and abs(r.s.stddev - math.sqrt(1.25)) < 1e-12
    assert r.d == [0.5, 1.0] and abs(r.g[1] - 20 / 255) < 1e-7 and abs(r.c[0] - 0.299) < 1e-6
    stats = lambda mean, dev: F.struct(F.lit(mean).alias("mean"), F.lit(dev).alias("stddev"))
    m = one(spark, same=images.intensity_match(stats(0.5, 0.2), stats(0.5, 0.2)), flat=images.intensity_match(stats(0.5, 0.2), stats(0.5, 0.0)))
    assert tuple(m.same) == (100, 100) and tuple(m.flat) == (100, 100)


def test_warp():
    ramp = [x / 15 for _ in range(16) for x in range(16)]
    assert images.warped(ramp, 16, (1, 0, 0, 1), (0, 0)).tolist() == pytest.approx(ramp)
    moved = images.warped(ramp, 16, (1, 0, 0, 1), (2, -1)).reshape(16, 16)
    assert moved[0, 0] == 0 and moved[3, 2] == 0 and moved[3, 5] == pytest.approx(3 / 15) and moved[15].sum() == 0
    for bad in (((1, 2, 2, 4), 16), ((1, 0, 0, 1), 15)):
        with pytest.raises(ValueError):
            images.warped(ramp, bad[1], bad[0], (0, 0))
