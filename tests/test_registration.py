import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import images
from tessera.functions import registration as R
from tessera.operators import alignment
from tessera.plans import alignments

CONTRASTS = {"same": lambda v: v, "scaled": lambda v: 0.4 * v + 0.3, "inverted": lambda v: 1 - v, "gamma": lambda v: np.abs(v) ** 2.2, "folded": lambda v: np.abs(v - 0.4)}
MAPS = [(0, 1.0, 0.0, (0.0, 0.0)), (8, 1.06, 0.04, (2.5, -1.5)), (-11, 0.93, -0.03, (-3.0, 2.0))]


def picture(size, a=np.eye(2), t=(0.0, 0.0), seed=3):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size] - (size - 1) / 2
    u, v = ((a[k][0] * x + a[k][1] * y + t[k]) / size for k in (0, 1))
    out = sum(rng.normal() * np.cos(2 * np.pi * (p * u + q * v) + rng.uniform(0, 6)) for p, q in rng.uniform(-2.2, 2.2, (16, 2)))
    return (out + 8) / 16


def pair(size, angle, zoom, shear, t):
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    a = zoom * np.array([[c, -s], [s, c]]) @ np.array([[1, shear], [0, 1]])
    back = np.linalg.inv(a)
    return a, np.array(t), picture(size), picture(size, back, -back @ np.array(t))


def corner_error(size, a, t, found, shift):
    h = (size - 1) / 2
    corners = np.array([[x, y] for x in (-h, h) for y in (-h, h)])
    return np.linalg.norm((corners @ found.T + shift) - (corners @ a.T + t), axis=1).mean()


@pytest.mark.parametrize("contrast", CONTRASTS)
def test_known_maps_are_found_under_every_contrast(contrast):
    for case in MAPS:
        a, t, fixed, moving = pair(32, *case)
        found, shift, value = R.registered(fixed, CONTRASTS[contrast](moving))
        assert corner_error(32, a, t, found, shift) < 0.5 and value > 0.3


#: Strengths and phases of waves, their map (angle, zoom, shift) and contrast: ascent from these once ended 0.57 pixels off, on a small peak.
STUCK = [
    ([0.071703, -0.206594, -0.051878, -0.031893, 0.032808, 0.016784, -0.005758, 0.014269, -0.251058, 0.114868, -0.04995, -0.056547, -0.071484, -0.021052, 0.035689, 0.007304], 3559, "gamma"),
]


@pytest.mark.parametrize("case", STUCK)
def test_small_peaks_are_left(case):
    vector, k, contrast = np.array(case[0]), case[1], case[2]
    size, angle, zoom = alignments.SIDE, np.radians(k % 17 - 8), 1 + (k % 7 - 3) * 0.03
    a, t = zoom * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]), np.array([k % 5 - 2, (k % 3 - 1) * 1.5])

    def drawn(a, t):
        y, x = np.mgrid[0:size, 0:size] - (size - 1) / 2
        u, v = ((a[i][0] * x + a[i][1] * y + t[i]) / size for i in (0, 1))
        strength = 0.5 + np.abs(vector[:8])
        waves = sum(s * np.cos(2 * np.pi * (p * u + q * v) + 20 * phase) for s, (p, q), phase in zip(strength, alignments.WAVES, vector[8:], strict=True))
        return 0.5 + waves / (2 * strength.sum())

    back = np.linalg.inv(a)
    found, shift, _ = R.registered(drawn(np.eye(2), np.zeros(2)), CONTRASTS[contrast](drawn(back, -back @ t)))
    assert corner_error(size, a, t, found, shift) < alignments.NEAR


def test_the_gradient_is_that_of_the_mutual_information():
    _, _, fixed, moving = pair(24, *MAPS[1])
    target = R.Pair(R.blurred(fixed, 2), R.blurred(moving, 2))
    m = np.array([0.3, -0.2, 0.1, 0.4, 0.35, -0.6])
    _, slope = target.at(m)
    for k in range(6):
        step = np.eye(6)[k] * 1e-5
        assert (target.at(m + step)[0] - target.at(m - step)[0]) / 2e-5 == pytest.approx(slope[k], abs=2e-3)


def test_registration_of_columns(spark):
    """The map as images.warp takes it brings moving onto fixed; a map to start from is refined; unusable pairs are told."""
    a, t, fixed, moving = pair(32, *MAPS[2])
    flat = [1.0] * 16
    rows = [(0, fixed.ravel().tolist(), moving.ravel().tolist()), (1, fixed.ravel().tolist(), flat), (2, flat, flat), (3, None, flat), (4, fixed.ravel().tolist(), [float("nan")] * 1024), (5, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "k int, f array<float>, m array<float>").withColumn("r", R.registration("f", "m"))
    got = {r.k: r.r for r in df.collect()}
    assert got[0].registered and [got[k].registered for k in (1, 2, 3, 4, 5)] == [False, False, None, False, False]
    assert [got[1][k] for k in R.MAP] == [1, 0, 0, 1, 0, 0] and got[3].m00 is None
    one = df.filter("k = 0").withColumn("again", R.registration("f", "m", "r"))
    warped = images.warp("m", F.lit(32), *[F.col(f"again.{k}") for k in R.MAP])
    shown = np.array(one.select(warped.alias("w")).first()["w"]).reshape(32, 32)
    assert np.abs(shown - fixed)[6:-6, 6:-6].mean() < 0.02


def slices_of(spark, size, contrasts):
    """Dates whose slice 3 is the reference under a map and a contrast; the others are other pictures."""
    rows = []
    for (date, contrast), case in zip(contrasts.items(), MAPS[1:], strict=False):
        _, _, _, moving = pair(size, *case)
        for position in range(7):
            rows.append((date, position, CONTRASTS[contrast](moving if position == 3 else picture(size, seed=position + 50)).ravel().tolist()))
    return spark.createDataFrame(rows, "date_iso string, position int, pixels array<float>")


def reference_of(spark, size, **more):
    values = {"zoom": 1.0, "rotation": 0.0, "pan_x": 0.0, "pan_y": 0.0, "affine00": 1.0, "affine01": 0.0, "affine10": 0.0, "affine11": 1.0} | more
    row = spark.createDataFrame([(picture(size).ravel().tolist(), 3, 7, 0.5, 100.0, 100.0)], "pixels array<float>, index int, count int, progress double, brightness double, contrast double")
    return row.withColumn("geometry", F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))


def test_align_all_dates_of_other_contrasts(spark):
    size = 24
    slices = slices_of(spark, size, {"d1": "inverted", "d2": "gamma"})
    got = {r.date_iso: r for r in alignment.aligned_dates(reference_of(spark, size), slices, 16).collect()}
    assert set(got) == {"d1", "d2"}
    for date, (angle, zoom, _, t) in zip(("d1", "d2"), MAPS[1:], strict=True):
        r = got[date]
        assert r.best_slice_index == 3 and r.offset == 0 and r.registered and r.nmi_score > 1.2
        assert r.rotation == pytest.approx(-angle, abs=1.5) and r.zoom == pytest.approx(1 / zoom, abs=0.04) and r.pan_x * t[0] < 0
    # The contrast that the gamma date needs is that of its registered slice.
    assert got["d2"].brightness != 100 or got["d2"].contrast != 100
    turned = {r.date_iso: r for r in alignment.aligned_dates(reference_of(spark, size, rotation=20.0), slices, 16).collect()}
    assert turned["d1"].rotation == pytest.approx(got["d1"].rotation + 20, abs=0.5)
    assert alignment.aligned_dates(reference_of(spark, size), slices.limit(0), 16).count() == 0


def test_one_date_is_scored_by_many_tasks(spark, monkeypatch):
    """Slices that come without pixels get them after they are dealt; dates that are not broadcast are joined by shuffle, with the same result."""
    size = 24
    slices = slices_of(spark, size, {"d1": "inverted"}).withColumnRenamed("pixels", "stored")
    given = []

    def pixels(rows):
        given.append(rows)
        return rows.withColumn("pixels", F.col("stored"))

    got = alignment.aligned_dates(reference_of(spark, size), slices, 16, pixels=pixels).collect()
    seeds, near, best = given
    assert [x.count() for x in (seeds, near, best)] == [1, 7, 1]
    assert near.select(F.spark_partition_id()).distinct().count() > 1
    monkeypatch.setattr(alignment, "BROADCAST_DATES", 0)
    assert alignment.aligned_dates(reference_of(spark, size), slices, 16, pixels=pixels).collect() == got
    assert len(got) == 1 and got[0].best_slice_index == 3 and got[0].registered


def test_numbers_of_vectors_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignments, "CHUNK", 3)
    ids = {7: [0, 2, 3, 11, 12, 13, 40], 8: [1, 5], 9: [-4, -1]}
    rows = spark.createDataFrame([(k, i) for k, own in ids.items() for i in own], "label int, vec_id long")
    got = {(r.label, r.vec_id): (r.position, r.n) for r in alignments.numbered(rows).collect()}
    assert got == {(k, i): (place, len(own)) for k, own in ids.items() for place, i in enumerate(own)}


def test_runs_of_equal_values(spark):
    rows = spark.createDataFrame([(0, [3, 1, 3, None, 2, 1, 3]), (1, []), (2, [None]), (3, None), (4, [7])], "k int, v array<int>")
    assert {r.k: r.n for r in rows.select("k", images.run_counts(F.col("v")).alias("n")).collect()} == {0: [2, 1, 3], 1: [], 2: [], 3: None, 4: [1]}


def test_average_score_of_nothing(spark):
    assert np.isnan(alignment.average_score(spark.createDataFrame([], "best_score double")).first().average)


#: A vector of 0.5 GB and its first entries, whose images were registered 0.55 pixels off: wide bins had shifted the peak.
SHIFTED = (15292, [0.0175639, -0.1765273, -0.0575838, 0.0882768, 0.1473494, 0.010655, 0.0876661, 0.075005, 0.030438, 0.1341128, 0.1030542, -0.1235343, -0.0643513, -0.0318133, -0.0306378, -0.2314539])


def test_wide_bins_do_not_shift_the_peak(spark, tmp_path):
    spark.createDataFrame([SHIFTED], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in alignments.registered_contrasts(spark, str(tmp_path)).collect()] == [(SHIFTED[0], "same", True, True)]


def test_vectors_without_an_image_are_not_registered(spark, tmp_path):
    vector = SHIFTED[1]
    rows = [(0, None), (1, vector[:10]), (2, [None, *vector[1:]]), (3, []), (-5, vector), (None, vector), (7, [float("nan")] * 16), (8, vector)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.vec_id: r.registered for r in alignments.registered_contrasts(spark, str(tmp_path)).collect()} == {k: k == 8 for k, _ in rows}


def test_pairs_are_climbed_together(monkeypatch):
    """Each as if alone, whatever lies between them."""
    sides, cases = (24, 16, 24, 24, 16, 24), [*MAPS, *MAPS]
    pairs = [tuple(v.ravel() for v in pair(side, *case)[2:]) + (None,) for side, case in zip(sides, cases, strict=True)]
    pairs[3:3] = [(None, pairs[0][1], None), (pairs[0][0], np.ones(576), None), (*pairs[2][:2], np.array([1, 0, 0, 1, 0.5, 0.5]))]
    evaluated, at = [], R.Pairs.at
    monkeypatch.setattr(R.Pairs, "at", lambda self, maps, which, **more: evaluated.append(len(which)) or at(self, maps, which, **more))
    monkeypatch.setattr(R, "HELD", 3 * 24 * 24)
    together = R.rows(pairs)
    assert max(evaluated) == 3
    for k, p in enumerate(pairs):
        assert R.rows([p]).astype(float).iloc[0].tolist() == pytest.approx(together.astype(float).iloc[k].tolist(), abs=1e-9, nan_ok=True)
    assert together["registered"].tolist() == [True, True, True, None, False, True, True, True, True]
