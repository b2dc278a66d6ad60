import math
import random

import pytest

from tessera.operators import pixels as P


@pytest.mark.parametrize("bins,ranges", [(P.BINS, P.RANGES), (2, P.RANGES), (5, 0)])
def test_percentiles_without_a_sort(spark, monkeypatch, bins, ranges):
    """Many equal pixels, neighbouring floats, huge and tiny ones, one pixel; with two bins, and with ranges joined by shuffle."""
    monkeypatch.setattr(P, "BINS", bins)
    monkeypatch.setattr(P, "RANGES", ranges)
    rng = random.Random(bins)
    images = {"equal": [3.0] * 500, "two": [1.0, math.nextafter(1.0, 2)] * 50, "wide": [rng.choice([-1.7e308, 1e-300, 0.0, 5.0, 1.7e308]) for _ in range(99)], "one": [-7.5], "many": [rng.gauss(0, 1) for _ in range(3000)], "none": []}
    rows = [(k, v) for k, vs in images.items() for v in vs] + [("many", float("nan")), ("many", float("inf")), ("many", None), ("none", None)]
    got = {r.image: r for r in P.statistics(spark.createDataFrame(rows, "image string, value double").repartition(5)).collect()}
    assert set(got) == set(images) - {"none"}
    for k, vs in images.items():
        if vs:
            v = sorted(vs)
            assert [got[k][s] for s in P.SHARES] == [v[int(len(v) * x)] for x in P.SHARES.values()]
            assert (got[k].min, got[k].max) == (v[0], v[-1]) and (k == "wide" or got[k].mean == pytest.approx(sum(v) / len(v)))
