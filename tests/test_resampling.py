import numpy as np
import pytest

from tessera.functions import resampling as R


def test_weights_keep_flat_images_and_areas():
    for source in (1, 3, 8, 17):
        for target in (1, 2, 5, 8, 40):
            w = R.weights(source, target)
            assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
            if target < source:
                assert np.allclose(w.sum(axis=0) * source / target, 1)  # every old pixel counts alike
    assert np.array_equal(R.weights(6, 6), np.eye(6))


def test_images_are_whole_in_proportion_and_in_the_middle(spark):
    wide = np.arange(32, dtype=float).reshape(4, 8)
    rows = [(0, wide.ravel().tolist(), 8, 4, 4), (1, wide.T.ravel().tolist(), 4, 8, 4), (2, None, 4, 8, 4), (3, [1.0], 4, 8, 4), (4, [2.0], 1, 1, 3), (5, wide.ravel().tolist(), 8, 4, 16)]
    df = spark.createDataFrame(rows, "k int, p array<double>, w int, h int, s int")
    got = {r.k: None if r.g is None else np.array(r.g).reshape(r.s, r.s) for r in df.select("k", "s", R.on_grid("p", "w", "h", "s").alias("g")).collect()}
    halved = wide.reshape(2, 2, 4, 2).mean(axis=(1, 3))
    assert np.allclose(got[0][1:3], halved) and not got[0][[0, 3]].any() and np.allclose(got[1][:, 1:3], halved.T)
    assert got[2] is None and got[3] is None and (got[4] == 2).all()
    assert got[5].shape == (16, 16) and not got[5][:4].any() and got[5][4, 0] == 0 and got[5][11, 15] == 31
    with pytest.raises(Exception, match="pixels"):
        df.filter("k = 0").select(R.on_grid("p", "w", "h", df["s"] - 4)).collect()
