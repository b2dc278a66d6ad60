import numpy as np
import pytest

from tessera.llm import whitening as W

NAMES = "vec_id long, embedding array<float>"


def brute(rows, wanted=W.COMPONENTS):
    """vec_id and x of the usable rows; n, deviations, leading eigenvalues and vectors by the whole covariance."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for _, v in usable)
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (d - len(v)) for _, v in usable], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(v)
    return [i for i, _ in usable], x, n, ((n * x - s) ** 2).sum(axis=1), e[::-1][:wanted], u[:, ::-1][:, :wanted], np.trace(v), s


def compare(spark, rows):
    df = spark.createDataFrame(rows, NAMES).selectExpr("*", "1 AS x", "'a' AS n", "2 AS component")
    got = W.whiten(df).toPandas()
    ids, x, n, deviation, e, u, trace, s = brute(rows)
    k = int((e > 1e-12 * trace).sum())
    assert len(got) == len(ids) * k
    want = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    near = 1e-10 + 1e-13 * e[0] / e[k - 1]  # rounding of the largest component in the smallest
    for c in range(k):
        own = got[got.component == c + 1].sort_values(["vec_id", "deviation"])
        order = np.lexsort((deviation, ids))
        assert own.vec_id.tolist() == [ids[i] for i in order]
        assert own.deviation.tolist() == deviation[order].tolist() and set(own.n) == {n}
        apart = min(np.abs(own.whitened - sign * want[order, c]).max() for sign in (1, -1))
        assert apart < 10 * near and np.allclose(own.explained, e[c] / trace, rtol=near)
        assert own.identity_error.iloc[0] < near
    return got


def test_whitening_of_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(spark, [*rows, *[(i + 10**6, v) for i, v in rows[:40]]])


def test_whitening_with_restarts_and_breakdowns(spark, monkeypatch):
    """Blocks of two in a space of a few directions: they break down, and one component has many equal rivals."""
    monkeypatch.setattr(W, "BLOCK", 2)
    rng = np.random.default_rng(5)
    wide = rng.standard_normal((300, 3)) * [5, 3, 1] @ rng.standard_normal((3, 40))
    compare(spark, [(i, v.tolist()) for i, v in enumerate(wide)])
    decay = rng.standard_normal((400, 150)) * 0.97 ** np.arange(150) @ np.linalg.qr(rng.standard_normal((150, 150)))[0]
    compare(spark, [(i, v.tolist()) for i, v in enumerate(decay)])


def test_whitening_ends_before_the_whole_space():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    e = np.concatenate([[100, 81, 64, 50], 10 * 0.9 ** np.arange(396)])
    a, calls = (q * e) @ q.T, []
    values, vectors = W.lanczos(lambda b: calls.append(b.shape[1]) or a @ b, rng.standard_normal((400, 16)), 4, rng)
    assert sum(calls) < 300 and np.allclose(values, e[:4], rtol=1e-13)
    assert np.abs(np.abs(np.sum(vectors * q[:, :4], axis=0)) - 1).max() < 1e-12


def test_whitening_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, -0.0, 3.25]), (4, None), (5, [None, 1.0, 1.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [0.1]), (9, []), (2, [-1.5, 0.7, 9.0])]
    got = W.whiten(spark.createDataFrame(rows, NAMES)).toPandas()
    assert sorted(got.vec_id.fillna(-1).tolist()) == sorted([-1, 1, 1, 2, 8, 9] * 3) and set(got.n) == {5}
    assert got.identity_error.iloc[0] < 1e-10 and got.explained.groupby(got.component).first().sum() == pytest.approx(1)
    for few in ([], [(4, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert W.whiten(spark.createDataFrame(few, NAMES)).count() == 0


def test_whitening_deviations_are_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**40), 2**40, (50, 3))
    x[:25] >>= 22
    for n in (1, 3, 977, 10**6):
        sums = [int(v) for v in rng.integers(-(2**50), 2**50, 3)]
        exact = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]
        assert W.deviations(x, n, sums) == [v if v < 2**63 else None for v in exact]
    edge = 3037000499  # its square is the last below 2^63
    assert W.deviations(np.array([[edge], [edge + 1]]), 1, [0]) == [edge**2, None]
