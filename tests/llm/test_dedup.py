import random
import re

import numpy as np

from tessera.llm import embed_dedup as E
from tessera.llm import minhash as M
from tessera.llm.common import connected_components

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(ids, linked)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rep", "'x' AS bands", "2 AS kept")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect()}


def test_minhash_on_documents(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_001, None), (10_002, ""), (10_003, "a b"), (10_004, "A  B"), (10_005, "a b c"), (10_006, "word " * 30_000), (10_007, "word " * 6)]
    assert found(spark, docs) == brute(docs)


def test_minhash_families_without_a_centre(spark, monkeypatch):
    """Copies that differ more from each other than from the text they came from, in blocks smaller than their group."""
    rng, docs = random.Random(3), []
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((i * 7 % 120, " ".join(w)))
    want = brute(docs)
    for limits in ({"BLOCK": 20}, {"BLOCK_SHINGLES": 2000}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(M, name, value)
            assert found(spark, docs) == want


def test_minhash_portions_are_whole_blocks():
    rows = [(band, 0, 0, "x" * n) for band, sizes in enumerate(((5, 0, 3), (9,), (1, 1), (30, 2), (0,), (4,))) for n in sizes]
    table = M.pa.table({c: [r[k] for r in rows] for k, c in enumerate(("band", "one", "two", "text"))})
    before, M.PORTION = M.PORTION, 17
    try:
        assert [sorted(set(p["band"].to_pylist())) for p in M.portions(table)] == [[0, 1], [2], [3], [4, 5]]
        assert sum(p.num_rows for p in M.portions(table)) == len(rows)
    finally:
        M.PORTION = before


def test_minhash_defined_cases(spark):
    got = found(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")])
    assert got == {5: (2, 5, True), None: (2, 5, False), 9: (2, 5, False)}
    assert found(spark, []) == {}


def test_minhash_of_shared_ids(spark):
    """Rows that share a doc_id but not a text are rows of their own: as many rows come out as went in."""
    a, b, c = "a b c d e f", "x y z w v u", "only one of its kind here"
    rows = [(5, a), (5, b), (9, a), (None, b), (None, c), (None, c), (7, ""), (7, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS t1", "4 AS comp")
    got = sorted((tuple(r) for r in M.near_duplicates(df).collect()), key=repr)
    want = [(5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (None, 2, 5, False), (None, 2, None, True), (None, 2, None, True), (7, 0, 7, True), (7, 0, 7, True), (8, 0, 8, True)]
    assert got == sorted(want, key=repr)
    left = M.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((tuple(r)[:2] for r in left.collect()), key=repr) == sorted([(5, a), (5, b), (None, c), (7, ""), (7, ""), (8, None)], key=repr)


def test_components_of_a_path(spark):
    n = 60
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(200, 201), (201, 201)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[200] == got[201] == 200


def near(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS n", "'x' AS h1", "2 AS label")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}


def test_embedding_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.900 to 0.905, in as many vectors as make the groups have lines with cells."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((1500, 32))
    side -= (side * x[:1500]).sum(axis=1, keepdims=True) * x[:1500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9001, 0.905, (1500, 1))
    v = np.concatenate([x, cosine * x[:1500] + np.sqrt(1 - cosine**2) * side])
    assert E.groups_for(len(v))[0] >= 1 and (v[:1500] * v[4000:]).sum(axis=1).max() < 0.906
    linked = (v @ v.T >= 0.9).sum(axis=1) - 1
    got = near(spark, [(i, r.tolist()) for i, r in enumerate(v)], "double")
    n = np.array([got[i][0] for i in range(len(v))])
    assert (n <= linked).all() and n.sum() >= 0.93 * linked.sum() >= 2500


def test_embeddings_of_shared_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.99, 0.05, 0.0]), (2, [0.99, 0.05, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in E.near_duplicates(df).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]


def test_embedding_hot_group_and_defined_cases(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.01 * rng.standard_normal(16)).tolist()) for i in range(60)]
    rows += [(100 + i, centre.tolist()) for i in range(5)] + [(200 + i, rng.standard_normal(16).tolist()) for i in range(20)]
    kept, E.BLOCK = E.BLOCK, 16
    try:
        got = near(spark, rows, "double")
    finally:
        E.BLOCK = kept
    assert all(got[i] == (64, 0, i == 0) for i in [*range(60), *range(100, 105)])
    odd = [(-1, None), (-2, []), (-3, [0.0, 0.0]), (-4, [float("nan"), 1.0]), (-5, [1.0, None]), (None, [1.0, 1.0]), (-6, [1.0, 1.0]), (-7, [2.0, 2.0]), (-8, [1.0, 1.0, 0.0]), (-9, [float("inf"), 1.0])]
    got = near(spark, odd, "double")
    assert got[-6] == (1, -7, False) and got[-7] == (1, -7, True) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (-1, -2, -3, -4, -5, -8, -9))
    assert near(spark, []) == {}
