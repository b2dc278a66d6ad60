import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import periodic as P
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """(start, length, period) of all runs, period by period."""
    n, seen = len(words), {}
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[0], (ids[: n - q] == ids[q:]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(same)).tolist()
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            if e - s + q >= max(24, 3 * q):
                seen.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def brute(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_periodic_on_documents(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op12_periodic"](spark, data)) == sorted((brute(*d) for d in docs), key=repr)


def stretches(rng):
    words, k = [], rng.choice([1, 2, 3, 50])
    for _ in range(rng.randint(0, 8)):
        unit = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 12))]
        words += unit * rng.randint(1, 25) if rng.random() < 0.6 else [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 40))]
    return words


@pytest.mark.parametrize("many", [P.MANY, 0, 2])
def test_periodic_runs_of_random_words(monkeypatch, many):
    """Few and many candidates a block: by following them, by whole Z-functions, and by both."""
    monkeypatch.setattr(P, "MANY", many)
    monkeypatch.setattr(P, "CELLS", 500)
    rng = random.Random(many)
    for _ in range(60):
        docs = [stretches(rng) for _ in range(rng.randint(0, 5))]
        ranges = np.cumsum([0, *map(len, docs)])
        ids = np.unique([x for d in docs for x in d], return_inverse=True)[1] if ranges[-1] else np.zeros(0, dtype=np.int64)
        want = [(int(ranges[i]) + s, int(ranges[i]) + s + n, q) for i, d in enumerate(docs) for s, n, q in brute_runs(d)]
        assert [tuple(r) for r in P.runs_of(ids, ranges).tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_periodic_defined_cases(spark):
    long = "x " * 40_000 + " ".join(f"y{i}" for i in range(5000)) + " é z" * 50
    docs = [(1, None), (2, ""), (3, "a b"), (None, "na " * 30), (None, "na " * 30), (5, "\tthe\ncat " * 12), (5, "a b c " * 7), (6, "a b c " * 8), (7, long), (8, " ".join(f"w{i}" for i in range(24)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'q' AS runs", "2 AS p", "3 AS g")
    assert rows(P.runs(df).select(*P.DIGEST)) == sorted((brute(*d, plant=False) if d[0] != 7 else long_row(long) for d in docs), key=repr)
    assert rows(P.runs(P.planted(df)).select(*P.DIGEST))[0][0] is not None and P.runs(df.limit(0)).count() == 0
    whole = {r.doc_id: r for r in P.runs(df.filter("doc_id = 6")).collect()}[6]
    assert [tuple(x) for x in whole.runs] == [(0, 24, 3)] and whole.collapsed == "a b c"


def long_row(text):
    words = WORD.findall(text)
    runs = [(0, 40_000, 1), (45_000, 50, 1)]
    gone = {*range(1, 40_000), *range(45_001, 45_050)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (7, 2, 0, 40_000, 1, 40_000_000, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
