import hashlib
import random
import re

import pytest

from tessera.llm import substrings as S
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def brute(docs):
    """(doc_id, n_words, n_removed, kept_sha256) of every row, by a table of all windows."""
    split = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in docs]
    lowest = {}
    for i, w in split:
        for p in range(len(w) - S.LENGTH + 1):
            key = tuple(w[p : p + S.LENGTH])
            lowest[key] = min(i, lowest.get(key, LAST))
    out = []
    for (doc_id, _), (i, w) in zip(docs, split, strict=True):
        gone = {k for p in range(len(w) - S.LENGTH + 1) if lowest[tuple(w[p : p + S.LENGTH])] < i for k in range(p, p + S.LENGTH)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS t1", "'x' AS doc", "2 AS anchor", "3 AS found").repartition(parts)
    return sorted((tuple(r) for r in S.without_repeats(df, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_substrings_on_documents(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_substrings"](spark, data).collect()), key=repr)
    assert got == brute(docs) and any(r[2] for r in got)


def corpus(rng):
    """Passages around the threshold, of few and many words, whole and changed, at edges, side by side, in few and many documents."""
    fresh = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    shared = [fresh(rng.choice([49, 50, 51, 60, 90, 130]), rng.choice([2, 30, 10**6])) for _ in range(5)]
    docs = []
    for _ in range(60):
        words = fresh(rng.choice([0, 1, 20]), 10**6)
        for _ in range(rng.randint(0, 4)):
            own = list(rng.choice(shared))
            if rng.random() < 0.5:
                a = rng.randrange(len(own))
                own = own[a : a + rng.randint(40, 80)]
            if own and rng.random() < 0.5:
                own[rng.randrange(len(own))] = f"x{rng.randrange(3)}"
            words += own + (fresh(rng.randint(0, 3), 3) if rng.random() < 0.8 else [])
        docs.append((rng.choice([None, *range(40)]), rng.choice([" ", "\n", " \t "]).join(words)))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_random_passages(spark, seed):
    docs = corpus(random.Random(seed))
    assert found(spark, docs) == brute(docs)


def test_substrings_without_broadcasts(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = corpus(random.Random(9))
        assert found(spark, docs) == brute(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_substrings_hot_passage(spark):
    """One passage in all documents between words of their own: a star about its smallest document, and no pairs."""
    rng = random.Random(4)
    passage = [f"p{rng.randrange(500)}" for _ in range(120)]
    docs = [(i, " ".join([f"a{rng.randrange(6)}" for _ in range(50)] + passage + [f"b{rng.randrange(6)}" for _ in range(50)])) for i in range(400)]
    got = found(spark, docs)
    assert got == brute(docs) and sum(r[2] >= 120 for r in got) == 399


def test_substrings_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None), (2, ""), (3, long), (3, long), (3, long + " tail"), (None, long), (None, long), (7, " ".join(f"w{i}" for i in range(49))), (8, "é " * 70), (9, "\né\t" * 30_000), (-1, "W0 " + long[3:]), (10, "W0 " + long[3:])]
    assert found(spark, docs) == brute(docs) and found(spark, []) == []
    df = spark.createDataFrame([(1, long), (2, "before " + long + " after")], "doc_id long, text string")
    second = {r.doc_id: r for r in S.without_repeats(df).collect()}[2]
    assert second.kept == "before after" and list(second.spans) == [1, 61]
