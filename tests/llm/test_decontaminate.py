import hashlib
import random
import re

import numpy as np

from tessera.llm import decontaminate as D

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        length = min(10, len(w))
        for i in range(len(w) - length + 1 if length and name is not None else 0):
            windows.setdefault(tuple(w[i : i + length]), set()).add(str(name))
    sizes, out = {len(k) for k in windows}, []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[k]
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, block=2_000_000):
    kept, D.BLOCK_BYTES = D.BLOCK_BYTES, block
    try:
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "'x' AS items")
        b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS spans")
        return sorted((tuple(r)[:6] for r in D.contamination(d, b).collect()), key=repr)
    finally:
        D.BLOCK_BYTES = kept


def test_brute_force_and_blocks(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    items += [(9001, "tHe of"), (9002, "zzzz"), (9003, ""), (9004, None), (None, "the"), (9001, "and the"), (16, items[16][1])]
    docs += [(-1, None), (-2, ""), (-3, "... !"), (None, items[0][1]), (-4, items[1][1].upper() + " x " + items[1][1]), (-4, items[1][1]), (-5, " ".join(["word"] * 200_000) + " " + items[2][1])]
    expected = brute(docs, items)
    assert run(spark, docs, items) == expected
    assert run(spark, docs, items, 3000) == expected


def test_suffix_array_and_its_bounds():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 300)
    array = D.suffix_array(text, 300)
    assert array.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())
    padded, test = np.concatenate([text, np.zeros(10, dtype=int)]), np.concatenate([text[40:60], np.zeros(10, dtype=int)])
    low, high = D.bounds(array, padded, test, np.arange(12), np.full(12, 8))
    for o, a, b in zip(range(12), low, high, strict=True):
        assert sorted(array[a:b].tolist()) == [i for i in range(300) if padded[i : i + 8].tolist() == test[o : o + 8].tolist()]


def test_one_pass_over_the_texts(spark, data, monkeypatch):
    """Blocks of the benchmark cost passes over passages; repeated items share no block's bound."""
    written, kept = [], D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, what, *more: written.append((what, "text" in df.columns)) or kept(df, what, *more))
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    items = [(i, "one and the same long item text " + docs[3][1]) for i in range(40)] * 2
    assert run(spark, docs, items, 10_000) == brute(docs, items)
    assert not any(text for what, text in written if what != "benchmark-items")


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_longest_match_and_removal(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x y " + " ".join(item.split()[5:25]) + " z"), (2, "nothing of it"), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    assert got[1].spans == [2, 22]
    assert (got[1].longest, got[1].longest_at, got[1].longest_item, got[1].n_hit) == (20, 2, "7", 20)
    assert sorted(r.doc_id or -1 for r in D.remove_contaminated(docs, bench).collect()) == [2]


def brute_longest(text, items):
    """(-words, place, item) of the longest run of words that a text and an item with a window in it share."""
    w, best = words(text), None
    for name, item in items:
        x = words(item)
        for shift in range(-len(x), len(w)):
            run = 0
            for p in range(max(0, shift), min(len(w), shift + len(x)) + 1):
                if p < min(len(w), shift + len(x)) and w[p] == x[p - shift]:
                    run += 1
                    continue
                if run >= min(10, len(x)):
                    best = min(best or (0, 0, ""), (-run, p - run, str(name)))
                run = 0
    return (-best[0], *best[1:]) if best else (0, None, None)


def test_many_items_share_a_passage(spark):
    """A prefix that all items share, and documents that hold it, cut, continued and repeated; the longest match is that of all pairs."""
    rng = random.Random(8)
    prefix = [f"p{k}" for k in range(30)]
    items = [(1000 + k, " ".join(prefix + [f"q{rng.randrange(4)}" for _ in range(k % 9)] + ["tail"] * (k % 3))) for k in range(40)] + [(7, "q1 q2"), (8, "p3 p4 p5")]
    docs = [(k, " ".join([f"a{k}"] * (k % 3) + prefix[k % 25 :] + items[rng.randrange(40)][1].split()[30 - k % 4 :] + prefix[: k % 13])) for k in range(60)]
    assert run(spark, docs, items) == brute(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.longest, r.longest_at, r.longest_item) for r in D.contamination(d, b).collect()}
    assert got == {i: brute_longest(t, items) for i, t in docs}


def test_memory_of_shared_items():
    """5,000 items with one prefix of 50 words against 10,000 documents in one batch: the worker's memory stays bounded."""
    import tracemalloc

    import pyarrow as pa

    prefix = " ".join(f"p{k}" for k in range(50))
    index = D.build_index([(f"i{k:04d}", f"{prefix} q{k} r{k % 7}") for k in range(5000)])
    n = 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([[0]] * n, pa.list_(pa.int64())), pa.array([[f"{prefix} q{k % 5000}"] for k in range(n)], pa.list_(pa.string()))], names=["row", "at", "passages"])
    held = type("Held", (), {"value": index})
    tracemalloc.start()
    found = [(x["row"], x["n_items"], x["longest"], x["longest_item"]) for out in D.searcher(held, True)(iter([batch])) for x in out.select(["row", "n_items", "longest", "longest_item"]).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [(k, 5000, 51, f"i{k % 5000:04d}") for k in range(n)] and peak < 500e6
