import numpy as np

from tessera.llm import token_counts as T


def test_round_trip_in_blocks_of_any_size(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> a"), (None, "b c"), (-4, "long " * 50_000), (-3, "<|endoftext|> a")], docs.schema)).selectExpr("*", "1 AS file", "2 AS n_tokens")
    with open(T.TOKENIZER, "rb") as f:
        encode = T.encoding(f.read()).encode_ordinary
    expected = sorted(((r.doc_id, len(encode(r.text or ""))) for r in docs.collect()), key=repr)
    for block in (1 << 18, 97, 3000):
        assert sorted((tuple(r) for r in T.document_tokens(docs, block_tokens=block).collect()), key=repr) == expected
    assert T.document_tokens(docs.limit(0)).count() == 0


def test_raw_files(spark, tmp_path):
    """Files of any size, read in blocks that end anywhere; one has an odd last byte, one a space in its name, one is empty."""
    rng, expected = np.random.default_rng(3), {}
    for name, n, tail in (("a.bin", 300, 7), ("b c.bin", 40, 0), ("empty.bin", 0, 0)):
        lengths = rng.integers(0, 40, n)
        stream = np.concatenate([np.zeros(0, dtype=int), *[np.append(rng.integers(0, 1000, k), T.SEPARATOR) for k in lengths], np.arange(tail)]).astype("<u2")
        (tmp_path / name).write_bytes(stream.tobytes() + (b"x" if tail else b""))
        expected[name] = lengths.tolist() + [tail] * (tail > 0)
    for block in (1, 13, 1 << 18):
        rows = T.count_tokens(T.read_flat(spark, str(tmp_path), block_tokens=block if block > 1 else 50)).orderBy("file", "ordinal").collect()
        for name, told in expected.items():
            assert [r.n_tokens for r in rows if r.file.replace("%20", " ").endswith(name)] == told
