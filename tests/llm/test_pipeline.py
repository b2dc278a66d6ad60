import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import brute as contaminated  # noqa: E402
from test_dedup import brute as deduplicated  # noqa: E402


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12 34 !!", "en", "src1", 8), (10_002, None, None, None, None), (10_003, "the and of that is with from", "en", "src1", 28)], docs.schema)
    docs = docs.unionByName(extra)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, data)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and ids == {r.doc_id for r in docs.collect()} - {10_001, 10_002}
    kept = kept.cache()
    one = stages["near_duplicates"](spark, kept, data)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, x in deduplicated([(r.doc_id, r.text) for r in kept.collect()]).items() if x[2]}
    one = one.cache()
    clean = stages["benchmark_passages"](spark, one, data)
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {x[0] for x in contaminated([(r.doc_id, r.text) for r in one.collect()], items) if not x[5]}
    mixed = stages["mixture"](spark, clean, data).cache()
    assert mixed.columns == columns and max(collections.Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    out = stages["shards"](spark, mixed, data)
    assert out.count() == mixed.count() and out.select("shard", "slot").distinct().count() == mixed.count()


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_shards_keep_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["shards"](spark, docs, data)
    assert sorted(map(repr, out.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_reads_are_bounded(spark, data):
    from tessera.llm import common

    own = {s: spark.conf.get(s, None) for s in (common.READ_SETTING, common.BATCH_SETTING)}
    try:
        for s in own:
            spark.conf.unset(s)
        docs = spark.read.parquet(f"{data}/documents.parquet")
        common.discard(common.materialize(docs.select("doc_id"), "bounded"))
        assert int(spark.conf.get(common.READ_SETTING)) == common.READ_ROWS <= 512
        spark.conf.set(common.READ_SETTING, 1000)
        kept = common.in_arrow(docs.select("doc_id"), lambda batches: batches, "doc_id long")
        assert kept.count() == docs.count() and int(spark.conf.get(common.READ_SETTING)) == 1000
        assert int(spark.conf.get(common.BATCH_SETTING)) == common.BATCH_BYTES
    finally:
        for s, v in own.items():
            if v is None:
                spark.conf.unset(s)
            else:
                spark.conf.set(s, v)
