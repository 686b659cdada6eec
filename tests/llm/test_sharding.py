import zlib

from loomlog.llm import sharding
from tests.llm.helpers import AWKWARD, documents


def test_report(spark):
    got = sharding.shard_report(documents(spark)).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in AWKWARD)
    for shard in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [r.doc_id or -1 for r in own] == sorted(r.doc_id or -1 for r in own)
    assert {r.law for r in got} == {"key"} and all(0 <= r.shard < 24 for r in got)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "'x' text")
    got = sharding.shard_report(docs).collect()
    grown = {r.doc_id: r.shard for r in sharding.shard_report(docs, 25).collect()}
    assert all(r.grown_shard == grown[r.doc_id] for r in got)
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert 100 < sum(r.grown_shard == 24 for r in got) < 320


def test_weights(spark):
    got = sharding.assign_shards(spark.range(8000).toDF("doc_id"), [1, 3, 0]).groupBy("shard").count().collect()
    counts = {r["shard"]: r["count"] for r in got}
    assert set(counts) == {0, 1} and 0.2 < counts[0] / 8000 < 0.3


def test_write_and_empty(spark, tmp_path):
    sharding.write_shards(spark.range(100).selectExpr("id doc_id", "'t' text"), str(tmp_path / "s"), [1, 1, 1])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
    assert sharding.shard_report(documents(spark, [])).count() == 0
