import zlib

import pytest
from pyspark.sql import functions as F

from verity.llm import sharding

from .helpers import EDGE_ROWS, SF, frame, with_clashes


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 9, 1000])
def test_same_as_the_published_walk(spark, shards):
    keys = spark.range(400).select(F.when(F.col("id") < 200, F.col("id") - 100).otherwise(F.xxhash64("id")).alias("k"))
    for r in keys.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect():
        assert r.s == jump(r.k, shards)


def check(rows, docs, shards=8):
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows), key=str) == sorted((
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(d or 0, shards), jump(d or 0, shards + 1))
        for d, t in docs), key=str)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_edges(spark):
    check(sharding.shard_documents(with_clashes(frame(spark, EDGE_ROWS))).collect(), EDGE_ROWS)


def test_test_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard_documents(df).collect()
    check(rows, [(r.doc_id, r.text) for r in df.collect()])
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 8 for r in moved) and 0 < len(moved) < len(rows) / 4


def test_empty_table(spark):
    assert sharding.shard_documents(frame(spark, [])).collect() == []


def test_written_shards(spark, tmp_path):
    df = frame(spark, [(i, str(i)) for i in range(100)])
    sharding.write_shards(df, F.col("doc_id"), 4, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 100 and all(r.shard == jump(r.doc_id, 4) for r in got)


def test_no_python_in_the_plan(spark):
    plan = sharding.shard_documents(frame(spark, EDGE_ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "BatchEvalPython" not in plan and "MapIn" not in plan
