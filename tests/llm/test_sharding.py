import zlib

import pytest
from pyspark.sql import functions as F

from blockloom.llm import sharding as S

TEXTS = "doc_id long, text string, size string"


def shards(df, **kw):
    return S.shard_by_bytes(df, **kw).toPandas()


def check(out, n_shards):
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert out.shard.between(0, n_shards - 1).all()


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    out = S.op8_histogram_shards(spark, sf).toPandas()
    check(out, 16)
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    both = docs.merge(out, on="doc_id")
    assert (both.text.map(lambda t: len(t.encode()) + 1) == both["size"]).all()
    assert (both.text.map(lambda t: zlib.crc32(t.encode())) == both.text_crc32).all()
    sizes = out.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    assert (sizes - out["size"].sum() / 16).abs().max() <= out["size"].max()


def test_splitters_meet_tolerance_on_small_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    out = shards(df, n_shards=8, probes=8)
    check(out, 8)
    sizes = out.groupby("shard")["size"].sum()
    assert (sizes / sizes.mean() - 1).abs().max() < 0.01


@pytest.mark.parametrize("same_id", [False, True])
def test_a_group_larger_than_a_shard_is_divided(spark, same_id):
    doc_id = F.lit(7) if same_id else F.col("id")
    df = spark.range(3_000).select(
        doc_id.alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    out = shards(df, n_shards=4)
    check(out, 4)
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 20


def test_small_groups_stay_whole(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("copy "), F.col("id") % 10_000).alias("text"))
    out = shards(df, n_shards=4, tolerance=0.01)
    text = out.doc_id % 10_000
    assert out.groupby(text).shard.nunique().max() == 1


def test_empty_null_and_clashing(spark):
    assert shards(spark.createDataFrame([], TEXTS)).empty
    out = shards(spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "ab", None), (1, None, "x")], TEXTS))
    check(out, 16)
    assert sorted(out["size"]) == [1, 1, 1, 3]
    assert set(out[out["size"] == 1].text_crc32) == {0}


def test_native(spark, sf):
    plan = S.op8_histogram_shards(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
