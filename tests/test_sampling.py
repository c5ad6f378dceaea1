import pytest
from pyspark.sql import functions as F

from lodestat.operators import metrics, sampling
from lodestat.streaming import incremental


def frame(spark, generators=6, reals=45):
    rows = [(f"r{i}", 0, "FFHQ" if i % 2 else "LHQ", f"authshard{i % 5}", i, 512 if i % 3 else 1024) for i in range(reals)]
    rows += [(f"g{g}-{i}", 1, f"generator/{g}", f"genshard{g}", i, 512) for g in range(generators) for i in range(10)]
    return spark.createDataFrame(rows, "key string, label int, model_name string, shard string, row_in_shard int, min_side int")


def test_matched_pool_balances_every_bucket(spark):
    pool = sampling.min_side_matched_pool(frame(spark))
    n = {(r["min_side"], r["label"]): r["count"] for r in pool.groupBy("min_side", "label").count().collect()}
    assert n[512, 0] == n[512, 1] and (1024, 0) not in n
    assert metrics.scale_canary(pool).first()["auroc"] == 0.5


def test_balance_covers_generators(spark):
    got = sampling.balance_classes(frame(spark), 12, 3, "key")
    assert got.where("label = 0").count() == got.where("label = 1").count() == 12
    assert got.where("label = 1").select("model_name").distinct().count() == 6
    assert sampling.balance_classes(frame(spark).where("label = 1"), 5, 3, "key").count() == 0


def test_stratified_balance(spark):
    got = sampling.stratified_balance(frame(spark), 20, 3, "key", "min_side")
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {0: 20, 1: 20}


def test_split_is_disjoint_and_stable_as_data_grow(spark):
    small, large = (sampling.disjoint_split(frame(spark, g, n), 0.3) for g, n in ((20, 30), (60, 90)))
    both = small.select("key", F.col("side").alias("a")).join(large.select("key", F.col("side").alias("b")), "key")
    assert both.where("a != b").count() == 0 and both.count() == 230
    per = large.where("label = 1").groupBy("model_name").agg(F.count_distinct("side").alias("n"))
    assert per.where("n > 1").count() == 0
    assert large.count() == 690
    share = sampling.disjoint_split(frame(spark, 200, 1), 0.2).where("label = 1").groupBy("side").agg(F.count_distinct("model_name").alias("n")).collect()
    assert 0.1 < {r["side"]: r["n"] for r in share}["test"] / 200 < 0.3
    with pytest.raises(ValueError):
        sampling.disjoint_split(large, 1.0)
    with pytest.raises(ValueError):
        sampling.check_split(frame(spark, 1))


def test_greedy_coverage_prefers_new_generators(spark):
    rows = [("a", "solo", i) for i in range(100)] + [("b", "solo", i) for i in range(90)] + [("c", f"g{i % 3}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "shard string, model_name string, i int")
    assert sampling.greedy_coverage(df, 2) == ["c", "a"]
    assert sampling.greedy_coverage(df, 9) == ["c", "a", "b"]


def test_plan(spark):
    rows = [("ga", 1, "s")] * 100 + [("gc", 1, f"g{i % 3}") for i in range(60)] + [("ra", 0, "L")] * 80
    df = spark.createDataFrame([(s, y, m, 512) for s, y, m in rows], "shard string, label int, model_name string, min_side int")
    plan = sampling.plan_shards(df, 1).first()
    assert plan["generated_shards"] == ["gc"] and plan["n_images"] == 120 and plan["n_generators"] == 3 and abs(plan["gb"] - 8.2) < 1e-9
    assert sampling.plan_shards(df, 1, 256).first()["note"]


def test_gate_refuses_a_leaking_split(spark):
    df = spark.createDataFrame([(0, 1000 + i) for i in range(20)] + [(1, i) for i in range(20)], "label int, min_side int")
    with pytest.raises(ValueError):
        sampling.split_gate(df)
    sampling.split_gate(df.withColumn("min_side", F.lit(512)))


def test_systematic_sample_has_both_ends(spark):
    got = sorted(r["id"] for r in sampling.systematic_sample(spark.range(101), 5, "id").collect())
    assert got == [0, 25, 50, 75, 100]


def test_empty_table(spark):
    none = frame(spark).where("false")
    assert sampling.min_side_matched_pool(none).count() == 0
    assert sampling.balance_classes(none, 5, 1, "key").count() == 0
    assert sampling.stratified_balance(none, 5, 1, "key", "min_side").count() == 0
    assert sampling.greedy_coverage(none, 3) == []


def test_stream_copy_resumes_and_split_holds(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "in"))
    stream = incremental.split_stream(incremental.read_stream(spark, str(tmp_path / "in"), frame(spark).schema))
    incremental.copy_new(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out"))
    assert first.count() == 105
    frame(spark, 7, 0).where("model_name = 'generator/6'").write.mode("append").parquet(str(tmp_path / "in"))
    incremental.copy_new(incremental.split_stream(incremental.read_stream(spark, str(tmp_path / "in"), frame(spark).schema)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    every = spark.read.parquet(str(tmp_path / "out"))
    assert every.count() == 115
    want = sampling.disjoint_split(frame(spark)).select("key", F.col("side").alias("w"))
    assert every.join(want, "key").where("side != w").count() == 0
