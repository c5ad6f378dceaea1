import hashlib

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from lodestat.functions import columns as C


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_sizes_of_malformed_lists(spark):
    rows = spark.createDataFrame([(1, [640, 480]), (2, [640]), (3, []), (4, None), (5, [None, 3])], "i int, resolution array<long>")
    got = {r["i"]: (r["width"], r["height"], r["min_side"]) for r in C.add_size_columns(rows).collect()}
    assert got == {1: (640, 480, 480), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 3, 0)}


def test_contaminated_sources_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0, "My-COCO"), (2, 1, "coco"), (3, None, "coco"), (4, 0, None), (5, 0, "FFHQ")], "i int, label int, model_name string")
    assert sorted(r["i"] for r in C.exclude_contaminated_sources(rows).collect()) == [2, 3, 4, 5]
    assert C.exclude_contaminated_sources(rows.select("i", "label")).count() == 5


def test_content(spark):
    cases = {"FFHQ": "face", " ffhq , celeba": "face", "ffhq,coco": None, "": None, "n/a": None, "what": None, "coco,what": None, "AFHQv2": "animal", ",lhq,": "scene"}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string")
    assert all(r["got"] == r["want"] for r in rows.select("want", C.content_category(F.col("s")).alias("got")).collect())


def test_stable_hash_is_sha256(spark):
    for key in ("a", "0:generator:x", "é"):
        want = int(hashlib.sha256(key.encode()).hexdigest()[:16], 16)
        assert int(one(spark, h=C.stable_hash(F.lit(key)))["h"]) == want


def test_logit_and_sigmoid_are_inverse_and_stable(spark):
    r = one(spark, a=C.sigmoid(C.logit(F.lit(0.3))), b=C.sigmoid(F.lit(-800.0)), c=C.sigmoid(F.lit(800.0)), d=C.logit(F.lit(1.0)))
    assert abs(r["a"] - 0.3) < 1e-12 and r["b"] == 0 and r["c"] == 1 and r["d"] > 13


def test_paths(spark):
    rows = spark.createDataFrame([("a/Fake/real/x.png",), ("train/AI/SDXL/v1/x.jpg",), ("a/b.png",), ("images/fake/x.png",)], "p string")
    got = [(r["l"], r["g"]) for r in rows.select(C.label_from_path(F.col("p")).alias("l"), C.generator_from_path(F.col("p"), F.lit("top")).alias("g")).collect()]
    assert got == [(0, "a"), (1, "SDXL/v1"), (None, "a"), (1, "top")]


def test_labels_and_names(spark):
    rows = spark.createDataFrame([("0.5", 1), ("0.49", 0), ("Tampered", 1), ("nature", 0), ("generated", 1)], "s string, want int")
    assert all(r["want"] == r["got"] for r in rows.select("want", C.coerce_label(F.col("s")).alias("got")).collect())
    assert one(spark, f=C.key_to_file(F.lit("a/b.parquet#3")))["f"] == "a_b.parquet__3.png"
    assert one(spark, x=C.is_image_path(F.lit("a/._b.png")), y=C.is_image_path(F.lit("a/b.JPeG"))).asDict() == {"x": False, "y": True}


def test_zero_vector_keeps_zero(spark):
    r = one(spark, v=C.l2_normalized(F.array(F.lit(0.0), F.lit(0.0))), w=C.l2_normalized(F.array(F.lit(3.0), F.lit(4.0))))
    assert r["v"] == [0.0, 0.0] and [round(x, 9) for x in r["w"]] == [0.6, 0.8]


def test_normalized_vectors_are_those_of_sql_to_the_sign_of_zero(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [[3.0, -1e-7], [-0.0, 1.0], [0.0, -2e-30], [0.1234565, 0.99235], [None, 3.0, 4.0], [None], [], None, [nan, 1.0], [inf, -inf, 1.0], [1e30, -1.0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = __spark_entry__.queries()["p14_l2_normalize"](spark, str(tmp_path)).collect()
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sql.execute(__spark_entry__.oracle_sql()["p14_l2_normalize"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and "-0.0" in repr(want)


def test_rounding_as_sql_does(spark):
    values = [0.5e-6, -0.5e-6, 0.1234565, -0.1234565, 2.5e-6, 1.0000005, 0.49999949999999994, -1e-7, -0.0, 0.0, 1.7e308, -1e300, 12345678901234.568, float("nan"), float("-inf")]
    got = [r["x"] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select(C.rounded(F.col("x"), 6).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in values]
    assert list(map(repr, got)) == list(map(repr, want))
