import duckdb
import numpy as np
import pytest

import __spark_entry__

from lodestat.functions import images as I
from lodestat.sources import manifest as M
from lodestat.sources import sinks


def test_scan_reports_corrupt_shards(spark, tmp_path):
    root = tmp_path / "shards"
    M.synthetic_manifest(spark, 12).drop("shard", "row_in_shard").coalesce(1).write.parquet(str(root / "a"))
    spark.range(5).selectExpr("cast(id as string) image_name", "1 label").coalesce(1).write.parquet(str(root / "b"))
    (root / "bad.parquet").write_bytes(b"junk")
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    got = M.scan_shards(spark, str(root))
    assert got.count() == 17 and set(got.columns) >= {"image_name", "label", "shard", "row_in_shard"}
    assert sorted(r["row_in_shard"] for r in got.where("model_name is null").collect()) == [0, 1, 2, 3, 4]
    report = M.scan_report(spark, str(root), got).first()
    assert (report["n_rows"], report["n_shards"], report["n_failed"], report["failed_shards"]) == (17, 3, 1, ["bad.parquet"])
    spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    with pytest.raises(ValueError):
        M.available_columns(got, ["nothing"])


def test_fetch_and_missing_shards(spark, tmp_path):
    root = str(tmp_path / "blobs")
    spark.range(6).selectExpr("case when id = 3 then null else cast(concat('x', id) as binary) end image_data", "id").coalesce(1).write.parquet(root)
    shard = M.scan_shards(spark, root, ["image_data"]).first()["shard"]
    selection = spark.createDataFrame([(shard, i, 1) for i in (1, 3, 5)] + [("gone.parquet", 0, 0)], "shard string, row_in_shard long, label int")
    assert sorted(bytes(r["image_data"]) for r in M.fetch_selected(spark, root, selection).collect()) == [b"x1", b"x5"]
    assert [r["shard"] for r in M.missing_shards(spark, root, selection).collect()] == ["gone.parquet"]
    with pytest.raises(ValueError):
        M.prepare_selection(selection.drop("label"))


def test_materialize_resumes(spark, tmp_path):
    rows = spark.range(10).selectExpr("concat('s#', id) as key", "id as label")
    path = str(tmp_path / "out")
    assert sinks.materialize(rows.where("label < 6"), path) == 6
    assert sinks.materialize(rows, path) == 4
    assert sinks.materialize(rows, path) == 0
    assert spark.read.parquet(path).count() == 10


def test_predictions_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0.12345678), ("a", None)], "image_path string, pred double")
    sinks.write_predictions(rows, str(tmp_path / "p"))
    got = M.read_predictions(spark, str(tmp_path / "p")).collect()
    assert [(r["image_path"], r["pred"]) for r in got] == [("b", 0.123457)]
    (tmp_path / "list.json").write_text('[{"image_path": "x", "pred": 0.5},\n {"image_path": "y", "pred": null, "error": "empty file"}]')
    assert [tuple(r) for r in M.read_predictions(spark, str(tmp_path / "list.json"), array=True).collect()] == [("x", 0.5)]


def test_duplicate_paths_last_wins(spark):
    manifest = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], "path string, label int, row int")
    predictions = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 2), ("z", 0.3, 3)], "image_path string, pred double, row int")
    got = M.join_predictions(predictions.drop("row"), manifest)
    assert sorted((r["pred"], r["label"]) for r in got.collect()) == [(0.1, 1), (0.2, 1)]
    assert sorted((r["path"], r["pred"]) for r in M.join_scores(manifest, predictions).select("path", "pred").collect()) == [("a", 0.2), ("a", 0.2)]


def test_column_names_and_cache_guard(spark, tmp_path):
    assert M.resolve_columns(spark.createDataFrame([(1, 2, 3)], "x int, img int, is_fake int")) == ("img", "is_fake")
    assert M.resolve_columns(spark.createDataFrame([(1, 2)], "x int, y int")) == ("x", "y")
    spark.createDataFrame([("k", "h1")], "key string, config_hash string").write.parquet(str(tmp_path / "c"))
    assert M.load_features(spark, str(tmp_path / "c"), "h1").count() == 1
    with pytest.raises(ValueError):
        M.load_features(spark, str(tmp_path / "c"), "h2")


def test_markdown(spark):
    assert sinks.markdown(spark.createDataFrame([("a", 0.5, None)], "v string, x double, y int")).splitlines()[-1] == "| a | 0.5000 | - |"


def test_fetch_reads_only_the_selections_files(spark, tmp_path):
    root = tmp_path / "shards"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).selectExpr("cast(concat('x', id) as binary) image_data", "id").coalesce(1).write.parquet(str(root / f"s{k}" / "a b+c"))
    scanned = M.scan_shards(spark, str(root), ["id"])
    chosen = scanned.where("id in (3, 7, 12)").selectExpr("shard", "row_in_shard", "1 as label", "'g' as model_name")
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)
    got = M.fetch_selected(spark, str(root), chosen)
    assert sorted(bytes(r["image_data"]) for r in got.collect()) == [b"x12", b"x3", b"x7"] and set(got.columns) == {"shard", "row_in_shard", "label", "model_name", "image_data"}
    assert len({f.rsplit("/", 3)[1] for f in got.inputFiles()} - {"s0", "s1"}) == 0
    by_name = chosen.selectExpr("substring_index(shard, '/', -1) shard", "row_in_shard", "label")
    assert M.fetch_selected(spark, str(root), by_name, broadcast_rows=0).count() == 3
    assert M.fetch_selected(spark, str(root), chosen.where("false")).count() == 0
    assert M.missing_shards(spark, str(root), by_name).count() == 0


def test_materialize_loses_nothing(spark, tmp_path):
    rows = spark.range(50).selectExpr("concat('s#', id) as key", "id as label")
    path = tmp_path / "out"
    assert sinks.materialize(rows, str(path), every=10) == 50 and sinks.materialize(rows, str(path), every=10) == 0
    other = tmp_path / "other"
    spark.range(2).write.parquet(str(other))
    with pytest.raises(ValueError):  # another table is no empty one
        sinks.materialize(rows, str(other))
    assert spark.read.parquet(str(other)).count() == 2
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part.parquet").write_bytes(b"PAR1 cut short")
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        sinks.materialize(rows, str(bad))
    assert sinks.materialize(rows, str(bad), start_over=True) == 50 and spark.read.parquet(str(bad)).count() == 50
    assert [(p / "part.parquet").read_bytes() for p in tmp_path.glob("bad.aside-*")] == [b"PAR1 cut short"]


def test_a_failed_write_leaves_the_old_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.write_manifest(spark.range(3).selectExpr("id", "0 as label"), path)
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_manifest(spark.range(3).selectExpr("id", "raise_error('x') as label"), path)
    assert M.load_manifest(spark, path).count() == 3
    sinks.write_manifest(M.load_manifest(spark, path).where("id > 0"), path, single_file=True)  # reads what it replaces
    assert M.load_manifest(spark, path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["m"]


def test_images_are_saved_once_and_whole(spark, tmp_path):
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    rows = spark.createDataFrame([("a/s#1", bytearray(I.encode_png(image))), ("a/s#2", bytearray(b"junk")), ("a/s#3", None)], "key string, content binary")
    for _ in range(2):
        got = {r["key"]: r for r in sinks.save_images(rows, f"file://{tmp_path}/png").collect()}
        assert [p.name for p in (tmp_path / "png").iterdir()] == ["a_s__1.png"] and got["a/s#2"]["path"] is None and got["a/s#3"]["error"] == "not a file"
    assert (I.load((tmp_path / "png" / "a_s__1.png").read_bytes())[0] == image).all()


def test_headers_without_pixels(spark):
    raw = I.encode_png(np.zeros((6, 9, 3), np.uint8))
    files = spark.createDataFrame([("a.png", len(raw), bytearray(raw)), ("b.png", 4, bytearray(b"junk"))], "path string, length long, content binary")
    got = M.image_headers(files).collect()
    assert [(r["path"], r["format"], r["min_side"], r["features"]["total_pixels"], r["features"]["is_png"]) for r in got] == [("a.png", "PNG", 6, 54.0, 1)]
    assert M.validation_shards(["x/b.parquet", "a_val.parquet"]) == ["a_val.parquet"] and M.validation_shards([f"s{k}" for k in range(9)]) == [f"s{k}" for k in range(5)]


def test_long_reports_are_refused(spark):
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), max_rows=4)


def against_sql(spark, tmp_path, query):
    """Rows of a query and of its SQL over documents in files whose sizes don't follow their names."""
    (tmp_path / "documents.parquet").mkdir()
    for name, low, high in (("b", 0, 5), ("a", 10, 70), ("c", 100, 130), ("d", 0, 0)):
        rows = spark.range(low, high).selectExpr("id as doc_id", "case when id % 7 > 0 then concat('text ', id) end as text").coalesce(1)
        rows.toPandas().astype({"doc_id": "int64", "text": "string"}).to_parquet(tmp_path / "documents.parquet" / f"part-{name}.parquet")
    spark.range(0, 200, 3).selectExpr("id as doc_id", "cast(id % 2 as int) as quality").toPandas().to_parquet(tmp_path / "labels.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql.execute(f"CREATE VIEW labels AS FROM '{tmp_path}/labels.parquet'")
    got = __spark_entry__.queries()[query](spark, str(tmp_path)).collect()
    return sorted(map(tuple, got)), sorted(sql.execute(__spark_entry__.oracle_sql()[query]).fetchall())


def test_row_identity_of_a_table_of_many_files(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "s3_shard_row_identity")
    assert got == want and len(got) == 95


def test_scan_of_a_table_of_many_files(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "s7_scan_shards")
    assert got == want == [("documents.parquet", 95, 0, 94)]


def test_selected_rows_of_a_table_of_many_files(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "s11_selected_rows")
    assert got == want and len(got) > 20
