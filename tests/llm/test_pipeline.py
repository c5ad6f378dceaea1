import random

import corpus_pipeline
import __spark_entry__


def write(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")


def test_stages_take_effect_and_keep_clean_rows(spark, tmp_path):
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = [(i, f"{prose(60)}\n{prose(40)}") for i in range(120)]
    toxic = [(200 + i, f"{prose(40)} vexhorr{rng.choice(['', 'id', 'ing', 'ous'])} {prose(20)}") for i in range(60)]
    item = prose(30)
    leaked = [(300, f"{prose(50)} {item} {prose(10)}")]
    copies = [(400, clean[0][1].replace("\n", " ")), (401, clean[1][1])]
    rows = [(i, t, "en", "s", len(t)) for i, t in clean + toxic + leaked + copies] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    root = str(tmp_path)
    write(spark, root, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, root, "labels", [(i, 1, int(i >= 200)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int")
    write(spark, root, "benchmark", [(1, item), (2, None)], "item_id long, text string")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{root}/out{k}")
        docs = spark.read.parquet(f"{root}/out{k}")
        seen.append({r["doc_id"] for r in docs.collect()})
    ids = lambda rows: {i for i, _ in rows}
    assert len(seen[0] & ids(toxic)) <= 6 and len(ids(clean) - seen[0]) <= 3
    assert 401 not in seen[1] and seen[1] >= (seen[0] - {401})
    assert 400 not in seen[2] and seen[2] >= (seen[1] - {400, 500, 501} - ids(toxic))
    assert seen[3] == seen[2] - {300} and seen[4] == seen[3]
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, root).collect()}
    assert whole == {r["doc_id"]: r["ids_sha256"] for r in docs.collect()}


def test_registered_once_each():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, `toxicity score` double, `text was null` boolean, row int, kept string, rk long, spans string, `a``b` string, decoded binary"


def test_stages_take_odd_rows_and_clashing_names(spark, tmp_path):
    root = str(tmp_path)
    write(spark, root, "labels", [(i, 1, int(i % 2)) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    write(spark, root, "benchmark", [(None, None), (None, "")], "item_id long, text string")
    extra = (0.5, True, 1, "k", 2, "s", "t", None)
    texts = [(i, f"word{i} other{i % 3} {'vexhorr' if i % 2 else 'fine'} tail{i * 7}") for i in range(40)]
    rows = [(i, t, "en", "s", len(t), *extra) for i, t in texts] + [(100, None, None, None, None, *[None] * 8), (100, None, None, None, None, *[None] * 8), (None, "", None, None, 0, *extra), (101, "long word " * 20000, "en", "s", 200000, *extra)]
    for name, some in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(some, CLASHES)
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, root)
            out.write.parquet(f"{root}/{name}{k}")
            out = spark.read.parquet(f"{root}/{name}{k}")
            if k < 4:
                assert out.columns == docs.columns, stage_name
                docs = out
            if some and k < 4:
                left = {(r["doc_id"], r["text"] is None) for r in out.collect()}
                assert {(100, True), (None, False), (101, False)} <= left, stage_name
        assert out.count() == (docs.count() if some else 0)
