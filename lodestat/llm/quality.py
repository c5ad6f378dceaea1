"""Quality by importance resampling over hashed n-gram models.

Two generative models, bags of unigrams and bigrams hashed into ``buckets``, are
estimated: one of target texts (labelled good), one of raw text (every row). A
text's log weight is the log ratio of its probabilities under the two. Adding
independent Gumbel noise and keeping the k largest keys samples k rows without
replacement in proportion to their weights (Gumbel top-k).

The raw model counts all rows. Target ids are at most ``max_target`` labelled
rows, those with the smallest hash, so that they can be broadcast. The k-th key
is found by counting key prefixes, 16 bits a time, and never by a global sort;
rows tied with the k-th are kept.

The noise is drawn from a hash of seed, id and text: reruns agree, and rows equal
in id and text are kept or left together. Null and empty texts weigh 0. Without
any target row the weights are 0 and the sample is uniform. Other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, quoted, texts_of, trimmed, with_row_key, Lexicon, Staged

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+")


def features(text: bytes, lexicon: Lexicon, buckets: int) -> np.ndarray:
    """Bucket of each word or run of symbols, and of each pair of neighbours."""
    h = lexicon.hashed(_TOKEN.findall(text.lower()))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    @trimmed
    def run(batches):
        lexicon, total = Lexicon(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(texts_of(batch.column("text")), batch.column("target").to_pylist(), strict=True):
                n = np.bincount(features(text, lexicon, buckets), minlength=buckets)
                total[0] += n
                if target:
                    total[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "raw", "target"])

    return run


def _weigh(shared, buckets: int, seed: int):
    @trimmed
    def run(batches):
        lexicon, ratio = Lexicon(), shared.value
        for batch in batches:
            own = [features(t, lexicon, buckets) for t in texts_of(batch.column("text"))]
            weight = np.array([float(ratio[f].sum()) for f in own])
            with np.errstate(over="ignore"):
                bits = mix(batch.column("rk").to_numpy().view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
            u = ((bits >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
            key = weight - np.log(-np.log(u))
            raw = key.view(np.int64)
            ordered = np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)  # integers in the order of the keys
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(f) for f in own], pa.int64()), pa.array(weight), pa.array(key), pa.array(ordered)], names=["id", "n_features", "log_weight", "gumbel_key", "ordered"])

    return run


def kth_largest(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, by four counts of 16-bit prefixes
    (65,536 rows at most come to the driver each time)."""
    prefix, left, rows = 0, k, df.select(F.col(column).alias("v"))
    for shift in (48, 32, 16, 0):
        top = F.shiftright("v", shift)
        counts = rows.groupBy(top.alias("d")).count().toPandas().sort_values("d", ascending=False)
        for d, n in zip(counts["d"].tolist(), counts["count"].tolist(), strict=True):
            if n >= left:
                prefix = d
                break
            left -= n
        rows = rows.where(top == F.lit(prefix))
    return prefix


def resample(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fraction: float | None = None, buckets: int = 10_000, max_target: int = 20_000, seed: int = 0,
) -> DataFrame:
    """``id, n_features, log_weight, gumbel_key, kept`` of every row; kept marks
    a share of ``fraction`` of all rows (by default, the share of good rows among
    the labelled ones)."""
    spark = df.sparkSession
    texts = with_row_key(df, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    judged = labels.select(quoted(id_col).alias("id"), quoted(label_col).alias("y")).where("id is not null and y is not null")
    if fraction is None:
        fraction = judged.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
        fraction = 0.5 if fraction is None else fraction
    good = judged.where("y = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_target).withColumn("target", F.lit(True))
    marked = texts.join(F.broadcast(good), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    n = marked.mapInArrow(_counts(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    model = np.zeros((2, buckets))
    model[:, n["bucket"].to_numpy(np.int64)] = n[["target", "raw"]].to_numpy(float).T
    taught = model[0].sum() > 0
    model = np.log((model + 1) / (model.sum(axis=1, keepdims=True) + buckets))
    ratio = spark.sparkContext.broadcast(model[0] - model[1] if taught else np.zeros(buckets))
    scored = Staged(texts.select("id", "text", "rk").mapInArrow(_weigh(ratio, buckets, seed), f"id {kind}, n_features long, log_weight double, gumbel_key double, ordered long"), "quality")
    k = round(fraction * scored.df.count())
    kept = F.col("ordered") >= F.lit(kth_largest(scored.df, "ordered", k)) if k else F.lit(False)
    return scored.df.select("id", "n_features", "log_weight", "gumbel_key", kept.alias("kept"))
