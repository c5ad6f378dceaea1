"""Cleaning a corpus for training, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept. The first four return the columns of ``documents``:

1. toxicity: rows with a score of 0.5 or more go;
2. line dedup: later copies of repeated runs, of 2 lines or of one line of 50
   words, are cut out of the texts, and rows whose every line was such a copy go;
3. n-gram Jaccard join: one row of each group of near-duplicates stays;
4. decontamination: rows with any benchmark window go;
5. byte-level BPE: the tokens of what is left, and their decoded bytes, as digests.

Null texts count as empty and stay null; they and empty texts are never toxic copies
or leaks, so they pass all stages. Null ids come before all others. Of rows equal in
id and text one stays (stage 3); equal texts under different ids are near-duplicates,
of which the smallest id stays. Texts of any length are read whole. Other columns,
whatever their names, go along until the last stage; empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from lodestat.llm.common import Staged, carried
from lodestat.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "toxicity score"
    while name in docs.columns:
        name += "'"
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < 0.5).drop(name)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(docs, min_run=2, carry=True, long_words=50).where("n_removed = 0 or n_removed < n_lines")
    kept = carried(out, docs.columns, "text", F.col("kept"))
    return kept.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    hits = decontaminate.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, carry=True)
    return carried(hits.where(F.size("spans") == 0), docs.columns, "text", F.col("text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: Training a classifier has no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}").df
    return STAGES[-1][1](spark, docs, sf_dir)
