"""Sinks: atomic, resumable and reproducible writes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import images as I


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the class of its paths."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, kind = _files(spark, source)
    if not files.rename(kind(source), kind(target)):
        raise OSError(f"{source} can't be renamed to {target}")


def write_manifest(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Parquet, written beside ``path`` and renamed when it is whole: a write that fails
    leaves the old table as it was, and readers never see a part. df may read from
    ``path`` itself."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    files, kind = _files(spark, path)
    try:
        (df.coalesce(1) if single_file else df).write.parquet(fresh)
        had = files.exists(kind(path))
        if had:
            _move(spark, path, old)
        try:
            _move(spark, fresh, path)
        except Exception:
            if had:
                _move(spark, old, path)
            raise
        if had:
            files.delete(kind(old), True)
    finally:
        files.delete(kind(fresh), True)


def existing(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys of an earlier run, or None if there is none. Anything else that keeps it
    from being read is an error: what can't be read is not taken for nothing."""
    files, kind = _files(spark, path)
    if not files.exists(kind(path)):
        return None
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a folder without a single file
            return None
        raise
    if key not in df.columns:
        raise ValueError(f"{path} has no column {key}; it is another table")
    return df.select(key).distinct()


def set_aside(spark: SparkSession, path: str) -> str:
    """Rename a table that can't be read, so that a run can start over and nothing is lost."""
    other = f"{path.rstrip('/')}.aside-{uuid.uuid4().hex}"
    _move(spark, path.rstrip("/"), other)
    return other


def remaining(selection: DataFrame, done: DataFrame | None, key: str = "key") -> DataFrame:
    """What is still to do. The anti-join comes before any fetch."""
    return selection if done is None else selection.join(done, key, "left_anti")


def materialize(selection: DataFrame, path: str, key: str = "key", every: int | None = None, start_over: bool = False) -> int:
    """Append the selected rows that ``path`` lacks; how many they were. ``every``
    commits about so many rows at a time, so that a run that is cut short goes on
    from there. start_over: a table that can't be read is set aside, not overwritten."""
    spark = selection.sparkSession
    try:
        done = existing(spark, path, key)
        if done is not None:
            done.count()  # every footer and key column can be read
    except Exception:
        if not start_over:
            raise
        set_aside(spark, path)
        done = None
    todo = remaining(selection.dropDuplicates([key]), done, key)
    n = todo.count()
    parts = max(math.ceil(n / every), 1) if every else 1
    for part in range(parts if n else 0):
        some = todo if parts == 1 else todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        some.write.mode("append").parquet(path)
    return n


def save_images(df: DataFrame, root: str, key: str = "key", content: str = "content") -> DataFrame:
    """``key, path, error``: each image decoded and written as ``root``/<name>.png, by its
    key. A file appears under its name when it is whole; one that stands already stays.
    root is any folder that pyarrow's file systems reach and all executors share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for k, name, raw in zip(batch["key"], batch["name"], batch["content"], strict=True):
                image, error = I.load(raw)
                target = f"{root.rstrip('/')}/{name}"
                if error is None:
                    files, at = fs.FileSystem.from_uri(target)
                    if files.get_file_info(at).type == fs.FileType.NotFound:
                        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                        part = f"{at}.{uuid.uuid4().hex}.tmp"
                        with files.open_output_stream(part) as out:
                            out.write(I.encode_png(image))
                        files.move(part, at)
                rows.append((k, target if error is None else None, error))
            yield pd.DataFrame(rows, columns=["key", "path", "error"])

    named = df.select(F.col(key).cast("string").alias("key"), C.key_to_file(F.col(key).cast("string")).alias("name"), F.col(content).alias("content"))
    return named.mapInPandas(run, "key string, path string, error string")


def file_name(key: str = "key"):
    return C.key_to_file(F.col(key))


def prediction_rows(df: DataFrame, path: str = "image_path", score: str = "pred") -> DataFrame:
    """image_path, pred (6 digits), in order of path."""
    return df.select(F.col(path).alias("image_path"), F.round(score, 6).alias("pred")).orderBy("image_path")


def write_predictions(df: DataFrame, path: str, **names: str) -> None:
    prediction_rows(df, **names).coalesce(1).write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A small table as JSON or CSV."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.json(path)


def markdown(df: DataFrame, digits: int = 4, max_rows: int = 1000) -> str:
    """A small table as Markdown; a null is a dash. A table of more than ``max_rows`` rows
    is refused."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report of more than {max_rows} rows; write it as a table instead")
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])
