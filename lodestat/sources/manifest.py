"""Manifests: metadata of parquet shards, folders and predictions, without blobs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..functions.images import header

#: The metadata columns of a manifest, and the names under which a
#: dataset may hold its image and its label.
METADATA = ("image_name", "format", "resolution", "mode", "model_name", "real_source", "subset", "split", "label", "architecture")
BLOB = "image_data"
IMAGE_NAMES = ("image", "img", "bytes", "data")
LABEL_NAMES = ("label", "type", "is_fake", "is_synthetic", "class")


class ShardScanError(RuntimeError):
    """No shard could be read."""


def available_columns(df: DataFrame, requested: Sequence[str]) -> list[str]:
    """Requested columns that exist, in the requested order."""
    found = [c for c in requested if c in df.columns]
    if not found:
        raise ValueError(f"none of {list(requested)} is among {df.columns}")
    return found


def list_shards(spark: SparkSession, root: str) -> list[str]:
    """Parquet files below a folder, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    return sorted(r["path"] for r in files.collect())


def _file():
    """The file of a row as a listing has it; the metadata column is URL-encoded."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^file:/+", "file:/")


def _relative(root: str):
    """A file's path below root, whatever scheme the path carries; its name, if it is the root itself."""
    tail = root.rstrip("/").split("://")[-1].removeprefix("file:")
    below = F.regexp_replace(F.substring_index(_file(), tail + "/", -1), "^/+", "")
    return F.when(_file().endswith(tail) & ~_file().contains(tail + "/"), F.substring_index(_file(), "/", -1)).otherwise(below)


def scan_shards(spark: SparkSession, root: str, columns: Sequence[str] = METADATA, skip_corrupt: bool = True, max_shards: int | None = None) -> DataFrame:
    """Metadata columns of all shards with ``shard`` (path below root) and
    ``row_in_shard`` (0-based). Schemas may differ; what a shard lacks is null."""
    reader = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", str(skip_corrupt).lower())
    df = reader.parquet(*(list_shards(spark, root)[:max_shards] if max_shards else [root]))
    return df.select(*available_columns(df, columns), _relative(root).alias("shard"), F.col("_metadata.row_index").alias("row_in_shard"))


def shard_offsets(manifest: DataFrame) -> DataFrame:
    """(shard, offset): rows of the shards before each, by path. As many as files."""
    sizes = sorted((r["shard"], r["count"]) for r in manifest.groupBy("shard").count().collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    return manifest.sparkSession.createDataFrame([(s, k) for (s, _), k in zip(sizes, starts, strict=False)], "shard string, offset long")


def as_one_shard(rows: DataFrame, name: str, offsets: DataFrame) -> DataFrame:
    """Rows of a table's files as rows of one shard, numbered through in the order of
    the files' paths. offsets come from a scan of all rows of the table."""
    place = (F.col("row_in_shard") + F.col("offset")).alias("row_in_shard")
    placed = rows.join(F.broadcast(offsets), "shard")
    return placed.select(*(F.lit(name).alias(c) if c == "shard" else place if c == "row_in_shard" else F.col(c) for c in rows.columns))


def scan_report(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """n_rows, n_shards, n_failed, failed_shards of a scan. Shards that gave no row
    failed unless they can be opened (and are empty)."""
    tail = root.rstrip("/").split("://")[-1].removeprefix("file:")
    files = spark.createDataFrame([(p, p.split(tail + "/")[-1]) for p in list_shards(spark, root)], "path string, shard string")
    silent = files.join(manifest.select("shard").distinct(), "shard", "left_anti").collect()
    failed = []
    for r in silent:
        try:
            spark.read.parquet(r["path"]).schema  # noqa: B018  reads the footer
        except Exception:  # noqa: BLE001
            failed.append(r["shard"])
    n = files.count()
    if n and len(failed) == n:
        raise ShardScanError(f"all {n} shards failed")
    return manifest.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(n).cast("long").alias("n_shards"), F.lit(len(failed)).cast("long").alias("n_failed"), F.lit(sorted(failed)).cast("array<string>").alias("failed_shards"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "label" not in df.columns:
        raise ValueError("a manifest needs a column label")
    return df


def prepare_selection(selection: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    missing = {"shard", "row_in_shard", "label"} - set(selection.columns)
    if missing:
        raise ValueError(f"the selection lacks {sorted(missing)}")
    return selection.select("shard", "row_in_shard", "label", *(c for c in columns if c in selection.columns and c not in ("shard", "row_in_shard", "label")))


def _resolved(spark: SparkSession, root: str, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shard, path) of the selection's shards by their path below root, else by their
    base name; and the shards that there are not. Both are as many as files."""
    tail = root.rstrip("/").split("://")[-1].removeprefix("file:")
    files = [(p, p.split(tail + "/")[-1] if not p.endswith(tail) else "", p.rsplit("/", 1)[-1]) for p in list_shards(spark, root)]
    full, base = {f: p for p, f, _ in files if f}, {}
    for p, _, b in files:
        base.setdefault(b, p)
    names = [r["shard"] for r in selection.select("shard").distinct().collect()]  # file names
    found = [(n, full.get(n, base.get(n))) for n in names if n is not None]
    have = spark.createDataFrame([x for x in found if x[1]], "shard string, path string")
    return have, spark.createDataFrame([(n,) for n, p in found if not p], "shard string")


def fetch_selected(spark: SparkSession, root: str, selection: DataFrame, blob: str = BLOB, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Selected rows with their blobs; null blobs are left out. Only the selection's files
    are read, and of them only the blob column; the selection is broadcast while it has
    ``broadcast_rows`` rows at most, so that blobs are filtered where they are read
    and never shuffled."""
    wanted = prepare_selection(selection, ["model_name", "min_side"])
    have, _ = _resolved(spark, root, selection)
    paths = sorted({r["path"] for r in have.collect()})
    if not paths:
        kind = next((f.dataType for f in spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(root).schema if f.name == blob), "binary")
        return wanted.where("false").withColumn(blob, F.lit(None).cast(kind))
    by_path = wanted.join(F.broadcast(have), "shard")
    low = wanted.agg(F.min("row_in_shard"), F.max("row_in_shard")).first()
    by_path = by_path.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    rows = spark.read.option("mergeSchema", "true").parquet(*paths).select(F.col(blob), _file().alias("path"), F.col("_metadata.row_index").alias("row_in_shard"))
    rows = rows.where(F.col("row_in_shard").between(low[0], low[1]) & F.col(blob).isNotNull())
    if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by_path = F.broadcast(by_path)
    return rows.join(by_path, ["path", "row_in_shard"]).select(*wanted.columns, blob)


def missing_shards(spark: SparkSession, root: str, selection: DataFrame) -> DataFrame:
    return _resolved(spark, root, selection)[1]


def validation_shards(names: Sequence[str], fallback: int = 5) -> list[str]:
    """Files named for validation, else the first ones by name."""
    words = ("validation", "val", "test", "eval")
    named = [n for n in sorted(names) if any(w in n.rsplit("/", 1)[-1].lower() for w in words)]
    return named or sorted(names)[:fallback]


def folder_manifest(paths: DataFrame, dataset: str, root_name: str, path: str = "path") -> DataFrame:
    """Labelled manifest of image paths; paths without a label folder are left out."""
    rows = paths.where(C.is_image_path(F.col(path))).withColumn("label", C.label_from_path(F.col(path))).where("label is not null")
    return rows.select(F.col(path).alias("key"), F.col(path).alias("path"), "label", C.generator_from_path(F.col(path), F.lit(root_name)).alias("model_name"), F.lit(dataset).alias("dataset"))


def image_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Image files of a folder (path, length, content); hidden ones are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).where(C.is_image_path(F.col("path"))).select("path", "length", "content")


def image_headers(files: DataFrame, content: str = "content", length: str = "length") -> DataFrame:
    """Add format, width, height and min_side from the first bytes of each file, and
    ``features`` (see columns.metadata_features); files whose header can't be read are
    left out. Only those bytes reach Python."""

    def run(batches):
        for batch in batches:
            found = [header(bytes(x)) if x is not None else None for x in batch.column("_head").to_pylist()]
            names = ["format", "width", "height"]
            columns = [pa.array([f[i] if f else None for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            rest = [n for n in batch.schema.names if n != "_head"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *columns], names=[*rest, *names])

    keep = [c for c in files.columns if c != content]
    rows = files.select(*keep, F.substring(content, 1, 65536).alias("_head"))
    schema = StructType([*(f for f in rows.schema if f.name != "_head"), *StructType.fromDDL("format string, width int, height int")])
    known = rows.mapInArrow(run, schema).where("format is not null")
    return known.withColumn("min_side", F.least("width", "height")).withColumn("features", C.metadata_features(F.col("width"), F.col("height"), F.col(length), F.col("format")))


def read_predictions(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """(image_path, pred) of a predictions file, failures left out. array: the file
    is one JSON array; else it has an object on each line, as write_predictions makes it."""
    return spark.read.schema("image_path string, pred double, error string").json(path, multiLine=array).where("pred is not null").select("image_path", "pred")


def join_predictions(predictions: DataFrame, manifest: DataFrame, path: str = "path", order: str = "row") -> DataFrame:
    """Inner join on path. The last of several manifest rows of a path counts;
    predictions keep their multiplicity."""
    last = manifest.groupBy(path).agg(F.max_by(F.struct(*(c for c in manifest.columns if c != path)), order).alias("m")).select(path, "m.*")
    return predictions.join(last, predictions["image_path"] == last[path])


def join_scores(manifest: DataFrame, predictions: DataFrame, path: str = "path", order: str = "row") -> DataFrame:
    """Manifest rows with a score; the last of several predictions of a path counts."""
    last = predictions.groupBy("image_path").agg(F.max_by("pred", order).alias("pred"))
    return manifest.join(last, manifest[path] == last["image_path"]).drop("image_path")


def lookup_path(rows: DataFrame, known: DataFrame, candidates: Sequence[str], path: str = "path") -> DataFrame:
    """Add ``found``: the first of the candidate columns whose path is known."""
    out, found = rows, []
    for i, c in enumerate(candidates):
        some = known.select(F.col(path).alias(f"_k{i}")).distinct()
        out = out.join(some, F.col(c) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_k{i}"))
    return out.withColumn("found", F.coalesce(*found)).drop(*(f"_k{i}" for i in range(len(candidates))))


def resolve_columns(df: DataFrame) -> tuple[str, str]:
    """Names of the image and label columns: the first known name, else the first and last column."""
    image = next((c for c in IMAGE_NAMES if c in df.columns), df.columns[0])
    label = next((c for c in LABEL_NAMES if c in df.columns), df.columns[-1])
    return image, label


def load_features(spark: SparkSession, path: str, expect_hash: str | None = None) -> DataFrame:
    """A feature cache (key, view, label, generator, features, config_hash); another
    configuration's cache is refused."""
    df = spark.read.parquet(path)
    if expect_hash is not None:
        other = df.where(F.col("config_hash") != expect_hash).select("config_hash").first()
        if other is not None:
            raise ValueError(f"cache of configuration {other[0]}, expected {expect_hash}")
    return df


def synthetic_manifest(spark: SparkSession, n: int = 40, generators: int = 4) -> DataFrame:
    """A toy manifest, every fifth row for validation."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("toy_"), i.cast("string")).alias("image_name"), (i % 2).cast("int").alias("label"), F.when(i % 2 == 1, F.concat(F.lit("gen/"), (i % generators).cast("string"))).otherwise("FFHQ").alias("model_name"),
        F.array(F.lit(512).cast("long"), F.lit(512).cast("long")).alias("resolution"), F.when(i % 5 == 4, "val").otherwise("train").alias("split"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("shard"), F.floor(i / 3).alias("row_in_shard"),
    )
