"""What the corpus operators share: scratch tables, row keys, packed arrays.

Scratch tables live under ``spark.checkpoint.dir`` (the folder the cluster
shares); only a session that is one process (``local``) gets a folder of its own
where that is unset, any other raises.
They outlive the call, because a lazy result still reads them, and go when the
session's Python ends or :func:`release` is called.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ship_package

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of one batch on its way to a Python worker, and of the texts that are worked on at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_packers: dict[int, zstandard.ZstdCompressor] = {}
_unpacker = zstandard.ZstdDecompressor()
_roots: dict[str, tuple[SparkSession, str]] = {}
_tables: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> None:
    """The package on the executors, and batches for Python workers bounded by bytes,
    however long the texts are."""
    ship_package(spark)
    now = spark.conf.get(_BATCH_BYTES, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """Folder for this session's scratch tables, below ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    prepare(spark)
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            base = "file://" + tempfile.mkdtemp(prefix="lodestat-")  # one process: its own folder is shared
            spark.conf.set("spark.checkpoint.dir", base)
        root = f"{base.rstrip('/')}/lodestat-{uuid.uuid4().hex[:12]}"
        _roots[app] = (spark, root)
        atexit.register(release, spark)
    return _roots[app][1]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one scratch table, wherever Spark's file systems keep it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of the session; results not yet read are lost."""
    try:
        app = spark.sparkContext.applicationId
        for table in _tables.pop(app, []):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        if app in _roots:
            drop_path(spark, _roots.pop(app)[1])
    except Exception:  # noqa: BLE001  the session may have gone already
        pass


def fetch(df: DataFrame):
    """A small result as pandas; the shuffle files that it took go at once."""
    with _setting(df.sparkSession, _CLEANUP, "true"):
        return df.toPandas()


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


class Staged:
    """A table written once, so that later readers don't repeat its work and a
    lost executor costs a re-read. ``drop`` it when nothing reads it any more.
    bucket keeps rows of one value of that column in one task of later readers,
    which then group by it without a shuffle."""

    def __init__(self, df: DataFrame, tag: str, by: list[str] | None = None, bucket: str | None = None):
        self.spark = df.sparkSession
        name = f"{tag}-{uuid.uuid4().hex}"
        self.path = f"{scratch_root(self.spark)}/{name}"
        writer = df.write.format("parquet").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(*by or [])
        with _setting(self.spark, _CLEANUP, "true"):  # its shuffle files aren't needed once it is written
            if bucket:
                table = "lodestat_" + name.replace("-", "_")
                _tables.setdefault(self.spark.sparkContext.applicationId, []).append(table)  # leaves the catalog with the session's other scratch tables
                writer.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), bucket).option("path", self.path).saveAsTable(table)
                self.df = self.spark.table(table)
            else:
                writer.save(self.path)
                self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self, part: str = "") -> None:
        """Delete the table, or one of the folders that ``by`` has made."""
        drop_path(self.spark, f"{self.path}/{part}" if part else self.path)


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: sorted and merged, never broadcast,
    however small it looks at first."""
    return df.hint("merge")


def key_ranges(df: DataFrame, bytes_per_range: int = 8 << 20) -> int:
    """How many ranges to deal a corpus-wide key space into: by the size that the
    plan states, so that a range stays small however large the input is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(min(size, 1 << 50) / bytes_per_range))


def quoted(name: str):
    """The column of this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row_key(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``id, text, rk, rh``: rk and rh (96 bits) name a row by its id and text.
    Never null; rows equal in both share a key and so get equal results. carry
    adds ``row``, a struct of all columns but the text, by their place, and whether the
    text was null."""
    i, t = quoted(id_col), F.coalesce(quoted(text_col), F.lit(""))
    rest = [F.struct(*(quoted(c).alias(f"c{k}") for k, c in enumerate(df.columns) if c != text_col), quoted(text_col).isNull().alias("null")).alias("row")] if carry else []
    keys = [F.xxhash64("id", "text").alias("rk"), F.hash("text", "id").alias("rh")]
    return df.select(i.alias("id"), t.alias("text"), *rest).select("*", *keys)


def fields(df: DataFrame, columns: list[str], more: str) -> StructType:
    """Schema of these columns of df, whatever their names, and more (as DDL)."""
    return StructType([*(df.schema[c] for c in columns), *StructType.fromDDL(more)])


def with_column(df: DataFrame, run, name: str, kind) -> DataFrame:
    """df.mapInArrow by a function that appends a column ``new`` of this type, whatever
    the names of the others (they are numbered on the way)."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    schema = StructType([*(StructField(c, f.dataType) for c, f in zip(plain, df.schema, strict=True)), StructField("new", kind)])
    return df.toDF(*plain).mapInArrow(run, schema).toDF(*df.columns, name)


def carried(df: DataFrame, columns: list[str], text_col: str, text) -> DataFrame:
    """The rows that ``with_row_key`` carried, as they came, with this text (null
    where it was null)."""
    text = F.when(~F.col("row")["null"], text)
    return df.select(*(text.alias(c) if c == text_col else F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(columns)))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str | int, max_bytes: int = SLICE_BYTES):
    """The batch in runs of rows with ``max_bytes`` of this column at most, or one row."""
    own = batch.column(column)
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    lo = 0
    while lo < batch.num_rows:
        done = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, done + max_bytes, "right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def trimmed(run):
    """A function for mapInArrow that gives free memory back to the system at its
    end: workers wait for the next task, and what they keep counts."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def hash64(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hash(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of each n consecutive entries of h, by doubling."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    done, out = 0, None
    block, size, factor = h, 1, base
    m = n
    while m:
        if m & 1:
            if out is None:
                out, done = block, size
            else:  # what is done so far stands first
                keep = len(h) - (done + size) + 1
                out = out[:keep] * np.uint64(factor) + block[done : done + keep]
                done += size
        m >>= 1
        if m:
            keep = len(h) - 2 * size + 1
            block = block[:keep] * np.uint64(factor) + block[size : size + keep]
            factor, size = factor * factor % (1 << 64), 2 * size
    return out


class Lexicon:
    """Numbers words in order of first sight and keeps a 64-bit hash of each.
    Starts again beyond ``limit`` words, so that its memory is bounded."""

    def __init__(self, limit: int = 250_000):
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        from collections import defaultdict

        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.words: list[bytes] = []
        self.hashes = np.empty(0, np.uint64)

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > self.limit:
            self.reset()
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def hashed(self, words: list[bytes]) -> np.ndarray:
        """The 64-bit hash of each word."""
        codes = self.codes(words)
        if len(self.hashes) < len(self.number):
            fresh = list(self.number)[len(self.hashes) :] if not len(self.hashes) else _tail(self.number, len(self.hashes))
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(hash64, fresh), np.uint64, len(fresh))])
        return self.hashes[codes]


def _tail(d: dict, n: int) -> list:
    """The keys that came after the first n, newest found first."""
    from itertools import islice

    return list(islice(reversed(d), len(d) - n))[::-1]


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """An integer array as bytes, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    if level not in _packers:
        _packers[level] = zstandard.ZstdCompressor(level=level)
    return _packers[level].compress(planes.tobytes())


def unpack(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(_unpacker.decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(dtype).reshape(-1)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenate flat[starts[i]:starts[i]+lens[i]] for each i of which."""
    n = lens[which]
    total = int(n.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(n)
    index = np.arange(total, dtype=np.int64) + np.repeat(starts[which] - (ends - n), n)
    return flat[index]
