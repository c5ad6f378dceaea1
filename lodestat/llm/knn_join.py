"""Exact top-k inner-product search as a Voronoi join.

Vectors are quantised to whole numbers, floor(scale * x). Up to ``max_pivots`` rows
(about the square root of the table) span Voronoi cells; each row falls into the
cell of its nearest pivot. A cell's summary is its size, its radius r around the
pivot and its largest norm. For a query q no score with a cell exceeds q.p + |q| r,
nor |q| times the largest norm.

A query is solved in its home cells first, those with the largest q.p that hold more
than k rows together. The k-th best score found there is a bound that its answer
cannot fall below, so of the other cells only those whose summary lets a score reach
it are necessary, and the query is sent to those and no others. Queries are the
smaller side, so they are the side that is replicated. How many cells that spares
depends on the data: clustered vectors need few, vectors without any structure need
all, because there no exact bound can rule a cell out.

Cells are kept in chunks of at most ``chunk`` rows, and a cell with many chunks is
dealt out under several salts, so a cell that holds a third of all rows is solved
by many tasks, each pair of a chunk and a pack of queries by one matrix product. A
task keeps only the best k of each query, and a window over (query) that is limited
before its shuffle merges them.

Bounds are computed in floating point and widened by a margin above its error.
Scores are exact: products in float64 while they stay below 2**53, in int64 below
2**63, else in whole numbers of any size; a score beyond a long is shown as the
nearest long, but ranks by its value (beyond 38 digits, scores tie).

Vectors that are null or hold null or non-finite components take no part; neither do
null ids. Vectors of different lengths meet on the components that both have, as if
the shorter one ended in zeros; an empty vector scores 0. Rows equal in id are
separate candidates, except that no row with a query's own id is one; several query
rows of one id share one ranking. Ties go to the smaller id. Fewer than k candidates
give all of them. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Staged, prepare, quoted, shuffled, trimmed

_LONG = 2**63
_DIGITS = 10**38 - 1
#: Rows with smaller components meet in exact float64 or int64 products, apart from the rest.
_SMALL = 2.0**22
_PACK = "cell int, n int, width int, qkeys binary, qids binary, q binary"
_FOUND = "qkey long, query_id long, id long, score long, beyond decimal(38,0)"


def _by_length(column: pa.ListArray):
    """(places, matrix) of the vectors of each length."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lens = np.diff(offsets)
    for n in np.unique(lens).tolist():
        at = np.flatnonzero(lens == n)
        yield at, values[offsets[at][:, None] + np.arange(n)]


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole doubles; infinite where that is beyond a double."""
    with np.errstate(over="ignore"):
        return np.floor(x.astype(np.float64) * scale)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python numbers, however large."""
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.astype(np.float64).tolist()], object).reshape(x.shape)


def _is_big(z: np.ndarray) -> np.ndarray:
    return np.abs(z).max(axis=1, initial=0) >= _SMALL


class _Packer:
    """Collects rows by key and gives them out in packs of ``size`` rows at most."""

    def __init__(self, size: int, limit: int = 64 << 20):
        self.size, self.limit, self.bytes, self.kept = size, limit, 0, defaultdict(list)

    def add(self, key: tuple, *columns: np.ndarray):
        """The packs that are full now; beyond ``limit`` bytes, all there are."""
        own = self.kept[key]
        own.append(columns)
        self.bytes += sum(c.nbytes for c in columns)
        if sum(len(c[0]) for c in own) >= self.size:
            yield from self._give(key)
        if self.bytes > self.limit:
            yield from self.rest()

    def _give(self, key: tuple):
        columns = [np.concatenate(c) for c in zip(*self.kept.pop(key), strict=True)]
        self.bytes -= sum(c.nbytes for c in columns)
        for lo in range(0, len(columns[0]), self.size):
            yield key, [c[lo : lo + self.size] for c in columns]

    def rest(self):
        for key in list(self.kept):
            yield from self._give(key)


def _groups(codes: np.ndarray):
    """(code, places) of each distinct code."""
    if not len(codes):
        return
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for a, b in zip(first, [*first[1:], len(order)], strict=True):
        yield int(codes[order[a]]), order[a:b]


def _assign(shared, scale: int, chunk: int):
    """Rows as packed chunks of one cell."""

    @trimmed
    def run(batches):
        pivots = shared.value
        half = (pivots**2).sum(axis=1) / 2
        packer = _Packer(chunk)

        def row(key, columns):
            ids, x, far, norm = columns
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([far.max()]), pa.array([norm.max()]), pa.array([ids.tobytes()]), pa.array([x.tobytes()], pa.binary())],
                names=["cell", "width", "n", "radius", "norm", "ids", "x"],
            )

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at, x in _by_length(batch.column("v")):
                z = quantised(x, scale)
                d = min(pivots.shape[1], x.shape[1])
                with np.errstate(all="ignore"):
                    cell = np.argmax(np.nan_to_num(z[:, :d] @ pivots[:, :d].T - half), axis=1)
                    tail = (pivots[cell, d:] ** 2).sum(axis=1) + (z[:, d:] ** 2).sum(axis=1)
                    far = np.sqrt(((z[:, :d] - pivots[cell, :d]) ** 2).sum(axis=1) + tail)
                    norm = np.sqrt((z**2).sum(axis=1))
                for code, own in _groups(cell * 2 + _is_big(z)):
                    for key, columns in packer.add((code // 2, x.shape[1], code % 2), ids[at[own]], x[own], np.nan_to_num(far[own], nan=np.inf, posinf=np.inf), norm[own]):
                        yield row(key, columns)
        for key, columns in packer.rest():
            yield row(key, columns)

    return run


def _bounds(z: np.ndarray, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """q.p with each pivot, and the score that no row of its cell can exceed."""
    d = min(pivots.shape[1], z.shape[1])
    with np.errstate(all="ignore"):
        middle, own = z[:, :d] @ pivots[:, :d].T, np.sqrt((z**2).sum(axis=1))[:, None]
        high = np.minimum(middle + own * radius, own * norm)
        high = high + 1e-9 * (np.abs(middle) + own * radius) + 1e-6
    return np.nan_to_num(middle, nan=0.0), np.where(np.isnan(high), np.inf, high)


def _homes(shared, summary: np.ndarray, scale: int, k: int):
    """Add each query's home cells. They are written, not computed again, since
    rounding may differ from batch to batch."""

    @trimmed
    def run(batches):
        pivots, (count, radius, norm) = shared.value, summary
        for batch in batches:
            homes = [None] * batch.num_rows
            for at, x in _by_length(batch.column("v")):
                middle, _ = _bounds(quantised(x, scale), pivots, radius, norm)
                order = np.argsort(-np.where(count > 0, middle, -np.inf), axis=1, kind="stable")
                enough = np.argmax(np.cumsum(count[order], axis=1) > k, axis=1)
                total = np.cumsum(count[order], axis=1)[:, -1] > k
                for i, own, n, full in zip(at.tolist(), order, enough, total, strict=True):
                    homes[i] = own[: n + 1] if full else own[count[own] > 0]
            yield batch.append_column("home", pa.array(homes, pa.list_(pa.int32())))

    return run


def _send(shared, summary: np.ndarray, scale: int, pack: int, home: bool):
    """Each query to its home cells, or to the other necessary ones, packed by cell."""

    @trimmed
    def run(batches):
        pivots, (count, radius, norm) = shared.value, summary
        packer = _Packer(pack)

        def row(key, columns):
            keys, ids, q = columns
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([keys.tobytes()]), pa.array([ids.tobytes()]), pa.array([q.tobytes()], pa.binary())],
                names=["cell", "n", "width", "qkeys", "qids", "q"],
            )

        for batch in batches:
            keys, ids, homes = batch.column("qkey").to_numpy(), batch.column("id").to_numpy(), batch.column("home").to_pylist()
            least = None if home else batch.column("least").to_numpy(zero_copy_only=False)
            for at, x in _by_length(batch.column("v")):
                z = quantised(x, scale)
                there = np.zeros((len(at), len(count)), bool)
                there[np.repeat(np.arange(len(at)), [len(homes[i]) for i in at]), [c for i in at for c in homes[i]]] = True
                if not home:
                    _, high = _bounds(z, pivots, radius, norm)
                    there = ~there & (count > 0) & ~(high < least[at][:, None])  # no bound (nan): everywhere
                which, cell = np.nonzero(there)
                for code, own in _groups(cell * 2 + _is_big(z)[which]):
                    some = which[own]
                    for key, columns in packer.add((code // 2, x.shape[1], code % 2), keys[at[some]], ids[at[some]], x[some]):
                        yield row(key, columns)
        for key, columns in packer.rest():
            yield row(key, columns)

    return run


def products(q: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Exact inner products of quantised vectors: int64, or Python numbers if they may not fit."""
    d = min(q.shape[1], x.shape[1])
    q, x = q[:, :d], x[:, :d]
    a, b = quantised(q, scale), quantised(x, scale)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * d
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return _whole(q, scale) @ _whole(x, scale).T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties to smaller ids, without
    those marked own."""
    if scores.dtype == object:
        picked = [sorted(np.flatnonzero(~own[i]).tolist(), key=lambda j, s=scores[i]: (-s[j], ids[j]))[:k] for i in range(len(scores))]
        return np.repeat(np.arange(len(scores)), [len(x) for x in picked]), np.array([j for x in picked for j in x], np.int64)
    bar = np.full(len(scores), -_LONG)
    if scores.shape[1] > k:
        rest = np.where(own, -_LONG, scores)
        bar = np.partition(rest, rest.shape[1] - k, axis=1)[:, -k]
    high = scores >= bar[:, None]
    high &= ~own
    n = np.count_nonzero(high, axis=1)
    if n.max(initial=0) <= 4 * k:
        row, column = np.nonzero(high)
    else:  # many ties: a row at a time
        some = [np.flatnonzero(h) for h in high]
        some = [c[np.lexsort((ids[c], ~scores[i, c]))[:k]] for i, c in enumerate(some)]
        row, column = np.repeat(np.arange(len(scores)), [len(c) for c in some]), np.concatenate(some)
    return row, column


def _top(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each key."""
    order = np.lexsort((ids, ~scores, keys))
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    n = np.diff(np.append(first, len(order)))
    return order[np.arange(len(order)) - np.repeat(first, n) < k]


def _solve(k: int, scale: int, dtype, limit: int = 400_000):
    """Best k of each query over the chunks that a task meets."""

    def rows(keys, qids, ids, scores, beyond=None):
        beyond = pa.nulls(len(keys), pa.decimal128(38, 0)) if beyond is None else pa.array(beyond, pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(qids), pa.array(ids), pa.array(scores), beyond], names=["qkey", "query_id", "id", "score", "beyond"])

    @trimmed
    def run(batches):
        found: list[tuple] = []
        held = 0
        for batch in batches:
            for j in range(batch.num_rows):
                width, qwidth = batch.column("width")[j].as_py(), batch.column("qwidth")[j].as_py()
                ids, keys, qids = (np.frombuffer(batch.column(c)[j].as_py(), np.int64) for c in ("ids", "qkeys", "qids"))
                x, q = (np.frombuffer(batch.column(c)[j].as_py(), dtype).reshape(m, w) for c, m, w in (("x", len(ids), width), ("q", len(qids), qwidth)))
                scores = products(q, x, scale)
                row, column = best(scores, ids, qids[:, None] == ids, k)
                value = scores[row, column]
                if scores.dtype == object:
                    wide = [None if -_LONG <= v < _LONG else min(max(v, -_DIGITS), _DIGITS) for v in value]
                    yield rows(keys[row], qids[row], ids[column], np.array([min(max(v, -_LONG), _LONG - 1) for v in value], np.int64), wide)
                    continue
                found.append((keys[row], qids[row], ids[column], value))
                held += len(row)
                if held > limit:
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    at = _top(columns[0], columns[2], columns[3], k)
                    found = [tuple(c[at] for c in columns)]
                    held = len(at)
                    if held > limit // 2:
                        yield rows(*found.pop())
                        held = 0
        if found:
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            at = _top(columns[0], columns[2], columns[3], k)
            yield rows(*(c[at] for c in columns))

    return run


@dataclass
class Search:
    """The plan of a search: chunks of cells, and packs of queries sent to them."""

    cells: int
    queries: DataFrame
    home: DataFrame
    others: DataFrame
    found: DataFrame

    def share(self) -> float:
        """Of all pairs of a query and a cell, the share that was looked at."""
        sent = sum(p.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for p in (self.home, self.others))
        return sent / max(self.queries.count() * self.cells, 1)


def search(df: DataFrame, k: int, id_col: str, vector_col: str, query_modulus: int, scale: int, max_pivots: int, chunk: int, pack: int) -> Search | None:
    spark = df.sparkSession
    prepare(spark)
    v = quoted(vector_col)
    if not isinstance(df.schema[vector_col].dataType.elementType, FloatType):
        v = v.cast("array<double>")
    dtype = np.float32 if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else np.float64
    rows = df.select(quoted(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    stated = lengths.agg(F.sum("n").alias("n"), F.max(F.struct("n", "size")).alias("top")).first()
    if not stated["n"]:
        return None
    dim = stated["top"]["size"]
    wanted = max(min(math.isqrt(stated["n"]), max_pivots, (4 << 20) // max(dim, 1)), 1)
    drawn = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id", "v"), "id").limit(2 * wanted).select("v").collect()
    z = quantised(np.array([r["v"] for r in drawn], np.float64).reshape(len(drawn), dim), scale)
    z = z[np.isfinite((z**2).sum(axis=1))]
    _, first = np.unique(z, axis=0, return_index=True) if dim else (None, np.arange(min(len(z), 1)))
    pivots = z[np.sort(first)[:wanted]] if len(z) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(pivots)  # max_pivots rows and 32 MB at most

    data = Staged(rows.mapInArrow(_assign(shared, scale, chunk), "cell int, width int, n long, radius double, norm double, ids binary, x binary"), "knn-cells").df
    summary = np.zeros((3, len(pivots)))
    for r in data.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("r"), F.max("norm").alias("m")).collect():  # a row for each pivot
        summary[:, r["cell"]] = r["n"], r["r"], r["m"]
    salts = spark.createDataFrame([(i, max(math.ceil(n / (16 * chunk)), 1)) for i, n in enumerate(summary[0].tolist())], "cell int, salts long")
    data = data.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("ids"), "salts")).select("cell", "salt", "width", "ids", "x")

    asked = rows.where(F.col("id") % query_modulus == 0)
    kind = "float" if dtype is np.float32 else "double"
    asked = asked.mapInArrow(_homes(shared, summary, scale, k), f"id long, v array<{kind}>, home array<int>")
    asked = Staged(asked.withColumn("qkey", F.monotonically_increasing_id()), "knn-queries").df

    def solved(sent: DataFrame) -> DataFrame:
        packs = sent.join(F.broadcast(salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        packs = packs.select("cell", "salt", F.col("width").alias("qwidth"), "qkeys", "qids", "q")
        return data.join(shuffled(packs), ["cell", "salt"]).drop("cell", "salt").mapInArrow(_solve(k, scale, dtype), _FOUND)

    home = Staged(asked.mapInArrow(_send(shared, summary, scale, pack, True), _PACK), "knn-home").df
    near = Staged(solved(home), "knn-near").df
    by = [F.desc("score"), F.desc(F.coalesce("beyond", F.lit(0))), F.col("id")]
    least = near.withColumn("at", F.row_number().over(Window.partitionBy("qkey").orderBy(*by))).where(F.col("at") == k)
    value = F.col("score").cast("double")
    least = least.where(F.col("score") > -_LONG).select("qkey", (value - F.abs(value) * 1e-9 - 1).alias("least"))  # below the rounding of a double
    others = asked.join(shuffled(least), "qkey", "left").mapInArrow(_send(shared, summary, scale, pack, False), _PACK)
    others = Staged(others, "knn-others").df
    return Search(int((summary[0] > 0).sum()), asked, home, others, near.unionByName(solved(others)))


def top_k(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_modulus: int = 100, scale: int = 1024, max_pivots: int = 1024, chunk: int = 4096, pack: int = 1024) -> DataFrame:
    """``query_id, rank, id, score``: for each row whose id is divisible by
    ``query_modulus``, its k best other rows by integer inner product."""
    plan = search(df, k, id_col, vector_col, query_modulus, scale, max_pivots, chunk, pack)
    if plan is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("beyond", F.lit(0))), "id")
    return plan.found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
