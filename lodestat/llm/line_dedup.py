"""Line dedup by a suffix array over line-ID sequences, built by prefix doubling.

The corpus is one long sequence of line IDs, document after document. Doubling
ranks the suffixes by their first 1, 2, 4, ... lines: the rank by 2k lines comes
from the pair (rank by k lines here, rank by k lines k further on), and ranks keep
the pairs' order. Suffixes that share their first k lines are an interval of the
suffix array whose longest common prefix (LCP) is k at least. Only suffixes that
share a prefix stay active, so most lines leave after the first count; doubling
goes on until no prefix is shared, log2 of the longest repeated run in all.

The LCP interval of a suffix is found on the way back down, from long ranks to
short ones. A suffix that shares k lines with others but not 2k starts in the
interval of its rank by k; for s = k/2, ..., 2, 1 it joins those of its interval
that have the same next s lines (equal ranks by s), if there are any. What has gone
into a narrower interval stands in the wider one as a single entry with its first
occurrence, so no interval is ever expanded into its members or pairs. At the end
each suffix knows its longest repeated run, which is maximal, and whether an
earlier place holds it.

Which lines go: every repeated run of ``min_run`` lines or more has a first
occurrence (document order is the id's, null first, ties by text). A line goes if
it lies in a later occurrence of some run and in the first occurrence of none, so
each repeated run survives in full once. Of 'A B X', 'A B C Y', 'A B C Z' stay 'A B
X', 'A B C Y' and 'Z'. A single line of ``long_words`` words or more can be a run by
itself, so that long passages on one line go too.

Ranks and intervals are counted before each shuffle; a line that a third of all
documents hold is one row of each count.

Lines are split at \\n and compare by 128-bit hashes of their exact text; blank
lines count as lines. Null and empty texts have no lines. Rows equal in id and
text are one document: they lose the same lines, none because of each other. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, fields, shuffled, slices, texts_of, trimmed, with_row_key

_AT = ["rk", "rh", "pos"]


@trimmed
def _lines(batches):
    """Hashes and numbers of words of the lines of each text."""
    for batch in batches:
        for some in slices(batch, "text"):
            lines = [t.split(b"\n") if t else [] for t in texts_of(some.column("text"))]
            n = np.fromiter(map(len, lines), np.int64, len(lines))
            h = [xxhash.xxh3_128_intdigest(x) for own in lines for x in own]
            words = np.fromiter((len(x.split()) for own in lines for x in own), np.int32, len(h))
            at = pa.array(np.repeat(np.arange(len(lines)), n), pa.int64())
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            one = np.fromiter((x >> 64 for x in h), np.uint64, len(h)).view(np.int64)
            two = np.fromiter((x & (2**64 - 1) for x in h), np.uint64, len(h)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(some.column(c).take(at) for c in ("id", "rk", "rh")), pa.array(pos.astype(np.int32)), pa.array(words), pa.array(one), pa.array(two)], names=["id", "rk", "rh", "pos", "words", "one", "two"])


def _place():
    """A suffix's place in document order."""
    return F.struct(F.col("id").isNotNull().alias("known"), "id", "rk", "rh", "pos")


def _ranks(df: DataFrame, keys: list[str], size: int, *more) -> Staged:
    """Ranks of the keys that stand more than once, in the keys' order, with more aggregates."""
    shared = df.groupBy(*keys).agg(F.count("*").alias("count"), *more).where("count > 1").drop("count")
    return Staged(shared.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), f"lines-ranks-{size}")  # ranks follow the partitions, so they are written before use


@dataclass
class _Level:
    """Suffixes that share their first ``size`` / 2 lines (all, if size is 1) with their
    rank by ``size`` lines, null if nothing shares those, and each rank's first place.
    ``here`` is the rank by half the size."""

    rows: DataFrame
    first: DataFrame

    def active(self) -> DataFrame:
        return self.rows.where("rank is not null")

    def leads(self) -> DataFrame:
        return self.first.select(F.col("rank").alias("node"), F.col("first").alias("lead"))


def _first_level(lines: Staged) -> _Level:
    ranks = _ranks(lines.df, ["one", "two"], 1)
    rows = lines.df.join(shuffled(ranks.df), ["one", "two"]).drop("one", "two").dropDuplicates(_AT)  # rows equal in id and text are one document
    rows = Staged(rows, "lines-1").df
    ranks.drop()
    return _Level(rows, Staged(rows.groupBy("rank").agg(F.min(_place()).alias("first")), "lines-first-1").df)


def _double(level: _Level, size: int) -> _Level:
    """Ranks by twice the lines: pairs of the rank here and the one ``size`` further on."""
    ahead = Window.partitionBy("rk", "rh").orderBy("pos").rangeBetween(size, size)
    pairs = level.active().select("id", *_AT, F.col("rank").alias("here"), F.first("rank").over(ahead).alias("then"))
    ranks = _ranks(pairs.where("then is not null"), ["here", "then"], 2 * size, F.min(_place()).alias("first")).df
    rows = pairs.join(shuffled(ranks.select("here", "then", "rank")), ["here", "then"], "left").select("id", *_AT, "here", "rank")
    return _Level(Staged(rows, f"lines-{2 * size}").df, ranks.select("rank", "here", "first"))


def _entries(level: _Level, half: _Level, size: int) -> DataFrame:
    """What the intervals of LCP ``size`` hold: suffixes that share no more than this by
    doubling, and each interval of twice the size (``level``) as one entry. ``node``
    names the interval, ``lead`` is its first place, (rk, rh, pos) where to read on."""
    alone = level.rows.where("rank is null").select(F.col("here").alias("node"), "id", *_AT, F.lit(True).alias("single"), _place().alias("first"))
    deep = level.first.select(F.col("here").alias("node"), "first.id", "first.rk", "first.rh", "first.pos", F.lit(False).alias("single"), "first")
    return alone.unionByName(deep).join(shuffled(half.leads()), "node").withColumn("size", F.lit(size))


def _narrow(entries: DataFrame, level: _Level, step: int) -> Staged:
    """One step down: entries of one interval with the same next ``step`` lines form a
    narrower interval, which stays in the wider one as an entry."""
    following = level.active().select("rk", "rh", F.col("pos").alias("to"), F.col("rank").alias("next"))
    read = entries.withColumn("to", F.col("pos") + F.col("size")).join(shuffled(following), ["rk", "rh", "to"], "left").drop("to")
    key = ["size", "node", "next"]
    groups = read.where("next is not null").groupBy(*key).agg(F.count("*").alias("n"), F.max("single").alias("any"), F.min("first").alias("inner"), F.min("lead").alias("outer")).where("n > 1 and any")
    formed = Staged(groups.select(*key, "inner", "outer").withColumn("child", F.monotonically_increasing_id()), f"lines-formed-{step}")
    inside = F.col("child").isNotNull()
    moved = read.join(shuffled(formed.df), key, "left").select(
        (F.col("size") + F.when(inside, step).otherwise(0)).alias("size"), F.coalesce("child", "node").alias("node"), "id", *_AT, "single", "first", F.coalesce("inner", "lead").alias("lead")
    )
    around = formed.df.select("size", "node", "inner.id", "inner.rk", "inner.rh", "inner.pos", F.lit(False).alias("single"), F.col("inner").alias("first"), F.col("outer").alias("lead"))
    out = Staged(moved.unionByName(around), f"lines-entries-{step}")
    formed.drop()
    return out


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 2, long_words: int | None = None) -> DataFrame:
    """``rk, rh, pos, n, first``: for each suffix that shares ``min_run`` lines or more
    with another, the longest run of lines that it shares, by its first line and
    number of lines; first marks the run's first occurrence. Runs of one line of
    ``long_words`` words or more are rows of their own."""
    texts = with_row_key(df, id_col, text_col)
    lines = Staged(texts.mapInArrow(_lines, fields(texts, ["id"], "rk long, rh int, pos int, words int, one long, two long")), "lines")
    levels, size = {1: _first_level(lines)}, 1
    lines.drop()
    while not levels[size].first.isEmpty():
        levels[2 * size] = _double(levels[size], size)
        size *= 2

    found = [levels[1].active().where("false").select(*_AT, F.lit(1).alias("n"), F.lit(True).alias("first"))]
    entries, step = None, size // 4
    while step >= 1:  # the intervals of LCP 2 * step join those that came down so far
        parts = [entries.df] if entries is not None else []
        if 4 * step > min_run:  # else their runs are too short
            parts.append(_entries(levels[4 * step], levels[2 * step], 2 * step))
        if parts:
            old, entries = entries, _narrow(reduce(DataFrame.unionByName, parts), levels[step], step)
            if old is not None:
                old.drop()
        step //= 2
    ends = [entries.df] if entries is not None else []
    if min_run <= 1 and 2 in levels:  # intervals of LCP 1 have nothing to step down by
        ends.append(_entries(levels[2], levels[1], 1))
    found += [e.where(F.col("single") & (F.col("size") >= min_run)).select(*_AT, F.col("size").alias("n"), (F.col("first") == F.col("lead")).alias("first")) for e in ends]
    if long_words is not None and min_run > 1:
        long = levels[1].active().where(F.col("words") >= long_words).select(F.col("rank").alias("node"), *_AT, _place().alias("place"))
        found.append(long.join(shuffled(levels[1].leads()), "node").select(*_AT, F.lit(1).alias("n"), (F.col("place") == F.col("lead")).alias("first")))
    return reduce(DataFrame.unionByName, found)


def _cut(columns: list[str]):
    @trimmed
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                kept, total, gone = [], [], []
                for text, own in zip(some.column("text").to_pylist(), some.column("runs").to_pylist(), strict=True):
                    lines = text.split("\n") if text else []
                    edges = np.zeros((2, len(lines) + 1), np.int64)
                    for r in own or []:
                        edges[int(r["first"]), r["pos"]] += 1
                        edges[int(r["first"]), r["pos"] + r["n"]] -= 1
                    later, first = np.cumsum(edges[:, :-1], axis=1) > 0
                    drop = later & ~first
                    total.append(len(lines))
                    gone.append(int(drop.sum()))
                    kept.append("\n".join([x for x, d in zip(lines, drop.tolist(), strict=True) if not d]) if gone[-1] else text)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "n_lines", "n_removed", "kept"])

    return run


def remove_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 2, carry: bool = False, long_words: int | None = None) -> DataFrame:
    """``id, n_lines, n_removed, kept``: every row's text without the later copies
    of repeated line runs; a single line of at least ``long_words`` words is a run
    too (None: no single line is, unless min_run is 1). carry adds ``row``, a struct of the row's other columns."""
    runs = repeated_runs(df, id_col, text_col, min_run, long_words).groupBy("rk", "rh").agg(F.collect_list(F.struct("pos", "n", "first")).alias("runs"))
    texts = with_row_key(df, id_col, text_col, carry)
    columns = ["id", "row"] if carry else ["id"]
    joined = texts.join(shuffled(Staged(runs, "lines-runs").df), ["rk", "rh"], "left").select(*columns, "text", "runs")
    return joined.mapInArrow(_cut(columns), fields(texts, columns, "n_lines long, n_removed long, kept string"))
