"""N-gram Jaccard join by MinHash banding with exact verification.

1. Each text becomes its set of hashed n-grams; texts with one set are one
   *class* from here on, named by a hash of the set, with a count of its texts.
2. ``rows`` MinHash values make a band, and ``bands`` bands are taken, so that a
   pair at ``threshold`` shares some band with probability ``recall`` at least.
   Classes shuffle on band hashes; each points at the smallest of its bucket
   (never at every other member), and the links' components are the candidates.
3. The full n-gram sets of a candidate component meet and every pair in it is
   verified exactly. A component of more than ``tile`` sets, or of more than
   ``tile_grams`` n-grams in all, is cut by hash into chunks, and each two chunks meet in a task of their own: memory is bounded,
   nothing is left out, and counts and a spanning forest go on, never the pairs.

Words are those of :mod:`decontaminate` (lower-cased letters and digits). A text
of fewer than n words is one n-gram of all of them; texts without words have no
n-grams and are alone. Ids may be null or repeated: each row is a text. The class
id is the smallest id among linked texts (transitively); links of a text are the
other texts at threshold or more, copies included. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, Staged, carried, mix, pack, shuffled, slices, texts_of, trimmed, unpack, window_hash, with_row_key
from .components import connected_components
from .decontaminate import words_of

_BASE = 0x9E3779B97F4A7C15


def bands_for(threshold: float, recall: float, rows: int = 6) -> int:
    """Bands of so many rows each that a pair at the threshold meets with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def ngrams(text: bytes, lexicon: Lexicon, n: int) -> np.ndarray:
    """Distinct hashes of the n-grams of a text, in order."""
    h = lexicon.hashed(words_of(text))
    if not len(h):
        return h
    return np.unique(mix(window_hash(h, min(n, len(h)), _BASE) + np.uint64(len(h) if len(h) < n else 0)))


def _signatures(n: int, bands: int, rows: int, seed: int):
    """Class, size of the set and band hashes of each text."""

    @trimmed
    def run(batches):
        rng = np.random.default_rng(seed)
        odd = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
        plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
        lexicon = Lexicon()
        for batch in batches:
            for some in slices(batch, "text"):
                own = texts_of(some.column("text"))
                sid, size, band = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), []
                for i, text in enumerate(own):
                    grams = ngrams(text, lexicon, n)
                    size[i] = len(grams)
                    if not len(grams):
                        band.append([])
                        continue
                    sid[i] = np.uint64(mix(np.array([(grams * np.uint64(_BASE)).sum() + np.uint64(len(grams)), 0], np.uint64))[0]).view(np.int64)
                    short = (grams >> np.uint64(32)).astype(np.uint32)
                    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                    for at in range(0, len(short), 2048):
                        np.minimum(least, (odd * short[at : at + 2048] + plus).min(axis=1), out=least)
                    h = mix(least.reshape(bands, rows).astype(np.uint64))
                    for k in range(1, rows):
                        h[:, 0] = mix(h[:, 0] * np.uint64(_BASE) + h[:, k])
                    band.append(mix(h[:, 0] + np.arange(bands, dtype=np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("rk"), some.column("rh"), pa.array(sid), pa.array(size), pa.array(band, pa.list_(pa.int64()))], names=["id", "rk", "rh", "sid", "size", "bands"])

    return run


def _sets(n: int):
    """The n-gram set of each class, packed."""

    @trimmed
    def run(batches):
        lexicon = Lexicon()
        for batch in batches:
            for some in slices(batch, "text"):
                grams = [pack(np.diff(ngrams(t, lexicon, n), prepend=np.uint64(0))) for t in texts_of(some.column("text"))]
                yield pa.RecordBatch.from_arrays([some.column("component"), some.column("sid"), some.column("copies"), some.column("chunks"), pa.array(grams, pa.binary())], names=["component", "sid", "copies", "chunks", "grams"])

    return run


def _verify(threshold: float):
    """applyInArrow: all pairs of a component, or of two chunks of a large one.
    Rows out: (sid, links, other): links counted for a set, or a spanning link."""

    def run(table: pa.Table) -> pa.Table:
        sid, copies = table["sid"].to_numpy(), table["copies"].to_numpy()
        side, x, y = table["side"].to_numpy(), table["x"][0].as_py(), table["y"][0].as_py()
        sets = [np.cumsum(unpack(g, np.uint64), dtype=np.uint64) for g in table["grams"].to_pylist()]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        n = np.diff(np.append(first, len(flat)))
        gram = np.repeat(np.arange(len(first)), n)
        shared = n[gram] > 1  # n-grams of one set alone meet nothing
        gram, owner = gram[shared], owner[shared]
        by_owner = np.argsort(owner, kind="stable")
        start = np.searchsorted(owner[by_owner], np.arange(len(sets) + 1))
        begin = np.searchsorted(gram, np.arange(len(first) + 1))
        links, spans = np.zeros(len(sets), np.int64), []
        label = np.arange(len(sets))
        for i in range(len(sets)):
            if x != y and side[i] != x:
                continue  # a pair across two chunks is looked at from the first
            own = gram[by_owner[start[i] : start[i + 1]]]
            counts = begin[own + 1] - begin[own]
            at = np.arange(counts.sum()) + np.repeat(begin[own] - (np.cumsum(counts) - counts), counts)
            both = np.bincount(owner[at], minlength=len(sets))
            met = np.flatnonzero(both)
            met = met[(met > i) if x == y else (side[met] == y)]
            near = met[both[met] >= threshold * (size[i] + size[met] - both[met])]
            links[i] += copies[near].sum()
            links[near] += copies[i]
            for j in near[label[near] != label[i]].tolist():
                if label[j] != label[i]:
                    spans.append((i, j))
                    label[label == label[j]] = label[i]
        own = np.flatnonzero(links)
        a, b = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
        return pa.table({
            "sid": pa.array(np.concatenate([sid[own], sid[a]]), pa.int64()), "links": pa.array(np.concatenate([links[own], np.zeros(len(a), np.int64)]), pa.int64()),
            "other": pa.array([None] * len(own) + sid[b].tolist(), pa.int64()),
        })

    return run


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 6, tile: int = 256, tile_grams: int = 2_000_000, seed: int = 1
) -> DataFrame:
    """``id, rk, rh, class_id, n_copies, n_links, leader`` of every row: class_id is
    the smallest id of the texts linked to it, n_copies how many rows have its set,
    leader marks the row (or rows equal to it) with the smallest id of its class."""
    bands = bands_for(threshold, recall, rows)
    texts = with_row_key(df, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    signed = Staged(texts.mapInArrow(_signatures(n, bands, rows, seed), f"id {kind}, rk long, rh int, sid long, size long, bands array<long>"), "join-signatures")
    classes = signed.df.where("size > 0").groupBy("sid").agg(F.count("*").alias("copies"), F.first("size").alias("size"), F.min(F.struct("rk", "rh")).alias("at"), F.first("bands").alias("bands"))
    classes = Staged(classes, "join-classes").df
    banded = classes.select("sid", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("sid").alias("least"), F.count("*").alias("c")).where("c > 1").select("band", "least")
    least = Staged(least, "join-buckets").df
    candidates = connected_components(banded.join(shuffled(least), "band").where("sid != least").select(F.col("sid").alias("u"), F.col("least").alias("v")))
    candidates = Staged(candidates, "join-candidates").df

    wanted = candidates.join(shuffled(classes.select("sid", "size", "copies", "at")), candidates["node"] == classes["sid"]).select("component", "sid", "size", "copies", F.col("at.rk").alias("rk"), F.col("at.rh").alias("rh"))
    wanted = Staged(wanted, "join-wanted").df
    chunks = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / tile_grams)).cast("int").alias("chunks")
    sizes = Staged(wanted.groupBy("component").agg(chunks), "join-sizes").df  # tables of their own, so that a large component's rows can be split in joins
    wanted = wanted.join(shuffled(sizes), "component").drop("size")
    one = texts.select("text", "rk", "rh").join(shuffled(wanted), ["rk", "rh"]).dropDuplicates(["sid"]).select("text", "component", "sid", "copies", "chunks")
    sets = one.mapInArrow(_sets(n), "component long, sid long, copies long, chunks int, grams binary")
    side = F.pmod(F.xxhash64("sid"), F.col("chunks").cast("long")).cast("int")
    dealt = sets.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other")).drop("other", "chunks")
    verified = Staged(dealt.groupBy("component", "x", "y").applyInArrow(_verify(threshold), "sid long, links long, other long"), "join-verified").df
    counted = verified.where("other is null").groupBy("sid").agg(F.sum("links").alias("links"))
    joined = connected_components(verified.where("other is not null"), "sid", "other").select(F.col("node").alias("sid"), "component")

    told = classes.select("sid", "copies").join(shuffled(counted), "sid", "left").join(shuffled(joined), "sid", "left")
    told = Staged(told.select("sid", "copies", "links", F.coalesce("component", "sid").alias("component")), "join-told").df  # a table of its own, so that a class's many copies can be split in the join
    rows_of = Staged(signed.df.select("id", "rk", "rh", "sid", "size").join(shuffled(told), "sid", "left"), "join-rows").df
    smallest = Staged(rows_of.where("size > 0").groupBy("component").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("null"), "id", "rk", "rh")).alias("lead")), "join-smallest").df
    out = rows_of.join(shuffled(smallest), "component", "left")
    alone = F.col("size") == 0
    return out.select(
        "id", "rk", "rh", F.when(alone, F.col("id")).otherwise(F.col("least")).alias("class_id"), F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        F.when(alone, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        (alone | ((F.col("rk") == F.col("lead.rk")) & (F.col("rh") == F.col("lead.rh")))).alias("leader"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each class, the one with the smallest id, with all its columns.
    Rows equal in id and text are one row."""
    leaders = near_duplicates(df, id_col, text_col, **settings).where("leader").select("rk", "rh").distinct()
    rows = with_row_key(df, id_col, text_col, carry=True).join(shuffled(leaders), ["rk", "rh"]).dropDuplicates(["rk", "rh"])
    return carried(rows, df.columns, text_col, F.col("text"))
