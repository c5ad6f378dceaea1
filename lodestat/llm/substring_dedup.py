"""Exact removal of repeated word windows by relative Lempel-Ziv parsing.

The corpus is its own reference, held as many small *reference blocks*. A block
is named by an anchor, the smallest hash of a ``gram``-word sequence inside a
window; since a window's words fix its anchor, equal windows always meet in the
same block, and a document is factored only against blocks that can hold a
factor of it. Consecutive windows with one anchor position form a segment. A block
indexes its distinct segments by hash, each with the first place where it stands.

1. *Index*: segments whose anchor occurs once in the corpus match nothing and go.
2. *Matches*: a segment that a block holds more than once matches its first place
   over all its windows.
3. *Factor boundaries*: a segment that differs from the others of its block can
   still share some windows with them: the ends of factors that begin or end inside
   it. Only there is each window looked up by itself, among the distinct segments
   of the block.
4. *Parse*: each document is factored greedily from left to right. A factor starts
   at the first window not yet factored that matches the reference and grows for as
   long as the next window matches at the next place of the same reference text;
   then a new factor starts. Words in no factor are literals. A factor has
   ``window`` words at least, and the union of the factors is what repeats.

Only matches come to a document, never the texts that it matches, so a passage that
a third of all documents share costs them one row each. All groups are counted,
never collected, and counts are combined before each shuffle. Windows compare by
128-bit hashes of their words.

Results: null and empty texts have no words and keep nothing. Two rows equal in
id and text are two documents. Ids may be null. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, Staged, fields, mix, shuffled, slices, texts_of, trimmed, window_hash, with_row_key

#: Odd multipliers of the polynomial hashes; any odd 64-bit values serve.
_GRAM, _ONE, _TWO, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _leftmost_min(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of the leftmost smallest entry of each window of g."""
    value, place, size = g, np.arange(len(g)), 1
    while size < width:
        step = min(size, width - size)
        later = value[step:] < value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        size += step
    return value, place


def _window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(window_hash(h, window, _ONE)), mix(window_hash(mix(h), window, _TWO))


def _segments(h: np.ndarray, window: int, gram: int):
    """(anchor, hash, hash, first window, windows) of each segment of a text."""
    value, place = _leftmost_min(mix(window_hash(h, gram, _GRAM)), window - gram + 1)
    start = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    n = np.diff(np.append(start, len(place)))
    step = (np.arange(len(place)) - np.repeat(start, n)).astype(np.uint64) * np.uint64(_STEP)
    one, two = (np.add.reduceat(mix(w + step), start) for w in _window_hashes(h, window))
    return value[start], one, two, start, n


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64))


def _index(window: int, gram: int):
    @trimmed
    def run(batches):
        lexicon = Lexicon()
        for batch in batches:
            texts, rk, rh = texts_of(batch.column("text")), batch.column("rk").to_numpy(), batch.column("rh").to_numpy()
            found, rows, words = [], [], 0
            for i, text in enumerate(texts):
                split = text.split()
                if len(split) >= window:
                    found.append(_segments(lexicon.hashed(split), window, gram))
                    rows.append(i)
                    words += len(split)
                if found and (words > 500_000 or i == len(texts) - 1):
                    a, one, two, start, n = zip(*found, strict=True)
                    at = np.repeat(rows, [len(x) for x in a])
                    yield pa.RecordBatch.from_arrays(
                        [_signed(a), _signed(one), _signed(two), pa.array(rk[at]), pa.array(rh[at]), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(n).astype(np.int32))],
                        names=["anchor", "one", "two", "rk", "rh", "s", "n"],
                    )
                    found, rows, words = [], [], 0

    return run


def _boundaries(window: int):
    """Each window of the segments that must be looked up window by window."""

    @trimmed
    def run(batches):
        lexicon = Lexicon()
        for batch in batches:
            rk, rh = batch.column("rk").to_numpy(), batch.column("rh").to_numpy()
            for i, (text, parts) in enumerate(zip(texts_of(batch.column("text")), batch.column("parts").to_pylist(), strict=True)):
                one, two = _window_hashes(lexicon.hashed(text.split()), window)
                at = np.concatenate([np.arange(p["s"], p["s"] + p["n"]) for p in parts])
                alone = np.repeat([p["alone"] for p in parts], [p["n"] for p in parts])
                yield pa.RecordBatch.from_arrays(
                    [_signed([one[at]]), _signed([two[at]]), pa.array(np.full(len(at), rk[i])), pa.array(np.full(len(at), rh[i])), pa.array(at.astype(np.int32)), pa.array(alone)],
                    names=["one", "two", "rk", "rh", "s", "alone"],
                )

    return run


def parse(s: np.ndarray, n: np.ndarray, rk: np.ndarray, rh: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """Greedy factors from the matches of a document: windows s .. s+n-1 stand at
    ``there`` of the reference text (rk, rh). A factor grows while the next match
    follows it here and there; gives the factors in the same form."""
    order = np.argsort(s, kind="stable")
    s, n, rk, rh, there = (x[order] for x in (s, n, rk, rh, there))
    follows = (s[:-1] + n[:-1] == s[1:]) & (rk[:-1] == rk[1:]) & (rh[:-1] == rh[1:]) & (there[:-1] + n[:-1] == there[1:])
    first = np.flatnonzero(np.concatenate([[True], ~follows])) if len(s) else np.empty(0, np.int64)
    return s[first], np.add.reduceat(n, first) if len(s) else n, rk[first], rh[first], there[first]


_FACTOR = "struct<start:int,stop:int,source_rk:bigint,source_rh:int,source_start:int>"


def _structs(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Array:
    """A list of structs for each row, from the columns of its structs."""
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
    ends = np.cumsum([0, *(len(r[0]) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names))


def _cut(window: int):
    """Parse each document and drop the words of its factors."""

    @trimmed
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                column = some.column("matches")
                ends = np.cumsum(np.fromiter((len(x) if x.is_valid else 0 for x in column), np.int64, len(column)))
                flat = [x.to_numpy() for x in column.flatten().flatten()]
                n_words, n_removed, kept, spans, factors = [], [], [], [], []
                for text, a, b in zip(texts_of(some.column("text")), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    words = text.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    s, n, rk, rh, there = parse(*(x[a:b] for x in flat))
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    factors.append((s, s + n + window - 1, rk, rh, there))
                    spans.append((turn[::2], turn[1::2]))
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(s) else words))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("id", "rk", "rh")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                     _structs(spans, ["start", "stop"], [pa.int32()] * 2), _structs(factors, ["start", "stop", "source_rk", "source_rh", "source_start"], [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()])],
                    names=["id", "rk", "rh", "n_words", "n_removed", "kept", "spans", "factors"],
                )

    return run


def matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8) -> DataFrame:
    """``rk, rh, s, n, at``: the windows s .. s+n-1 of the text named (rk, rh) each
    start somewhere else too; ``at`` (rk, rh, s) is where they start in the reference."""
    texts = with_row_key(df, id_col, text_col)
    place = "rk long, rh int, s int, n int"
    index = Staged(texts.select("text", "rk", "rh").mapInArrow(_index(window, gram), f"anchor long, one long, two long, {place}"), "rlz-index")
    # what is joined with corpus-sized rows is a table of its own, so that a hot anchor's rows can be split in the join
    shared = Staged(index.df.groupBy("anchor").count().where("count > 1").select("anchor"), "rlz-anchors")
    blocks = Staged(index.df.join(shuffled(shared.df), "anchor"), "rlz-blocks")
    index.drop()
    shared.drop()

    key = ["anchor", "one", "two"]
    segments = Staged(blocks.df.groupBy(*key).agg(F.count("*").alias("c"), F.min(F.struct("rk", "rh", "s", "n")).alias("at")), "rlz-segments")
    repeated = segments.df.where("c > 1").select(*key, F.struct("at.rk", "at.rh", "at.s").alias("at"))
    whole = blocks.df.join(shuffled(repeated), key).select("rk", "rh", "s", "n", "at")
    mixed = Staged(segments.df.groupBy("anchor").agg(F.count("*").alias("m"), F.min("c").alias("least")).where("m > 1 and least = 1").select("anchor"), "rlz-mixed")
    asked = segments.df.join(shuffled(mixed.df), "anchor").groupBy("at.rk", "at.rh").agg(F.collect_list(F.struct("at.s", "at.n", (F.col("c") == 1).alias("alone"))).alias("parts"))
    once = texts.select("text", "rk", "rh").join(shuffled(asked), ["rk", "rh"]).dropDuplicates(["rk", "rh"]).select("text", "rk", "rh", "parts")
    windows = Staged(once.mapInArrow(_boundaries(window), "one long, two long, rk long, rh int, s int, alone boolean"), "rlz-boundaries")
    twice = windows.df.groupBy("one", "two").agg(F.count("*").alias("c"), F.min(F.struct("rk", "rh", "s")).alias("at")).where("c > 1").select("one", "two", "at")
    edges = windows.df.where("alone").join(shuffled(Staged(twice, "rlz-windows").df), ["one", "two"]).select("rk", "rh", "s", F.lit(1).alias("n"), "at")
    return whole.unionByName(edges)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8) -> DataFrame:
    """``id, rk, rh, n_words, n_removed, kept, spans, factors``: every text without the
    words of windows that start anywhere else as well. spans are the word ranges cut
    out; factors is the parse, word ranges with the reference text (rk, rh) and the
    word there that they are copied from (the reference's own copy names itself)."""
    found = matches(df, id_col, text_col, window, gram).groupBy("rk", "rh").agg(F.collect_set(F.struct("s", "n", "at.rk", "at.rh", F.col("at.s").alias("there"))).alias("matches"))  # a set: rows equal in id and text have one parse
    texts = with_row_key(df, id_col, text_col)
    joined = texts.join(shuffled(Staged(found, "rlz-matches").df), ["rk", "rh"], "left").select("id", "rk", "rh", "text", "matches")
    return joined.mapInArrow(_cut(window), fields(texts, ["id", "rk", "rh"], f"n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>, factors array<{_FACTOR}>"))
