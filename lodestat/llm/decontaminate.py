"""Benchmark decontamination by a prefix-filtered set join with exact checks.

An item's *windows* are its runs of ``window`` consecutive words (an item of
fewer words is one window). A document contains a window only if it contains
every word of it, so a prefix of one word, the first in an order by rarity, is enough
to join on: the rarest word by document frequency over the whole corpus.

1. Windows: the distinct windows of all items, with 64-bit hashes of their words.
2. Order: in how many documents each benchmark word stands; each window's rarest
   word and its offset in the window are its prefix entry. A window with a word that
   no document holds goes.
3. Candidates: each place of a prefix word in a document, with the offset and length
   of an entry, fixes where a window would start (the positional bound); it must fit
   into the document (the length bound).
4. Join and check: candidates meet the windows in a shuffle on the hash (128 bits) of
   the item-sized window of words around the place, so a frequent prefix word spreads
   over many keys, and only equal windows meet.

What documents are filtered by before a shuffle (words, entries, windows) are bitmaps
of ``2**filter_bits`` bits, whatever the benchmark's size; they let some rows through
that the join then drops, and never hold one back. Documents are read twice, their
texts are never shuffled (but for ``carry``).

Words are lower-cased (A-Z only) runs of letters, digits and non-ASCII
characters. Null and empty texts have no words and no hits; items without words have
no windows. Repeated items count one each; ids may be null (a null item id is left
out of the list of ids). Other columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, Staged, fetch, fields, mix, prepare, quoted, shuffled, slices, texts_of, trimmed, with_row_key

#: Lower case for A-Z; ASCII characters that are neither letter nor digit become spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Odd multipliers of the polynomial hashes; any odd 64-bit values serve.
_ONE, _TWO = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _flat(lexicon: Lexicon, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some texts end to end, the text of each, and where each
    text begins (and the last one ends)."""
    split = [words_of(t) for t in texts]
    ends = np.cumsum([0, *map(len, split)])
    return lexicon.hashed([w for words in split for w in words]), np.repeat(np.arange(len(split)), np.diff(ends)), ends


def _windows_at(h: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the n words from each start on; the length is part of them."""
    one, two = np.zeros((2, len(start)), np.uint64)
    for k in range(n):
        word = h[start + k]
        one, two = one * np.uint64(_ONE) + word, two * np.uint64(_TWO) + mix(word)
    return mix(one + np.uint64(n)), mix(two + np.uint64(n))


def _entry(h: np.ndarray, offset, n) -> np.ndarray:
    """Hash of a prefix entry: word, its offset, length of the window."""
    return mix(h + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(offset, np.uint64) * np.uint64(1 << 16) + np.asarray(n, np.uint64)))


class Bitmap:
    """A set of hashes that may hold more than it was given. Its size is fixed."""

    def __init__(self, bits: int, cells: np.ndarray, masks: np.ndarray):
        self.bits = bits
        self.cells = np.zeros(1 << max(bits - 3, 0), np.uint8)
        np.bitwise_or.at(self.cells, cells, masks.astype(np.uint8))

    @staticmethod
    def of(df: DataFrame, column: str, bits: int) -> Bitmap:
        """Of a column of hashes; at most a row for each byte comes to the driver."""
        place = F.explode(F.array(F.shiftrightunsigned(F.col(column), 64 - bits), F.shiftrightunsigned(F.shiftleft(F.col(column), bits), 64 - bits))).alias("p")
        cells = df.select(place).select(F.shiftright("p", 3).alias("cell"), F.expr("shiftleft(1, cast(p & 7 as int))").alias("mask")).groupBy("cell").agg(F.bit_or("mask").alias("mask"))
        found = fetch(cells)
        return Bitmap(bits, found["cell"].to_numpy(np.int64), found["mask"].to_numpy(np.int64))

    def holds(self, h: np.ndarray) -> np.ndarray:
        down = np.uint64(64 - self.bits)
        out = np.ones(len(h), bool)
        for p in (h >> down, (h << np.uint64(self.bits)) >> down):
            out &= (self.cells[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _item_windows(window: int):
    """The distinct windows of each item."""

    def run(batches):
        lexicon = Lexicon()
        for batch in batches:
            for some in slices(batch, "text"):
                h, _, ends = _flat(lexicon, texts_of(some.column("text")))
                size = np.minimum(np.diff(ends), window)
                for n in np.unique(size[size > 0]).tolist():
                    items = np.flatnonzero(size == n)
                    each = np.diff(ends)[items] - n + 1  # windows of each item
                    at = np.repeat(items, each)
                    start = np.repeat(ends[items], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    one, two = _windows_at(h, start, n)
                    order = np.lexsort((two, one, at))
                    new = np.concatenate([[True], (np.diff(at[order]) != 0) | (np.diff(one[order].view(np.int64)) != 0) | (np.diff(two[order].view(np.int64)) != 0)])
                    first = order[new]
                    rows = pa.array(at[first], pa.int64())
                    words = pa.FixedSizeListArray.from_arrays(_signed(h[start[first][:, None] + np.arange(n)].ravel()), n).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("item_no").take(rows), some.column("item_id").take(rows), _signed(one[first]), _signed(two[first]), pa.array(np.full(len(first), n, np.int32)), words], names=["item_no", "item_id", "one", "two", "n", "words"]
                    )

    return run


def _frequencies(shared):
    """Documents of a task that hold each benchmark word."""

    @trimmed
    def run(batches):
        known, lexicon, found, size = shared.value, Lexicon(), [], 0

        def counted():
            words, n = (np.concatenate(x) for x in zip(*found, strict=True))
            distinct, at = np.unique(words, return_inverse=True)
            return distinct, np.bincount(at, weights=n).astype(np.int64)

        for batch in batches:
            for some in slices(batch, 0):
                h, doc, _ = _flat(lexicon, texts_of(some.column(0)))
                own = np.flatnonzero(known.holds(h))
                order = own[np.lexsort((h[own], doc[own]))]
                again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])]) if len(order) else np.empty(0, bool)
                words, n = np.unique(h[order[~again]], return_counts=True)  # a word counts once in a document
                found.append((words, n))
                size += len(words)
                if size > 1_000_000:
                    found = [counted()]
                    size = len(found[0][0])
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([_signed(found[0][0]), pa.array(found[0][1])], names=["word", "df"])
                        found, size = [], 0
        if found:
            words, n = counted()
            yield pa.RecordBatch.from_arrays([_signed(words), pa.array(n)], names=["word", "df"])

    return run


def _entries(batches):
    """Hash of each window's prefix entry."""
    for batch in batches:
        h = batch.column("word").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("one"), _signed(_entry(h, batch.column("offset").to_numpy(), batch.column("n").to_numpy()))], names=["word", "one", "entry"])


def _candidates(shared, columns: list[str]):
    """Number of words of each document, and the windows that its prefix words point at."""

    @trimmed
    def run(batches):
        words, entries, windows, lengths = shared.value
        lexicon = Lexicon()
        for batch in batches:
            for some in slices(batch, "text"):
                h, doc, ends = _flat(lexicon, texts_of(some.column("text")))
                place, found = np.flatnonzero(words.holds(h)), []
                for n in lengths if len(place) else ():
                    start = np.unique(np.concatenate([place[entries.holds(_entry(h[place], o, n))] - o for o in range(n)]))
                    start = start[(start >= 0) & (start + n <= len(h))]
                    start = start[doc[start] == doc[start + n - 1]]  # it fits into the document
                    one, two = _windows_at(h, start, n)
                    kept = windows.holds(one)
                    found.append((start[kept], one[kept], two[kept], np.full(kept.sum(), n)))
                start, one, two, n = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 2, np.empty(0, np.int64))
                order = np.argsort(start, kind="stable")
                start, one, two, n = (x[order] for x in (start, one, two, n))
                column = pa.StructArray.from_arrays([_signed(one), _signed(two), pa.array(start - ends[doc[start]], pa.int32()), pa.array(n, pa.int32())], names=["one", "two", "start", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, ends), pa.int32()), column)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), pa.array(np.diff(ends), pa.int64()), lists], names=[*columns, "n_words", "candidates"])

    return run


def find_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, filter_bits: int = 24, carry: bool = False) -> DataFrame:
    """``id, n_words, spans, item_ids`` of every document: the word ranges inside
    occurrences of item windows, and the items (ids as strings) they come from.
    carry adds ``text`` and ``row``, a struct of the row's other columns."""
    spark = df.sparkSession
    prepare(spark)
    items = benchmark.select(quoted(item_col).cast("string").alias("item_id"), quoted(item_text_col).cast("string").alias("text"))
    items = Staged(items.withColumn("item_no", F.monotonically_increasing_id()), "items").df
    key = ["one", "two", "n"]
    owned = items.mapInArrow(_item_windows(window), "item_no long, item_id string, one long, two long, n int, words array<long>")
    windows = Staged(owned.groupBy(*key).agg(F.first("words").alias("words"), F.collect_set(F.struct("item_no", "item_id")).alias("items")), "item-windows").df

    texts = with_row_key(df, id_col, text_col, carry)
    terms = windows.select(*key, F.posexplode("words").alias("offset", "word"))
    known = spark.sparkContext.broadcast(Bitmap.of(terms.select("word"), "word", filter_bits))
    seen = texts.select("text").mapInArrow(_frequencies(known), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    rarity = terms.join(shuffled(Staged(seen, "word-frequencies").df), "word", "left").groupBy(*key).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "word")).alias("rarest"))
    prefix = Staged(rarity.where("rarest.df > 0").select(*key, "rarest.offset", "rarest.word"), "window-prefixes").df
    entries = Staged(prefix.select("word", "one", "offset", "n").mapInArrow(_entries, "word long, one long, entry long"), "prefix-entries").df
    lengths = sorted(r["n"] for r in prefix.select("n").distinct().collect())  # window lengths, 1 to window
    shared = spark.sparkContext.broadcast((*(Bitmap.of(entries, c, filter_bits) for c in ("word", "entry", "one")), lengths))

    place = ["id", "rk", "rh"]
    pointed = Staged(texts.select(*place, "text").mapInArrow(_candidates(shared, place), fields(texts, place, "n_words long, candidates array<struct<one:bigint,two:bigint,start:int,n:int>>")), "window-candidates").df
    kept = windows.join(shuffled(prefix.select(*key)), key).select(*key, "items")
    hits = pointed.select("rk", "rh", F.inline("candidates")).join(shuffled(Staged(kept, "windows-kept").df), key)
    spans = F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))).alias("spans")
    hits = Staged(hits.groupBy("rk", "rh").agg(spans, F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")), "window-hits").df
    hits = hits.select("rk", "rh", _union_spans(F.col("spans")).alias("spans"), F.transform("items", lambda x: x["item_id"]).alias("item_ids"))

    rows = pointed.select(*place, "n_words")
    columns = ["id"]
    if carry:  # texts meet what was found of them by row; rows equal in id and text share it
        columns = ["id", "text", "row"]
        rows = texts.join(shuffled(pointed.select("rk", "rh", "n_words").dropDuplicates(["rk", "rh"])), ["rk", "rh"])
    none = F.array().cast("array<struct<start:int,stop:int>>"), F.array().cast("array<string>")
    return rows.join(shuffled(hits), ["rk", "rh"], "left").select(*columns, "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("item_ids", none[1]).alias("item_ids"))


def _union_spans(spans):
    """Column: overlapping or touching ranges as one."""
    kind = "array<struct<start:int,stop:int>>"
    return F.aggregate(
        F.array_sort(spans.cast(kind)),
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def n_hit():
    """Column: words inside any span."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["stop"] - s["start"]))
