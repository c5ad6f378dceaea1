"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

A text is cut before every single space that a non-space follows; no match of
the tokenizer's pattern crosses such a place, so each piece ("word") encodes the
same wherever it stands. Then

1. each block of texts (at most ``block_bytes``) numbers its distinct words and
   keeps every text as the numbers of its words in order, i.e. by position;
2. the distinct words of all blocks meet by hash range, and every distinct word
   is encoded once (its pattern matches separately);
3. the ids go back to the blocks that asked, where texts are put together again
   by position.

Only words distinct within a block are shuffled, never occurrences or texts, so
a very frequent word is one row for each block and no group can grow hot.
Decoding joins ids with the token-byte table, whose size the vocabulary fixes.

Null and empty texts have no ids and decode to no bytes. Ids may repeat or be
null. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import Staged, gather, hash64, key_ranges, pack, prepare, quoted, slices, trimmed, unpack, with_column

_CUT = re.compile(r"(?= \S)")
_IRREGULAR = re.compile(r" (?:\s|$)")
_encoders: dict[tuple[str, str], object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def words_of(text: str) -> list[str]:
    """The pieces of a text between which no pattern match can stand."""
    if not text:
        return []
    if _IRREGULAR.search(text):
        return [w for w in _CUT.split(text) if w]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + w for w in rest]


def _digest(ranks: dict[bytes, int]) -> str:
    return xxhash.xxh3_128_hexdigest(b"".join(b"%d:%d:%b" % (i, len(t), t) for t, i in ranks.items()))


def _encoder(digest: str, ranks: dict[bytes, int], pattern: str):
    """One encoder for each Python worker, vocabulary and pattern."""
    key = (digest, pattern)
    if key not in _encoders:
        import tiktoken

        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _blocks(ranges: int, block_bytes: int):
    """mapInArrow: texts to numbered words. Rows of kind 0 hold texts (256 at
    most), of kind 1 the words of one block in one hash range, of kind 2 the place
    of each word number among them. The commonest words have the smallest numbers."""

    def flush(block: int, ids: list, docs: list, number: dict):
        words = [w.encode() for w in number]
        at = np.fromiter((hash64(w) % ranges for w in words), np.int64, len(words))
        order = sorted(range(len(words)), key=lambda i: (at[i], words[i]))
        counts = np.bincount(np.concatenate(docs), minlength=len(words)) if words else np.empty(0, np.int64)
        by_count = np.argsort(-counts, kind="stable")
        rank, place = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
        rank[by_count] = np.arange(len(words), dtype=np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        for lo in range(0, len(ids), 256):
            some = docs[lo : lo + 256]
            yield block, 0, [None], [ids[lo : lo + 256]], [pack(np.array([len(d) for d in some], np.uint32))], [pack(rank[np.concatenate(some)], 6)]
        ps, first = np.unique(at[order], return_index=True)
        lens, blobs = [], []
        for a, b in zip(first, [*first[1:], len(order)], strict=True):
            own = [words[i] for i in order[a:b]]
            lens.append(pack(np.fromiter(map(len, own), np.uint32, len(own))))
            blobs.append(pack(np.frombuffer(b"".join(own), np.uint8), 12))
        yield block, 1, ps.tolist(), [None] * len(ps), lens, blobs
        yield block, 2, [None], [None], [None], [pack(place[by_count])]

    @trimmed
    def run(batches):
        from pyspark import TaskContext

        part, k, id_type = TaskContext.get().partitionId(), 0, None
        ids, docs, size = [], [], 0
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__

        def rows(block, kind, p, i, codes, blob):
            n = len(p)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array(i, pa.list_(id_type)), pa.array([kind] * n, pa.int32()), pa.array(p, pa.int64()), pa.array(codes, pa.binary()), pa.array(blob, pa.binary())],
                names=["block", "ids", "kind", "p", "lens", "data"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                i, text = i.as_py(), text.as_py()
                words = words_of(text or "")
                docs.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                ids.append(i)
                size += len(text or "")
                if size >= block_bytes:
                    for x in flush((part << 24) + k, ids, docs, number):
                        yield rows(*x)
                    ids, docs, size, k = [], [], 0, k + 1
                    number.clear()
        if ids:
            for x in flush((part << 24) + k, ids, docs, number):
                yield rows(*x)

    return run


def _encode_range(shared, pattern: str):
    """applyInArrow: the words of one hash range, from all blocks; each distinct
    word is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        encode = _encoder(*shared.value, pattern).encode_ordinary
        number: dict[bytes, int] = {}
        ids: list[list[int]] = []
        lens_out, ids_out = [], []
        for lens, blob in zip(table["lens"], table["data"], strict=True):
            raw, which, at = unpack(blob.as_py(), np.uint8).tobytes(), [], 0
            for n in unpack(lens.as_py(), np.uint32).tolist():
                word = raw[at : at + n]
                at += n
                k = number.setdefault(word, len(ids))
                if k == len(ids):
                    ids.append(encode(word.decode()))
                which.append(k)
            lens_out.append(pack(np.fromiter((len(ids[k]) for k in which), np.uint32, len(which))))
            ids_out.append(pack(np.fromiter((x for k in which for x in ids[k]), np.uint32), 9))
        return pa.table({"block": table["block"], "p": table["p"], "lens": pa.array(lens_out, pa.binary()), "ids": pa.array(ids_out, pa.binary())})

    return run


class _TokenBytes:
    """The token-byte table: the bytes of each id, end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts, self.flat = np.cumsum(self.lens) - self.lens, np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.starts, self.lens, ids.astype(np.int64)).tobytes()


def _reassemble(shared):
    """cogroup: put the texts of a block together again by position; shared: the
    token-byte table, if the ids are to be decoded as well."""

    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words["p"].to_numpy(), kind="stable").tolist()
        lens_of, ids_of = words["lens"].to_pylist(), words["ids"].to_pylist()
        none = np.empty(0, np.uint32)
        lens = np.concatenate([none, *(unpack(lens_of[i], np.uint32) for i in order)]).astype(np.int64)
        flat = np.concatenate([none, *(unpack(ids_of[i], np.uint32) for i in order)])
        starts = np.cumsum(lens) - lens
        kind, ids, doc_lens, data = docs["kind"].to_pylist(), docs["ids"], docs["lens"].to_pylist(), docs["data"].to_pylist()
        place = unpack(data[kind.index(2)], np.uint32).astype(np.int64)
        starts, lens = starts[place], lens[place]
        own, out, n, texts = [], [], [], []
        for k in (i for i, x in enumerate(kind) if x == 0):
            codes, at = unpack(data[k], np.uint32).astype(np.int64), 0
            for m in unpack(doc_lens[k], np.uint32).tolist():
                tokens = gather(flat, starts, lens, codes[at : at + m])
                at += m
                out.append(tokens.astype("<u4").tobytes())
                n.append(len(tokens))
                if shared is not None:
                    texts.append(shared.value.decode(tokens))
            own.append(ids[k].values)
        columns = {"id": pa.chunked_array(own, docs.schema.field("ids").type.value_type), "n_tokens": pa.array(n, pa.int64()), "ids_le": pa.array(out, pa.binary())}
        return pa.table(columns | ({} if shared is None else {"decoded": pa.array(texts, pa.binary())}))

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, decoded: bool = False) -> DataFrame:
    """``id, n_tokens, ids_le``: a text's token ids as little-endian unsigned
    32-bit integers, as the tiktoken library's encode_ordinary gives them; with
    ``decoded``, also what :func:`decode` gives of them, in the same pass.
    :func:`as_array` turns them into an array column."""
    spark = df.sparkSession
    prepare(spark)
    ranks = load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((_digest(ranks), ranks))  # the vocabulary's size bounds it
    src = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    ranges = key_ranges(src)
    row = f"block long, ids array<{kind}>, kind int, p long, lens binary, data binary"
    blocks = Staged(src.mapInArrow(_blocks(ranges, block_bytes), row), "bpe-blocks", by=["kind"], bucket="block")
    asked = blocks.df.where("kind = 1").select("block", "p", "lens", "data")
    replies = Staged(asked.groupBy("p").applyInArrow(_encode_range(shared, pattern), "block long, p long, lens binary, ids binary"), "bpe-ids")
    blocks.drop("kind=1")
    docs = blocks.df.where("kind != 1").select("block", "kind", "ids", "lens", "data")
    table = spark.sparkContext.broadcast(_TokenBytes(ranks)) if decoded else None
    return docs.groupBy("block").cogroup(replies.df.groupBy("block")).applyInArrow(_reassemble(table), f"id {kind}, n_tokens long, ids_le binary" + (", decoded binary" if decoded else ""))


def as_array(ids_le: str = "ids_le"):
    """Column: packed ids as array<int>."""

    @F.pandas_udf("array<int>")
    def unpacked(s):
        return s.map(lambda b: np.frombuffer(b, "<u4").astype(np.int32))

    return unpacked(F.col(ids_le))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids_le") -> DataFrame:
    """Add ``decoded``: the bytes of the ids, from the token-byte table. Every
    other column stays as it is."""
    spark: SparkSession = df.sparkSession
    if "decoded" in df.columns:
        raise ValueError("the rows have a column decoded already")
    shared = spark.sparkContext.broadcast(_TokenBytes(load_ranks(ranks_path)))
    at = df.columns.index(ids_col)

    @trimmed
    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                text = [None if b is None else shared.value.decode(np.frombuffer(b, "<u4")) for b in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.binary())], names=[*part.schema.names, "new"])

    return with_column(df, run, "decoded", BinaryType())


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    both = encode(df, ranks_path, pattern, id_col, text_col, decoded=True)
    return both.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


