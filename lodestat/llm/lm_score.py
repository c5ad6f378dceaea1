"""Language-model scoring by deleted interpolation of word bigrams.

P(w | v) mixes the maximum-likelihood bigram c(v w)/c(v) with the add-one
unigram (c(w)+1)/(N+V+1). The mixture weight depends on a bucket of the
context's frequency, floor(log2 c(v)), and is learned by expectation-maximisation
on deleted counts: every training token is held out in turn, i.e. scored with
its own occurrence taken off the counts. A context never seen in training has
weight 0. One end token follows each text; it also is the context of the first.

Counting is corpus-wide. Each block of texts counts its distinct words and
bigrams (64-bit hashes), the counts of all blocks meet by hash range, and the
totals return to the blocks, which score their own texts. So occurrences and
texts are never shuffled, and no key gets more than one entry for each block.
The likelihood ratios that EM needs are kept as histograms (1/16 of an octave),
whose size is fixed.

Null and empty texts are the end token alone. Ids may repeat or be null (a null
id counts as remainder 0). Other columns are ignored; with no training text at
all, every score is the uniform 1/(V+1) with V = 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetch, key_ranges, mix, pack, quoted, texts_of, trimmed, unpack, Lexicon, Staged

_END = b"\n"  # no word holds a white space
#: Bits of a bigram's hash; of 10**9 different bigrams, a few thousand share one.
BIGRAM_BITS = np.uint64(48)
BUCKETS, STEPS, LOWEST = 64, 16, -24 * 16
BINS = 2 + 88 * 16  # the first is for a ratio of 0


def _bigrams(h: np.ndarray, codes: np.ndarray, end: int) -> np.ndarray:
    """Key of each token with the one before it, for texts that each end in the end token."""
    before = np.concatenate([[end], codes[:-1]])
    return mix(h[before] * np.uint64(0x9E3779B97F4A7C15) + mix(h[codes])) >> (np.uint64(64) - BIGRAM_BITS)


def _counted(keys: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each stands in a training text."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(taught[order].astype(np.int64), first) if len(keys) else first


def _blocks(ranges: int, block_bytes: int):
    """mapInArrow: rows of kind 0 are texts (256 at most) as word numbers, of kind 1
    a block's word hashes, of kinds 2 and 3 its words' and bigrams' counts by hash
    range. The commonest words have the smallest numbers."""

    @trimmed
    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        state = {"meta": [], "docs": [], "held": [], "size": 0}
        lexicon = Lexicon(limit=1 << 62)
        end = int(lexicon.codes([_END])[0])

        def flush():
            nonlocal k, end
            block, k = (part << 24) + k, k + 1
            lexicon.hashed([_END])
            codes = np.concatenate(state["docs"])
            lens = np.array([len(d) for d in state["docs"]])
            taught = np.repeat(~np.array(state["held"]), lens)
            by_count = np.argsort(-np.bincount(codes), kind="stable")
            rank = np.empty(len(by_count), np.int64)
            rank[by_count] = np.arange(len(by_count))
            h, codes, end = lexicon.hashes[by_count], rank[codes], int(rank[end])

            def rows(kind, p, ids, held, lens, data):
                n = len(data)
                return pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(p, pa.int64()), pa.array(ids, pa.list_(state["type"])), pa.array(held, pa.list_(pa.bool_())), pa.array(lens, pa.binary()), pa.array(data, pa.binary())],
                    names=["block", "kind", "p", "ids", "held", "lens", "data"],
                )

            ends = np.cumsum(lens)
            for lo in range(0, len(lens), 256):
                hi = min(lo + 256, len(lens))
                some = codes[ends[lo] - lens[lo] : ends[hi - 1]]
                yield rows(0, [None], [state["meta"][lo:hi]], [state["held"][lo:hi]], [pack(lens[lo:hi])], [pack(some.astype(np.uint32))])
            yield rows(1, [None], [None], [None], [None], [h.tobytes()])
            for kind, bits, keys in ((2, np.uint64(64), h[codes]), (3, BIGRAM_BITS, _bigrams(h, codes, end))):
                keys, n = _counted(keys, taught)
                at = (keys >> (bits - np.uint64(32))) * np.uint64(ranges) >> np.uint64(32)
                ps, first = np.unique(at, return_index=True)
                cut = list(zip(first, [*first[1:], len(keys)], strict=True))
                gaps = [np.diff(keys[a:b], prepend=np.uint64(0)) for a, b in cut]
                none = [None] * len(ps)
                yield rows(kind, ps.astype(np.int64), none, none, [pack(n[a:b]) for a, b in cut], [pack(g) for g in gaps])
            lexicon.reset()
            end = int(lexicon.codes([_END])[0])
            state.update(meta=[], docs=[], held=[], size=0)

        for batch in batches:
            state["type"] = batch.column("id").type
            rows = zip(batch.column("id").to_pylist(), texts_of(batch.column("text")), batch.column("held_out").to_pylist(), strict=True)
            for i, text, held in rows:
                words = text.lower().split()
                words.append(_END)
                state["docs"].append(lexicon.codes(words))
                state["meta"].append(i)
                state["held"].append(held)
                state["size"] += len(text) + 16
                if state["size"] >= block_bytes:
                    yield from flush()
        if state["docs"]:
            yield from flush()

    return run


def _totals(table: pa.Table) -> pa.Table:
    """applyInArrow: the counts of one hash range added up over all blocks; each
    block gets the totals of its own keys back, in its own order."""
    kind = table["kind"][0].as_py()
    keys = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in table["data"]]
    counts = np.concatenate([unpack(x.as_py(), np.int64) for x in table["lens"]])
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, counts)
    ends = np.cumsum([len(x) for x in keys])
    replies = [pack(total[which[e - len(x) : e]]) for x, e in zip(keys, ends, strict=True)]
    n = len(replies)
    sums = [int(total.sum()), int((total > 0).sum())] if kind == 2 else [0, 0]
    return pa.table({
        "block": table["block"], "kind": table["kind"], "p": table["p"], "totals": pa.array(replies, pa.binary()),
        "tokens": pa.array([sums[0]] + [0] * (n - 1), pa.int64()), "types": pa.array([sums[1]] + [0] * (n - 1), pa.int64()),
    })


class _Block:
    """A block's tokens with their corpus-wide counts."""

    def __init__(self, docs: pa.Table, totals: pa.Table):
        kind = docs["kind"].to_numpy()
        texts = docs.take(np.flatnonzero(kind == 0))
        h = np.frombuffer(docs["data"][int(np.flatnonzero(kind == 1)[0])].as_py(), np.uint64)
        self.ids = pa.chunked_array([x.values for x in texts["ids"]], docs.schema.field("ids").type.value_type)
        self.held = np.array([y for x in texts["held"].to_pylist() for y in x], bool)
        self.lens = np.concatenate([unpack(x.as_py(), np.int64) for x in texts["lens"]])
        self.starts = np.cumsum(self.lens) - self.lens
        codes = np.concatenate([unpack(x.as_py(), np.uint32) for x in texts["data"]]).astype(np.int64)
        end = int(codes[-1])  # every text's last token
        before = np.concatenate([[end], codes[:-1]])
        kinds, ps, packed = totals["kind"].to_numpy(), totals["p"].to_numpy(), totals["totals"].to_pylist()
        of = {k: np.concatenate([unpack(packed[i], np.int64) for i in sorted(np.flatnonzero(kinds == k), key=lambda i: ps[i])]) for k in (2, 3)}
        by_word = np.empty(len(h), np.int64)
        by_word[np.argsort(h, kind="stable")] = of[2]
        self.c, self.context = by_word[codes], by_word[before]
        keys = _bigrams(h, codes, end)
        _, which = np.unique(keys, return_inverse=True)
        self.pair = of[3][which]

    def bucket(self) -> np.ndarray:
        return np.frexp(self.context.astype(float))[1].clip(0, BUCKETS - 1)


def _ratios(tokens: int, types: int):
    """cogroup: by bucket, the histogram of (deleted bigram)/(deleted unigram)
    probability over the training tokens."""

    def run(key, docs: pa.Table, totals: pa.Table) -> pa.Table:
        b = _Block(docs, totals)
        taught = np.repeat(~b.held, b.lens)
        c, context, pair, bucket = b.c[taught], b.context[taught], b.pair[taught], b.bucket()[taught]
        one = c / (tokens - 1 + types + 1)
        two = (pair - 1) / np.maximum(context - 1, 1)
        with np.errstate(divide="ignore"):
            at = np.where(two > 0, np.clip(np.rint(np.log2(two / one) * STEPS) - LOWEST, 0, BINS - 2) + 1, 0).astype(np.int64)
        found, n = np.unique(bucket * BINS + at, return_counts=True)
        return pa.table({"bin": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def fit_weights(bins: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """One mixture weight for each bucket, by EM over the ratio histogram."""
    weights = np.zeros(BUCKETS)
    for b in np.unique(bins // BINS):
        own = bins // BINS == b
        at, mass = bins[own] % BINS, n[own].astype(float)
        ratio = np.where(at > 0, np.exp2((at - 1 + LOWEST) / STEPS), 0.0)
        w = 0.5
        for _ in range(rounds):
            w = float((mass * (w * ratio / (w * ratio + 1 - w))).sum() / mass.sum())
            w = min(max(w, 1e-9), 1 - 1e-9)
        weights[b] = w
    return weights


def _scores(tokens: int, types: int, weights: np.ndarray):
    def run(key, docs: pa.Table, totals: pa.Table) -> pa.Table:
        b = _Block(docs, totals)
        one = (b.c + 1) / (tokens + types + 1)
        w = np.where(b.context > 0, weights[b.bucket()], 0.0)
        mixed = w * (b.pair / np.maximum(b.context, 1)) + (1 - w) * one
        at = b.starts
        return pa.table({
            "id": b.ids, "held_out": pa.array(b.held), "n_tokens": pa.array(b.lens, pa.int64()), "n_known": pa.array(np.add.reduceat((b.c > 0).astype(np.int64), at)),
            "base_score": pa.array(np.add.reduceat(np.log10(one), at)), "score": pa.array(np.add.reduceat(np.log10(mixed), at)),
        })

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, block_bytes: int = 6 << 20) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of
    every text; the model learns from rows whose crc32(id) mod ``modulus`` is
    not ``remainder``. base_score is the unigram's log10, score the mixture's."""
    src = df.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    src = src.withColumn("held_out", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % modulus == remainder, F.lit(False)))
    kind = src.schema["id"].dataType.simpleString()
    ranges = key_ranges(src)
    blocks = Staged(src.mapInArrow(_blocks(ranges, block_bytes), f"block long, kind int, p long, ids array<{kind}>, held array<boolean>, lens binary, data binary"), "lm-blocks", by=["kind"])
    asked = blocks.df.where("kind > 1").select("block", "kind", "p", "lens", "data")
    totals = Staged(asked.groupBy("kind", "p").applyInArrow(_totals, "block long, kind int, p long, totals binary, tokens long, types long"), "lm-totals")
    tokens, types = totals.df.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()

    for done in ("kind=2", "kind=3"):
        blocks.drop(done)
    docs = blocks.df.where("kind < 2").select("block", "kind", "ids", "held", "lens", "data")
    both = docs.groupBy("block").cogroup(totals.df.select("block", "kind", "p", "totals").groupBy("block"))
    seen = fetch(both.applyInArrow(_ratios(tokens, types), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")))  # BUCKETS * BINS rows at most
    weights = fit_weights(seen["bin"].to_numpy(np.int64), seen["n"].to_numpy(np.int64))
    out = both.applyInArrow(_scores(tokens, types, weights), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))
