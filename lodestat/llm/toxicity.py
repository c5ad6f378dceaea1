"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams (3 to 6 bytes, with marks
at both ends), hashed into ``2**bits`` embeddings. A segment of about
``segment`` words is the average of its embeddings (a shorter text counts as filled up
with words that say nothing), and a softmax over two classes reads it;
embeddings and softmax are trained jointly with numpy (gradient descent with
momentum). Misspelt and
inflected words share most n-grams with those seen, and so their vectors. As a
few words make a long text toxic, a text scores as its worst segment does: after
a first round on all segments, training goes on with the segments of toxic texts
that the model itself points at, and a logistic fit maps the worst segment's
margin to the probability of label 1.

Training reads at most ``max_per_class`` rows of label 0 and half as many of label
1 (smallest hash of the id); of these, texts of more than ``max_train_words`` words (or 12
times as many characters) are left out of training and not replaced. Scoring reads every whole
text, in slices bounded by bytes, so that long texts need no more memory than short ones. What is broadcast is one number for each bucket.

Null and empty texts get the score of a segment without words. Rows with a null
label or id don't train; with fewer than two classes, every score is the smoothed
share of label 1. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Lexicon, gather, mix, prepare, quoted, slices, trim, trimmed, with_column
from .decontaminate import WORD_BYTES


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(WORD_BYTES).split()


def subwords(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of every word."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lens)
    end = np.repeat(np.cumsum(lens), lens)
    place = np.arange(len(data))
    h = mix(data.astype(np.uint64) + np.uint64(1))
    rolling, owners, buckets = h, [], []
    down = np.uint64(64 - bits)
    for n in range(2, 7):
        if len(data) < n:
            break
        rolling = rolling[:-1] * np.uint64(0x100000001B3) + h[n - 1 :]
        if n >= 3:
            ok = place[: len(rolling)] + n <= end[: len(rolling)]
            owners.append(owner[: len(rolling)][ok])
            buckets.append((mix(rolling[ok]) >> down).astype(np.int64))
    whole = Lexicon(limit=1 << 62).hashed(words) if words else np.empty(0, np.uint64)
    return np.concatenate([*owners, np.arange(len(words))]), np.concatenate([*buckets, (mix(whole) >> down).astype(np.int64)])


@dataclass
class Model:
    """margin = mean of ``weight`` over a segment's features + bias; the score is
    sigmoid(slope * worst margin + shift)."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int
    segment: int


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _unrepeated(codes: np.ndarray) -> np.ndarray:
    """Without words that repeat the one before."""
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def _starts(n: int, segment: int) -> np.ndarray:
    """First words of a text's segments, which are as equal as can be."""
    k = max(round(n / segment), 1)
    return np.arange(k) * n // k


class _Segments:
    """Segments of some texts, as word numbers end to end."""

    def __init__(self, codes: list[np.ndarray], segment: int):
        starts = [_starts(len(c), segment) for c in codes]
        self.word = np.concatenate(codes)
        self.doc = np.repeat(np.arange(len(codes)), [len(s) for s in starts])
        self.lens = np.concatenate([np.diff(np.append(s, len(c))) for c, s in zip(codes, starts, strict=True)])
        self.start = np.cumsum(self.lens) - self.lens
        self.fill = np.maximum(segment / np.maximum(self.lens, 1), 1)  # a short text counts as filled up
        self.n_docs = len(codes)

    def sizes(self, per_word: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_word[self.word], self.start) * self.fill

    def worst(self, margin: np.ndarray) -> np.ndarray:
        out = np.full(self.n_docs, -np.inf)
        np.maximum.at(out, self.doc, margin)
        return out


class _Features:
    """The features of each word that ``min_docs`` training texts or more hold; what
    fewer hold can only be learned by heart. Words are worked on in runs, so that what a
    step needs beside the features themselves does not grow with the vocabulary."""

    def __init__(self, vocabulary: list[bytes], codes: list[np.ndarray], bits: int, min_docs: int, run: int = 1 << 13):
        sizes, buckets = [], []
        for lo in range(0, len(vocabulary), run):
            words = vocabulary[lo : lo + run]
            owner, bucket = subwords(words, bits)
            sizes.append(np.bincount(owner, minlength=len(words)))
            buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        size, bucket = np.concatenate(sizes), np.concatenate(buckets)
        self.per_word = size.astype(float)
        first = np.cumsum(size) - size
        docs = np.zeros(1 << bits, np.int32)
        for c in codes:
            own = np.unique(c)
            docs[np.unique(gather(bucket, first, size, own))] += 1
        self.used = np.flatnonzero(docs >= min_docs)
        place = np.full(1 << bits, -1, np.int32)
        place[self.used] = np.arange(len(self.used))
        del bucket
        for i, (n, b) in enumerate(zip(sizes, buckets, strict=True)):
            b = place[b]
            sizes[i] = np.add.reduceat(b >= 0, np.cumsum(n) - n, dtype=np.int64)  # no word is without features: each is one of its own
            buckets[i] = b[b >= 0]
        self.size, self.bucket = np.concatenate(sizes), np.concatenate(buckets)
        words, ends = [*range(0, len(size), run), len(size)], np.append(0, np.cumsum(self.size))
        self.runs = [(a, b, int(ends[a]), int(ends[b])) for a, b in zip(words, words[1:], strict=False)]

    def _owner(self, a: int, b: int) -> np.ndarray:
        return np.repeat(np.arange(b - a), self.size[a:b])

    def by_word(self, value: np.ndarray) -> np.ndarray:
        """Sum of a number for each used bucket over the features of each word."""
        return np.concatenate([np.bincount(self._owner(a, b), weights=value[self.bucket[lo:hi]], minlength=b - a) for a, b, lo, hi in self.runs])

    def by_bucket(self, value: np.ndarray) -> np.ndarray:
        """Sum of a number for each word over the words of each used bucket."""
        out = np.zeros(len(self.used))
        for a, b, lo, hi in self.runs:
            out += np.bincount(self.bucket[lo:hi], weights=np.repeat(value[a:b], self.size[a:b]), minlength=len(out))
        return out


def train(codes: list[np.ndarray], vocabulary: list[bytes], y: np.ndarray, positive_share: float, bits: int = 18, dim: int = 4, segment: int = 8, rounds: int = 2, steps: int = 60, min_docs: int = 5, seed: int = 0) -> Model:
    """A model from texts as numbers of their words in ``vocabulary``, none of them
    empty. Every fourth text is set aside to choose where training stops, and to
    calibrate the probability."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    codes = [_unrepeated(c) for c in codes]
    taught = [x for x, a in zip(codes, aside, strict=True) if not a]
    c, f = _Segments(taught, segment), _Features(vocabulary, taught, bits, min(min_docs, 1 + len(y) // 50))
    judged, truth = (_Segments([x for x, a in zip(codes, aside, strict=True) if a], segment), y[aside]) if aside.any() else (c, y)
    y = y[~aside]
    n_seg, size_of = len(c.lens), np.maximum(c.sizes(f.per_word), 1)
    judged_size = np.maximum(judged.sizes(f.per_word), 1)
    seg = np.repeat(np.arange(n_seg), c.lens)
    emb = rng.normal(0, 0.1, (dim, len(f.used)))
    soft, bias = rng.normal(0, 1, (dim, 2)), np.zeros(2)
    params = [emb, soft, bias]
    rate = (1.0, 0.05, 0.05)
    seen = f.by_bucket(np.bincount(c.word, minlength=len(vocabulary)).astype(float))
    scale = 1 / np.sqrt(np.maximum(seen, 1))  # common features stand in every segment and move least

    def forward():
        return np.array([np.add.reduceat(f.by_word(e)[c.word], c.start) for e in emb]) / size_of

    found: list[tuple[float, Model]] = []

    def snapshot():
        """The model so far, if it gives the texts set aside the best loss."""
        scalar, b = (soft[:, 1] - soft[:, 0]) @ emb, float(bias[1] - bias[0])
        z = judged.worst(np.add.reduceat(f.by_word(scalar)[judged.word], judged.start) / judged_size + b)
        slope, shift = _calibrate(z, truth, positive_share)
        gap = slope * z + shift
        share = np.where(truth == 1, positive_share / max(truth.sum(), 1), (1 - positive_share) / max((truth == 0).sum(), 1))
        loss = float((share * np.logaddexp(0, np.where(truth == 1, -gap, gap))).sum())
        if not found or loss < found[0][0]:
            weight = np.zeros(1 << bits, np.float32)
            weight[f.used] = scalar
            found[:] = [(loss, Model(weight, b, slope, shift, bits, segment))]

    label = y[c.doc].astype(float)
    weight = 1 / np.bincount(c.doc, minlength=len(y))[c.doc]
    for _ in range(rounds):
        for side in (0.0, 1.0):  # both classes weigh the same
            own = label == side
            weight[own] *= 0.5 / max(weight[own].sum(), 1e-12)
        pace, best, size, unit = [np.zeros_like(x) for x in params], np.inf, 1.0, None
        kept = [x.copy() for x in params]
        for step in range(steps):
            if step in (1, 2, 4, 8, 16, 32, 48):
                snapshot()
            mean = forward()
            logits = mean.T @ soft + bias
            gap = logits[:, 1] - logits[:, 0]
            loss = float((weight * np.logaddexp(0, np.where(label == 1, -gap, gap))).sum())
            if loss > best:  # too far: back, and on with half the step
                for x, old in zip(params, kept, strict=True):
                    x[:] = old
                pace, size, best = [np.zeros_like(x) for x in params], size / 2, np.inf
                continue
            best = loss
            kept = [x.copy() for x in params]
            g = weight * (_sigmoid(gap) - label)
            g2 = np.stack([-g, g], axis=1)
            d_seg = (g2 @ soft.T).T / size_of
            d_emb = np.array([f.by_bucket(np.bincount(c.word, weights=d[seg], minlength=len(vocabulary))) for d in d_seg]) * scale
            downhill = (d_emb, mean @ g2, g2.sum(axis=0))
            if unit is None:  # the first steps have the lengths in rate; later ones follow the gradient
                unit = [r / max(np.abs(d).max(), 1e-12) for r, d in zip(rate, downhill, strict=True)]
            size *= 1.1
            for i, d in enumerate(downhill):
                pace[i] = 0.8 * pace[i] + d
                params[i] -= size * unit[i] * pace[i]
        logits = forward().T @ soft + bias
        margin = logits[:, 1] - logits[:, 0]
        pointed = (y[c.doc] == 1) & ((margin >= c.worst(margin)[c.doc]) | (margin > 0))
        weight = np.where(y[c.doc] == 1, pointed.astype(float), 1.0)
        snapshot()
    return found[0][1]


def _calibrate(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic fit of label on margin, classes weighted to their share of the corpus."""
    w = np.where(y == 1, share / max((y == 1).sum(), 1), (1 - share) / max((y == 0).sum(), 1)) * len(y)
    center, scale = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - center) / scale, np.ones(len(z))])
    target = np.where(y == 1, 1 - 1 / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    a = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(a @ x)
        h = (x * (w * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, x @ (w * (p - target)) + 1e-3 * a), -4, 4)
    slope = max(float(a[0] / scale), 1e-9)
    return slope, float(a[1] - a[0] * center / scale)


class Scorer:
    """Scores texts by a model. Each distinct word is looked up once; what is known of
    words starts again beyond ``limit`` of them, so that memory is bounded."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.total, self.size = np.empty(0), np.empty(0)

    def _codes(self, split: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > self.limit:
            self.forget()
        codes = [_unrepeated(np.fromiter(map(self.number.__getitem__, t), np.int64, len(t))) for t in split]
        fresh = list(islice(reversed(self.number), len(self.number) - len(self.total)))[::-1]
        if fresh:
            owner, bucket = subwords(fresh, self.model.bits)
            self.total = np.concatenate([self.total, np.bincount(owner, weights=self.model.weight[bucket], minlength=len(fresh))])
            self.size = np.concatenate([self.size, np.bincount(owner, minlength=len(fresh)).astype(float)])
        return codes

    def margins(self, split: list[list[bytes]]) -> np.ndarray:
        """The margin of the worst segment of each text, given as words."""
        model, codes = self.model, self._codes(split)
        margin = np.full(len(split), model.bias)
        own = [i for i, c in enumerate(codes) if len(c)]
        if own:
            flat, n = np.concatenate([codes[i] for i in own]), np.array([len(codes[i]) for i in own])
            first = np.cumsum(n) - n
            starts = [a + _starts(k, model.segment) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            text = np.cumsum([0, *(len(x) for x in starts)])[:-1]
            starts = np.concatenate(starts)
            lens = np.diff(np.append(starts, len(flat)))
            value = np.add.reduceat(self.total[flat], starts) / (np.add.reduceat(self.size[flat], starts) * np.maximum(model.segment / lens, 1)) + model.bias
            margin[own] = np.maximum.reduceat(value, text)
        return margin

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.model.slope * self.margins([words_of(t) for t in texts]) + self.model.shift)


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    modulus: int = 5, max_per_class: int = 2000, max_train_words: int = 2000, seed: int = 0,
) -> Model | float:
    """A model from labelled rows whose crc32(id) mod ``modulus`` is not 0, or the
    share of label 1 if there aren't two classes."""
    y = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").dropDuplicates(["id"])
    y = y.where(F.crc32(F.col("id").cast("string").cast("binary")) % modulus != 0)
    count = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    share = (count.get(1, 0) + 0.5) / (sum(count.values()) + 1)
    if len(count) < 2:
        return share
    order = [F.xxhash64("id", F.lit(seed)), F.col("id")]
    picked = y.where("y = 0").orderBy(*order).limit(max_per_class).unionByName(y.where("y = 1").orderBy(*order).limit(max_per_class // 2))
    text = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where(F.length("text") <= 12 * max_train_words)
    number: dict[bytes, int] = {}
    rows = []
    for r in text.join(F.broadcast(picked), "id").collect():  # 1.5 * max_per_class at most
        words = words_of(r["text"])
        if 0 < len(words) <= max_train_words:
            rows.append((str(r["id"]), int(r["y"]), np.array([number.setdefault(w, len(number)) for w in words], np.int32)))
    rows.sort(key=lambda r: (r[0], len(r[2])))
    if len({r[1] for r in rows}) < 2:
        return share
    codes, vocabulary, truth = [r[2] for r in rows], list(number), np.array([r[1] for r in rows])
    del rows, number
    trim()
    try:
        return train(codes, vocabulary, truth, share, seed=seed)
    finally:
        trim()


def score(df: DataFrame, model: Model | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row with its score in a last column, ``score_col``."""
    if score_col in df.columns:
        raise ValueError(f"the rows have a column {score_col} already; name another score_col")
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    @trimmed
    def run(batches):
        scorer = None if isinstance(shared.value, float) else Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                texts = part.column(at).to_pylist()
                s = np.full(len(texts), shared.value) if scorer is None else scorer.scores(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, "new"])

    return with_column(df, run, score_col, DoubleType())
