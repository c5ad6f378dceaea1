"""The operators on texts against brute force, with nulls, empty and long texts,
repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from lodestat.llm import byte_bpe, components, decontaminate, line_dedup, lm_score, ngram_join, quality, substring_dedup, toxicity
from lodestat.llm.common import with_row_key

SCHEMA = "doc_id long, text string, rk string, row int, kept double"  # extra columns with names that operators use


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in texts], SCHEMA)


def corpus(seed=0):
    """Random prose with a shared passage, copies, self-repeats, nulls and a long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [prose(rng.randint(0, 120)) for _ in range(12)]
    texts += [f"{prose(20)} {passage} {prose(20)}" for _ in range(6)] + [passage, passage]
    texts += [f"{prose(5)}\n{passage}\t{prose(3)}  {passage[:200]}", " ".join(["a b c"] * 40), "x " * 80, "", None, " \n ", prose(5000)]
    texts += [texts[3], texts[3], texts[14]]
    rows = list(enumerate(texts))
    return [*rows, rows[13], (None, texts[5]), (None, None)]


def spark_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_repeated_windows_are_cut(spark):
    window = 35
    for data in (corpus(), []):
        words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]
        at = defaultdict(int)
        for w in words:
            for s in range(len(w) - window + 1):
                at[tuple(w[s : s + window])] += 1
        want = Counter()
        for (i, _), w in zip(data, words, strict=True):
            gone = set()
            for s in range(len(w) - window + 1):
                if at[tuple(w[s : s + window])] > 1:
                    gone |= set(range(s, s + window))
            want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
        got = substring_dedup.remove_repeats(table(spark, data)).collect()
        assert Counter((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
        # the parse: factors cover the spans, and each is a copy of its source
        text_of = {(r["rk"], r["rh"]): w for r in got for (i, t), w in zip(data, words, strict=True) if i == r["id"] and len(w) == r["n_words"]}
        for r in got:
            own, covered = text_of[r["rk"], r["rh"]], set()
            for f in r["factors"]:
                source = text_of[f["source_rk"], f["source_rh"]]
                assert f["stop"] - f["start"] >= window and own[f["start"] : f["stop"]] == source[f["source_start"] :][: f["stop"] - f["start"]]
                covered |= set(range(f["start"], f["stop"]))
            assert len(covered) == r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"])


def test_parse_is_greedy():
    found = [(9, 1, 1, 0, 54), (0, 4, 1, 0, 50), (4, 5, 1, 0, 54), (20, 3, 1, 0, 70), (23, 2, 2, 0, 73), (25, 1, 2, 0, 75), (26, 1, 2, 0, 99), (27, 1, 2, 1, 100)]
    got = substring_dedup.parse(*np.array(found).T)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(0, 9, 1, 0, 50), (9, 1, 1, 0, 54), (20, 3, 1, 0, 70), (23, 3, 2, 0, 73), (26, 1, 2, 0, 99), (27, 1, 2, 1, 100)]
    assert all(len(x) == 0 for x in substring_dedup.parse(*np.empty((5, 0), np.int64)))


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_later_copies_of_line_runs_go(spark, run):
    lines = ["a", "b", "c", "d", ""]
    rng = random.Random(run)
    data = [(i, "\n".join(rng.choice(lines) * rng.randint(1, 3) for _ in range(rng.randint(0, 12)))) for i in range(25)]
    story = [f"s{k}" for k in range(40)]  # long runs that nest and overlap
    data += [(40 + i, "\n".join([f"t{i}", *story[rng.randint(0, 12) : rng.randint(14, 40)], "u", *story[rng.randint(0, 5) : rng.randint(5, 12)]])) for i in range(8)]
    data += [(60, "A\nB\nX"), (61, "A\nB\nC\nY"), (62, "A\nB\nC\nZ"), (63, "q\n" * 30)] + [(30, None), (31, "a\na\na\na\na\na"), (None, "b\nc\nd\na")]
    data.append(data[4])
    split = {d: d[1].split("\n") if d[1] else [] for d in data}
    order = sorted(split, key=lambda d: (d[0] is not None, d[0] or 0))
    windows = defaultdict(list)
    for d in order:
        for s in range(len(split[d])):
            for n in range(run, len(split[d]) - s + 1):
                windows[tuple(split[d][s : s + n])].append((d, s))
    first, later = defaultdict(set), defaultdict(set)
    for w, places in windows.items():
        for k, (d, s) in enumerate(places):
            if len(places) > 1:
                (later if k else first)[d] |= set(range(s, s + len(w)))
    want = Counter()
    for d in data:
        gone = later[d] - first[d]
        want[d[0], len(split[d]), len(gone), "\n".join(x for k, x in enumerate(split[d]) if k not in gone)] += 1
    got = line_dedup.remove_repeated_lines(table(spark, data), min_run=run).select("id", "n_lines", "n_removed", "kept")
    assert spark_rows(got) == want
    assert line_dedup.remove_repeated_lines(table(spark, []), min_run=run).count() == 0


def test_each_repeated_run_survives_once(spark):
    data = [(1, "A\nB\nX"), (2, "A\nB\nC\nY"), (3, "A\nB\nC\nZ")]
    got = {r["id"]: r["kept"] for r in line_dedup.remove_repeated_lines(table(spark, data)).collect()}
    assert got == {1: "A\nB\nX", 2: "A\nB\nC\nY", 3: "Z"}


def test_long_single_lines_are_runs(spark):
    long, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(49))
    data = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, f"x\n{other}"), (5, f"y\n{other}"), (6, f"{long}\nnew"), (7, f"{long}\nnew"), (8, None)]
    want = {1: data[0][1], 2: "c\nd", 3: "", 4: data[3][1], 5: data[4][1], 6: data[5][1], 7: "", 8: ""}  # 6 holds the first copy of a run of two lines
    got = line_dedup.remove_repeated_lines(table(spark, data), min_run=2, long_words=50).collect()
    assert {r["id"]: r["kept"] for r in got} == want
    without = line_dedup.remove_repeated_lines(table(spark, data), min_run=2).collect()
    assert {r["id"]: r["kept"] for r in without} == {i: t or "" for i, t in data} | {7: ""}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 3)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: find(x) for x in list(up)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def grams(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[s : s + n]) for s in range(max(len(w) - n + 1, 1))} if w else set()


@pytest.mark.parametrize("tile", [(256, 2_000_000), (4, 2_000_000), (256, 300)])
def test_near_duplicates_match_all_pairs(spark, tile):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    near = []
    for k in range(14):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(200)] = f"new{k}"
        near.append(" ".join(w))
    data = corpus() + [(100 + k, t) for k, t in enumerate(near)] + [(200, "one two"), (201, "One, two!"), (202, "!!"), (203, "!!")]
    sets = [grams(t) for _, t in data]
    linked = [[bool(a) and bool(b) and x != y and len(a & b) >= 0.8 * len(a | b) for y, b in enumerate(sets)] for x, a in enumerate(sets)]
    root = list(range(len(data)))
    for x in range(len(data)):
        for y in range(len(data)):
            if linked[x][y] and root[x] != root[y]:
                a, b = root[x], root[y]
                root = [a if z == b else z for z in root]
    least = {c: min((data[y][0] for y in range(len(data)) if root[y] == c and data[y][0] is not None), default=None) for c in set(root)}
    want = Counter((data[x][0], least[root[x]] if sets[x] else data[x][0], sum(bool(s) and s == sets[x] for s in sets) if sets[x] else 1, sum(linked[x])) for x in range(len(data)))
    got = ngram_join.near_duplicates(table(spark, data), tile=tile[0], tile_grams=tile[1])
    assert spark_rows(got.select("id", "class_id", "n_copies", "n_links")) == want
    kept = ngram_join.keep_one(table(spark, data), tile=tile[0], tile_grams=tile[1])
    assert kept.columns == ["doc_id", "text", "rk", "row", "kept"]
    alone = {d for d, s in zip(data, sets, strict=True) if not s}
    assert kept.count() == len({root[x] for x in range(len(data)) if sets[x]}) + len({(i, t or "") for i, t in alone})
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("filter_bits", [24, 5])  # few bits let almost every candidate through to the join
def test_benchmark_hits_match_brute_force(spark, filter_bits):
    docs = corpus()
    texts = dict(docs)
    words = decontaminate.words_of
    take = lambda i, a, b: " ".join(x.decode() for x in words((texts[i] or "").encode())[a:b])
    items = [(1, take(12, 15, 50)), (2, take(13, 0, 12).upper()), (3, take(3, 2, 8)), (4, "nothing like it"), (5, None), (6, "!?"), (10, take(12, 15, 50)), (7, take(14, 5, 30) + " end")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    want = Counter()
    for i, t in docs:
        w, hit, found = words((t or "").encode()), set(), set()
        for item, text in items:
            own = words((text or "").encode())
            n = min(len(own), 10)
            for s in range(len(own) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        want[i, len(w), len(hit), ",".join(sorted(found))] += 1
    got = decontaminate.find_hits(table(spark, docs), bench, filter_bits=filter_bits)
    assert Counter((r["id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), ",".join(sorted(r["item_ids"]))) for r in got.collect()) == want
    assert decontaminate.find_hits(table(spark, docs), bench.where("false")).where("size(spans) > 0").count() == 0
    assert decontaminate.find_hits(table(spark, []), bench, filter_bits=filter_bits).count() == 0


def test_lm_counts_and_mixture(spark):
    data = corpus()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, t in data if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in data)
    got = lm_score.score(table(spark, data), block_bytes=2000).collect()
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    again = lm_score.score(table(spark, data).repartition(1)).collect()
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(r["score"], 6) for r in again)
    assert lm_score.score(table(spark, [])).count() == 0


def test_em_finds_the_weight():
    rng = np.random.default_rng(0)
    from_bigram = rng.random(200_000) < 0.7  # two kinds of tokens: ratio 8 where the bigram model made it, mostly
    ratio = np.where(from_bigram == (rng.random(200_000) < 0.9), 3, -3)
    bins, n = np.unique(2 * lm_score.BINS + ratio * lm_score.STEPS - lm_score.LOWEST + 1, return_counts=True)
    w = lm_score.fit_weights(bins, n)[2]
    like = lambda x: (n * np.log(x * 2.0 ** ((bins % lm_score.BINS - 1 + lm_score.LOWEST) / lm_score.STEPS) + 1 - x)).sum()
    grid = np.linspace(0.001, 0.999, 999)
    assert abs(w - grid[np.argmax([like(x) for x in grid])]) < 0.005


NASTY = ["", "a", " a", "a ", "a  b", "a \n b\n\n\nc", "\t\tx", "don't  we'll 'S", "１２３ ½ x²", "日本語 テスト", "é   　x  y\x1cz \x85w", "!!!! ??", "<|endoftext|>", "\U0001f600\U0001f600 a", "x" * 3000, "a b " * 2000, None, "\r\n \r\n", "  lead", "trail   "]


def test_bpe_is_tiktoken_and_decodes(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    data = list(enumerate(NASTY)) + [(100 + i, "".join(rng.choice("ab 'sé\n\t1! ") for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(None, "x y"), (0, "x y"), (3, "a ")] + corpus()
    want = Counter()
    for i, t in data:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    for block_bytes in (8 << 20, 500):
        encoded = byte_bpe.encode(table(spark, data), path, P.PATTERN, block_bytes=block_bytes)
        got = byte_bpe.decode(encoded, path).collect()
        assert Counter((r["id"], r["n_tokens"], hashlib.sha256(r["ids_le"]).hexdigest(), hashlib.sha256(r["decoded"]).hexdigest()) for r in got) == want
    whole = byte_bpe.digests(table(spark, data), path, P.PATTERN).collect()
    assert Counter(tuple(r) for r in whole) == want
    array = encoded.select("n_tokens", byte_bpe.as_array().alias("ids")).collect()
    assert all(len(r["ids"]) == r["n_tokens"] for r in array)
    assert byte_bpe.digests(table(spark, []), path, P.PATTERN).count() == 0


def toxic_corpus(n=400, seed=0):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(800)]
    rows, y = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 150))]
        bad = i % 3 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = "vexhorr" + rng.choice(["", "id", "ing", "ous", "el", "um", "ak"])
        rows.append((i, " ".join(w)))
        y.append((i, int(bad)))
    return rows, y


def test_toxicity_generalises_to_unseen_forms(spark):
    rows, y = toxic_corpus()
    labels = spark.createDataFrame([*y, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    assert toxicity.fit(table(spark, rows), labels).weight.tolist() == model.weight.tolist()
    clean = [t for i, t in rows if i % 3][:40]
    unseen = [(2000 + k, t + " vexhorr" + ["is", "ati", "one", "usk"][k % 4]) for k, t in enumerate(clean)]
    extra = [(1002, None), (1003, ""), *((3000 + k, t) for k, t in enumerate(clean)), *unseen]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, rows + extra), model).collect()}
    held = [(i, t) for i, t in y if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == t for i, t in held]) > 0.95
    assert np.mean([got[2000 + k] > max(got[3000 + j] for j in range(40)) for k in range(40)]) > 0.8  # forms never seen in training
    assert got[1002] == got[1003] < 0.5
    flat = toxicity.fit(table(spark, rows), labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(table(spark, rows[:3]), flat).collect()} == {flat}
    with pytest.raises(ValueError):
        toxicity.score(table(spark, rows), model, score_col="kept")
    assert toxicity.score(table(spark, []), model).count() == 0


def test_quality_prefers_the_target_and_samples_k(spark):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["the", "of", "and", "house", "river", "stone"]) for _ in range(50))) for i in range(150)]
    junk = [(200 + i, "!! ".join(rng.choice(["ZZ", "##", "QX", "777"]) for _ in range(50))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:60]] + [(i, 0) for i, _ in junk[:20]], "doc_id long, quality int")
    df = table(spark, good + junk)
    got = {r["id"]: r for r in quality.resample(df, labels).collect()}
    assert sum(r["kept"] for r in got.values()) == 150 and all(got[i]["kept"] for i, _ in good)
    assert min(got[i]["log_weight"] for i, _ in good) > max(got[i]["log_weight"] for i, _ in junk)
    again = {r["id"]: r["gumbel_key"] for r in quality.resample(df.repartition(5), labels).collect()}
    assert again == {i: r["gumbel_key"] for i, r in got.items()}
    none = quality.resample(table(spark, corpus()), labels.where("false"), fraction=0.5).collect()
    assert {r["log_weight"] for r in none} == {0.0} and abs(sum(r["kept"] for r in none) - len(none) / 2) <= 2
    assert quality.resample(table(spark, []), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(2)
    v = [rng.randint(-(2**63), 2**63 - 1) for _ in range(200)] + [5] * 10 + [-5, 0]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for k in (1, 50, 100, len(v)):
        assert quality.kth_largest(df, "v", k) == sorted(v, reverse=True)[k - 1]


def test_lm_score_is_deleted_interpolation_by_brute_force(spark):
    data = [(i, t) for i, t in corpus(3)] + [(200 + i, "x y z x y w " * (i % 4)) for i in range(12)]
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    taught = [tokens(t) for i, t in data if not held(i)]
    c, pair = Counter(x for t in taught for x in t), Counter(p for t in taught for p in zip([b"\n", *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    bucket = lambda x: c[x].bit_length()
    for step, close in ((1 / lm_score.STEPS, 1e-6), (0, 0.02)):  # as the histogram rounds ratios, and without rounding
        ratios = defaultdict(list)
        for t in taught:  # each training token with its own occurrence taken off
            for a, b in zip([b"\n", *t[:-1]], t, strict=True):
                r = (pair[a, b] - 1) / max(c[a] - 1, 1) / (c[b] / (n - 1 + v + 1))
                ratios[bucket(a)].append(2 ** (round(math.log2(r) / step) * step) if r and step else r)
        weight = {}
        for k, own in ratios.items():
            r, w = np.array(own), 0.5
            for _ in range(60):
                w = min(max(float((w * r / (w * r + 1 - w)).mean()), 1e-9), 1 - 1e-9)
            weight[k] = w

        def log10(t):
            total = 0.0
            for a, b in zip([b"\n", *t[:-1]], t, strict=True):
                w = weight[bucket(a)] if c[a] else 0.0
                total += math.log10(w * pair[a, b] / max(c[a], 1) + (1 - w) * (c[b] + 1) / (n + v + 1))
            return total

        want = sorted((str(i), log10(tokens(t))) for i, t in data)
        got = sorted((str(r["id"]), r["score"]) for r in lm_score.score(table(spark, data)).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) <= close * (1 + abs(b)) for (_, a), (_, b) in zip(got, want, strict=True))


M64 = (1 << 64) - 1


def mix64(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def test_toxicity_scores_are_a_plain_reading_of_the_weights(spark):
    rows, y = toxic_corpus(150)
    model = toxicity.fit(table(spark, rows), spark.createDataFrame(y, "doc_id long, toxic int"))

    def buckets(word):
        marked, out = b"<" + word + b">", []
        for n in range(3, 7):
            for s in range(len(marked) - n + 1):
                h = 0
                for b in marked[s : s + n]:
                    h = (h * 0x100000001B3 + mix64(b + 1)) & M64
                out.append(mix64(h) >> (64 - model.bits))
        return [*out, mix64(xxhash.xxh3_64_intdigest(word)) >> (64 - model.bits)]

    def score(text):
        words = [w for w in re.sub(rb"[^0-9a-z\x80-\xff]", b" ", (text or "").lower().encode()).split()]
        words = [w for k, w in enumerate(words) if not k or words[k - 1] != w]
        k = max(round(len(words) / model.segment), 1)
        margins = []
        for j in range(k if words else 0):
            part = words[j * len(words) // k : (j + 1) * len(words) // k]
            own = [b for w in part for b in buckets(w)]
            margins.append(sum(float(model.weight[b]) for b in own) / (len(own) * max(model.segment / len(part), 1)) + model.bias)
        return 1 / (1 + math.exp(-(model.slope * max(margins, default=model.bias) + model.shift)))

    data = rows[:25] + [(900, None), (901, ""), (902, "!!"), (903, "vexhorrid"), (904, "A a a B " * 400), (905, rows[0][1]), (906, "é日本 x " * 30), (907, " ".join(t for _, t in rows))]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, data), model).collect()}
    assert all(abs(got[i] - score(t)) < 1e-6 for i, t in data)


def test_quality_weights_and_keys_by_brute_force(spark):
    data = [(i, t) for i, t in corpus(5)] + [(300, "x y " * 3000), (301, "x y " * 3000)]
    labels = [(i, int(i % 2 == 0)) for i, _ in data if i is not None and i < 20]
    df = table(spark, data)
    got = quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=500, seed=4).collect()
    good = {i for i, q in labels if q}

    def features(text):
        w = [xxhash.xxh3_64_intdigest(x) for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (text or "").encode().lower())]
        return [x % 500 for x in w] + [mix64((a * 0x9E3779B97F4A7C15 + b) & M64) % 500 for a, b in zip(w, w[1:], strict=False)]

    raw, target = Counter(x for _, t in data for x in features(t)), Counter(x for i, t in data if i in good for x in features(t))
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + 500)) - math.log((raw[b] + 1) / (sum(raw.values()) + 500)) for b in range(500)]
    key_of = {(r["id"], r["text"]): r["rk"] for r in with_row_key(df, "doc_id", "text").collect()}
    want = []
    for i, t in data:
        w = sum(ratio[b] for b in features(t))
        u = ((mix64(((key_of[i, t or ""] & M64) + 4 * 0x9E3779B97F4A7C15) & M64) >> 11) + 0.5) / (1 << 53)
        want.append((str(i), len(features(t)), round(w, 6), round(w - math.log(-math.log(u)), 6)))
    assert sorted((str(r["id"]), r["n_features"], round(r["log_weight"], 6), round(r["gumbel_key"], 6)) for r in got) == sorted(want)
    share = sum(q for _, q in labels) / len(labels)
    bar = sorted((w[3] for w in want), reverse=True)[round(share * len(data)) - 1]
    assert all(r["kept"] == (round(r["gumbel_key"], 6) >= bar) for r in got)


def test_toxicity_trains_in_bounded_memory():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i * 7919 % 99991:05d}{i % 89:02d}".encode() for i in range(60_000)]
    codes = [rng.integers(0, len(vocabulary), 200).astype(np.int32) for _ in range(300)]
    tracemalloc.start()
    toxicity.train(codes, vocabulary, np.arange(300) % 3 // 2, 0.3, rounds=1, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000  # 101 MB while all features of the vocabulary were worked on at once, now 24


def test_toxicity_sums_over_features_by_brute_force():
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(100)]
    vocabulary = list(dict.fromkeys(vocabulary))
    codes = [np.array([rng.randrange(len(vocabulary)) for _ in range(12)]) for _ in range(20)]
    own = [[] for _ in vocabulary]
    for w, b in zip(*toxicity.subwords(vocabulary, 10), strict=True):
        own[w].append(int(b))
    docs = Counter(b for c in codes for b in {b for w in c for b in own[w]})
    used = sorted(b for b, n in docs.items() if n >= 3)
    f = toxicity._Features(vocabulary, codes, 10, 3, run=7)
    assert f.used.tolist() == used and f.per_word.tolist() == [len(x) for x in own]
    value, word = {b: rng.randrange(100) for b in used}, [rng.randrange(100) for _ in vocabulary]
    assert f.by_word(np.array([value[b] for b in used], float)).tolist() == [sum(value.get(b, 0) for b in x) for x in own]
    assert f.by_bucket(np.array(word, float)).tolist() == [sum(word[w] * x.count(b) for w, x in enumerate(own)) for b in used]
