"""Matched pools, balanced samples, group-disjoint splits and shard plans.

"First" rows of a group are those with the smallest (shard, row_in_shard), or the
smallest ``order``; random choices take the smallest sha256 of seed and key, so
they don't depend on partitions and only grow when the data does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .metrics import scale_canary

ROW_ORDER = ("shard", "row_in_shard")


def _kept(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in names))


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], band: Column, name: str = "_r") -> DataFrame:
    """Add the place (from 1) of each row in its group. ``band`` cuts a group into parts
    that follow the order; ranks are taken inside parts, on top of the counts of the
    parts before, so a group that holds half of all rows is no single task."""
    rows = df.withColumn("_band", band)
    counts = rows.groupBy(*groups, "_band").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1))
    keys = [*groups, "_band"]
    offsets = counts.select(*(F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(offsets, same).withColumn(name, F.col("_before") + inside).drop("_band", "_before", *(f"_o{i}" for i in range(len(keys))))


def hash_band(h: Column) -> Column:
    """The band of a hash in hex: 256 parts of about the same size."""
    return F.substring(h, 1, 2)


def matched_pool(df: DataFrame, buckets: Sequence[str], order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """In each bucket, the first n rows of both classes, n the smaller class's count.
    Null buckets and labels are left out. Counts are combined before the shuffle,
    and ranks are taken in bands of the first order column (shards)."""
    named = df.where(F.col("label").isin(0, 1)).dropna(subset=list(buckets))
    count = named.groupBy(*buckets).agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("_n")).where("_n > 0")
    return _kept(ranked(named.join(count, list(buckets)), [*buckets, "label"], order, F.col(order[0])).where("_r <= _n"), df.columns)


def min_side_matched_pool(df: DataFrame, min_crop_size: int = 256, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    return matched_pool(C.native_crop_pool(df, min_crop_size), ["min_side"], order)


def content_matched_pool(df: DataFrame, min_crop_size: int = 256, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    df = df if "content" in df.columns else C.add_content_column(df)
    return matched_pool(C.native_crop_pool(df, min_crop_size), ["content", "min_side"], order)


def resolution_matched_pool(df: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    df = df if "width" in df.columns else C.add_size_columns(df)
    return matched_pool(df.where("min_side > 0"), ["width", "height"], order)


def round_robin(df: DataFrame, group: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows taken in turns from the groups, in shuffled order; rows without a group last."""
    h = C.shuffled(seed, F.col(key))
    turns = ranked(df, [group], [h, key], hash_band(h), "_t").withColumn("_t", F.when(F.col(group).isNotNull(), F.col("_t")))
    return _kept(turns.orderBy(F.col("_t").asc_nulls_last(), h, F.col(key)).limit(n), df.columns)


def balance_classes(df: DataFrame, n_per_class: int, seed: int, key: str, generator: str = "model_name") -> DataFrame:
    """As many rows of both classes: authentic ones at random, generated ones in
    turns over generators; none if a class is missing."""
    n = {r["label"]: r["count"] for r in df.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    n = min(n_per_class, n.get(0, 0), n.get(1, 0))
    real = _kept(df.where("label = 0").orderBy(C.shuffled(seed, F.col(key)), key).limit(n), df.columns)
    return real.unionByName(round_robin(df.where("label = 1"), generator, n, seed, key))


def stratified_balance(df: DataFrame, n_per_class: int, seed: int, key: str, stratum: str, generator: str = "model_name") -> DataFrame:
    """As balance_classes within each stratum; a stratum's share is its part of the
    budget, rounded half to even, and at most its smaller class."""
    named = df.where(F.col("label").isin(0, 1) & F.col(stratum).isNotNull())
    cap = named.groupBy(stratum).agg(F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("_cap")).where("_cap > 0")
    total = cap.agg(F.coalesce(F.sum("_cap"), F.lit(0))).first()[0]
    budget = min(n_per_class, total)
    share = cap.withColumn("_share", F.least(F.bround(F.lit(float(budget)) * F.col("_cap") / F.lit(max(total, 1)), 0).cast("long"), F.col("_cap")))
    h = C.shuffled(seed, F.col(key))
    turns = ranked(named.join(share, stratum), [stratum, "label", generator], [h, key], hash_band(h), "_t")
    turns = turns.withColumn("_t", F.when(F.col("label") == 0, F.lit(0)).when(F.col(generator).isNotNull(), F.col("_t")))
    late = F.when(F.col("_t").isNull(), F.lit(1)).otherwise(0)
    band = F.struct(late, F.floor(F.col("_t") / 256), F.when(late.eqNullSafe(1) | (F.col("label") == 0), hash_band(h)))
    return _kept(ranked(turns, [stratum, "label"], [F.col("_t").asc_nulls_last(), h, F.col(key)], band).where("_r <= _share"), df.columns)


def greedy_coverage(df: DataFrame, n_shards: int, generator: str = "model_name") -> list[str]:
    """Shards that each add the most generators not covered yet; ties by rows, then
    by shard name. What is covered stays distributed; one row a step comes back."""
    pairs = df.where(F.col(generator).isNotNull()).select("shard", F.col(generator).alias("g")).distinct()
    sizes = df.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n"))
    chosen: list[str] = []
    for _ in range(n_shards):
        covered = pairs.where(F.col("shard").isin(chosen)).select("g").distinct() if chosen else None
        fresh = pairs.join(covered, "g", "left_anti") if chosen else pairs
        rows = sizes.where(~F.col("shard").isin(chosen)) if chosen else sizes
        best = rows.join(fresh.groupBy("shard").agg(F.count("*").alias("new")), "shard", "left").orderBy(F.coalesce("new", F.lit(0)).desc(), F.col("n").desc(), "shard").first()
        if best is None:
            break
        chosen.append(best["shard"])
    return chosen


def plan_shards(df: DataFrame, n_shards_per_class: int = 5, min_side: int | None = 512, generator: str = "model_name", shard_gb: float = 4.1) -> DataFrame:
    """One row: the shards to fetch for both classes and what they yield."""
    spark = df.sparkSession
    pool = df if min_side is None else (df if "min_side" in df.columns else C.add_size_columns(df)).where(F.col("min_side") == min_side)
    fake = greedy_coverage(pool.where("label = 1"), n_shards_per_class, generator)
    real = [r["shard"] for r in pool.where("label = 0").groupBy("shard").count().orderBy(F.col("count").desc(), "shard").limit(n_shards_per_class).collect()]
    inside = restrict_to_shards(pool.where("label = 1"), fake).select("label", generator).unionByName(restrict_to_shards(pool.where("label = 0"), real).select("label", generator))
    n = inside.agg(F.count_if(F.col("label") == 1).alias("f"), F.count_if(F.col("label") == 0).alias("r"), F.count_distinct(F.when(F.col("label") == 1, F.col(generator))).alias("g")).first()
    shards = sorted({*fake, *real})
    row = (sorted(fake), sorted(real), 2 * min(n["f"], n["r"]), n["g"], shard_gb * len(shards), "" if shards else "no shard holds rows of this size")
    return spark.createDataFrame([row], "generated_shards array<string>, authentic_shards array<string>, n_images long, n_generators long, gb double, note string")


def restrict_to_shards(df: DataFrame, shards: Sequence[str]) -> DataFrame:
    return df.where(F.col("shard").isin(list(shards)))


def disjoint_split(df: DataFrame, holdout: float = 0.2, seed: int = 0, generator: str = "model_name") -> DataFrame:
    """Add ``side``, train or test. Generated rows go by their generator's hash and
    authentic ones by their row's, so no generator is on both sides and nothing
    moves as the data grows; it takes no shuffle and works on streams as well."""
    if not 0 < holdout < 1:
        raise ValueError("holdout must be between 0 and 1")
    row = F.concat(F.lit(f"{seed}:row:"), F.col("shard").cast("string"), F.lit("#"), F.col("row_in_shard").cast("string"))
    key: Column = F.when(F.col("label") == 1, F.concat(F.lit(f"{seed}:generator:"), F.col(generator))).when(F.col("label") == 0, row)
    return df.withColumn("side", F.when(F.coalesce(C.hash_below(key, holdout), F.lit(False)), "test").otherwise("train"))


def check_split(df: DataFrame, generator: str = "model_name") -> None:
    """A split needs two generators at least."""
    if df.where((F.col("label") == 1) & F.col(generator).isNotNull()).select(generator).distinct().limit(2).count() < 2:
        raise ValueError("a generator-disjoint split needs at least two generators")


def summarize(df: DataFrame, keys: Sequence[str], generator: str = "model_name") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 0).alias("n_authentic"), F.count_if(F.col("label") == 1).alias("n_generated"), F.count_distinct(F.when(F.col("label") == 1, F.col(generator))).alias("n_generators"))


def split_gate(df: DataFrame, limit: float = 0.6) -> None:
    """Refuse a split whose scale tells the label."""
    auroc = scale_canary(df).first()["auroc"]
    if auroc is not None and max(auroc, 1 - auroc) > limit:
        raise ValueError(f"scale canary {auroc:.4f}: the label can be read off the image size")


def permutation_split(df: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """Add ``fit``: round(fraction * rows) rows at random, all of them for 1.0."""
    hashes = df.select(C.shuffled(seed, F.col(key)).alias("h"))
    bands = sorted((r["b"] or "", r["count"]) for r in hashes.groupBy(F.substring("h", 1, 4).alias("b")).count().collect())  # 65,536 at most
    n, cut = round(fraction * sum(c for _, c in bands)), None
    before = 0
    for b, c in bands:
        if before < n <= before + c:  # only this band is sorted
            cut = hashes.where(F.substring("h", 1, 4) == b).orderBy("h").limit(n - before).agg(F.max("h")).first()[0]
        before += c
    return df.withColumn("fit", C.shuffled(seed, F.col(key)) <= F.lit(cut) if cut is not None else F.lit(False))


def bernoulli_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Add ``split``: val for about a ``share`` of the rows, by the hash of their key."""
    own = F.concat(F.lit(f"{seed}:split:"), F.col(key).cast("string"))
    return df.withColumn("split", F.when(F.coalesce(C.hash_below(own, share), F.lit(False)), "val").otherwise("train"))


def stratified_split(df: DataFrame, fraction: float, seed: int, key: str, label: str = "label") -> DataFrame:
    """Add ``fit``: the same share of each class."""
    h = C.shuffled(seed, F.col(key))
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    rows = ranked(df, [label], [h, key], hash_band(h)).join(counts, F.col(label).eqNullSafe(F.col("_l")))
    return rows.withColumn("fit", F.col("_r") <= F.bround(F.col("_n") * F.lit(fraction), 0)).drop("_n", "_r", "_l")


def cap_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(C.shuffled(seed, F.col(key)), key).limit(n)


def class_cap(df: DataFrame, n: int, order: Sequence[str], label: str = "label") -> DataFrame:
    """The first n // 2 rows of each class."""
    return _kept(ranked(df, [label], order, F.col(order[0])).where(F.col("_r") <= n // 2), df.columns)


def generator_cap(df: DataFrame, max_per_generator: int, max_generators: int, max_total: int, order: Sequence[str], generator: str = "model_name") -> DataFrame:
    """Half of max_per_generator rows of each of the first max_generators
    generators, half of max_total rows of both classes at most."""
    place = F.struct(*order)
    first = df.where("label = 1").groupBy(generator).agg(F.min(place).alias("_first")).where(F.col(generator).isNotNull()).orderBy("_first").limit(max_generators).select(generator)
    own = ranked(df.where("label = 1").join(first, generator, "left_semi"), [generator], order, F.col(order[0]))
    fake = own.where(F.col("_r") <= max_per_generator // 2).orderBy(*order).limit(max_total // 2)
    real = df.where("label = 0").orderBy(*order).limit(max_total // 2)
    return _kept(fake, df.columns).unionByName(_kept(real, df.columns))


def limit_per_class(df: DataFrame, n: int, order: Sequence[str], label: str = "label") -> DataFrame:
    """n rows at most: the first max(1, n // classes) of each class, in order."""
    classes = df.select(label).distinct().count()
    return _kept(ranked(df, [label], order, F.col(order[0])).where(F.col("_r") <= max(1, n // max(classes, 1))).orderBy(*order).limit(n), df.columns)


def systematic_sample(df: DataFrame, n: int, order: str) -> DataFrame:
    """n rows at even steps of the order column's ranks, first and last included.
    Ranks come from counts of value ranges, not from one global window."""
    total = df.count()
    if total <= n:
        return df
    if n == 1:
        return _kept(with_rank(df, order).where("_rank = 0"), df.columns)
    steps, span = n - 1, total - 1  # rank r is chosen if r = i * span div steps for a whole i
    return _kept(with_rank(df, order).where(f"((_rank * {steps}L + {span - 1}L) div {span}L) * {span}L div {steps}L = _rank"), df.columns)


def with_rank(df: DataFrame, order: str, bands: int = 64) -> DataFrame:
    """Add ``_rank``, the place (from 0) in the order of a numeric column without ties."""
    bounds = df.agg(F.percentile_approx(order, [i / bands for i in range(1, bands)], 10_000)).first()[0] or []
    band = sum((F.col(order) > b).cast("int") for b in sorted(set(bounds))) if bounds else F.lit(0)
    banded = df.withColumn("_band", band)
    sizes = {r["_band"]: r["count"] for r in banded.groupBy("_band").count().collect()}
    before, table = 0, []
    for b in sorted(sizes):
        table += [F.lit(b), F.lit(before)]
        before += sizes[b]
    start = F.element_at(F.create_map(*table), F.col("_band")) if table else F.lit(0)
    return banded.withColumn("_rank", start + F.row_number().over(Window.partitionBy("_band").orderBy(order)) - 1).drop("_band")
