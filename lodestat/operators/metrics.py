"""Binary metrics for any grouping, from one pass over distinct scores.

Every function takes ``keys``: a view, a generator, a benchmark, a bootstrap
round, or none. Rows are summed to (keys, score) first; the running counts that a
curve needs are taken inside bands of scores, and bands' totals are added, so no
group, not even the only one, is sorted by a single task. Undefined values (one
class only) are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FPR_TARGETS = (0.01, 0.05, 0.10)


def _scored(score: str) -> Column:
    s = F.col(score).cast("double")
    return s.isNotNull() & ~F.isnan(s)


def roc_points(df: DataFrame, keys: Sequence[str] = (), y: str = "label", score: str = "score", bands: int = 64) -> DataFrame:
    """keys, score, p, n (positives and negatives at it), tp, fp (at it or above), pos, neg
    (all), and ``following``, p and n at the next lower score. Null and NaN scores are left out."""
    rows = df.where(_scored(score) & F.col(y).isin(0, 1))
    points = rows.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    bounds = rows.agg(F.percentile_approx(F.col(score).cast("double"), [i / bands for i in range(1, bands)], 1000)).first()[0] or []
    band = sum((F.col("score") > b).cast("int") for b in sorted(set(bounds))) if bounds else F.lit(0)
    points = points.withColumn("_band", band)
    sums = points.groupBy(*keys, "_band").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"), F.max_by(F.struct("p", "n"), "score").alias("top"))
    above = Window.partitionBy(*keys, F.lit(0)).orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every, below = Window.partitionBy(*keys, F.lit(0)), Window.partitionBy(*keys, F.lit(0)).orderBy(F.col("_band").desc())  # a row for each band
    sums = sums.select(*keys, "_band", F.lead("top").over(below).alias("_next"), *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in ("bp", "bn")), F.sum("bp").over(every).alias("pos"), F.sum("bn").over(every).alias("neg"))
    inside = Window.partitionBy(*keys, "_band").orderBy(F.col("score").desc())
    own = inside.rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({"_p": F.sum("p").over(own), "_n": F.sum("n").over(own), "_then": F.lead(F.struct("p", "n")).over(inside)})
    same = F.lit(True)
    for k in [*keys, "_band"]:
        same = same & points[k].eqNullSafe(sums[k])
    out = points.join(sums, same) if keys else points.join(sums, "_band")
    return out.select(*(points[k] for k in keys), points["score"], "p", "n", (F.col("_p") + F.col("_bp")).alias("tp"), (F.col("_n") + F.col("_bn")).alias("fp"), "pos", "neg", F.coalesce("_then", "_next").alias("following"))


def roc_curve(df: DataFrame, keys: Sequence[str] = (), y: str = "label", score: str = "score", drop_collinear: bool = False) -> DataFrame:
    """keys, threshold, fpr, tpr, with the origin (threshold infinity) of each group."""
    points = roc_points(df, keys, y, score)
    if drop_collinear:  # a point between two equal steps
        points = points.where(F.col("following").isNull() | (F.col("following.p") != F.col("p")) | (F.col("following.n") != F.col("n")))
    curve = points.select(*keys, F.col("score").alias("threshold"), F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))
    start = points.select(*keys).distinct() if keys else points.limit(1).select()
    return curve.unionByName(start.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def compute_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "label", score: str = "score", threshold: float = 0.5, n_bins: int = 15) -> DataFrame:
    """One row for each group, or for all rows."""
    s, t = F.col(score).cast("double"), F.col(y).cast("double")
    rows = df.where(_scored(score) & t.isin(0, 1))
    pred = (s >= threshold).cast("double")
    basic = rows.groupBy(*keys).agg(
        F.count_if(t == 1).alias("n_positive"), F.count_if(t == 0).alias("n_negative"), F.avg((pred == t).cast("double")).alias("accuracy"), F.avg((s - t) * (s - t)).alias("brier"),
        ((F.avg(F.when(t == 1, pred)) + F.avg(F.when(t == 0, 1 - pred))) / 2).alias("balanced_accuracy"),
    )
    bins = rows.groupBy(*keys, F.least(F.floor(s * n_bins), F.lit(n_bins - 1)).alias("_bin")).agg(F.abs(F.sum(s) - F.sum(t)).alias("gap"), F.count("*").alias("c"))
    ece = bins.groupBy(*keys).agg((F.sum("gap") / F.sum("c")).alias("ece"))
    points = roc_points(df, keys, y, score)
    fpr, tpr = F.try_divide("fp", "neg"), F.try_divide("tp", "pos")
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    gap, balanced = F.abs(fpr - (1 - tpr)), (tpr + (1 - fpr)) / 2
    best = F.max(F.struct(balanced.alias("b"), F.col("score").alias("s")))
    curve = points.groupBy(*keys).agg(
        F.when(both, F.sum(F.col("p") * ((F.col("neg") - F.col("fp")) + F.col("n") / 2)) / (F.max("pos") * F.max("neg"))).alias("auroc"),
        F.when(both, F.sum(F.try_divide("p", "pos") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"),
        F.when(both, F.create_map(*[x for f in FPR_TARGETS for x in (F.lit(f), F.coalesce(F.max(F.when(fpr <= f, tpr)), F.lit(0.0)))])).alias("tpr_at_fpr"),
        F.when(both, F.min(F.struct(gap.alias("g"), (-F.col("score")).alias("s"), ((fpr + (1 - tpr)) / 2).alias("e")))["e"]).alias("eer"),
        F.when(both, F.greatest(best["b"], F.lit(0.5))).alias("best_balanced_accuracy"), F.when(both, F.when(best["b"] > 0.5, best["s"]).otherwise(F.max("score"))).alias("best_threshold"),
    )
    names = [*keys, "n_positive", "n_negative", "auroc", "average_precision", "accuracy", "ece", "brier", "tpr_at_fpr", "balanced_accuracy", "eer", "best_balanced_accuracy", "best_threshold"]
    if not keys:
        return basic.crossJoin(ece).crossJoin(curve).where("n_positive + n_negative > 0").select(*names)  # one row each
    out = basic
    for part in (ece, curve):
        same = F.lit(True)
        for k in keys:
            same = same & out[k].eqNullSafe(part[k])
        kept = [out[c] for c in out.columns]
        out = out.join(part, same).select(*kept, *(part[c] for c in part.columns if c not in keys))
    return out.select(*names)


def flat(metrics: DataFrame) -> DataFrame:
    """tpr_at_fpr as columns, and the gap between the best and the fixed threshold."""
    out = metrics.select("*", *(F.element_at("tpr_at_fpr", F.lit(f)).alias(f"tpr_at_fpr_{f:g}".replace(".", "_")) for f in FPR_TARGETS))
    return out.withColumn("threshold_gap", F.col("best_balanced_accuracy") - F.col("balanced_accuracy")).drop("tpr_at_fpr")


def feature_canary(df: DataFrame, value: Column, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Metrics of a raw feature used as the score, scaled to [0, 1] (0.5 if constant)."""
    v = value.cast("double")
    rows = df.select(*keys, label, v.alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    joined = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))  # one row
    score = F.coalesce(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")), F.when(F.col("_v").isNotNull(), 0.5))
    return compute_metrics(joined.withColumn("_score", score), keys, label, "_score")


def scale_canary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return feature_canary(df, F.col("min_side"), keys)


def resolution_canary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return feature_canary(df, F.col("width").cast("double") * F.col("height"), keys)


def categorical_canary(df: DataFrame, category: str, label: str = "label") -> DataFrame:
    """Metrics of each category's share of label 1, used as the score."""
    rows = df.where(F.col(label).isin(0, 1)).select(F.col(category).alias("_c"), label)
    share = rows.groupBy("_c").agg(F.avg(F.col(label).cast("double")).alias("_score"))
    joined = rows.join(share.withColumnRenamed("_c", "_d"), F.col("_c").eqNullSafe(F.col("_d")))
    return compute_metrics(joined, (), label, "_score")


def matrix_summary(metrics: DataFrame, view: str = "view", clean: str = "clean") -> DataFrame:
    """Over the degraded views: worst, which one, mean, and relative loss against clean."""
    bad = (F.col(view) != clean) & F.col("auroc").isNotNull()
    out = metrics.agg(
        F.max(F.when(F.col(view) == clean, F.col("auroc"))).alias("clean_auroc"), F.min(F.when(bad, F.col("auroc"))).alias("worst_auroc"),
        F.min(F.when(bad, F.struct("auroc", view)))[view].alias("worst_transform"), F.avg(F.when(bad, F.col("auroc"))).alias("mean_auroc"),
    )
    return out.withColumn("relative_degradation", F.try_divide(F.col("clean_auroc") - F.col("worst_auroc"), F.col("clean_auroc")))


def delta_auroc(metrics: DataFrame, view: str = "view", clean: str = "clean") -> DataFrame:
    """Each view's loss of AUROC against clean."""
    base = metrics.where(F.col(view) == clean).select(F.col("auroc").alias("clean_auroc")).limit(1)
    return metrics.select(view, "auroc").crossJoin(F.broadcast(base)).withColumn("delta_auroc", F.col("clean_auroc") - F.col("auroc"))


def confusion(df: DataFrame, y: str = "label", score: str = "score", threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    p, t = F.col(score) >= threshold, F.col(y) == 1
    out = df.where(F.col(score).isNotNull() & F.col(y).isin(0, 1)).groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return out.withColumn("fpr", F.col("fp") / F.greatest(F.lit(1), F.col("fp") + F.col("tn"))).withColumn("fnr", F.col("fn") / F.greatest(F.lit(1), F.col("fn") + F.col("tp")))


def confident_errors(df: DataFrame, key: str, y: str = "label", score: str = "score", k: int = 15, threshold: float = 0.5) -> DataFrame:
    """The k most confident false positives and the k most confident false negatives."""
    fp = df.where((F.col(y) == 0) & (F.col(score) >= threshold)).orderBy(F.col(score).desc(), key).limit(k).withColumn("kind", F.lit("false_positive"))
    fn = df.where((F.col(y) == 1) & (F.col(score) < threshold)).orderBy(F.col(score).asc(), key).limit(k).withColumn("kind", F.lit("false_negative"))
    return fp.unionByName(fn).select("kind", key, score)


def score_shift(df: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """Mean and percentiles of the scores of each class."""
    return df.groupBy(y).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), *(F.expr(f"percentile({score}, {q})").alias(n) for q, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))))


def rate_bias(df: DataFrame, y: str = "label", score: str = "score", threshold: float = 0.5, limit: float = 0.1) -> DataFrame:
    """Predicted against actual share of label 1, and the side of the bias if it is large."""
    out = df.agg(F.avg((F.col(score) >= threshold).cast("double")).alias("predicted_rate"), F.avg(F.col(y).cast("double")).alias("actual_rate"))
    gap = F.col("predicted_rate") - F.col("actual_rate")
    return out.withColumn("bias", F.when(gap > limit, "generated").when(gap < -limit, "authentic").otherwise("none"))


def per_generator(df: DataFrame, generator: str = "model_name", y: str = "label", score: str = "score", min_rows: int = 20) -> DataFrame:
    """AUROC of each generator's rows against all authentic rows. Authentic rows are
    summed to distinct scores first, so only those meet the generators."""
    real = df.where(F.col(y) == 0).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    fake = df.where((F.col(y) == 1) & F.col(generator).isNotNull())
    names = fake.groupBy(generator).count().where(F.col("count") >= min_rows).select(generator)
    rows = fake.join(names, generator).groupBy(generator, F.col(score).alias("s")).agg(F.count("*").alias("p"))
    both = rows.select("s").distinct().withColumn("n", F.lit(0).cast("long")).unionByName(real).groupBy("s").agg(F.sum("n").alias("n"))
    below = ranked_sums(both, "s", "n").select("s", (F.col("n") / 2 + F.col("_below")).alias("w"))
    total = real.agg(F.sum("n").alias("neg"))
    out = rows.join(below, "s").groupBy(generator).agg(F.sum("p").alias("n_generated"), F.sum(F.col("p") * F.col("w")).alias("u"))
    return out.crossJoin(F.broadcast(total)).select(generator, "n_generated", F.try_divide("u", F.col("n_generated") * F.col("neg")).alias("auroc"))


def ranked_sums(df: DataFrame, order: str, value: str, bands: int = 64) -> DataFrame:
    """Add ``_below``: the sum of value over rows with a smaller order column."""
    bounds = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / bands for i in range(1, bands)], 1000)).first()[0] or []
    banded = df.withColumn("_band", sum((F.col(order) > b).cast("int") for b in sorted(set(bounds))) if bounds else F.lit(0))
    before, table = 0, []
    for r in banded.groupBy("_band").agg(F.sum(value).alias("v")).orderBy("_band").collect():  # a row for each band
        table += [F.lit(r["_band"]), F.lit(before)]
        before += r["v"]
    start = F.element_at(F.create_map(*table), F.col("_band")) if table else F.lit(0)
    own = Window.partitionBy("_band").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return banded.withColumn("_below", start + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_band")


def spread(per: DataFrame, limit: float = 0.15) -> DataFrame:
    out = per.agg(F.min("auroc").alias("low"), F.max("auroc").alias("high"))
    return out.withColumn("spread", F.col("high") - F.col("low")).withColumn("concentrated", F.coalesce(F.col("spread") > limit, F.lit(False)))


def overall_verdict(metrics: DataFrame, limit: float = 0.05) -> DataFrame:
    gap = F.col("best_balanced_accuracy") - F.col("balanced_accuracy")
    return metrics.withColumn("threshold_gap", gap).withColumn("verdict", F.when(gap > limit, "calibration").otherwise("separation"))


def youden(df: DataFrame, keys: Sequence[str] = (), y: str = "label", score: str = "score") -> DataFrame:
    """Threshold of the largest tpr - fpr and the accuracy it gives."""
    points = roc_points(df, keys, y, score).where("pos > 0 and neg > 0")
    best = F.max(F.struct((F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg")).alias("j"), "score", ((F.col("tp") + F.col("neg") - F.col("fp")) / (F.col("pos") + F.col("neg"))).alias("accuracy")))
    return points.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.score").alias("threshold"), F.col("b.j").alias("j"), F.col("b.accuracy").alias("accuracy"))


def bootstrap_auroc(df: DataFrame, key: str, y: str = "label", score: str = "score", n: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean, deviation and percentile interval of AUROC over n resamples; resamples
    with one class are skipped. Draw j of resample b is row hash(seed:b:j) mod rows."""
    from .sampling import with_rank

    rows = with_rank(df.where(F.col(score).isNotNull() & F.col(y).isin(0, 1)).select(key, y, score), key).select(F.col("_rank").alias("i"), y, score)
    total = rows.count()
    draws = df.sparkSession.range(n * total).select((F.col("id") % n).alias("b"), F.floor(F.col("id") / n).alias("j"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string")), 256), 1, 8), 16, 10).cast("long")
    auroc = compute_metrics(draws.withColumn("i", h % max(total, 1)).join(rows, "i"), ["b"], y, score).where("auroc is not null")
    tail = (1 - ci) / 2
    return auroc.agg(F.count("*").alias("n"), F.avg("auroc").alias("mean"), F.stddev_pop("auroc").alias("std"), F.expr(f"percentile(auroc, {tail})").alias("low"), F.expr(f"percentile(auroc, {1 - tail})").alias("high"))


def weighted_average(df: DataFrame, value: str, n: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("average"))
