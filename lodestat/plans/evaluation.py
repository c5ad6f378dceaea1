"""Whole evaluations: per view, per benchmark, per generator, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.sinks import markdown


def robustness(scores: DataFrame, view: str = "view", clean: str = "clean") -> tuple[DataFrame, DataFrame]:
    """(metrics of each view that has both classes, summary of the degraded views)."""
    cells = metrics.compute_metrics(scores, [view]).where("auroc is not null")
    return metrics.delta_auroc(cells, view, clean), metrics.matrix_summary(cells, view, clean)


def out_of_domain(scores: DataFrame, benchmark: str = "benchmark", development: str | None = None) -> DataFrame:
    """Each benchmark's metrics, its best threshold by Youden's J with the accuracy
    there, and the loss of AUROC against the development benchmark."""
    cells = metrics.compute_metrics(scores, [benchmark]).select(benchmark, "n_positive", "n_negative", "auroc", "average_precision", "accuracy")
    best = metrics.youden(scores, [benchmark]).select(benchmark, F.col("threshold").alias("youden_threshold"), F.col("accuracy").alias("calibrated_accuracy"))
    out = cells.join(best, benchmark, "left")
    if development is None:
        return out.withColumn("generalisation_gap", F.lit(None).cast("double"))
    base = cells.where(F.col(benchmark) == development).select(F.col("auroc").alias("_dev")).limit(1)
    return out.crossJoin(F.broadcast(base)).withColumn("generalisation_gap", F.col("_dev") - F.col("auroc")).drop("_dev")  # one row


def averaged_views(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Test-time augmentation: the mean score of a key's views."""
    return scores.groupBy(*keys).agg(F.avg(score).alias(score))


def generator_slices(cache: DataFrame, generator: str = "generator", label: str = "label") -> DataFrame:
    """Rows of each generator, with the number of authentic rows that every slice
    shares; the authentic rows themselves are not repeated."""
    real = cache.where(F.col(label) == 0).agg(F.count("*").alias("n_authentic"))
    return cache.where((F.col(label) == 1) & F.col(generator).isNotNull()).groupBy(generator).agg(F.count("*").alias("n_generated")).crossJoin(F.broadcast(real))


def one_view(cache: DataFrame, name: str = "clean", view: str = "view") -> DataFrame:
    return cache.where(F.col(view) == name)


def diagnose(frame: DataFrame, generator: str = "model_name") -> dict[str, DataFrame]:
    """The parts of a diagnosis: verdict, score shift, rate bias, generators and
    their spread, and the canaries for which the frame has columns."""
    per = metrics.per_generator(frame, generator)
    out = {
        "overall": metrics.overall_verdict(metrics.flat(metrics.compute_metrics(frame))), "score_shift": metrics.score_shift(frame), "rate_bias": metrics.rate_bias(frame),
        "per_generator": per.orderBy("auroc", generator), "spread": metrics.spread(per),
    }
    if "min_side" in frame.columns:
        out["scale_canary"] = metrics.flat(metrics.scale_canary(frame))
    if "format" in frame.columns:
        out["format_canary"] = metrics.flat(metrics.categorical_canary(frame, "format"))
    return out


def report(parts: dict[str, DataFrame]) -> str:
    """Small tables as one Markdown text."""
    return "\n\n".join(f"## {name}\n\n{markdown(df)}" for name, df in parts.items())
