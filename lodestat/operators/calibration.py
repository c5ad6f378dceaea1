"""Score calibration, linear heads and metadata audits, fitted with Spark ML."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .metrics import compute_metrics


@dataclass(frozen=True)
class Calibration:
    """sigmoid(a * logit(p) + b)."""

    a: float = 1.0
    b: float = 0.0
    method: str = "identity"
    n_fit: int = 0

    @property
    def is_identity(self) -> bool:
        return self.a == 1.0 and self.b == 0.0

    def transform(self, p: Column) -> Column:
        return p if self.is_identity else C.calibrated(p, self.a, self.b)

    def transform_logits(self, z: Column) -> Column:
        return C.sigmoid(F.lit(self.a) * z + F.lit(self.b))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Calibration:
        return cls(**json.loads("".join(r["value"] for r in spark.read.text(path).collect())))

    @classmethod
    def load_if_present(cls, spark: SparkSession, path: str) -> Calibration:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return cls.load(spark, path) if exists else cls()


def _logistic(rows: DataFrame, c: float):
    n = rows.count()
    if rows.select("label").distinct().limit(2).count() < 2:
        raise ValueError("two classes are needed to fit")
    fit = LogisticRegression(featuresCol="features", labelCol="label", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)
    return fit, n


def fit_platt(df: DataFrame, score: str = "score", y: str = "label", c: float = 1e6) -> Calibration:
    rows = df.where(F.col(score).isNotNull() & F.col(y).isin(0, 1)).select(F.col(y).cast("double").alias("label"), array_to_vector(F.array(C.logit(F.col(score)))).alias("features"))
    fit, n = _logistic(rows, c)
    return Calibration(float(fit.coefficients[0]), float(fit.intercept), "platt", n)


def fit_to_prior(df: DataFrame, score: str = "score", prior: float = 0.5) -> Calibration:
    """Shift so that a share ``prior`` of the scores is 0.5 or more."""
    if not 0 < prior < 1:
        raise ValueError("prior must be between 0 and 1")
    cut, n = df.where(F.col(score).isNotNull()).agg(F.percentile(C.logit(F.col(score)), 1 - prior), F.count("*")).first()
    if not n:
        raise ValueError("no scores to fit")
    return Calibration(1.0, -float(cut), "prior", n)


def report(df: DataFrame, fit: Calibration, score: str = "score", y: str = "label") -> DataFrame:
    """Metrics before and after."""
    both = df.select(y, score).withColumn("stage", F.lit("before")).unionByName(df.select(y, fit.transform(F.col(score)).alias(score)).withColumn("stage", F.lit("after")))
    return compute_metrics(both, ["stage"], y, score)


@dataclass(frozen=True)
class LinearHead:
    weights: list[float]
    bias: float

    @property
    def n_parameters(self) -> int:
        return len(self.weights) + 1

    def score(self, features: Column) -> Column:
        return C.linear_score(features, self.weights, self.bias)


def fit_head(df: DataFrame, features: str = "features", y: str = "label", c: float = 1.0) -> LinearHead:
    """Logistic regression on L2-normalised features."""
    rows = df.select(F.col(y).cast("double").alias("label"), array_to_vector(C.l2_normalized(F.col(features))).alias("features"))
    fit, _ = _logistic(rows, c)
    return LinearHead([float(x) for x in fit.coefficients], float(fit.intercept))


def bias_audit(df: DataFrame, features: list[str], y: str = "label", train: str = "fit", seed: int = 42) -> DataFrame:
    """How well metadata alone tell the label: a random forest's held-out AUROC,
    its severity, and the importance of each feature."""
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)
    fit = RandomForestClassifier(featuresCol="features", labelCol=y, numTrees=100, maxDepth=6, seed=seed).fit(rows.where(train))
    auroc = compute_metrics(fit.transform(rows.where(f"not {train}")).select(y, vector_to_array("probability")[1].alias("score")), (), y, "score")
    level = F.when(F.col("auroc") > 0.85, "severe").when(F.col("auroc") > 0.7, "moderate").otherwise("low")
    weights = F.create_map(*[F.lit(x) for n, v in zip(features, fit.featureImportances.toArray(), strict=True) for x in (n, float(v))])
    return auroc.select("auroc", level.alias("severity"), weights.alias("importances"))


def view_logits(df: DataFrame, keys: list[str], logit: str, fit: Calibration) -> DataFrame:
    """Mean logit over the views of a key, calibrated after the mean."""
    return df.groupBy(*keys).agg(F.avg(logit).alias("mean_logit")).withColumn("score", fit.transform_logits(F.col("mean_logit")))


def budget(entries: DataFrame, limit: int = 2_000_000_000) -> DataFrame:
    """Parameter totals of (component, n_parameters, trainable) against a limit that
    they must stay below. Negative counts are an error."""
    checked = F.when(F.col("n_parameters") < 0, F.raise_error(F.lit("negative parameter count"))).otherwise(F.col("n_parameters")).cast("long")
    out = entries.withColumn("_n", checked).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("trainable"), F.col("_n"))), F.lit(0)).alias("trainable"))
    return out.select("total", "trainable", (F.col("total") - F.col("trainable")).alias("frozen"), (F.lit(limit) - F.col("total")).alias("headroom"), (F.col("total") / F.lit(limit)).alias("utilization"), (F.col("total") < limit).alias("within_limit"))


def warm_up(step: int, steps: int) -> float:
    """Weight of a consistency loss at a step: grows evenly to 1 over the first steps."""
    return 1.0 if steps <= 0 else min(max(step / steps, 0.0), 1.0)


def cosine_consistency(df: DataFrame, u: str, v: str) -> DataFrame:
    """Mean cosine distance of two views' feature vectors."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.greatest(F.sqrt(dot(u, u) * dot(v, v)), F.lit(1e-8))
    return df.agg(F.avg(1 - dot(u, v) / norm).alias("cosine"))


def consistency(df: DataFrame, p: str, q: str, y: str) -> DataFrame:
    """Mean binary cross-entropy of p and symmetric KL divergence of two views."""
    a, b = (F.greatest(F.least(F.col(c), F.lit(1 - 1e-7)), F.lit(1e-7)) for c in (p, q))
    bce = -(F.col(y) * F.log(a) + (1 - F.col(y)) * F.log(1 - a))
    kl = lambda s, t: s * F.log(s / t) + (1 - s) * F.log((1 - s) / (1 - t))
    return df.agg(F.avg(bce).alias("bce"), F.avg((kl(a, b) + kl(b, a)) / 2).alias("symmetric_kl"))
