import math

import numpy as np
from pyspark.sql import functions as F

from lodestat.operators import calibration, metrics


def scored(spark, y, s, **keys):
    return spark.createDataFrame([(int(a), float(b), *keys.values()) for a, b in zip(y, s, strict=True)], "label int, score double" + "".join(f", {k} string" for k in keys))


def brute(y, s):
    p, n = s[y == 1], s[y == 0]
    return float(((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])).mean())


def test_known_values(spark):
    y = [0] * 5 + [1] * 5
    perfect = metrics.compute_metrics(scored(spark, y, y)).first()
    assert perfect["auroc"] == perfect["average_precision"] == 1 and perfect["eer"] == 0 and perfect["best_balanced_accuracy"] == 1
    inverted = metrics.compute_metrics(scored(spark, y, [1 - v for v in y])).first()
    assert inverted["auroc"] == 0 and inverted["accuracy"] == 0
    constant = metrics.compute_metrics(scored(spark, y, [0.5] * 10)).first()
    assert constant["auroc"] == 0.5 and constant["best_threshold"] == 0.5 and constant["eer"] == 0.5


def test_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 40
    got = metrics.compute_metrics(scored(spark, y, s)).first()
    assert math.isclose(got["auroc"], brute(y, s), abs_tol=1e-12)
    cut = np.unique(s)[::-1]
    tpr, fpr = (np.array([(s[y == c] >= t).mean() for t in cut]) for c in (1, 0))
    assert math.isclose(got["tpr_at_fpr"][0.1], tpr[fpr <= 0.1].max() if (fpr <= 0.1).any() else 0)
    assert math.isclose(got["best_balanced_accuracy"], max(((tpr + 1 - fpr) / 2).max(), 0.5))
    assert math.isclose(metrics.youden(scored(spark, y, s)).first()["j"], (tpr - fpr).max())


def test_one_class_is_null_and_groups_with_null_keys(spark):
    df = scored(spark, [1, 1], [0.2, 0.9], view="a").unionByName(scored(spark, [0, 1], [0.2, 0.9], view="b")).unionByName(scored(spark, [0, 1], [0.9, 0.2], view="c").withColumn("view", F.lit(None).cast("string")))
    got = {r["view"]: r for r in metrics.compute_metrics(df, ["view"]).collect()}
    assert got["a"]["auroc"] is None and got["a"]["accuracy"] == 0.5 and got["b"]["auroc"] == 1 and got[None]["auroc"] == 0
    assert metrics.compute_metrics(df.where("false")).count() == 0


def test_ece_bins(spark):
    assert metrics.compute_metrics(scored(spark, [1, 1, 1, 1], [1.0, 1.0, 1.0, 1.0])).first()["ece"] == 0
    assert math.isclose(metrics.compute_metrics(scored(spark, [0, 0], [1.0, 1.0])).first()["ece"], 1)


def test_curve_drops_collinear_points(spark):
    rows = scored(spark, [1, 1, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5])
    full, short = (metrics.roc_curve(rows, drop_collinear=d).count() for d in (False, True))
    assert (full, short) == (6, 3)


def test_per_generator_is_brute_force(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 30, 300) / 30
    names = [f"g{i % 3}" for i in range(300)]
    df = spark.createDataFrame([(int(a), float(b), n) for a, b, n in zip(y, s, names, strict=True)], "label int, score double, model_name string")
    for r in metrics.per_generator(df, min_rows=1).collect():
        own = np.array([n == r["model_name"] for n in names])
        keep = (y == 0) | own
        assert math.isclose(r["auroc"], brute(y[keep], s[keep]), abs_tol=1e-12)


def test_calibration_keeps_the_order_and_fits_the_prior(spark, tmp_path):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    s = np.clip(0.1 + 0.1 * y + rng.normal(0, 0.05, 400), 0.001, 0.999)
    df = scored(spark, y, s)
    fit = calibration.fit_platt(df)
    out = {r["stage"]: r for r in calibration.report(df, fit).collect()}
    assert math.isclose(out["before"]["auroc"], out["after"]["auroc"], abs_tol=1e-9) and out["after"]["accuracy"] > out["before"]["accuracy"]
    prior = calibration.fit_to_prior(df, prior=0.25)
    assert abs(df.select(F.avg((prior.transform(F.col("score")) >= 0.5).cast("double"))).first()[0] - 0.25) < 0.01
    fit.save(spark, str(tmp_path / "c"))
    assert calibration.Calibration.load(spark, str(tmp_path / "c")) == fit
    assert calibration.Calibration.load_if_present(spark, str(tmp_path / "none")).is_identity


def test_budget_is_strict(spark):
    rows = spark.createDataFrame([("a", 1_999_999_999, True), ("b", 1, False)], "component string, n_parameters long, trainable boolean")
    got = calibration.budget(rows).first()
    assert not got["within_limit"] and got["headroom"] == 0 and got["frozen"] == 1
