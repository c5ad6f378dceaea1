import numpy as np

from lodestat.plans import evaluation


def test_diagnosis_report(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    rows = [(int(a), float(np.clip(0.3 * a + rng.random() * 0.6, 0, 1)), f"g{i % 2}", 512 + i % 3, "PNG") for i, a in enumerate(y)]
    df = spark.createDataFrame(rows, "label int, score double, model_name string, min_side int, format string")
    parts = evaluation.diagnose(df)
    assert set(parts) == {"overall", "score_shift", "rate_bias", "per_generator", "spread", "scale_canary", "format_canary"}
    text = evaluation.report({k: parts[k] for k in ("per_generator", "format_canary")})
    assert "## per_generator" in text and "| g0 |" in text
    assert parts["format_canary"].first()["auroc"] == 0.5


def test_robustness_skips_views_of_one_class(spark):
    rows = [("clean", 1, 0.9), ("clean", 0, 0.1), ("blur", 1, 0.2), ("blur", 0, 0.4), ("jpeg", 1, 0.5)]
    cells, summary = evaluation.robustness(spark.createDataFrame(rows, "view string, label int, score double"))
    assert {r["view"]: r["delta_auroc"] for r in cells.collect()} == {"clean": 0.0, "blur": 1.0}
    s = summary.first()
    assert s["worst_transform"] == "blur" and s["relative_degradation"] == 1.0
