"""Detectors behind one contract, and the grid of degraded views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images as I


class Detector:
    """Scores images. ``predict_batch`` gives one number for each image."""

    name = "detector"

    def predict_batch(self, images: list[np.ndarray]) -> list[float]:
        raise NotImplementedError

    def predict(self, df: DataFrame, content: str = "content") -> DataFrame:
        """image_path, pred, and error with a null pred where an image can't be read.
        The detector is sent to a worker once; images arrive in Arrow batches."""
        own = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                loaded = [I.load(x) for x in batch[content]]
                good = [i for i, (image, _) in enumerate(loaded) if image is not None]
                scores = own.predict_batch([loaded[i][0] for i in good])
                if len(scores) != len(good):
                    raise ValueError(f"{own.name} gave {len(scores)} scores for {len(good)} images")
                pred = pd.Series([None] * len(batch), dtype="float64")
                pred.iloc[good] = scores
                yield pd.DataFrame({"image_path": batch["image_path"], "pred": pred, "error": [e for _, e in loaded]})

        return df.select("image_path", F.col(content).alias(content)).mapInPandas(run, "image_path string, pred double, error string")


class ConstantDetector(Detector):
    """The same score for all; needs no image and stays in the JVM."""

    def __init__(self, score: float = 0.5):
        if not 0 <= score <= 1:
            raise ValueError("a score lies between 0 and 1")
        self.score, self.name = score, f"constant({score:g})"

    def predict_batch(self, images: list[np.ndarray]) -> list[float]:
        return [self.score] * len(images)

    def predict(self, df: DataFrame, content: str = "content") -> DataFrame:
        return df.select("image_path", F.lit(float(self.score)).alias("pred"))


class ProbeDetector(Detector):
    """An encoder (image to vector) under a linear head."""

    def __init__(self, encoder: Callable[[np.ndarray], np.ndarray], weights: list[float], bias: float):
        self.encoder, self.weights, self.bias, self.name = encoder, np.array(weights), bias, "probe"

    def predict_batch(self, images: list[np.ndarray]) -> list[float]:
        out = []
        for image in images:
            v = self.encoder(image)
            z = float(v @ self.weights / max(np.linalg.norm(v), 1e-8) + self.bias)
            out.append(float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z))))
        return out


class MeanDetector(Detector):
    """Mean brightness: a detector without weights, for tests and as a floor."""

    name = "mean"

    def predict_batch(self, images: list[np.ndarray]) -> list[float]:
        return [float(x.mean() / 255) for x in images]


def build_detector(spec: str, **settings) -> Detector:
    kinds = {"constant": ConstantDetector, "probe": ProbeDetector, "mean": MeanDetector}
    if spec not in kinds:
        raise ValueError(f"no detector {spec}; there are {sorted(kinds)}")
    return kinds[spec](**settings)


def predict_files(files: DataFrame, detector: Detector, include_failures: bool = False, degrade_by: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """image_path and pred of image files (path, content), each decoded once, degraded
    first if asked, in order of path. Files that can't be read are left out, or rows with
    a null pred."""
    own = detector if degrade_by is None else _Degraded(detector, degrade_by)
    rows = own.predict(files.select(F.col("path").alias("image_path"), "content"))
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    return (rows if include_failures else rows.where("pred is not null")).select("image_path", "pred", "error").orderBy("image_path")


class _Degraded(Detector):
    def __init__(self, detector: Detector, change: Callable[[np.ndarray], np.ndarray]):
        self.detector, self.change, self.name = detector, change, f"degraded {detector.name}"

    def predict_batch(self, images: list[np.ndarray]) -> list[float]:
        return self.detector.predict_batch([self.change(x) for x in images])


def drawn(vectors: DataFrame, broken=None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """path, content: each vector as a PNG of one row of grey pixels, cut short where ``broken``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grey = [np.floor(np.abs(np.asarray(v, float)) * 255).clip(0, 255).astype(np.uint8) for v in batch["v"]]
            raw = [I.encode_png(np.repeat(g[None, :, None], 3, axis=2)) for g in grey]
            yield pd.DataFrame({"path": batch["path"], "content": [x[:20] if b else x for x, b in zip(raw, batch["b"], strict=True)]})

    rows = vectors.select(F.concat(F.lit("/images/"), F.col(key).cast("string"), F.lit(".png")).alias("path"), F.col(vector).alias("v"), (F.lit(False) if broken is None else broken).alias("b"))
    return rows.mapInPandas(run, "path string, content binary")


def with_views(df: DataFrame) -> DataFrame:
    """Each row once for each view of the grid (16, a fixed list)."""
    return df.select("*", F.inline(F.array(*(F.struct(F.lit(v.name).alias("view"), F.lit(v.family).alias("family")) for v in I.eval_grid()))))


def degrade(df: DataFrame, content: str = "content", views: list[str] | None = None, crop: int = 256) -> DataFrame:
    """image_path, view, features of each image and view: decoded once, then
    degraded and cropped for every view (images that can't be read give nothing)."""
    grid = [v for v in I.eval_grid() if views is None or v.name in views]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["image_path"], batch[content], strict=True):
                image, _ = I.load(raw)
                if image is not None:
                    rows += [(path, v.name, I.native_crop(v.apply(image), crop).astype(np.float32).mean(axis=(0, 1)).tolist()) for v in grid]
            yield pd.DataFrame(rows, columns=["image_path", "view", "features"])

    return df.select("image_path", content).mapInPandas(run, "image_path string, view string, features array<float>")
