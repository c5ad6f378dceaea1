"""Column expressions: sizes, content, hashes, probabilities, vectors. None of
them shuffles or leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model: source names that must not enter a pool, source
# keys of each content category in order, names of missing sources, and the folder
# names that stand for labels or for no generator.
CONTAMINATED = ("coco", "raise")
CONTENT = {
    "face": ("ffhq", "celeba", "celebhq", "metfaces"),
    "animal": ("afhqv2",),
    "scene": ("coco", "imagenet", "laion", "landscapeshq", "lhq", "vision"),
}
NO_SOURCE = ("", "n/a", "none", "nan")
LABEL_FOLDERS = {
    "0_real": 0, "real": 0, "nature": 0, "reals": 0, "authentic": 0,
    "1_fake": 1, "fake": 1, "ai": 1, "fakes": 1, "generated": 1, "synthetic": 1,
}
OTHER_FOLDERS = ("train", "val", "test", "validation", "extracted", "images")
FAKE_NAMES = ("1", "ai", "fake", "1_fake", "synthetic", "generated")
FAKE_WORDS = ("fake", "synthetic", "aigc", "gen", "tampered", "1")

U64_MAX = (1 << 64) - 1


def add_size_columns(df: DataFrame, resolution: str = "resolution") -> DataFrame:
    """width, height, min_side of a [w, h] list; 0 if it is null, short or holds nulls."""
    side = lambda i: F.when(F.size(resolution) >= 2, F.coalesce(F.get(resolution, F.lit(i)), F.lit(0))).otherwise(0).cast("long")
    out = df.withColumn("width", side(0)).withColumn("height", side(1))
    return out.withColumn("min_side", F.least("width", "height"))


def exclude_contaminated_sources(df: DataFrame, sources=CONTAMINATED) -> DataFrame:
    """Without authentic rows whose source name holds one of these; null labels and names stay."""
    if "model_name" not in df.columns:
        return df
    bad = F.lower(F.coalesce("model_name", F.lit("none"))).rlike("|".join(sources))
    return df.where(~(F.coalesce(F.col("label") == 0, F.lit(False)) & bad))


def native_crop_pool(df: DataFrame, crop_size: int = 256) -> DataFrame:
    return (df if "min_side" in df.columns else add_size_columns(df)).where(F.col("min_side") >= crop_size)


def content_category(source: Column) -> Column:
    """Category on which all comma-separated parts of a source agree, else null."""
    text = F.lower(F.trim(source))

    def of(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, keys in reversed(CONTENT.items()):
            out = F.when(part.rlike("|".join(keys)), F.lit(name)).otherwise(out)
        return out

    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    found = F.array_distinct(F.transform(parts, of))
    usable = ~text.isin(*NO_SOURCE) & (F.size(found) == 1)
    return F.when(usable, F.get(found, F.lit(0)))


def add_content_column(df: DataFrame, reliable_only: bool = True) -> DataFrame:
    """Authentic rows by model_name, others by real_source (trusted where subset is Manual)."""
    name, source = (F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("model_name", "real_source"))
    generated = content_category(source)
    if reliable_only and "subset" in df.columns:
        generated = F.when(F.col("subset") == "Manual", generated)
    return df.withColumn("content", F.when(F.col("label") == 0, content_category(name)).otherwise(generated))


def stable_hash(key: Column) -> Column:
    """First 64 bits of sha256 as an unsigned integer, decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_below(key: Column, fraction: float) -> Column:
    """Whether a key's hash falls into the first ``fraction`` of the hash range."""
    return stable_hash(key) < F.lit(str(int(fraction * U64_MAX) + 1)).cast("decimal(20,0)")


def shuffled(seed: int, key: Column) -> Column:
    """A sort key that stands for a seeded shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def seed_for_key(seed: int, key: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), 1, 8), 16, 10).cast("long")


def config_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def output_dim(dim: Column, layers: Column, pooled: Column) -> Column:
    """Feature width: one vector for each layer and one if pooled."""
    return dim * (layers + pooled.cast("int"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def calibrated(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * logit(p) + F.lit(b))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines with binary arithmetic do: halves of the scaled
    number away from zero, and what rounds to zero from below is -0.0."""
    scaled = F.signum(x) * F.round(F.abs(x) * 10.0**digits) / 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(x)


def l2_normalized(v: Column) -> Column:
    """A vector of length 1; null components stay null and add nothing to the length."""
    v = v.cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)))), F.lit(1e-8))
    return F.transform(v, lambda x: x / norm)


def dot(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear_score(v: Column, weights: list[float], bias: float) -> Column:
    return sigmoid(dot(l2_normalized(v), F.array(*map(F.lit, weights))) + F.lit(bias))


def is_alarming(auroc: Column, limit: float = 0.6) -> Column:
    return F.coalesce(F.greatest(auroc, 1 - auroc) >= limit, F.lit(False))


def smoothed_label(y: Column, s: float) -> Column:
    return y * (1 - s) + s / 2


def warmup_factor(step: Column, steps: int) -> Column:
    return F.least(F.lit(1.0), (step + 1) / F.lit(max(steps, 1)))


def path_parts(path: Column) -> Column:
    """Folders of a path, without its file name."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def label_from_path(path: Column) -> Column:
    """Label of the deepest folder that names one, else null."""
    table = F.create_map(*[F.lit(x) for kv in LABEL_FOLDERS.items() for x in kv])
    found = F.filter(F.transform(path_parts(path), lambda x: F.try_element_at(table, F.lower(x))), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(-1))


def generator_from_path(path: Column, root: Column | None = None) -> Column:
    """Folders that are neither labels nor structure, joined; else the root's name."""
    skip = F.array(*map(F.lit, [*LABEL_FOLDERS, *OTHER_FOLDERS]))
    kept = F.filter(path_parts(path), lambda x: ~F.array_contains(skip, F.lower(x)))
    return F.coalesce(F.nullif(F.array_join(kept, "/"), F.lit("")), root if root is not None else F.lit("root"))


def coerce_label(raw: Column) -> Column:
    """1 for numbers of 0.5 or more, or texts with a word for generated images."""
    number = raw.cast("string").try_cast("double")
    return F.when(number.isNotNull(), (number >= 0.5).cast("int")).otherwise(F.lower(raw.cast("string")).rlike("|".join(FAKE_WORDS)).cast("int"))


def label_from_value(raw: Column, path: Column) -> Column:
    """1 for a known name of generated images; without any value, by words in the path."""
    by_path = F.lower(F.coalesce(path, F.lit(""))).rlike("ai|fake|1_")
    return F.when(raw.isNull(), by_path.cast("int")).otherwise(F.lower(F.trim(raw.cast("string"))).isin(*FAKE_NAMES).cast("int"))


def is_validation_file(name: Column) -> Column:
    return F.lower(name).rlike("validation|val|test|eval")


def key_to_file(key: Column) -> Column:
    return F.concat(F.replace(F.replace(key, F.lit("/"), F.lit("_")), F.lit("#"), F.lit("__")), F.lit(".png"))


def is_image_path(path: Column) -> Column:
    return path.rlike(r"(?i)\.(jpg|jpeg|png|webp|bmp|tif|tiff)$") & ~path.rlike(r"(^|/)\._[^/]*$")


def metadata_features(width: Column, height: Column, size: Column, form: Column) -> Column:
    """What a file tells without its pixels: sides, pixels (1 at least), aspect, bytes,
    bytes for each pixel, and flags of its format. Missing sides count as 0."""
    w, h, n = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (width, height, size))
    pixels = F.greatest(w * h, F.lit(1.0))
    name = F.lower(F.coalesce(form, F.lit("")))
    return F.struct(
        w.alias("width"), h.alias("height"), pixels.alias("total_pixels"), (w / F.greatest(h, F.lit(1.0))).alias("aspect"), n.alias("file_size"), (n / pixels).alias("bytes_per_pixel"),
        name.isin("jpg", "jpeg").cast("int").alias("is_jpeg"), (name == "png").cast("int").alias("is_png"), (name == "webp").cast("int").alias("is_webp"),
    )


def shown(name: Column, width: int = 34) -> Column:
    """A name cut to the width of a report's column."""
    return F.substring(name, 1, width)
