"""Mask statistics over pixel relations (image, y, x, class_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a label as a disease.
DISEASE_WORDS = ["cancer", "tumor", "edema", "effusion", "pneumonia", "pneumothorax", "atelectasis", "disease"]


def disease_classes(labels: DataFrame, words: list[str] | None = None) -> DataFrame:
    low = F.lower(F.col("label"))
    hit = F.lit(False)
    for w in words or DISEASE_WORDS:
        hit = hit | F.contains(low, F.lit(w))
    return labels.filter(hit)


def union_mask(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Foreground pixels of any mask, each once."""
    return pixels.filter("class_id > 0").select(*by, "y", "x").distinct()


def disease_pixels(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    ids = disease_classes(labels).select("class_id")
    return pixels.join(F.broadcast(ids) if ids.count() < 10_000 else ids, "class_id", "left_semi")


def bounding_boxes(pixels: DataFrame, by: list[str], width: Column, height: Column, ratio: float = 0.25) -> DataFrame:
    """(by, n, x0, y0, x1, y1): the box of the foreground, padded by a share of its size and clamped to the image; ends exclusive."""
    b = pixels.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.min("y").alias("b"), (F.max("x") + 1).alias("c"), (F.max("y") + 1).alias("d"))
    px, py = ((F.col("c") - F.col("a")) * ratio).cast("int"), ((F.col("d") - F.col("b")) * ratio).cast("int")
    return b.select(*by, "n", F.greatest(F.lit(0), F.col("a") - px).alias("x0"), F.greatest(F.lit(0), F.col("b") - py).alias("y0"), F.least(width, F.col("c") + px).alias("x1"), F.least(height, F.col("d") + py).alias("y1"))


def mask_rule(values: Column) -> Column:
    """How a mask's set of values is read: 'threshold' within {0, 255}, 'positive' within {0, 1}, else 'nonzero'."""
    within = lambda *v: F.size(F.array_except(values, F.array(*[F.lit(x) for x in v]))) == 0
    return F.when(within(0, 255), "threshold").when(within(0, 1), "positive").otherwise("nonzero")


def hit_rate(records: DataFrame, key: str, hit: Column, limit: int) -> DataFrame:
    """One row: share of hits among the first limit rows by key."""
    return records.select(key, hit.alias("hit")).orderBy(key).limit(limit).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)), 6).alias("hit_rate"))


def pixel_difference(a: DataFrame, b: DataFrame, by: list[str], value: str = "v", on: list[str] | None = None) -> DataFrame:
    """(by, diff): mean absolute difference over the pixels of both images, matched on by and place or the columns given; a pixel missing on one side counts as 0 there."""
    on = on or [*by, "y", "x"]
    j = a.select(*on, F.col(value).alias("va")).join(b.select(*on, F.col(value).alias("vb")), on, "full")
    return j.groupBy(*by).agg(F.round(F.avg(F.abs(F.coalesce("va", F.lit(0)) - F.coalesce("vb", F.lit(0)))), 6).alias("diff"))


def preferred_masks(masks: DataFrame, by: str, name: str) -> DataFrame:
    """Per image, masks whose file name tells a disease if there are any, else all."""
    from pyspark.sql import Window

    d = masks.withColumn("_d", F.lower(F.col(name)).rlike("disease|lesion|abnormal"))
    return d.withColumn("_any", F.max("_d").over(Window.partitionBy(by))).filter(F.col("_d") | ~F.col("_any")).drop("_d", "_any")


def resolve_paths(wanted: DataFrame, listing: DataFrame, key: str, candidates: str) -> DataFrame:
    """(key, path): the first candidate path, in array order, that the listing has; null if none."""
    c = wanted.select(key, F.posexplode(candidates).alias("p", "path"))
    got = c.join(listing.select("path"), "path", "left_semi").groupBy(key).agg(F.min_by("path", "p").alias("path"))
    return wanted.select(key).join(got, key, "left")


def apply_mask(pixels: DataFrame, mask: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Image pixels with those outside the mask set to 0; an image whose mask has no pixel stays as it is."""
    on = [*by, "y", "x"]
    inside = mask.select(*on).distinct().withColumn("_in", F.lit(True))
    masked = mask.select(*by).distinct().withColumn("_has", F.lit(True))
    j = pixels.join(inside, on, "left").join(masked, by, "left")
    return j.select(*on, F.when(F.col("_in") | F.col("_has").isNull(), F.col(value)).otherwise(F.lit(0)).alias(value))


def crop(pixels: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Pixels inside their image's box (x0, y0, x1, y1), moved to its corner; images without a box stay whole."""
    j = pixels.join(boxes.select(*by, "x0", "y0", "x1", "y1"), by, "left")
    j = j.filter("x0 is null or (x >= x0 and x < x1 and y >= y0 and y < y1)")
    return j.withColumns({"x": F.col("x") - F.coalesce("x0", F.lit(0)), "y": F.col("y") - F.coalesce("y0", F.lit(0))}).select(*pixels.columns)


def resize_nearest(pixels: DataFrame, by: list[str], size: tuple[Column, Column], target: tuple[Column, Column]) -> DataFrame:
    """Pixels of images of size (width, height) at target size; every target pixel takes the nearest source pixel.

    Each source pixel is repeated over the target pixels that fall on it, so there is no join.
    """
    (w, h), (tw, th) = size, target
    reach = lambda at, n, to: F.sequence(F.ceil((at * to - (n / 2)) / n + F.lit(0.0)).cast("int"), F.ceil(((at + 1) * to - (n / 2)) / n).cast("int") - 1)
    inside = lambda at, n, to: F.filter(F.when(F.ceil(((at + 1) * to - (n / 2)) / n).cast("int") - 1 >= F.ceil((at * to - (n / 2)) / n).cast("int"), reach(at, n, to)).otherwise(F.array().cast("array<int>")), lambda v: (v >= 0) & (v < to))
    rest = [c for c in pixels.columns if c not in (*by, "x", "y")]
    d = pixels.select(*by, *rest, F.explode(inside(F.col("x"), w, tw)).alias("_x"), "y")
    return d.select(*by, *rest, F.col("_x").alias("x"), F.explode(inside(F.col("y"), h, th)).alias("y")).select(*pixels.columns)
