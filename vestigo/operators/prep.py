"""Dataset preparation: label boxes, splits, split counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vestigo.functions.numbers import clamp
from vestigo.operators.spread import spread_rank
from vestigo.session import stash

# Class names and their numbers.
CLASSES = {
    "car": 0,
    "carro": 0,
    "motorcycle": 1,
    "moto": 1,
    "bus": 2,
    "onibus": 2,
    "truck": 3,
    "caminhao": 3,
    "van": 4,
    "pickup": 5,
    "vehicle": 0,
    "veiculo": 0,
}


def class_id(name: Column) -> Column:
    """Exact class name, else the first listed name that contains the label or is contained in it."""
    cleaned = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    exact = [F.when(cleaned == k, F.lit(v)) for k, v in CLASSES.items()]
    near = [F.when(cleaned.contains(k) | F.lit(k).contains(cleaned), F.lit(v)) for k, v in CLASSES.items()]
    return F.coalesce(*exact, *near)


def boxes_to_yolo(objects: DataFrame) -> DataFrame:
    """One label line per known object: class, centre and size relative to the image, within 0-1.

    Six decimals, half-even. `objects`: name, xmin, ymin, xmax, ymax, width, height.
    """

    def share(c: Column) -> Column:
        return F.bround(clamp(c, 0.0, 1.0).cast("decimal(28,12)"), 6).cast("double")

    w, h = F.col("width"), F.col("height")
    known = objects.withColumn("class_id", class_id(F.col("name"))).where(F.col("class_id").isNotNull())
    boxed = (
        known.withColumn("cx", share((F.col("xmin") + F.col("xmax")) / 2 / w))
        .withColumn("cy", share((F.col("ymin") + F.col("ymax")) / 2 / h))
        .withColumn("w", share((F.col("xmax") - F.col("xmin")) / w))
        .withColumn("h", share((F.col("ymax") - F.col("ymin")) / h))
    )
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    return boxed.withColumn("line", line)


def split_dataset(items: DataFrame, path: str, val_ratio: float = 0.15, test_ratio: float = 0.10) -> DataFrame:
    """Ordered split by path: train first, then val and test, the latter two at least one item each.

    Spark cuts the order into ranges of about equal numbers of items, whatever root the paths share.
    The ranges are written once, so that positions and offsets count the same ones.
    """
    ranges = stash(items.repartitionByRange(path).withColumn("_range", F.spark_partition_id()), "split-ranges")
    ranked = spread_rank(ranges, [], F.col("_range"), [F.col(path)], "position", total="total").drop("_range")
    test = F.greatest(F.lit(1), F.floor(F.col("total") * test_ratio))
    val = F.greatest(F.lit(1), F.floor(F.col("total") * val_ratio))
    train = F.col("total") - test - val
    return ranked.withColumn(
        "split",
        F.when(F.col("position") <= train, "train").when(F.col("position") <= train + val, "val").otherwise("test"),
    ).drop("total")


def hash_split(items: DataFrame, key: str, val_ratio: float = 0.15, test_ratio: float = 0.10) -> DataFrame:
    """Split by key hash: no shuffle, and an item keeps its split when others come and go."""
    share = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000
    return items.withColumn(
        "split", F.when(share < test_ratio, "test").when(share < test_ratio + val_ratio, "val").otherwise("train")
    )


def split_stats(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("items"))
