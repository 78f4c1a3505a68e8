"""Box arithmetic on four-column boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOX = ("x1", "y1", "x2", "y2")


def box_of(row: Column) -> list[Column]:
    return [row[name] for name in BOX]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union, 0 for empty or disjoint boxes."""
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = width * height
    area_a = F.greatest(zero, (a[2] - a[0]) * (a[3] - a[1]))
    area_b = F.greatest(zero, (b[2] - b[0]) * (b[3] - b[1]))
    union = area_a + area_b - inter
    return F.when(union > 0.0, inter / union).otherwise(zero)


def bbox_key(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Box rounded to whole pixels, as a join key; blank if any side is missing."""
    whole = [F.rint(c).cast("bigint").cast("string") for c in (x1, y1, x2, y2)]
    return F.coalesce(F.concat(whole[0], F.lit(","), whole[1], F.lit(","), whole[2], F.lit(","), whole[3]), F.lit(""))


def dms_to_decimal(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = deg + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)
