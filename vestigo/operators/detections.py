"""Detection jobs: priority, suppression, merging, fallbacks, overlap pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vestigo.functions.geometry import BOX, box_of, iou
from vestigo.functions.numbers import rnd
from vestigo.operators.boxes import BoxIndex
from vestigo.operators.ordered import ordered_fold
from vestigo.operators.spread import falling_bucket, spread_rank

# Weights of area, centrality and confidence; overlap and fallback thresholds; caps.
AREA_WEIGHT, CENTRE_WEIGHT, CONFIDENCE_WEIGHT = 0.60, 0.25, 0.15
NMS_IOU = 0.45
FALLBACK_CONFIDENCE = 0.30
MERGE_CAP = 12
MIN_READ_LENGTH = 6


def priority_score(width: float, height: float) -> Column:
    x1, y1, x2, y2 = [F.col(c) for c in BOX]
    area = F.greatest(F.lit(1.0), x2 - x1) * F.greatest(F.lit(1.0), y2 - y1)
    dx = F.abs((x1 + x2) / 2.0 - width / 2.0) / max(1.0, width / 2.0)
    dy = F.abs((y1 + y2) / 2.0 - height / 2.0) / max(1.0, height / 2.0)
    centrality = 1.0 - F.least(F.lit(1.0), (dx + dy) / 2.0)
    share = area / max(1.0, width * height)
    return share * AREA_WEIGHT + centrality * CENTRE_WEIGHT + F.coalesce("confidence", F.lit(0.0)) * CONFIDENCE_WEIGHT


def prioritize_detections(detections: DataFrame, width: float, height: float) -> DataFrame:
    """Rank the boxes of each image by size, centrality and confidence."""
    scored = detections.withColumn("priority_score", rnd(priority_score(width, height), 6))
    return spread_rank(
        scored,
        ["evidence_id"],
        falling_bucket(F.col("priority_score"), 0.0, 1.0),
        [F.col("priority_score").desc(), F.col("det_id")],
        "priority_rank",
    ).withColumn("is_primary_candidate", F.col("priority_rank") == 1)


def nms(detections: DataFrame, threshold: float = NMS_IOU) -> DataFrame:
    """Greedy non-maximum suppression per image: a box stays if no kept box overlaps it enough.

    Boxes are read by falling confidence (missing counts as 0), then det_id, each image by one task
    that holds only the kept boxes, found by size and place (`BoxIndex`), so a box meets few of them
    however many there are. A box without area overlaps none.
    """
    columns = [c for c in detections.columns if c != "evidence_id"]
    i1, j1, i2, j2 = [columns.index(c) for c in BOX]

    def add(kept: BoxIndex, row: tuple) -> list[tuple]:
        box = (float(row[i1]), float(row[j1]), float(row[i2]), float(row[j2]))
        if kept.meets(box):
            return []
        kept.put(len(kept), box)
        return [row]

    turned = detections.withColumn("_turn", -F.coalesce("confidence", F.lit(0.0)))
    return ordered_fold(
        turned, "evidence_id", ["_turn", "det_id"], columns, lambda: BoxIndex(threshold), add, lambda kept: [],
        T.StructType([detections.schema["evidence_id"], *[detections.schema[c] for c in columns]]),
    )


def merge_detections(detections: DataFrame, threshold: float = NMS_IOU, cap: int | None = MERGE_CAP) -> DataFrame:
    """Primary boxes then secondary ones; an overlapping box replaces the first it meets if it is
    more confident; the most confident `cap` stay (all for None). A missing confidence counts as 0.
    Images are read in order, each by one task that holds only the boxes kept so far."""
    detections = detections.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    columns = [c for c in detections.columns if c != "evidence_id"]
    at = {c: i for i, c in enumerate(columns)}

    i1, j1, i2, j2 = [at[c] for c in BOX]

    def add(kept: tuple[BoxIndex, list], row: tuple) -> None:
        index, rows = kept
        box = (float(row[i1]), float(row[j1]), float(row[i2]), float(row[j2]))
        slot = index.first(box)
        if slot is None:
            index.put(len(rows), box)
            rows.append(row)
        elif row[at["confidence"]] > rows[slot][at["confidence"]]:
            index.put(slot, box)
            rows[slot] = row

    def close(kept: tuple[BoxIndex, list]) -> list:
        ranked = sorted(kept[1], key=lambda b: -b[at["confidence"]])[:cap]
        return [(*box, rank + 1) for rank, box in enumerate(ranked)]

    turned = detections.withColumn("_turn", F.when(F.col("source") == "primary", 0).otherwise(1))
    schema = detections.withColumn("merged_rank", F.lit(1)).schema
    start = lambda: (BoxIndex(threshold), [])
    return ordered_fold(turned, "evidence_id", ["_turn", "det_id"], columns, start, add, close, schema)


def detector_fallback_union(
    detections: DataFrame, min_confidence: float = FALLBACK_CONFIDENCE, threshold: float = NMS_IOU
) -> DataFrame:
    """Secondary boxes join only where the primary detector was unsure, then NMS."""
    sure = (
        detections.where(F.col("source") == "primary")
        .groupBy("evidence_id")
        .agg(F.max("confidence").alias("_best"))
        .where(F.col("_best") >= min_confidence)
    )
    fallback = detections.where(F.col("source") != "primary").join(sure, "evidence_id", "left_anti")
    pooled = detections.where(F.col("source") == "primary").unionByName(fallback)
    return nms(pooled, threshold)


def missing_valid_ocr(detections: DataFrame, reads: DataFrame, text: str = "text") -> DataFrame:
    """Ranked detections whose rank has no read of useful length; `text` is already normalised."""
    good = reads.where((F.length(text) >= MIN_READ_LENGTH) & (F.col("det_rank") > 0)).select(
        "evidence_id", F.col("det_rank").alias("priority_rank")
    )
    return detections.where(F.col("priority_rank") > 0).join(good, ["evidence_id", "priority_rank"], "left_anti")


def iou_pairs(detections: DataFrame, threshold: float = NMS_IOU, pitch: float = 64.0) -> DataFrame:
    """Overlapping pairs of an image. Boxes meet on shared grid cells, and a pair is reported
    only from the cell that holds the corner where their overlap begins."""

    def cells(side: str) -> DataFrame:
        spanned = detections.select(
            "evidence_id", *[F.col(c).alias(f"{side}_{c}") for c in ("det_id", *BOX)]
        )
        columns = F.sequence(F.floor(F.col(f"{side}_x1") / pitch), F.floor(F.col(f"{side}_x2") / pitch))
        rows = F.sequence(F.floor(F.col(f"{side}_y1") / pitch), F.floor(F.col(f"{side}_y2") / pitch))
        return spanned.withColumn("_cx", F.explode(columns)).withColumn("_cy", F.explode(rows))

    a, b = cells("a"), cells("b")
    met = a.join(b, ["evidence_id", "_cx", "_cy"]).where(
        (F.col("a_det_id") < F.col("b_det_id"))
        & (F.col("_cx") == F.floor(F.greatest("a_x1", "b_x1") / pitch))
        & (F.col("_cy") == F.floor(F.greatest("a_y1", "b_y1") / pitch))
    )
    overlap = iou([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX])
    return (
        met.withColumn("iou", overlap)
        .where(F.col("iou") >= threshold)
        .select("evidence_id", "a_det_id", "b_det_id", "iou")
    )


def top_regions(prioritized: DataFrame, n: int = 4) -> DataFrame:
    """First n boxes of each image by priority rank, renumbered; the partial top-n runs before the shuffle."""
    w = Window.partitionBy("evidence_id").orderBy("priority_rank", "det_id")
    return prioritized.withColumn("region", F.row_number().over(w)).where(F.col("region") <= n)
