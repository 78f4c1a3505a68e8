"""Detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.operators import detections as D
from vestigo.operators.fusion import normalize_reads
from vestigo.plans.derived import load, with_tables
from vestigo.plans.registry import query, r

# Size of the images the derived boxes lie in.
WIDTH, HEIGHT = 640.0, 128.0


def iou_sql(a: str, b: str) -> str:
    w = f"greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area = "greatest(0.0, ({0}x2-{0}x1)*({0}y2-{0}y1))"
    union = f"({area.format(a)} + {area.format(b)} - ({w})*({h}))"
    return f"(CASE WHEN {union} > 0 THEN ({w})*({h})/{union} ELSE 0.0 END)"


_SCORE = (
    "(greatest(1.0,x2-x1)*greatest(1.0,y2-y1))/81920.0*0.60 + "
    "(1.0-least(1.0,(abs((x1+x2)/2.0-320.0)/320.0 + abs((y1+y2)/2.0-64.0)/64.0)/2.0))*0.25 + confidence*0.15"
)

PRIORITIZED_SQL = (
    with_tables("detections", "reads")
    + f""", scored AS (SELECT *, {r(_SCORE, 6)} AS priority_score FROM detections),
    prioritized AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY priority_score DESC, det_id)
    AS priority_rank FROM scored)"""
)


def prioritized(spark, sf):
    return D.prioritize_detections(load(spark, sf, "detections"), WIDTH, HEIGHT)


@query(
    "prioritize_detections",
    PRIORITIZED_SQL
    + """ SELECT evidence_id, det_id, priority_score, priority_rank, priority_rank=1 AS is_primary_candidate
    FROM prioritized""",
)
def prioritize_detections(spark, sf):
    return prioritized(spark, sf).select(
        "evidence_id", "det_id", "priority_score", "priority_rank", "is_primary_candidate"
    )


def _nms_sql(source: str) -> str:
    return (
        with_tables("detections", recursive=True)
        + f""", pool AS ({source}),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY confidence DESC, det_id) AS rn FROM pool),
    walk AS (
      SELECT evidence_id, rn, [{{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept
      FROM ordered WHERE rn = 1
      UNION ALL
      SELECT o.evidence_id, o.rn, CASE WHEN len(list_filter(w.kept, lambda k: {iou_sql('o.', 'k.')} >= 0.45)) > 0
        THEN w.kept ELSE list_append(w.kept, {{'det_id': o.det_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END
      FROM walk w JOIN ordered o ON o.evidence_id = w.evidence_id AND o.rn = w.rn + 1),
    ends AS (SELECT evidence_id, arg_max(kept, rn) AS kept FROM walk GROUP BY evidence_id),
    survivors AS (SELECT evidence_id, unnest(kept).det_id AS det_id FROM ends)
    SELECT s.evidence_id, s.det_id, o.confidence, o.source FROM survivors s JOIN ordered o
    ON o.evidence_id = s.evidence_id AND o.det_id = s.det_id"""
    )


@query("nms", _nms_sql("SELECT * FROM detections"))
def nms(spark, sf):
    return D.nms(load(spark, sf, "detections")).select("evidence_id", "det_id", "confidence", "source")


@query(
    "merge_detections",
    with_tables("detections", recursive=True)
    + f""", ordered AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY source, det_id) AS rn
      FROM detections),
    boxes AS (SELECT evidence_id, rn, {{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2,
      'confidence': confidence, 'source': source}} AS b FROM ordered),
    walk AS (
      SELECT evidence_id, rn, [b] AS kept FROM boxes WHERE rn = 1
      UNION ALL
      SELECT evidence_id, rn, CASE WHEN slot IS NULL OR slot = 0 THEN list_append(kept, b)
        WHEN b.confidence > kept[slot].confidence THEN kept[1:slot-1] || [b] || kept[slot+1:] ELSE kept END
      FROM (SELECT o.evidence_id, o.rn, o.b, w.kept,
              list_position([{iou_sql('o.b.', 'k.')} >= 0.45 for k in w.kept], true) AS slot
            FROM walk w JOIN boxes o ON o.evidence_id = w.evidence_id AND o.rn = w.rn + 1)),
    ends AS (SELECT evidence_id, arg_max(kept, rn) AS kept FROM walk GROUP BY evidence_id),
    slots AS (SELECT evidence_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS slot FROM ends),
    ranked AS (SELECT evidence_id, k.det_id AS det_id, k.confidence AS confidence, k.source AS source,
      row_number() OVER (PARTITION BY evidence_id ORDER BY k.confidence DESC, slot) AS merged_rank FROM slots)
    SELECT * FROM ranked WHERE merged_rank <= 12""",
)
def merge_detections(spark, sf):
    merged = D.merge_detections(load(spark, sf, "detections"))
    return merged.select("evidence_id", "det_id", "confidence", "source", F.col("merged_rank").cast("bigint"))


@query(
    "detector_fallback_union",
    _nms_sql(
        """SELECT * FROM detections d WHERE source = 'primary' OR NOT EXISTS (SELECT 1 FROM detections p
        WHERE p.evidence_id = d.evidence_id AND p.source = 'primary' AND p.confidence >= 0.30)"""
    ),
)
def detector_fallback_union(spark, sf):
    return D.detector_fallback_union(load(spark, sf, "detections")).select(
        "evidence_id", "det_id", "confidence", "source"
    )


@query(
    "missing_valid_ocr",
    PRIORITIZED_SQL
    + """ SELECT evidence_id, det_id, priority_rank FROM prioritized p WHERE NOT EXISTS (
    SELECT 1 FROM reads r WHERE r.evidence_id = p.evidence_id AND r.det_rank = p.priority_rank
    AND length(regexp_replace(upper(r.text), '[^A-Z0-9]', '', 'g')) >= 6)""",
)
def missing_valid_ocr(spark, sf):
    reads = normalize_reads(load(spark, sf, "reads"))
    return D.missing_valid_ocr(prioritized(spark, sf), reads).select("evidence_id", "det_id", "priority_rank")


@query(
    "iou_pairs",
    with_tables("detections")
    + f""" SELECT * FROM (SELECT a.evidence_id, a.det_id AS a_det_id, b.det_id AS b_det_id,
    {iou_sql('a.', 'b.')} AS iou
    FROM detections a JOIN detections b ON a.evidence_id = b.evidence_id AND a.det_id < b.det_id) WHERE iou >= 0.45""",
)
def iou_pairs(spark, sf):
    return D.iou_pairs(load(spark, sf, "detections"))


@query(
    "top_regions",
    PRIORITIZED_SQL
    + """ SELECT evidence_id, det_id, priority_rank AS region FROM prioritized WHERE priority_rank <= 4""",
)
def top_regions(spark, sf):
    scored = load(spark, sf, "detections").withColumn(
        "priority_score", D.rnd(D.priority_score(WIDTH, HEIGHT), 6)
    )
    # Only the leading boxes are needed, so rank by falling score directly and let the top-n prune early.
    ranked = D.top_regions(scored.withColumn("priority_rank", -F.col("priority_score")), 4)
    return ranked.select("evidence_id", "det_id", F.col("region").cast("bigint"))
