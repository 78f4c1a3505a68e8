"""Benchmark, calibration, gate and dataset-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.functions.numbers import norm_conf, rnd
from vestigo.functions.plates import norm_plate, pattern_quality
from vestigo.operators import bench as B, fusion as U, prep as N
from vestigo.plans.derived import _PLATE, add, load, read, with_tables
from vestigo.plans.fusion import FUSED_SQL, NORM, clean, quality_sql
from vestigo.plans.registry import matching_sql, query, r, xsum

# -- derived tables ----------------------------------------------------------------------------

add(
    "catalog_items",
    "part",
    [
        "p_partkey AS pos",
        "p_name || '_' || p_brand || '.jpg' AS image",
        "CASE WHEN p_size%3=0 THEN 'scene' WHEN p_size%3=1 THEN 'crop' ELSE 'pdf' END AS kind",
        "CASE WHEN p_partkey%5=0 THEN '' ELSE 'ABC' || lpad(CAST(p_partkey%10000 AS STRING),4,'0') END AS expected_text",
        "CASE WHEN p_size<15 THEN 'easy' WHEN p_size<30 THEN 'medium' WHEN p_size<42 THEN 'hard' ELSE 'critical' END "
        "AS difficulty",
        "p_type",
        "p_size",
    ],
)
add(
    "expected_plates",
    "orders",
    ["o_orderkey AS evidence_id", "o_orderkey*7 AS seed"],
    ["evidence_id", f"{_PLATE} AS expected_text"],
)
add(
    "ocr_samples",
    "orders",
    [
        "o_orderkey AS sample_id",
        "o_orderpriority AS scenario",
        "'ABC' || lpad(CAST(o_custkey%10000 AS STRING),4,'0') AS expected_text",
        "CASE WHEN o_orderkey%4=0 THEN 'ABC' || lpad(CAST(o_orderkey%10000 AS STRING),4,'0') "
        "ELSE 'ABC' || lpad(CAST(o_custkey%10000 AS STRING),4,'0') END AS top_text",
        "o_orderkey%3<>0 AS matched",
        "CASE WHEN o_custkey%7=0 THEN NULL ELSE 1+o_custkey%5 END AS expected_rank",
        "o_totalprice/100000 AS weighted_support",
        "CASE WHEN o_orderstatus='P' THEN 'pdf' WHEN o_orderstatus='F' THEN 'crop' ELSE 'scene' END AS kind",
    ],
)
add(
    "engine_matches",
    "lineitem",
    [
        "l_orderkey AS sample_id",
        "'engine_' || lower(l_returnflag) AS engine",
        "l_suppkey%4<>0 AND l_returnflag<>'R' AS top_match",
        "l_partkey%5<>0 AS candidate_found",
        "CASE WHEN l_partkey%5<>0 THEN 1+l_partkey%6 END AS candidate_rank",
        "l_extendedprice/1000 AS best_score",
        "l_discount*1000 AS avg_conf",
    ],
)
add(
    "detector_results",
    "lineitem",
    [
        "CASE WHEN l_linenumber%3=0 THEN 'crop' ELSE 'scene' END AS kind",
        "CASE WHEN l_returnflag='R' THEN 500 ELSE 200 END AS status_code",
        "l_quantity/10 AS aspect",
        "l_linestatus='F' AND l_suppkey%2=0 AS used_full_image",
        "l_suppkey%3<>0 AS roi_detected",
        "l_discount*1000 AS selected_quality",
        "l_extendedprice/500 AS selected_score",
        "l_extendedprice AS area",
        "CASE WHEN l_partkey%3=0 THEN 'contour' WHEN l_partkey%3=1 THEN 'model' ELSE 'none' END AS selected_source",
        "CASE WHEN l_discount<0.03 THEN 'baixa' WHEN l_discount<0.07 THEN 'media' ELSE 'alta' END AS quality_label",
    ],
)
add(
    "scene_results",
    "orders",
    [
        "o_orderpriority AS scenario",
        "CASE WHEN o_custkey%5=0 THEN 'clahe_soft_2' WHEN o_custkey%5=1 THEN 'clahe_strong' WHEN o_custkey%5=2 "
        "THEN 'gamma_dark' WHEN o_custkey%5=3 THEN 'original' ELSE 'Sharpen_x' END AS variant",
        "CASE WHEN o_custkey%2=0 THEN 'OpenCV' ELSE 'hdr' END AS family",
        "o_orderkey%3<>0 AND o_custkey%5<>2 AS matched",
        "o_totalprice/5000 AS confidence",
    ],
)
add(
    "video_cases",
    "events",
    [
        "event_id AS case_id",
        "event_type AS quality_class",
        "CASE WHEN user_id%3=0 THEN 'noite' ELSE 'dia' END AS scene_a",
        "CASE WHEN user_id%5=0 THEN 'chuva' ELSE '' END AS scene_b",
        "event_type<>'error' AS ok",
        "CASE WHEN user_id%4=0 THEN '' ELSE 'ABC' || lpad(CAST(user_id%10000 AS STRING),4,'0') END AS expected",
        "CASE WHEN event_id%6=0 THEN '' WHEN event_id%7=0 THEN 'XYZ0000' "
        "ELSE 'ABC' || lpad(CAST(user_id%10000 AS STRING),4,'0') END AS predicted",
        "value/100 AS overall_confidence",
        "value AS consensus_ratio",
        "(100-value)/100 AS image_quality_score",
    ],
    ["*", "expected<>'' AND expected=predicted AS matched"],
)
add(
    "config_rows",
    "lineitem",
    ["l_orderkey*7 AS seed", "l_returnflag", "l_linestatus", "l_partkey", "l_discount"],
    [
        "'cfg_' || lower(l_returnflag) AS config",
        "CASE WHEN l_linestatus='O' THEN 'aberto' ELSE 'fechado' END AS segment",
        f"{_PLATE} AS expected",
        f"CASE WHEN l_partkey%4=0 THEN substr({_PLATE},2,6) WHEN l_partkey%4=1 THEN replace({_PLATE},'A','4') "
        f"ELSE {_PLATE} END AS observed",
        "1-l_discount*10 AS confidence",
    ],
)
add(
    "suite_jobs",
    "lineitem",
    [
        "'group_' || lower(l_returnflag) AS job_group",
        "'bench_' || CAST(l_linenumber AS STRING) AS benchmark",
        "CASE WHEN l_suppkey%10=0 THEN 'failed' ELSE 'ok' END AS status",
        "l_extendedprice/1000 AS duration_sec",
    ],
)
add(
    "battery_cases",
    "orders",
    [
        "o_orderpriority AS battery",
        "CASE WHEN o_orderstatus='P' THEN 'timeout' ELSE '' END AS error",
        "o_orderkey%5<>0 AS matched",
        "o_totalprice/10000 AS elapsed_seconds",
        "o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AS older",
        "o_orderkey AS case_id",
    ],
)

# -- manifests ---------------------------------------------------------------------------------

_TARGET_SQL = """list_filter(['scene_preprocess', CASE WHEN p_size%2=0 THEN 'plate_detector' END,
  CASE WHEN p_type<>'ECONOMY' THEN 'ocr_reranking' END], lambda t: t IS NOT NULL)"""


def catalog(spark, sf):
    items = load(spark, sf, "catalog_items")
    targets = F.array_compact(
        F.array(
            F.lit("scene_preprocess"),
            F.when(F.col("p_size") % 2 == 0, "plate_detector"),
            F.when(F.col("p_type") != "ECONOMY", "ocr_reranking"),
        )
    )
    return items.withColumn("targets", targets)


def manifests(spark, sf):
    items = catalog(spark, sf)
    core = items.where(F.col("difficulty") == "critical").select("image")
    return B.build_manifests(items, core)


_MANIFEST_SQL = (
    with_tables("catalog_items")
    + f""", items AS (SELECT *, {_TARGET_SQL} AS targets FROM catalog_items),
    core AS (SELECT DISTINCT image FROM items WHERE difficulty = 'critical'),
    ruled AS (
      SELECT 'scene_preprocess' AS m, i.* FROM items i WHERE list_contains(targets, 'scene_preprocess') AND expected_text <> ''
      UNION ALL SELECT 'plate_detector', i.* FROM items i WHERE list_contains(targets, 'plate_detector') AND kind <> 'pdf'
      UNION ALL SELECT 'ocr_reranking', i.* FROM items i WHERE list_contains(targets, 'ocr_reranking') AND expected_text <> ''
      UNION ALL SELECT 'ocr_reranking_real', i.* FROM items i
        WHERE list_contains(targets, 'ocr_reranking') AND expected_text <> '' AND kind <> 'pdf'
      UNION ALL SELECT 'ocr_reranking_core_real', i.* FROM items i
        WHERE list_contains(targets, 'ocr_reranking') AND expected_text <> '' AND kind <> 'pdf' AND image IN (SELECT image FROM core)
      UNION ALL SELECT 'ocr_reranking_crops_real', i.* FROM items i
        WHERE list_contains(targets, 'ocr_reranking') AND expected_text <> '' AND kind = 'crop'),
    leveled AS (SELECT m AS manifest, image, kind, expected_text, difficulty, pos FROM ruled UNION ALL
      SELECT m || '_hard', image, kind, expected_text, difficulty, pos FROM ruled WHERE difficulty IN ('hard', 'critical')),
    manifests AS (SELECT manifest, image, kind, expected_text, difficulty, pos FROM (SELECT *, row_number() OVER
      (PARTITION BY manifest, image, kind ORDER BY pos) AS n FROM leveled) WHERE n = 1)"""
)


@query("build_manifests", _MANIFEST_SQL + " SELECT * FROM manifests")
def build_manifests(spark, sf):
    return manifests(spark, sf)


@query(
    "manifest_summary",
    _MANIFEST_SQL
    + """ SELECT manifest, count(*) AS entries, count(*) FILTER (expected_text <> '') AS with_expected_text,
    count(*) FILTER (kind = 'pdf') AS pdf_count, count(*) FILTER (difficulty = 'easy') AS easy_count,
    count(*) FILTER (difficulty = 'medium') AS medium_count, count(*) FILTER (difficulty = 'hard') AS hard_count,
    count(*) FILTER (difficulty = 'critical') AS critical_count FROM manifests GROUP BY manifest""",
)
def manifest_summary(spark, sf):
    return B.manifest_summary(manifests(spark, sf), ["easy", "medium", "hard", "critical"])


# -- reading accuracy --------------------------------------------------------------------------


@query(
    "candidate_rank",
    FUSED_SQL.replace("WITH ", with_tables("expected_plates") + ", ", 1)
    + """ SELECT e.evidence_id, e.expected_text, coalesce(min(k.rank), -1) AS expected_rank FROM expected_plates e
    LEFT JOIN ranked k ON k.evidence_id = e.evidence_id AND k.text = e.expected_text GROUP BY ALL""",
)
def candidate_rank(spark, sf):
    ranked = U.rank_and_filter(U.text_candidates(clean(spark, sf)))
    return B.candidate_rank(ranked, load(spark, sf, "expected_plates"))


def pct(part: str, whole: str, places: int = 2) -> str:
    return r(f"{part}/greatest(1, {whole})*100.0", places)


@query(
    "ocr_accuracy",
    with_tables("ocr_samples")
    + f""", t AS (SELECT count(*) AS total, count(*) FILTER (matched) AS matched,
      count(*) FILTER (expected_text <> '' AND top_text = expected_text) AS top, count(expected_rank) AS found,
      {xsum('expected_rank')}/count(expected_rank) AS mean_rank, quantile_cont(expected_rank::DOUBLE, 0.5) AS median_rank,
      CAST(sum(CAST(weighted_support AS DECIMAL(28,12))) FILTER (matched) AS DOUBLE)/count(*) FILTER (matched) AS good,
      CAST(sum(CAST(weighted_support AS DECIMAL(28,12))) FILTER (NOT matched) AS DOUBLE)/count(*) FILTER (NOT matched) AS bad
      FROM ocr_samples)
    SELECT total, matched, {pct('matched', 'total')} AS accuracy_percent, top AS top_candidate_match_count,
      {pct('top', 'total')} AS top_candidate_match_rate_percent, found AS expected_in_top_count,
      {pct('found', 'total')} AS expected_in_top_rate_percent, {r('coalesce(mean_rank, 0)', 3)} AS avg_expected_rank,
      {r('coalesce(median_rank, 0)', 3)} AS median_expected_rank, {r('coalesce(good, 0)', 3)} AS avg_support_matched,
      {r('coalesce(bad, 0)', 3)} AS avg_support_mismatched FROM t""",
)
def ocr_accuracy(spark, sf):
    return B.ocr_accuracy(load(spark, sf, "ocr_samples"))


_ENGINE_SQL = (
    with_tables("engine_matches")
    + f""", t AS (SELECT engine, count(*) AS total, count(*) FILTER (top_match) AS top_match,
      count(*) FILTER (candidate_found) AS candidate_found, coalesce({xsum('candidate_rank')}/count(candidate_rank), 0)
      AS mean_rank, quantile_cont(candidate_rank::DOUBLE, 0.5) AS median_rank, {xsum('best_score')}/count(*) AS mean_score,
      {xsum('avg_conf')}/count(*) AS mean_conf FROM engine_matches GROUP BY engine)"""
)


@query(
    "per_engine_summary",
    _ENGINE_SQL
    + f""" SELECT engine, total, top_match, candidate_found, {pct('top_match', 'total')} AS top_match_rate_percent,
    {pct('candidate_found', 'total')} AS candidate_recall_rate_percent, {r('mean_rank', 3)} AS mean_candidate_rank,
    {r('coalesce(median_rank, 0)', 3)} AS median_candidate_rank, {r('mean_score', 2)} AS mean_top_score,
    {r('mean_conf', 2)} AS mean_top_confidence FROM t""",
)
def per_engine_summary(spark, sf):
    return B.per_engine_summary(load(spark, sf, "engine_matches"))


@query(
    "engine_calibration",
    _ENGINE_SQL
    + f""", q AS (SELECT engine, top_match/total AS m, top_match/total*0.60 + candidate_found/total*0.25 +
      (CASE WHEN mean_rank > 0 THEN greatest(0.2, least(1.0, 1.2/greatest(1.0, mean_rank))) ELSE 1.0 END)*0.15 AS quality
      FROM t)
    SELECT engine, {r('quality', 6)} AS quality,
      {r('greatest(0.55, least(1.35, 1.0 + greatest(-0.10, least(0.10, (quality-0.55)*0.28))))', 3)} AS weight,
      CASE WHEN m >= 0.75 THEN 0.19 WHEN m <= 0.45 THEN 0.17 ELSE 0.18 END::DOUBLE AS factor_min,
      CASE WHEN m >= 0.75 THEN 1.03 WHEN m <= 0.45 THEN 0.96 ELSE 1.0 END::DOUBLE AS factor_max FROM q""",
)
def engine_calibration(spark, sf):
    return B.engine_calibration(load(spark, sf, "engine_matches"))


@query(
    "support_thresholds",
    with_tables("ocr_samples")
    + f""", s AS (SELECT quantile_cont(weighted_support, 0.2) FILTER (matched) AS p20,
      quantile_cont(weighted_support, 0.8) FILTER (NOT matched) AS p80,
      quantile_cont(weighted_support, 0.75) FILTER (kind = 'pdf') AS p75,
      CAST(sum(CAST(weighted_support AS DECIMAL(28,12))) FILTER (matched) AS DOUBLE)/count(*) FILTER (matched) AS good,
      CAST(sum(CAST(weighted_support AS DECIMAL(28,12))) FILTER (NOT matched) AS DOUBLE)/count(*) FILTER (NOT matched) AS bad,
      {xsum('expected_rank')}/count(expected_rank) AS mean_rank FROM ocr_samples)
    SELECT {r('greatest(0.16, least(0.28, 0.22 + (1.15-mean_rank)*0.015))', 3)} AS rank_decay_step,
      {r('greatest(1.05, least(1.75, 1.35 + (good-bad)*0.12))', 3)} AS support_bonus_per_engine,
      {r('greatest(6.4, greatest(5.8, least(8.5, p80+0.25)), greatest(5.8, least(8.5, p20-0.15)))', 3)}
        AS single_engine_min_weighted_support,
      {r('greatest(6.6, greatest(5.8, least(8.5, p75+0.15)))', 3)} AS pdf_probable_min_weighted_support FROM s""",
)
def support_thresholds(spark, sf):
    return B.support_thresholds(load(spark, sf, "ocr_samples"))


# -- detector ----------------------------------------------------------------------------------


@query(
    "detector_summary",
    with_tables("detector_results")
    + f""" SELECT count(*) AS total, count(*) FILTER (kind = 'scene') AS scene_total,
    count(*) FILTER (kind <> 'scene') AS crop_total, count(*) FILTER (roi_detected) AS roi_detected_total,
    count(*) FILTER (used_full_image) AS full_image_total,
    {pct("count(*) FILTER (kind = 'scene' AND roi_detected)", "count(*) FILTER (kind = 'scene')")} AS scene_roi_rate_percent,
    {pct("count(*) FILTER (kind = 'scene' AND used_full_image)", "count(*) FILTER (kind = 'scene')")} AS scene_fallback_rate_percent,
    {r(xsum('selected_score') + '/count(*)', 2)} AS avg_selected_score,
    {r(xsum('selected_quality') + '/count(*)', 2)} AS avg_selected_quality FROM detector_results""",
)
def detector_summary(spark, sf):
    return B.detector_summary(load(spark, sf, "detector_results"))


@query(
    "detector_counts",
    with_tables("detector_results")
    + """ SELECT 'selected_source' AS dimension, selected_source AS value, count(*) AS n FROM detector_results GROUP BY ALL
    UNION ALL SELECT 'quality_label', quality_label, count(*) FROM detector_results GROUP BY ALL
    UNION ALL SELECT 'kind', kind, count(*) FROM detector_results GROUP BY ALL""",
)
def detector_counts(spark, sf):
    return B.detector_counts(load(spark, sf, "detector_results"))


@query(
    "detector_calibration",
    with_tables("detector_results")
    + f""", u AS (SELECT * FROM detector_results WHERE status_code = 200 AND aspect > 0
      AND NOT (kind = 'scene' AND used_full_image)),
    c AS (SELECT count(*) AS usable, count(*) FILTER (kind = 'scene' AND roi_detected) AS roi,
      quantile_cont(aspect, 0.5) AS am, quantile_cont(aspect, 0.5) FILTER (selected_quality > 0) AS qm,
      quantile_cont(aspect, 0.1) FILTER (selected_quality > 0) AS p10,
      quantile_cont(aspect, 0.9) FILTER (selected_quality > 0) AS p90,
      quantile_cont(area, 0.15) FILTER (selected_quality > 0 AND area > 0) AS a15 FROM u)
    SELECT usable, roi AS scene_samples, roi AS scene_roi_detected, 100.0::DOUBLE AS scene_roi_rate_percent,
      {r('am', 3)} AS aspect_target, {r('qm', 3)} AS quality_aspect_target,
      {r('greatest(1.0, least(2.6, (p90-p10)/2.2))', 3)} AS aspect_tolerance,
      CAST(round_even(greatest(3000.0, least(30000.0, least(4500.0, a15*0.90))), 0) AS BIGINT) AS min_area FROM c""",
)
def detector_calibration(spark, sf):
    return B.detector_calibration(load(spark, sf, "detector_results"))


# -- scene -------------------------------------------------------------------------------------


@query(
    "scene_summary",
    with_tables("scene_results")
    + f""", v AS (SELECT scenario, variant, count(*) AS n FROM scene_results GROUP BY ALL),
    l AS (SELECT scenario, string_agg(variant || ':' || n, ',' ORDER BY n DESC, variant) AS variants FROM v GROUP BY scenario)
    SELECT scenario, count(*) AS total, count(*) FILTER (matched) AS correct,
      {pct('count(*) FILTER (matched)', 'count(*)')} AS accuracy_percent,
      {r(xsum('confidence') + '/count(*)', 2)} AS avg_confidence, any_value(variants) AS variants
    FROM scene_results JOIN l USING (scenario) GROUP BY scenario""",
)
def scene_summary(spark, sf):
    return B.scene_summary(load(spark, sf, "scene_results"))


# Known variant prefixes and the current profile values of the derived scenarios.
_PREFIXES = ["clahe", "clahe_soft", "gamma", "original"]


def _profiles(spark, sf):
    scenarios = load(spark, sf, "scene_results").select("scenario").distinct()
    rows = F.array(
        F.struct(F.lit("original_margin").alias("path"), F.lit(0.8).alias("value")),
        F.struct(F.lit("variant_prefix_bonus.clahe").alias("path"), F.lit(0.5).alias("value")),
    )
    return scenarios.withColumn("_p", F.explode(rows)).select("scenario", "_p.*")


_RATE = "(correct/total)"


@query(
    "scene_calibration",
    with_tables("scene_results")
    + f""", p AS (SELECT scenario, lower(family) AS family, matched, CASE WHEN lower(variant) LIKE 'clahe\\_soft%' ESCAPE '\\'
      THEN 'clahe_soft' WHEN lower(variant) LIKE 'original%' THEN 'original' WHEN lower(variant) LIKE 'clahe%' THEN 'clahe'
      WHEN lower(variant) LIKE 'gamma%' THEN 'gamma' ELSE split_part(lower(variant), '_', 1) END AS prefix FROM scene_results),
    s AS (SELECT scenario, count(*) AS total, count(*) FILTER (matched) AS correct FROM p GROUP BY scenario),
    f AS (SELECT scenario, family, count(*) AS total, count(*) FILTER (matched) AS correct FROM p GROUP BY ALL),
    x AS (SELECT scenario, prefix, count(*) AS total, count(*) FILTER (matched) AS correct FROM p GROUP BY ALL)
    SELECT scenario, 'original_margin' AS path, total, correct, {r(f'''CASE WHEN {_RATE} < 0.8 THEN
      greatest(0.2, least(1.0, 0.8-(0.8-{_RATE})*0.45)) WHEN {_RATE} > 0.92 THEN
      greatest(0.25, least(1.0, 0.8+({_RATE}-0.92)*0.15)) ELSE 0.8 END''', 3)} AS value FROM s
    UNION ALL SELECT f.scenario, 'family_bonus.' || family, f.total, f.correct,
      {r('greatest(-1.5, least(2.5, (f.correct/f.total - s.correct/s.total)*1.1))', 3)} FROM f JOIN s USING (scenario)
    UNION ALL SELECT scenario, 'variant_prefix_bonus.' || prefix, total, correct, {r(f'''greatest(-2.0, least(5.0,
      (CASE WHEN prefix = 'clahe' THEN 0.5 ELSE 0.0 END) + ({_RATE}-0.5)*1.8))''', 3)} FROM x""",
)
def scene_calibration(spark, sf):
    return B.scene_calibration(load(spark, sf, "scene_results"), _profiles(spark, sf), _PREFIXES)


# -- video -------------------------------------------------------------------------------------

_TARGETS = [("quality_class", "click", 0.5), ("quality_class", "view", 0.9), ("scenario", "noite", 0.6), ("scenario", "chuva", 0.95)]


@query(
    "group_precision",
    with_tables("video_cases")
    + f""", targets(dimension, value, min_precision) AS (VALUES {', '.join(f"('{d}', '{v}', {p}::DOUBLE)" for d, v, p in _TARGETS)}),
    m AS (SELECT *, CASE WHEN expected = '' THEN predicted = '' ELSE predicted = expected END AS hit FROM video_cases WHERE ok),
    tagged AS (SELECT 'quality_class' AS dimension, quality_class AS value, hit, expected = '' AS blank FROM m
      UNION ALL SELECT 'scenario', scene_a, hit, expected = '' FROM m
      UNION ALL SELECT 'scenario', CASE WHEN scene_b = '' THEN 'indefinida' ELSE scene_b END, hit, expected = '' FROM m)
    SELECT dimension, value, count(*) AS total, count(*) FILTER (hit) AS matched,
      {r('count(*) FILTER (hit)/count(*)', 6)} AS precision, coalesce(any_value(min_precision), 0.0::DOUBLE) AS target_precision,
      count(*) FILTER (hit)/count(*) >= coalesce(any_value(min_precision), 0.0) AS passed,
      {r('count(*) FILTER (blank)/count(*)', 6)} AS unlabelled_share
    FROM tagged LEFT JOIN targets USING (dimension, value) GROUP BY dimension, value""",
)
def group_precision(spark, sf):
    cases = load(spark, sf, "video_cases").withColumn("scenarios", F.array("scene_a", "scene_b"))
    targets = spark.createDataFrame(_TARGETS, "dimension string, value string, min_precision double")
    return B.group_precision(cases, targets)


def _nearest(c: str) -> str:
    return f"""(SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n
      FROM hits) WHERE i = CAST(round_even((n-1)*0.1, 0) AS BIGINT))"""


@query(
    "recommended_thresholds",
    with_tables("video_cases")
    + f""", hits AS (SELECT * FROM video_cases WHERE ok AND matched)
    SELECT {r(f"greatest(0.55, {_nearest('overall_confidence')})", 4)} AS confidence_min,
      {r(f"greatest(35.0, {_nearest('consensus_ratio')})", 2)} AS consensus_ratio_min,
      {r(f"greatest(0.45, {_nearest('image_quality_score')})", 4)} AS image_quality_min""",
)
def recommended_thresholds(spark, sf):
    return B.recommended_thresholds(load(spark, sf, "video_cases"))


# -- configurations ----------------------------------------------------------------------------

_CONFIG_SQL = (
    with_tables("config_rows", recursive=True)
    + f""", {matching_sql("SELECT DISTINCT expected AS a, observed AS b FROM config_rows WHERE expected <> ''")},
    s1 AS (SELECT c.*, coalesce(2.0::DOUBLE*matched/(length(expected)+length(observed)), 0.0) AS similarity, CASE WHEN observed = expected AND expected <> '' THEN 1.0 ELSE 0.0
      END::DOUBLE AS exact, {quality_sql('observed')} AS pattern FROM config_rows c LEFT JOIN matching ON a = expected AND b = observed),
    s2 AS (SELECT *, exact*0.65 + similarity*0.20 + confidence*0.10 + pattern*0.05 AS final FROM s1),
    s3 AS (SELECT config, segment, exact, similarity, confidence, final FROM s2 UNION ALL
      SELECT config, 'all', exact, similarity, confidence, final FROM s2),
    summary AS (SELECT config, segment, count(*) AS n, {r(xsum('exact') + '/count(*)', 4)} AS exact_rate,
      {r(xsum('similarity') + '/count(*)', 4)} AS avg_similarity, {r(xsum('confidence') + '/count(*)', 4)} AS avg_confidence,
      {r(xsum('final') + '/count(*)', 4)} AS avg_score, {r('quantile_cont(final, 0.5)', 4)} AS median_score
      FROM s3 GROUP BY config, segment)"""
)


def _scored(spark, sf):
    rows = load(spark, sf, "config_rows")
    return B.case_scores(rows.withColumn("pattern", pattern_quality(F.col("observed"))))


@query("config_summary", _CONFIG_SQL + " SELECT * FROM summary")
def config_summary(spark, sf):
    return B.config_summary(_scored(spark, sf))


@query(
    "config_selection",
    _CONFIG_SQL
    + """, placed AS (SELECT segment, config, avg_score, row_number() OVER (PARTITION BY segment ORDER BY avg_score DESC,
      exact_rate DESC, avg_similarity DESC, config) AS place FROM summary),
    counted AS (SELECT segment, count(*) AS configs FROM summary GROUP BY segment)
    SELECT p.segment, p.config AS best_config, p.avg_score AS best_score, c.configs FROM placed p JOIN counted c
    ON c.segment = p.segment WHERE p.place = 1""",
)
def config_selection(spark, sf):
    return B.config_selection(_scored(spark, sf))


# -- suites and gates --------------------------------------------------------------------------


@query(
    "suite_rollup",
    with_tables("suite_jobs")
    + f""", a AS (SELECT 'group' AS level, job_group AS name, * FROM suite_jobs UNION ALL
      SELECT 'benchmark', benchmark, * FROM suite_jobs)
    SELECT level, name, count(*) AS jobs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed,
      {r(xsum('duration_sec'), 3)} AS duration_sec FROM a GROUP BY level, name""",
)
def suite_rollup(spark, sf):
    return B.suite_rollup(load(spark, sf, "suite_jobs"))


# Policy in the shape of a gate file: one bound or drop per job and metric.
_POLICY = [
    ("1-URGENT", "summary.accuracy_percent", 60.0, None, 0.5),
    ("2-HIGH", "summary.accuracy_percent", 90.0, None, None),
    ("3-MEDIUM", "summary.avg_weighted_support", None, 500.0, 0.0),
    ("4-NOT SPECIFIED", "summary.missing_metric", 1.0, None, None),
    ("5-LOW", "summary.avg_weighted_support", None, 100.0, 5.0),
]


def _gate_inputs(spark, sf):
    samples = load(spark, sf, "bench_samples")
    old = F.col("config") == "O"
    # The baseline ran the last scenario under a former name, so that job has none.
    renamed = F.when(F.col("scenario") == "5-LOW", "5-LOWEST").otherwise(F.col("scenario"))
    current = B.job_metrics(samples.where(~old), "scenario")
    base = B.job_metrics(samples.where(old).withColumn("scenario", renamed), "scenario")
    jobs = samples.groupBy(F.col("scenario").alias("job")).agg(
        F.when(F.count_if("matched") * 100 >= F.count(F.lit(1)) * 66, "ok").otherwise("failed").alias("status")
    )
    policy = spark.createDataFrame(_POLICY, "job string, metric string, min double, max double, max_drop double")
    return jobs, current, policy, base


def _v(x):
    return "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"


_METRICS = f"""SELECT scenario AS job, 'summary.accuracy_percent' AS metric, {pct('count(*) FILTER (matched)', 'count(*)')} AS value
  FROM {{0}} GROUP BY scenario UNION ALL SELECT scenario, 'summary.avg_weighted_support',
  {r(xsum('weighted_support') + '/count(*)', 4)} FROM {{0}} GROUP BY scenario"""

_GATE_SQL = (
    with_tables("bench_samples")
    + f""", cur AS (SELECT * FROM bench_samples WHERE config <> 'O'),
    old AS (SELECT * REPLACE (CASE WHEN scenario = '5-LOW' THEN '5-LOWEST' ELSE scenario END AS scenario) FROM bench_samples WHERE config = 'O'),
    metrics AS ({_METRICS.format('cur')}), baseline AS ({_METRICS.format('old')}),
    jobs AS (SELECT scenario AS job, CASE WHEN count(*) FILTER (matched)*100 >= count(*)*66 THEN 'ok' ELSE 'failed' END
      AS status FROM bench_samples GROUP BY scenario),
    policy(job, metric, lo, hi, max_drop) AS (VALUES {', '.join(f"('{j}', '{m}', {_v(a)}, {_v(b)}, {_v(c)})" for j, m, a, b, c in _POLICY)}),
    w AS (SELECT p.*, m.value AS actual, b.value AS base, EXISTS (SELECT 1 FROM baseline x WHERE x.job = p.job) AS base_job
      FROM policy p JOIN jobs USING (job) LEFT JOIN metrics m ON m.job = p.job AND m.metric = p.metric
      LEFT JOIN baseline b ON b.job = p.job AND b.metric = p.metric),
    checks AS (
      SELECT job, 'job_status_ok' AS "check", status = 'ok' AS passed, NULL::DOUBLE AS actual, NULL::DOUBLE AS expected FROM jobs
      UNION ALL SELECT job, metric, false, NULL, NULL FROM w WHERE actual IS NULL
      UNION ALL SELECT job, metric || ':min', actual >= lo, actual, lo FROM w WHERE actual IS NOT NULL AND lo IS NOT NULL
      UNION ALL SELECT job, metric || ':max', actual <= hi, actual, hi FROM w WHERE actual IS NOT NULL AND hi IS NOT NULL
      UNION ALL SELECT job, metric || ':baseline_present', false, NULL, NULL FROM w
        WHERE actual IS NOT NULL AND max_drop IS NOT NULL AND NOT base_job
      UNION ALL SELECT job, metric || ':baseline_metric_present', false, NULL, NULL FROM w
        WHERE actual IS NOT NULL AND max_drop IS NOT NULL AND base_job AND base IS NULL
      UNION ALL SELECT job, metric || ':max_drop_vs_baseline', base-actual <= max_drop, {r('base-actual', 4)}, max_drop FROM w
        WHERE actual IS NOT NULL AND max_drop IS NOT NULL AND base IS NOT NULL)"""
)


@query(
    "regression_gate",
    _GATE_SQL + ' SELECT job, "check", passed, coalesce(actual, -1) AS actual, coalesce(expected, -1) AS expected FROM checks',
)
def regression_gate(spark, sf):
    return B.regression_gate(*_gate_inputs(spark, sf)).fillna(-1.0, ["actual", "expected"])


@query(
    "gate_rollup",
    _GATE_SQL
    + """ SELECT j.job, status = 'ok' AS executed, count(c.job) AS checks_count, count(*) FILTER (c.passed) AS checks_passed,
    coalesce(bool_and(c.passed), true) AS gate_passed, CASE WHEN status = 'ok' AND coalesce(bool_and(c.passed), true)
    THEN 'READY_FOR_PRODUCTION' ELSE 'REQUIRES_REVIEW' END AS readiness FROM jobs j LEFT JOIN checks c ON c.job = j.job
    GROUP BY j.job, status""",
)
def gate_rollup(spark, sf):
    jobs, current, policy, base = _gate_inputs(spark, sf)
    return B.gate_rollup(jobs, B.regression_gate(jobs, current, policy, base))


def _battery(where: str) -> str:
    return f"""SELECT battery, count(*) AS total_cases, count(*) FILTER (error = '') AS valid_cases,
    count(*) FILTER (error = '' AND matched) AS matched_cases,
    {pct("count(*) FILTER (error = '' AND matched)", "count(*) FILTER (error = '')", 1)} AS accuracy_percent,
    {r("coalesce(CAST(sum(CAST(elapsed_seconds AS DECIMAL(28,12))) FILTER (error = '') AS DOUBLE), 0)/greatest(1, count(*) FILTER (error = ''))", 2)}
    AS average_elapsed_seconds FROM battery_cases WHERE {where} GROUP BY battery"""


@query("battery_summary", with_tables("battery_cases") + " " + _battery("true"))
def battery_summary(spark, sf):
    return B.battery_summary(load(spark, sf, "battery_cases"), "battery")


@query(
    "battery_failures",
    with_tables("battery_cases")
    + " SELECT battery, case_id, elapsed_seconds FROM battery_cases WHERE error = '' AND NOT matched",
)
def battery_failures(spark, sf):
    cases = load(spark, sf, "battery_cases")
    return cases.where((F.col("error") == "") & ~F.col("matched")).select("battery", "case_id", "elapsed_seconds")


_LIMITS = {"min_accuracy": 80.0, "min_matched": 4, "max_average_seconds": 25.0, "max_accuracy_drop": 0.0, "max_matched_drop": 0}


@query(
    "battery_gate",
    with_tables("battery_cases")
    + f""", cur AS ({_battery('NOT older')}), old AS ({_battery('older')}),
    j AS (SELECT c.*, o.accuracy_percent AS oa, o.matched_cases AS om FROM cur c LEFT JOIN old o USING (battery))
    SELECT battery, 'min_accuracy_percent' AS "check", accuracy_percent >= 80 AS passed, accuracy_percent AS actual, 80.0::DOUBLE
      AS expected FROM j
    UNION ALL SELECT battery, 'min_matched_cases', matched_cases >= 4, matched_cases, 4 FROM j
    UNION ALL SELECT battery, 'max_average_elapsed_seconds', average_elapsed_seconds <= 25, average_elapsed_seconds, 25 FROM j
    UNION ALL SELECT battery, 'max_accuracy_drop_percent', {r('oa-accuracy_percent', 2)} <= 0, {r('oa-accuracy_percent', 2)}, 0
      FROM j WHERE oa IS NOT NULL
    UNION ALL SELECT battery, 'max_matched_drop_cases', om-matched_cases <= 0, om-matched_cases, 0 FROM j WHERE oa IS NOT NULL""",
)
def battery_gate(spark, sf):
    cases = load(spark, sf, "battery_cases")
    now = B.battery_summary(cases.where(~F.col("older")), "battery")
    old = B.battery_summary(cases.where("older"), "battery")
    return B.battery_gate(now, old, _LIMITS, "battery")


# -- timings -----------------------------------------------------------------------------------


@query(
    "latency_summary",
    with_tables("spans")
    + f""", t AS (SELECT stage, count(*) AS n, count(*) FILTER (status <> 'ok') AS errors, {xsum('duration_ms')} AS s,
      quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.9) AS p90, quantile_cont(duration_ms, 0.99) AS p99
      FROM spans GROUP BY stage)
    SELECT stage, n, errors, {r('s/n', 4)} AS mean_ms, {r('p50', 4)} AS p50_ms, {r('p90', 4)} AS p90_ms,
      {r('p99', 4)} AS p99_ms, {r('s/(SELECT sum(s) FROM t)', 6)} AS share FROM t""",
)
def latency_summary(spark, sf):
    return B.latency_summary(load(spark, sf, "spans"))


@query(
    "run_comparison",
    with_tables("spans")
    + f""", t AS (SELECT stage AS job, CASE WHEN status = 'ok' THEN 'plain' ELSE 'tuned' END AS variant, duration_ms AS ms FROM spans),
    m AS (SELECT job, CAST(sum(CAST(ms AS DECIMAL(28,12))) FILTER (variant = 'plain') AS DOUBLE)/count(*) FILTER (variant = 'plain') AS b,
      CAST(sum(CAST(ms AS DECIMAL(28,12))) FILTER (variant = 'tuned') AS DOUBLE)/count(*) FILTER (variant = 'tuned') AS o FROM t GROUP BY job)
    SELECT job, {r('b', 4)} AS base_ms, {r('o', 4)} AS other_ms, {r('o/b', 3)} AS ratio,
      CASE WHEN abs(o/b-1.0) < 0.05 THEN 'tie' WHEN o/b < 1 THEN 'tuned' ELSE 'plain' END AS winner FROM m""",
)
def run_comparison(spark, sf):
    timings = load(spark, sf, "spans").select(
        F.col("stage").alias("job"),
        F.when(F.col("status") == "ok", "plain").otherwise("tuned").alias("variant"),
        F.col("duration_ms").alias("ms"),
    )
    return B.run_comparison(timings, "plain", "tuned")


@query(
    "audit_rollup",
    """SELECT epoch_us(date_trunc('hour', ts))//1000000 AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL""",
)
def audit_rollup(spark, sf):
    log = read(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    return B.audit_rollup(log).withColumn("window_start", F.col("window_start").cast("bigint"))


@query(
    "merge_calibration",
    f"""WITH d AS (SELECT p_brand AS scope, p_type || '.' || p_size AS path, {r('avg(p_retailprice)/1000', 6)} AS value
      FROM part GROUP BY ALL),
    l AS (SELECT p_brand AS scope, p_type || CASE WHEN p_size > 25 THEN '.' ELSE '.small.' END || p_size AS path, {r('min(p_retailprice)/2000', 6)} AS value
      FROM part GROUP BY ALL),
    c AS (SELECT p_brand AS scope, p_type || CASE WHEN p_type = 'PROMO' THEN '.' ELSE '.uncapped.' END || p_size AS path, CASE WHEN min(p_size) < 30 THEN NULL
      ELSE min(p_size)/50.0::DOUBLE END AS cap FROM part GROUP BY ALL),
    m AS (SELECT scope, path, coalesce(l.value, d.value) AS now, l.value IS NOT NULL AS overridden
      FROM d FULL OUTER JOIN l USING (scope, path)),
    k AS (SELECT scope, path, greatest(0.1, least(1.0, coalesce(cap, 0.35::DOUBLE))) AS cap FROM c)
    SELECT scope, path, CASE WHEN now > cap THEN {r('cap', 4)} ELSE now END AS value, overridden,
      coalesce(now > cap, false) AS capped FROM m LEFT JOIN k USING (scope, path)""",
)
def merge_calibration(spark, sf):
    part = read(spark, sf, "part")
    scope = F.col("p_brand").alias("scope")
    path = lambda *between: F.concat_ws(".", "p_type", *between, "p_size").alias("path")
    price = F.col("p_retailprice")
    # Every part gives a default, an override and a cap; those of a role of their own bear its name in the path.
    small = F.when(F.col("p_size") <= 25, "small")
    uncapped = F.when(F.col("p_type") != "PROMO", "uncapped")
    defaults = part.groupBy(scope, path()).agg(rnd(F.avg(price) / 1000, 6).alias("value"))
    loaded = part.groupBy(scope, path(small)).agg(rnd(F.min(price) / 2000, 6).alias("value"))
    caps = part.groupBy(scope, path(uncapped)).agg(
        F.when(F.min("p_size") >= 30, F.min("p_size") / 50.0).alias("cap")
    )
    return B.merge_calibration(defaults, loaded, caps)


# -- dataset preparation -----------------------------------------------------------------------

add(
    "label_objects",
    "lineitem",
    [
        "l_orderkey AS image_id",
        "(CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS object_id",
        "CASE WHEN l_partkey%8=0 THEN ' Car ' WHEN l_partkey%8=1 THEN 'motorcycle' WHEN l_partkey%8=2 THEN 'minibus' "
        "WHEN l_partkey%8=3 THEN 'tru' WHEN l_partkey%8=4 THEN 'pickup' WHEN l_partkey%8=5 THEN 'bicycle' "
        "WHEN l_partkey%8=6 THEN 'VEICULO' ELSE 'tree' END AS name",
        "l_quantity*10 AS xmin",
        "l_tax*1000 AS ymin",
        "l_quantity*10+80+l_suppkey%40 AS xmax",
        "l_tax*1000+700+l_partkey%20 AS ymax",
        "500 AS width",
        "720 AS height",
    ],
)


def _share(c: str) -> str:
    return f"round_even(greatest(0.0, least(1.0, {c}))*1000000, 0)/1000000"


@query(
    "boxes_to_yolo",
    with_tables("label_objects")
    + f""", k(name, id, i) AS (VALUES {', '.join(f"('{n}', {v}, {i})" for i, (n, v) in enumerate(N.CLASSES.items()))}),
    c AS (SELECT o.*, coalesce((SELECT id FROM k WHERE k.name = lower(trim(o.name))), (SELECT arg_min(id, i) FROM k
      WHERE contains(lower(trim(o.name)), k.name) OR contains(k.name, lower(trim(o.name))))) AS class_id FROM label_objects o),
    b AS (SELECT image_id, object_id, class_id::BIGINT AS class_id, {_share('(xmin+xmax)/2/width')} AS cx,
      {_share('(ymin+ymax)/2/height')} AS cy, {_share('(xmax-xmin)/width')} AS w, {_share('(ymax-ymin)/height')} AS h
      FROM c WHERE class_id IS NOT NULL)
    SELECT *, format('{{}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', class_id, cx, cy, w, h) AS line FROM b""",
)
def boxes_to_yolo(spark, sf):
    boxed = N.boxes_to_yolo(load(spark, sf, "label_objects"))
    return boxed.select("image_id", "object_id", F.col("class_id").cast("bigint").alias("class_id"), "cx", "cy", "w", "h", "line")


_SPLIT_SQL = """WITH n AS (SELECT path, row_number() OVER (ORDER BY path) AS position, count(*) OVER () AS total
  FROM (SELECT p_name || '/' || p_partkey || '.jpg' AS path FROM part)),
split AS (SELECT path, position, CASE
  WHEN position <= total - greatest(1, floor(total*0.10)) - greatest(1, floor(total*0.15)) THEN 'train'
  WHEN position <= total - greatest(1, floor(total*0.10)) THEN 'val' ELSE 'test' END AS split FROM n)"""


def _split(spark, sf):
    items = read(spark, sf, "part").select(F.concat(F.col("p_name"), F.lit("/"), F.col("p_partkey"), F.lit(".jpg")).alias("path"))
    return N.split_dataset(items, "path")


@query("split_dataset", _SPLIT_SQL + " SELECT * FROM split")
def split_dataset(spark, sf):
    return _split(spark, sf)


@query("split_stats", _SPLIT_SQL + " SELECT split, count(*) AS items FROM split GROUP BY split")
def split_stats(spark, sf):
    return N.split_stats(_split(spark, sf))
