"""Quality, triage, compatibility and readiness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.functions.plates import CONFUSABLE
from vestigo.operators import places as G, fusion as U, quality as Q
from vestigo.plans.derived import add, load, read, with_tables
from vestigo.plans.fusion import FUSED_SQL, clean
from vestigo.plans.registry import query, r, xsum

add(
    "image_metrics",
    "lineitem",
    [
        "(CAST(l_orderkey AS STRING) || '-' || CAST((CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS STRING)) AS image_id",
        "l_extendedprice/120 AS laplacian",
        "l_tax*10 AS contrast",
        "CAST((l_partkey*7)%256 AS DOUBLE) AS brightness",
        "l_partkey%1200+60 AS width",
        "l_suppkey*8+60 AS height",
        "CAST(l_linenumber*12-45 AS DOUBLE) AS angle",
        "l_discount*10 AS angle_conf",
    ],
)
add(
    "scene_metrics",
    "lineitem",
    [
        "(CAST(l_orderkey AS STRING) || '-' || CAST((CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS STRING)) AS image_id",
        "CAST((l_partkey*7)%256 AS DOUBLE) AS brightness",
        "CAST(l_suppkey%70 AS DOUBLE) AS contrast",
        "CAST((l_partkey*3)%400 AS DOUBLE) AS sharpness",
        "l_discount*400 AS noise",
        "l_tax*200 AS under",
        "CAST(l_partkey%15 AS DOUBLE) AS over",
        "CAST(l_linenumber AS DOUBLE)/1.5 AS edges",
        "CAST((l_suppkey*11)%130 AS DOUBLE) AS saturation",
    ],
)
add(
    "variant_candidates",
    "lineitem",
    [
        "l_orderkey AS image_id",
        "(CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS position",
        "CASE WHEN l_orderkey%3=0 THEN 'dark' ELSE 'balanced' END AS scenario",
        "CASE WHEN l_partkey%4=0 THEN 'clahe_soft_1' WHEN l_partkey%4=1 THEN 'CLAHE_hard' WHEN l_partkey%4=2 THEN 'gamma_2' ELSE 'original' END AS variant",
        "CASE WHEN l_suppkey%3=0 THEN 'OpenCV' WHEN l_suppkey%3=1 THEN 'hdr' ELSE 'other' END AS family",
        "l_extendedprice/1000 AS quality",
        "l_discount AS distance",
    ],
)
add(
    "protocol_cases",
    "orders",
    [
        "o_orderkey AS case_id",
        "CAST(o_custkey%101 AS DOUBLE) AS quality",
        "CAST(100-o_orderkey%40 AS DOUBLE) AS integrity",
        "CAST((o_custkey*3)%101 AS DOUBLE) AS consensus",
        "CAST((o_orderkey*7)%101 AS DOUBLE) AS avg_conf",
        "CAST((o_orderkey*11)%101 AS DOUBLE) AS law_score",
        "CASE WHEN o_custkey%101<15 THEN 'CRITICA' ELSE 'BOA' END AS grade",
        "CASE WHEN o_orderkey%11=0 THEN 'revisao_obrigatoria' ELSE 'ok' END AS integrity_status",
        "CASE WHEN o_custkey%9=0 THEN 'sem_candidato' WHEN o_custkey%9<4 THEN 'fallback_full_scene' ELSE 'ok' END AS roi_status",
        "o_orderkey%13=0 AS integrity_review",
        "CASE WHEN o_orderkey%10=0 THEN '' WHEN o_orderkey%10=1 THEN 'AB1' WHEN o_orderkey%10<4 THEN 'AIO123' "
        "ELSE 'ABS' || lpad(CAST(o_custkey%10000 AS STRING),4,'0') END AS text",
        "o_orderkey%10>=4 AS pattern_valid",
        "CASE WHEN o_orderkey%10<4 THEN 'Indefinido' ELSE 'Antigo' END AS pattern",
        "o_custkey%5 AS ambiguity_count",
        "o_custkey%7=0 AS abstained",
        "o_custkey%2=0 AS dual_headlamps",
        "o_custkey%3=0 AS vertical_pair",
        "CASE WHEN o_custkey%4=0 THEN NULL ELSE CAST(o_custkey%130 AS DOUBLE) END AS design_conf",
        "CASE WHEN o_custkey%6=0 THEN NULL ELSE CAST(o_custkey%140 AS DOUBLE) END AS emblem_conf",
        "o_custkey%8=0 AS interior",
        "o_custkey%12=0 AS odd_light",
        "o_orderstatus",
        "o_custkey",
        "CAST(o_custkey%35 AS DOUBLE)/10 AS aspect",
        "CASE WHEN o_custkey%4=0 THEN 'frontal' WHEN o_custkey%4=1 THEN ' Traseira' ELSE 'lateral' END AS view",
    ],
)


def _joined(df, *arrays, sep=";"):
    for name in arrays:
        df = df.withColumn(name, F.concat_ws(sep, name))
    return df


@query(
    "quality_score",
    with_tables("image_metrics")
    + f""", s AS (SELECT *, least(1.0, laplacian/500.0) AS bs, CASE WHEN width*height < 20000 THEN 'very_low' WHEN width*height < 100000 THEN 'low'
      WHEN width*height < 500000 THEN 'medium' ELSE 'high' END AS resolution, CASE WHEN brightness < 50 THEN 'too_dark' WHEN brightness < 100 THEN 'dark'
      WHEN brightness > 200 THEN 'too_bright' WHEN brightness > 180 THEN 'bright' ELSE 'ok' END AS brightness_level,
      CASE WHEN brightness BETWEEN 100 AND 180 THEN 1.0 WHEN brightness BETWEEN 50 AND 220 THEN 0.8 WHEN brightness BETWEEN 30 AND 240 THEN 0.5 ELSE 0.2 END::DOUBLE AS ls FROM image_metrics)
    SELECT image_id, CASE WHEN bs < 0.2 THEN 'very_blurry' WHEN bs < 0.4 THEN 'blurry' WHEN bs < 0.7 THEN 'acceptable' ELSE 'sharp' END AS blur_level,
      brightness_level, resolution, {r('''bs*0.35 + contrast*0.25 + ls*0.15 + (CASE resolution WHEN 'very_low' THEN 0.3 WHEN 'low' THEN 0.6 WHEN 'medium' THEN 0.85 ELSE 1.0 END)::DOUBLE*0.15
      + (1.0-least(1.0, angle_conf*0.5))*0.10''', 6)} AS overall_quality_score,
      concat_ws(';', CASE WHEN bs < 0.2 THEN 'CRÍTICO: Imagem muito desfocada' END, CASE WHEN contrast < 0.2 THEN 'CRÍTICO: Contraste insuficiente' END,
        CASE WHEN brightness_level IN ('too_dark', 'too_bright') THEN 'AVISO: Brilho inadequado' END, CASE WHEN resolution = 'very_low' THEN 'AVISO: Resolução muito baixa' END,
        CASE WHEN abs(angle) > 30 THEN 'AVISO: Rotação excessiva (' || format('{{:.1f}}', angle) || '°)' END) AS issues,
      (CASE WHEN bs < 0.4 THEN 1 ELSE 0 END) + (CASE WHEN bs < 0.7 THEN 1 ELSE 0 END) + (CASE WHEN contrast < 0.3 THEN 1 ELSE 0 END) + (CASE WHEN brightness_level IN ('too_dark', 'too_bright') THEN 1 ELSE 0 END)
        + (CASE WHEN resolution IN ('very_low', 'low') THEN 1 ELSE 0 END) + (CASE WHEN abs(angle) > 15 THEN 1 ELSE 0 END) AS recommendations FROM s""",
)
def quality_score(spark, sf):
    scored = Q.quality_score(load(spark, sf, "image_metrics"))
    return _joined(scored.withColumn("recommendations", F.size("recommendations")), "issues")


_SCENE_TESTS = [
    ("foggy", "foggy", "greatest(0.0, 28.0-contrast)*1.5 + greatest(0.0, 60.0-saturation)*1.0", 6),
    ("dark", "brightness <= 92 OR under >= 12", "greatest(0.0, (92.0-brightness)*0.9) + greatest(0.0, under-12.0)*1.1", 0),
    ("bright", "brightness >= 194 OR over >= 12", "greatest(0.0, brightness-194.0)*0.9 + greatest(0.0, over-12.0)*1.1", 1),
    ("low_contrast", "(contrast <= 34 AND NOT foggy) OR edges <= 1.8", "greatest(0.0, 34.0-contrast)*1.3", 2),
    ("noisy", "noise >= 24", "greatest(0.0, noise-24.0)*1.4", 3),
    ("blurred", "sharpness <= 160", "greatest(0.0, 160.0-sharpness)*0.9", 4),
    ("adulterated_lighting", "edges > 1.8 AND edges < 4.0 AND noise > 24*0.4::DOUBLE", "1.2::DOUBLE", 6),
]


@query(
    "scene_scenarios",
    with_tables("scene_metrics")
    + ", m AS (SELECT *, contrast <= 28 AND saturation <= 60 AS foggy FROM scene_metrics), t AS ("
    + " UNION ALL ".join(f"SELECT image_id, '{n}' AS tag, ({s})::DOUBLE AS sev, {p} AS place FROM m WHERE {c}" for n, c, s, p in _SCENE_TESTS)
    + """), g AS (SELECT image_id, string_agg(tag, '+' ORDER BY sev DESC, place, tag) AS label FROM t GROUP BY image_id)
    SELECT m.image_id, coalesce(label, 'balanced') AS label, split_part(coalesce(label, 'balanced'), '+', 1) AS "primary" FROM m LEFT JOIN g ON g.image_id = m.image_id""",
)
def scene_scenarios(spark, sf):
    return Q.scene_scenarios(load(spark, sf, "scene_metrics")).select("image_id", "label", "primary")


_PROFILE_ROWS = [
    ("dark", 1.2, 2.0, 3.8, "opencv", 0.4),
    ("dark", 1.2, 2.0, 3.8, "default", 0.1),
    ("balanced", 1.0, 0.0, 5.0, "hdr", -0.3),
    ("balanced", 1.0, 0.0, 5.0, "default", 0.0),
]
_PREFIX_ROWS = [("dark", "clahe", 1.5), ("dark", "clahe_soft", 2.5), ("dark", "gamma", 0.7), ("balanced", "original", 3.0)]


@query(
    "select_variant",
    with_tables("variant_candidates")
    + f""", p(scenario, m, b, w, family, fb) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, '{e}', {f}::DOUBLE)" for a, b, c, d, e, f in _PROFILE_ROWS)}),
    x(scenario, prefix, bonus) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _PREFIX_ROWS)}),
    s AS (SELECT v.*, coalesce((SELECT arg_max(bonus, length(prefix)) FROM x WHERE x.scenario = v.scenario AND starts_with(lower(v.variant), x.prefix)), 0.0) AS pb,
      coalesce((SELECT arg_max(prefix, length(prefix)) FROM x WHERE x.scenario = v.scenario AND starts_with(lower(v.variant), x.prefix)), '') AS prefix,
      coalesce((SELECT fb FROM p WHERE p.scenario = v.scenario AND p.family = lower(v.family)), (SELECT fb FROM p WHERE p.scenario = v.scenario AND p.family = 'default')) AS fb,
      CASE scenario WHEN 'dark' THEN 1.2 ELSE 1.0 END::DOUBLE AS m, CASE scenario WHEN 'dark' THEN 2.0 ELSE 0.0 END::DOUBLE AS b, CASE scenario WHEN 'dark' THEN 3.8 ELSE 5.0 END::DOUBLE AS w
      FROM variant_candidates v),
    c AS (SELECT image_id, position, variant, {r('pb+fb', 4)} AS bonus, prefix, quality*m + b + {r('pb+fb', 4)} - distance*w AS score FROM s)
    SELECT image_id, variant, bonus, prefix, {r('score', 6)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, position) AS n FROM c) WHERE n = 1""",
)
def select_variant(spark, sf):
    profiles = spark.createDataFrame(
        _PROFILE_ROWS, "scenario string, multiplier double, bias double, distance_weight double, family string, family_bonus double"
    )
    prefixes = spark.createDataFrame(_PREFIX_ROWS, "scenario string, prefix string, bonus double")
    return Q.select_variant(load(spark, sf, "variant_candidates"), profiles, prefixes)


def cases(spark, sf):
    base = load(spark, sf, "protocol_cases")
    k = F.col("o_custkey")
    issues = F.array_compact(F.array(F.when(k % 2 == 0, "desfoque"), F.when(k % 5 == 0, "contraste")))
    return base.withColumn("quality_issues", issues).withColumn(
        "integrity_issues", F.array_compact(F.array(F.when(k % 3 == 0, "metadados")))
    )


TRIAGE_SQL = (
    with_tables("protocol_cases", "component_reads")
    + f""", t0 AS (SELECT *, quality*0.42 + integrity*0.38 + consensus*0.10 + avg_conf*0.10 AS comp FROM protocol_cases),
    t1 AS (SELECT *, CASE WHEN grade = 'CRITICA' OR integrity_status = 'revisao_obrigatoria' OR roi_status = 'sem_candidato' THEN 'D' WHEN comp >= 85 THEN 'A'
      WHEN comp >= 70 THEN 'B' WHEN comp >= 50 THEN 'C' ELSE 'D' END AS c1 FROM t0),
    t2 AS (SELECT *, roi_status = 'fallback_full_scene' AND c1 IN ('A', 'B') AS demoted FROM t1),
    triage AS (SELECT case_id, CASE WHEN demoted THEN 'C' ELSE c1 END AS triage_class, {r('greatest(0.0, least(100.0, comp))', 1)} AS triage_score,
      (CASE WHEN demoted THEN 'C' ELSE c1 END) = 'D' OR integrity_review OR roi_status = 'sem_candidato' OR grade = 'CRITICA' AS manual_review,
      CASE WHEN grade = 'CRITICA' OR integrity_status = 'revisao_obrigatoria' OR roi_status = 'sem_candidato' OR demoted THEN
        concat_ws(';', CASE WHEN grade = 'CRITICA' THEN 'qualidade_da_imagem_critica' END, CASE WHEN integrity_status = 'revisao_obrigatoria' THEN 'integridade_da_captura_requer_revisao' END,
          CASE WHEN roi_status = 'sem_candidato' THEN 'sem_roi_confiavel' END, CASE WHEN demoted THEN 'fallback_em_imagem_completa' END)
      ELSE concat_ws(';', CASE WHEN o_custkey%2=0 THEN 'desfoque' END, CASE WHEN o_custkey%5=0 THEN 'contraste' END, CASE WHEN o_custkey%3=0 THEN 'metadados' END,
        CASE WHEN consensus < 40 THEN 'consenso_ocr_baixo' END) END AS reasons FROM t2),
    comps AS (SELECT case_id, component, status, confidence FROM (SELECT *, row_number() OVER (PARTITION BY case_id, component
      ORDER BY read_id DESC, confidence DESC, status DESC) AS n FROM component_reads) WHERE n = 1)"""
)


@query("quality_triage", TRIAGE_SQL + " SELECT * FROM triage")
def quality_triage(spark, sf):
    return _joined(Q.quality_triage(cases(spark, sf)), "reasons")


def _sql_list(items):
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_CRIT = ", ".join(
    f"({i}, '{l}', {w}::DOUBLE, '{c}', {_sql_list(f)}, {_sql_list(p)}, '{b}')" for i, (l, w, c, f, p, b) in enumerate(Q.CRITERIA)
)
MATRIX_SQL = (
    TRIAGE_SQL
    + f""", crit(i, label, weight, component, full_s, part_s, bonus) AS (VALUES {_CRIT}),
    j AS (SELECT c.case_id, k.*, coalesce(m.status, 'indefinido') AS status, greatest(0.0, least(100.0, coalesce(m.confidence, 0.0)))/100.0 AS sh,
      dual_headlamps, vertical_pair, design_conf, emblem_conf FROM protocol_cases c CROSS JOIN crit k LEFT JOIN comps m ON m.case_id = c.case_id AND m.component = k.component),
    p0 AS (SELECT *, {r('''least(weight, greatest(0.0, CASE WHEN list_contains(full_s, status) THEN weight*0.70::DOUBLE + sh*weight*0.30::DOUBLE
        WHEN list_contains(part_s, status) THEN weight*0.45::DOUBLE + sh*weight*0.20::DOUBLE WHEN starts_with(status, 'limitado_vista') THEN weight*0.20::DOUBLE + sh*weight*0.15::DOUBLE
        WHEN status IN ('fraca', 'sinal_fraco', 'linha_parcial', 'parcial') THEN weight*0.25::DOUBLE + sh*weight*0.15::DOUBLE
        WHEN status IN ('nao_detectado', 'nao_detectada', 'ausente', 'indefinido', 'indefinida') THEN 0 ELSE weight*0.15::DOUBLE + sh*weight*0.10::DOUBLE END))''', 2)} AS base,
      CASE WHEN bonus = 'dual_headlamps' AND dual_headlamps THEN 1.0 WHEN bonus = 'vertical_pair' AND vertical_pair THEN 1.2
        WHEN bonus = 'design' THEN coalesce(CASE WHEN design_conf IS NOT NULL THEN least(1.5, design_conf*0.015) END, 0) WHEN bonus = 'emblem' THEN coalesce(CASE WHEN emblem_conf IS NOT NULL THEN least(1.0, emblem_conf*0.01) END, 0) ELSE 0 END::DOUBLE AS extra,
      NOT (status = 'indefinido' OR (component IN ('farois_dianteiros', 'lanternas_traseiras', 'grade_dianteira') AND status IN ('nao_detectado', 'nao_detectada'))) AS known FROM j),
    p1 AS (SELECT *, {r('least(weight, base+extra)', 1)} AS points FROM p0),
    ag AS (SELECT case_id, {xsum('points')} AS s, {xsum('CASE WHEN known THEN weight ELSE 0 END')} AS mx, max(CASE WHEN i=0 THEN points END) AS l0, max(CASE WHEN i=1 THEN points END) AS l1,
      max(CASE WHEN i=2 THEN points END) AS l2 FROM p1 GROUP BY case_id),
    pl AS (SELECT c.*, ag.* EXCLUDE (case_id), {r('''CASE WHEN text = '' THEN 0.0 ELSE least(25.0, (CASE WHEN pattern_valid THEN 11.0 ELSE 0.0 END) + (CASE WHEN length(text) = 7 THEN 4.0 WHEN length(text) >= 5 THEN 2.5 ELSE 0.0 END)
      + least(6.0, law_score*0.16) + least(4.0, consensus*0.06) + least(4.0, avg_conf*0.05)) END''', 1)} AS plate FROM protocol_cases c JOIN ag ON ag.case_id = c.case_id),
    mt AS (SELECT *, {r('s + plate + CASE WHEN interior THEN 6.0 ELSE 0.0 END', 1)} AS score_total, {r("mx + (CASE WHEN text <> '' THEN 25.0 ELSE 0.0 END) + (CASE WHEN interior THEN 10.0 ELSE 0.0 END)", 1)} AS available_max FROM pl),
    matrix AS (SELECT case_id, score_total, available_max, CASE WHEN available_max > 0 THEN {r('score_total/available_max*100.0', 1)} ELSE 0.0 END AS available_ratio, available_max AS coverage_percent,
      CASE WHEN score_total >= 90 THEN 'MUITO_PROVAVELMENTE_CORRESPONDENTE' WHEN score_total >= 75 THEN 'FORTEMENTE_COMPATIVEL' WHEN score_total >= 60 THEN 'COMPATIVEL' WHEN score_total >= 40 THEN 'POUCO_COMPATIVEL' ELSE 'INCOMPATIVEL' END AS level,
      'Placa/OCR total ou parcial=' || format('{{:.1f}}', plate) || '; Farois=' || format('{{:.1f}}', l0) || '; Lanternas traseiras=' || format('{{:.1f}}', l1) || '; Linha lateral / vidros / colunas=' || format('{{:.1f}}', l2) AS summary FROM mt)"""
)


def _components(spark, sf):
    reads = load(spark, sf, "component_reads")
    return reads.groupBy("case_id", "component").agg(
        F.max_by(F.struct("status", "confidence"), F.struct("read_id", "confidence", "status")).alias("r")
    ).select("case_id", "component", "r.*")


def matrix(spark, sf):
    return Q.compatibility_matrix(cases(spark, sf), _components(spark, sf))


@query("compatibility_matrix", MATRIX_SQL + " SELECT * FROM matrix")
def compatibility_matrix(spark, sf):
    return matrix(spark, sf)


CHECK_SQL = (
    MATRIX_SQL
    + """, so AS (SELECT c.*, length(text) >= 6 AND avg_conf >= 80 AND consensus >= 90 AND (pattern_valid OR pattern NOT IN ('', 'Indefinido')) AS strong_ocr, m.coverage_percent, m.score_total, m.level AS lv
      FROM protocol_cases c JOIN matrix m ON m.case_id = c.case_id),
    checks AS (
      SELECT case_id, 'capture_integrity' AS code, integrity_status AS status, integrity_status = 'revisao_obrigatoria' AS strong, CASE WHEN integrity_status = 'revisao_obrigatoria' THEN 'alto' ELSE 'medio' END AS impact FROM so
      UNION ALL SELECT case_id, 'image_quality', grade, grade = 'CRITICA' OR quality < 48, CASE WHEN grade = 'CRITICA' THEN 'alto' ELSE 'medio' END FROM so
      UNION ALL SELECT case_id, 'ocr_pattern', CASE WHEN pattern_valid THEN 'valida' ELSE 'invalida' END, NOT pattern_valid, CASE WHEN pattern_valid THEN 'baixo' ELSE 'alto' END FROM so
      UNION ALL SELECT case_id, 'ocr_ambiguity', CASE WHEN ambiguity_count >= 2 THEN 'alta' ELSE 'ok' END, ambiguity_count >= 3, 'medio' FROM so
      UNION ALL SELECT case_id, 'ocr_consensus', CASE WHEN consensus < 40 THEN 'baixo' ELSE 'ok' END, false, 'baixo' FROM so
      UNION ALL SELECT case_id, 'visual_abstention', CASE WHEN abstained THEN 'ativa' ELSE 'inativa' END, false, 'medio' FROM so
      UNION ALL SELECT case_id, 'compatibility_coverage', CASE WHEN coverage_percent < 35 THEN 'baixa' ELSE 'ok' END, coverage_percent < 35 AND NOT strong_ocr, CASE WHEN coverage_percent < 35 AND NOT strong_ocr THEN 'alto' ELSE 'medio' END FROM so
      UNION ALL SELECT case_id, 'interior_presence', 'indisponivel', false, 'baixo' FROM so),
    exclusion AS (SELECT *, status NOT IN ('ok', 'valida', 'inativa', 'baixo', 'indisponivel') AS triggered FROM checks)"""
)


@query("exclusion_checks", CHECK_SQL + " SELECT * FROM exclusion")
def exclusion_checks(spark, sf):
    return Q.exclusion_checks(cases(spark, sf), matrix(spark, sf))


@query(
    "conclusion",
    CHECK_SQL
    + """, ec AS (SELECT case_id, count(*) FILTER (strong) AS sc FROM exclusion GROUP BY case_id),
    f0 AS (SELECT so.case_id, text, strong_ocr, triage_class, score_total, lv, sc, CASE WHEN strong_ocr AND sc = 0 THEN false ELSE t.manual_review OR sc > 0 END AS manual_review
      FROM so JOIN triage t ON t.case_id = so.case_id JOIN ec ON ec.case_id = so.case_id),
    f1 AS (SELECT *, CASE WHEN strong_ocr AND score_total < 40 THEN 'conclusivo' WHEN triage_class = 'D' OR manual_review OR score_total < 40 THEN 'inconclusivo' ELSE 'conclusivo' END AS d1,
      text <> '' AND length(text) < 7 AS partial FROM f0),
    f2 AS (SELECT *, CASE WHEN strong_ocr AND score_total < 40 AND lv = 'INCOMPATIVEL' THEN 'COMPATIVEL_PARCIAL' WHEN d1 = 'inconclusivo' AND score_total < 40 AND NOT strong_ocr THEN 'INCOMPATIVEL' ELSE lv END AS l1 FROM f1)
    SELECT case_id, CASE WHEN partial AND triage_class = 'D' THEN 'inconclusivo' ELSE d1 END AS decision, CASE WHEN partial AND l1 = 'INCOMPATIVEL' THEN 'COMPATIVEL_PARCIAL' ELSE l1 END AS level,
      manual_review, strong_ocr FROM f2""",
)
def conclusion(spark, sf):
    own, mx = cases(spark, sf), matrix(spark, sf)
    return Q.conclusion(own, Q.quality_triage(own), mx, Q.exclusion_counts(Q.exclusion_checks(own, mx)))


_AMB = "CASE substr(text, i, 1) " + " ".join(f"WHEN '{k}' THEN '{' ou '.join(v[:2])}'" for k, v in CONFUSABLE.items()) + " END"


@query(
    "ocr_record",
    FUSED_SQL.replace("WITH ", with_tables("protocol_cases") + ", ", 1)
    + f""", sp AS (SELECT case_id, i, CASE WHEN substr(text, i, 1) BETWEEN '0' AND '9' THEN 'D' ELSE 'L' END AS slot, {_AMB} AS alt FROM protocol_cases, range(1, 9) t(i) WHERE i <= length(text)),
    sg AS (SELECT case_id, string_agg('P' || i || '[' || slot || ']', '; ' ORDER BY i) AS marks, string_agg('P' || i || ': ' || alt, '; ' ORDER BY i) AS det FROM sp WHERE alt IS NOT NULL GROUP BY case_id),
    rv AS (SELECT c.case_id, string_agg(k.text || ' detectado por: ' || k.engine, '; ' ORDER BY k.rank) AS conflicts FROM protocol_cases c JOIN ranked k ON k.evidence_id = c.case_id
      WHERE k.rank BETWEEN 2 AND 4 AND k.text <> c.text GROUP BY c.case_id)
    SELECT c.case_id, CASE WHEN text = '' THEN 'indefinido' ELSE text END AS main_text, {r('greatest(0.0, least(100.0, avg_conf*0.48 + consensus*0.27 + law_score*0.25))', 1)} AS estimate,
      coalesce(marks, '-') AS uncertain, CASE WHEN det IS NOT NULL OR odd_light THEN 'Atencao: Possivel adulteracao (' || concat_ws('; ', det, CASE WHEN odd_light THEN 'Anomalia de luz/adulteracao' END)
        || ') - Verificar imagem' ELSE 'Nao detectada' END AS tamper_alert, coalesce(conflicts, '') AS conflicts, text <> '' AND length(text) < 7 AS partial_plate
    FROM protocol_cases c LEFT JOIN sg ON sg.case_id = c.case_id LEFT JOIN rv ON rv.case_id = c.case_id""",
)
def ocr_record(spark, sf):
    ranked = U.rank_and_filter(U.text_candidates(clean(spark, sf))).withColumnRenamed("evidence_id", "case_id")
    return Q.ocr_record(cases(spark, sf), ranked)


_BODY_SQL = (
    with_tables("protocol_cases")
    + f""", b AS (SELECT case_id, aspect, CASE WHEN aspect <= 0 THEN 'indefinido' WHEN o_custkey%3=0 AND o_custkey%2=0 THEN 'hatch' WHEN aspect >= 2.7 THEN 'picape/caminhonete'
      WHEN aspect >= 2.15 THEN 'sedan/van' WHEN aspect >= 1.45 THEN 'hatch' ELSE 'indefinido' END AS body_style,
      {r('''CASE WHEN aspect <= 0 THEN 0.0::DOUBLE WHEN o_custkey%3=0 AND o_custkey%2=0 THEN CASE WHEN quality >= 45 THEN 82.0 ELSE 66.0 END WHEN aspect >= 2.7 THEN least(88.0, 48.0+(aspect-2.7)*14.0)
      WHEN aspect >= 2.15 THEN least(82.0, 46.0+(aspect-2.15)*18.0) WHEN aspect >= 1.45 THEN least(78.0, 44.0+(2.1-abs(aspect-1.9))*10.0) ELSE 0.0 END''', 1)} AS body_confidence,
      CASE WHEN aspect <= 0 THEN 'indefinido' WHEN aspect >= 2.7 THEN 'grande' WHEN aspect >= 2.05 THEN 'medio' ELSE 'compacto' END AS size_class,
      CASE WHEN o_custkey%4=1 THEN 'traseira' WHEN o_custkey%4=0 THEN 'dianteira' ELSE 'indefinida' END AS plate_position FROM protocol_cases),
    profile AS (SELECT case_id, body_style, body_confidence, size_class, CASE body_style WHEN 'hatch' THEN 'curto' WHEN 'sedan/van' THEN 'medio' WHEN 'picape/caminhonete' THEN 'longo' ELSE 'indefinido' END AS rear_volume,
      CASE body_style WHEN 'hatch' THEN 'acentuado' WHEN 'sedan/van' THEN 'suave' WHEN 'picape/caminhonete' THEN 'plano' ELSE 'indefinido' END AS roof_slope,
      CASE body_style WHEN 'hatch' THEN 'compacta' WHEN 'sedan/van' THEN 'ampla' WHEN 'picape/caminhonete' THEN 'vertical' ELSE 'indefinida' END AS rear_window,
      CASE body_style WHEN 'hatch' THEN 'integrada' WHEN 'sedan/van' THEN 'proeminente' WHEN 'picape/caminhonete' THEN 'robusta' ELSE 'indefinida' END AS c_pillar, plate_position FROM b)"""
)


def _profiles(spark, sf):
    k = F.col("o_custkey")
    shaped = cases(spark, sf).withColumn("compact", k % 2 == 0).withColumn("rear_vertical", k % 3 == 0).withColumn("rear_conf", F.col("quality"))
    return Q.vehicle_profile(shaped)


@query("vehicle_profile", _BODY_SQL + " SELECT * FROM profile")
def vehicle_profile(spark, sf):
    return _profiles(spark, sf)


@query(
    "body_style_rollup",
    _BODY_SQL + f" SELECT body_style, size_class, count(*) AS cases, {r(xsum('body_confidence') + '/count(*)', 4)} AS avg_confidence FROM profile GROUP BY ALL",
)
def body_style_rollup(spark, sf):
    return Q.body_style_rollup(_profiles(spark, sf))


_READY_SQL = (
    with_tables("protocol_cases")
    + f""", rc AS (SELECT *, avg_conf/100 AS conf, quality/100 AS iq, CASE WHEN avg_conf >= 85 THEN 'high' WHEN avg_conf >= 65 THEN 'medium' WHEN avg_conf >= 45 THEN 'low' ELSE 'reject' END AS cl FROM protocol_cases),
    rd AS (SELECT case_id, concat_ws('|', CASE WHEN text = '' THEN '{Q.BLOCK_TEXT}' END, CASE WHEN o_orderstatus = 'P' THEN '{Q.BLOCK_META}' END) AS blockers,
      concat_ws('|', CASE WHEN cl IN ('reject', 'low') OR conf < 0.75 THEN '{Q.CAUTION_CONFIDENCE} (0.75)' END, CASE WHEN NOT pattern_valid THEN '{Q.CAUTION_PATTERN}' END,
        CASE WHEN consensus < 50 THEN '{Q.CAUTION_CONSENSUS}' END, CASE WHEN iq < 0.60 THEN '{Q.CAUTION_QUALITY}' END) AS cautions FROM rc),
    ready AS (SELECT case_id, CASE WHEN blockers <> '' THEN 'nao_apto' WHEN cautions <> '' THEN 'apto_com_revisao' ELSE 'apto_prova_preliminar' END AS status, blockers, cautions FROM rd)"""
)


def _ready(spark, sf):
    conf = F.col("avg_conf")
    shaped = cases(spark, sf).select(
        "case_id",
        "text",
        (F.col("o_orderstatus") != "P").alias("has_metadata"),
        F.when(conf >= 85, "high").when(conf >= 65, "medium").when(conf >= 45, "low").otherwise("reject").alias("level"),
        (conf / 100).alias("confidence"),
        "pattern_valid",
        "consensus",
        (F.col("quality") / 100).alias("image_quality"),
    )
    return Q.judicial_readiness(shaped)


@query("judicial_readiness", _READY_SQL + " SELECT * FROM ready")
def judicial_readiness(spark, sf):
    return _joined(_ready(spark, sf), "blockers", "cautions", sep="|")


@query(
    "readiness_rollup",
    _READY_SQL
    + f""", x AS (SELECT status, unnest(string_split(CASE WHEN blockers = '' AND cautions = '' THEN '-' WHEN blockers = '' THEN cautions WHEN cautions = '' THEN blockers ELSE blockers || '|' || cautions END, '|')) AS reason FROM ready),
    c AS (SELECT status, reason, count(*) AS cases FROM x GROUP BY ALL UNION ALL SELECT status, '(total)', count(*) FROM ready GROUP BY status)
    SELECT *, {r('cases/(SELECT count(*) FROM ready)', 6)} AS rate FROM c""",
)
def readiness_rollup(spark, sf):
    return Q.readiness_rollup(_ready(spark, sf))


@query(
    "gps_context",
    f"""WITH e AS (SELECT c_custkey AS image_id, c_custkey%5<>0 AS has_gps, CASE WHEN c_custkey%7=0 THEN NULL ELSE (c_custkey%90)::DOUBLE END AS ld, (c_custkey%60)::DOUBLE AS lm,
      c_acctbal/200 AS ls, c_custkey%2=0 AS south, (c_nationkey*7)::DOUBLE AS od, c_custkey%3=0 AS west, c_acctbal AS alt FROM customer),
    p AS (SELECT *, ld + lm/60.0 + ls/3600.0 AS lat, od + lm/60.0 + ls/3600.0 AS lon FROM e),
    s AS (SELECT *, CASE WHEN NOT has_gps THEN 'no_gps_metadata' WHEN lat IS NULL THEN 'gps_invalid' ELSE 'gps_extracted' END AS status FROM p)
    SELECT image_id, status, CASE WHEN status = 'gps_extracted' THEN {r('CASE WHEN south THEN -lat ELSE lat END', 7)} END AS latitude,
      CASE WHEN status = 'gps_extracted' THEN {r('CASE WHEN west THEN -lon ELSE lon END', 7)} END AS longitude, CASE WHEN status = 'gps_extracted' THEN {r('alt', 2)} END AS altitude_m FROM s""",
)
def gps_context(spark, sf):
    k = F.col("c_custkey")
    exif = read(spark, sf, "customer").select(
        k.alias("image_id"),
        (k % 5 != 0).alias("has_gps"),
        F.when(k % 7 == 0, "n/a").otherwise((k % 90).cast("string")).alias("lat_d"),
        (k % 60).alias("lat_m"),
        (F.col("c_acctbal") / 200).alias("lat_s"),
        F.when(k % 2 == 0, "s").otherwise("N").alias("lat_ref"),
        (F.col("c_nationkey") * 7).alias("lon_d"),
        (k % 60).alias("lon_m"),
        (F.col("c_acctbal") / 200).alias("lon_s"),
        F.when(k % 3 == 0, "W").otherwise("E").alias("lon_ref"),
        F.col("c_acctbal").alias("altitude"),
    )
    return Q.gps_context(exif)


#: Kilometres within which a place counts as near.
_NEAR_KM = 250.0


@query(
    "nearest_places",
    f"""WITH p AS (SELECT c_custkey AS point_id, CASE WHEN c_custkey%11=0 THEN NULL ELSE ((c_custkey*7919)%179000)/1000.0::DOUBLE - 89.5 END AS latitude,
      ((c_custkey*104729)%360000)/1000.0::DOUBLE - 180.0 AS longitude FROM customer),
    g AS (SELECT s_suppkey AS place_id, s_name AS name, ((s_suppkey*15485)%179000)/1000.0::DOUBLE - 89.5 AS lat, ((s_suppkey*49979)%360000)/1000.0::DOUBLE - 180.0 AS lon FROM supplier),
    d AS (SELECT point_id, place_id, name, 2*6371.0088::DOUBLE*asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(lat)-radians(latitude))/2), 2)
      + cos(radians(latitude))*cos(radians(lat))*pow(sin((radians(lon)-radians(longitude))/2), 2)))) AS km FROM p, g WHERE latitude IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY {r('km', 6)}, place_id) AS rn FROM d WHERE km <= {_NEAR_KM})
    SELECT p.point_id, latitude, longitude, place_id, name AS place, {r('km', 3)} AS distance_km FROM p LEFT JOIN n ON n.point_id = p.point_id AND rn = 1""",
)
def nearest_places(spark, sf):
    place = lambda key, step, size: (F.col(key) * step % size) / 1000.0
    points = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("point_id"),
        F.when(F.col("c_custkey") % 11 != 0, place("c_custkey", 7919, 179000) - 89.5).alias("latitude"),
        (place("c_custkey", 104729, 360000) - 180.0).alias("longitude"),
    )
    places = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("place_id"),
        F.col("s_name").alias("name"),
        (place("s_suppkey", 15485, 179000) - 89.5).alias("latitude"),
        (place("s_suppkey", 49979, 360000) - 180.0).alias("longitude"),
    )
    return G.nearest_places(points, places, _NEAR_KM)
