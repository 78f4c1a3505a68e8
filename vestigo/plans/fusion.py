"""Read-fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.functions.plates import norm_plate, spaceless, with_validation
from vestigo.operators import fusion as U
from vestigo.operators.detections import prioritize_detections
from vestigo.plans.derived import load, read, with_tables
from vestigo.plans.registry import query, r, xsum

NORM = "regexp_replace(upper(trim({0})), '[^A-Z0-9]', '', 'g')"
LEGAL = "(regexp_full_match({0}, '[A-Z]{{3}}[0-9]{{4}}') OR regexp_full_match({0}, '[A-Z]{{3}}[0-9][A-Z][0-9]{{2}}'))"


def quality_sql(c: str) -> str:
    letters = f"length(regexp_replace({c}, '[^A-Z]', '', 'g'))"
    digits = f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
    return (
        f"(CASE WHEN {c} = '' THEN 0.0 WHEN {LEGAL.format(c)} THEN 1.0 "
        f"WHEN length({c}) = 7 AND {letters} >= 2 AND {digits} >= 2 THEN 0.6 WHEN length({c}) = 7 THEN 0.35 "
        f"WHEN length({c}) BETWEEN 5 AND 8 THEN 0.2 ELSE 0.05 END)::DOUBLE"
    )


BBOX_SQL = (
    "(CASE WHEN x1 IS NULL THEN 0.35 "
    "WHEN greatest(1.0,x2-x1)/greatest(1.0,y2-y1) < 1.2 OR greatest(1.0,x2-x1)/greatest(1.0,y2-y1) > 10 THEN 0.05 "
    "ELSE greatest(0.1, 1.0-least(1.0, abs(greatest(1.0,x2-x1)/greatest(1.0,y2-y1)-3.5)/4.0)) END)::DOUBLE"
)

CLEAN_SQL = (
    with_tables("reads", "detections")
    + f""", clean AS (SELECT * FROM (SELECT evidence_id, read_id, det_rank, engine, {NORM.format('text')} AS text,
      greatest(0.0, least(1.0, CASE WHEN confidence > 1 THEN confidence/100.0 ELSE confidence END)) AS confidence,
      x1, y1, x2, y2 FROM reads) WHERE text <> '')"""
)

FUSED_SQL = (
    CLEAN_SQL
    + f""", lik AS (SELECT *, {BBOX_SQL} AS lik FROM clean),
    run AS (SELECT *, count(*) OVER (PARTITION BY evidence_id, text, engine ORDER BY read_id) AS vote FROM lik),
    pick AS (SELECT evidence_id, text, arg_max(engine, vote*1e15::HUGEINT + read_id) AS engine FROM run GROUP BY ALL),
    ran AS (SELECT evidence_id, count(DISTINCT engine) AS engines_executed FROM clean GROUP BY evidence_id),
    agg AS (SELECT evidence_id, text, count(*) AS support_count, {xsum('confidence')} AS sum_conf,
      max(lik) AS bbox, count(DISTINCT engine) AS engine_support_count, min(read_id) AS first_read,
      {quality_sql('text')} AS pattern_quality FROM lik GROUP BY evidence_id, text),
    fused AS (SELECT a.evidence_id, a.text, p.engine, {r('sum_conf/support_count', 4)} AS avg_conf,
      {r('(sum_conf/support_count*0.60 + pattern_quality*0.30 + bbox*0.10)*(1.0+least(0.15, 0.03*(support_count-1)))', 4)}
      AS score, support_count, engine_support_count, engines_executed,
      CASE WHEN engines_executed > 1 THEN {r('engine_support_count/engines_executed*100.0', 1)} ELSE 0.0 END
      AS agreement_ratio, {r('sum_conf', 4)} AS weighted_support, pattern_quality, {r('bbox', 4)} AS bbox_likelihood,
      first_read FROM agg a JOIN pick p USING (evidence_id, text) JOIN ran USING (evidence_id)),
    kept AS (SELECT *, NOT ((length(text) < 3 AND pattern_quality < 0.30) OR score < 0.16) AS keep,
      count(*) OVER (PARTITION BY evidence_id) AS n FROM fused),
    kept2 AS (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id) AS nk FROM kept),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY score DESC, first_read) AS rank
      FROM kept2 WHERE keep OR n = 1 OR nk = 0),
    plausible AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY rank) AS pr FROM ranked
      WHERE pattern_quality >= 0.60 OR (length(text) >= 6 AND pattern_quality >= 0.20)),
    best AS (SELECT o.o_orderkey AS evidence_id, coalesce(p.text, '') AS best_text, coalesce(p.engine, 'none')
      AS best_engine, coalesce(p.avg_conf, 0.0) AS best_avg_conf, coalesce(p.score, 0.0) AS best_score,
      coalesce(c.n, 0) AS candidates, CASE WHEN c.n IS NULL THEN 'ocr_sem_resultado' WHEN p.text IS NULL
      THEN 'best_candidate_low_plausibility' ELSE '' END AS warning
      FROM orders o LEFT JOIN plausible p ON p.evidence_id = o.o_orderkey AND p.pr = 1
      LEFT JOIN (SELECT evidence_id, count(*) AS n FROM ranked GROUP BY evidence_id) c ON c.evidence_id = o.o_orderkey)"""
)


def clean(spark, sf):
    return U.normalize_reads(load(spark, sf, "reads"))


def evidence(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"))


def best(spark, sf):
    return U.best_candidate(evidence(spark, sf), U.text_candidates(clean(spark, sf)))


@query("fuse_reads", FUSED_SQL + " SELECT * EXCLUDE (first_read) FROM fused")
def fuse_reads(spark, sf):
    return U.fuse_reads(clean(spark, sf)).drop("first_read", "engines")


@query(
    "candidate_engine",
    FUSED_SQL
    + """ SELECT p.evidence_id, p.text, p.engine, m.votes FROM pick p JOIN (SELECT evidence_id, text,
    max(vote) AS votes FROM run GROUP BY ALL) m USING (evidence_id, text)""",
)
def candidate_engine(spark, sf):
    return U.candidate_engine(clean(spark, sf))


@query("rank_and_filter", FUSED_SQL + " SELECT evidence_id, text, score, rank FROM ranked")
def rank_and_filter(spark, sf):
    ranked = U.rank_and_filter(U.text_candidates(clean(spark, sf)))
    return ranked.select("evidence_id", "text", "score", "rank")


@query("best_candidate", FUSED_SQL + " SELECT * FROM best")
def best_candidate(spark, sf):
    return best(spark, sf)


@query(
    "consensus",
    FUSED_SQL
    + f""", backing AS (SELECT b.evidence_id, count(DISTINCT c.engine) AS n,
      string_agg(DISTINCT c.engine, ',' ORDER BY c.engine) AS names
      FROM best b JOIN clean c ON c.evidence_id = b.evidence_id AND c.text = b.best_text GROUP BY b.evidence_id)
    SELECT b.*, coalesce(engines_executed, 0) AS engines_executed, coalesce(n, 0) AS engines_supporting_best,
      coalesce(names, '') AS supporting_engines,
      CASE WHEN engines_executed > 1 AND n > 0 THEN {r('n/engines_executed*100.0', 1)} ELSE 0.0 END AS consensus_ratio,
      CASE WHEN engines_executed > 1 AND n > 0 THEN 'cross_engine_consensus' ELSE 'single_engine_or_no_consensus' END
      AS consensus_basis FROM best b LEFT JOIN ran USING (evidence_id) LEFT JOIN backing USING (evidence_id)""",
)
def consensus(spark, sf):
    return U.fused_verdict(evidence(spark, sf), load(spark, sf, "reads"))


def _key(p: str = "") -> str:
    parts = [f"CAST(CAST(round_even({p}{c}, 0) AS BIGINT) AS VARCHAR)" for c in ("x1", "y1", "x2", "y2")]
    return f"coalesce({parts[0]} || ',' || {parts[1]} || ',' || {parts[2]} || ',' || {parts[3]}, '')"


@query(
    "plate_analyses",
    CLEAN_SQL
    + f""", pri_source AS (SELECT *, {r('''(greatest(1.0,x2-x1)*greatest(1.0,y2-y1))/81920.0*0.60 +
    (1.0-least(1.0,(abs((x1+x2)/2.0-320.0)/320.0 + abs((y1+y2)/2.0-64.0)/64.0)/2.0))*0.25 + confidence*0.15''', 6)} AS ps
      FROM detections),
    dets AS (SELECT evidence_id, det_id, {_key()} AS bbox, confidence AS detection_confidence,
      row_number() OVER (PARTITION BY evidence_id ORDER BY ps DESC, det_id) AS priority_rank FROM pri_source),
    scored AS (SELECT evidence_id, {_key()} AS bbox, read_id, text, engine, {r('confidence', 4)} AS confidence,
      {r(f"confidence*0.60 + {quality_sql('text')}*0.30 + {BBOX_SQL}*0.10", 4)} AS composite FROM (SELECT * REPLACE (CASE WHEN engine = 'engine_r' THEN -evidence_id ELSE evidence_id END AS evidence_id) FROM clean)),
    loose AS (SELECT evidence_id, CASE WHEN bbox = '' THEN 'full_image' ELSE bbox END AS bbox, read_id, text, engine,
      confidence, composite FROM scored WHERE evidence_id NOT IN (SELECT evidence_id FROM dets)),
    groups AS (SELECT evidence_id, CAST(-1 AS BIGINT) AS det_id, bbox, 0.0 AS detection_confidence,
      row_number() OVER (PARTITION BY evidence_id ORDER BY min(read_id)) AS priority_rank FROM loose
      GROUP BY evidence_id, bbox),
    matched AS (SELECT d.evidence_id, d.det_id, d.bbox, d.priority_rank, d.detection_confidence, s.read_id, s.text,
        s.engine, s.confidence, s.composite FROM dets d LEFT JOIN scored s USING (evidence_id, bbox)
      UNION ALL
      SELECT g.evidence_id, g.det_id, g.bbox, g.priority_rank, g.detection_confidence, s.read_id, s.text, s.engine,
        s.confidence, s.composite FROM groups g JOIN loose s USING (evidence_id, bbox)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY evidence_id, det_id, bbox ORDER BY composite DESC, read_id)
      AS n FROM matched)
    SELECT evidence_id, det_id, bbox, priority_rank, CAST(detection_confidence AS DOUBLE) AS detection_confidence,
      coalesce(max(CASE WHEN n = 1 THEN text END), '') AS best_text,
      coalesce(max(CASE WHEN n = 1 THEN engine END), '') AS best_engine,
      coalesce(max(CASE WHEN n = 1 THEN confidence END), 0.0) AS best_confidence,
      coalesce(max(CASE WHEN n = 1 THEN composite END), 0.0) AS best_composite_score,
      coalesce(string_agg(text, '|' ORDER BY n), '') AS candidate_texts
    FROM numbered WHERE n <= 8 GROUP BY ALL""",
)
def plate_analyses(spark, sf):
    """Reads of one engine count as evidence of their own, on which no detector ran."""
    apart = F.when(F.col("engine") == "engine_r", -F.col("evidence_id")).otherwise(F.col("evidence_id"))
    reads = clean(spark, sf).withColumn("evidence_id", apart)
    return U.plate_analyses(prioritize_detections(load(spark, sf, "detections"), 640.0, 128.0), reads)


_READ_COLUMNS = ["evidence_id", "read_id", "engine", "text"]
_MERGE_KEY = f"evidence_id, engine, det_rank, {NORM.format('text')}, x1, y1, x2, y2"


@query(
    "merge_reads",
    with_tables("reads")
    + f""", tagged AS (SELECT *, row_number() OVER (PARTITION BY {_MERGE_KEY} ORDER BY read_id) AS n,
      max(CASE WHEN engine = 'engine_a' THEN 1 ELSE 0 END) OVER (PARTITION BY {_MERGE_KEY}) AS seen FROM reads)
    SELECT evidence_id, read_id, engine, text FROM tagged WHERE engine = 'engine_a' OR (seen = 0 AND n = 1)""",
)
def merge_reads(spark, sf):
    reads = load(spark, sf, "reads")
    first = F.col("engine") == "engine_a"
    return U.merge_reads(reads.where(first), reads.where(~first)).select(*_READ_COLUMNS)


@query(
    "dedupe_reads",
    with_tables("reads")
    + f""" SELECT evidence_id, read_id, engine, text FROM (SELECT evidence_id, read_id, engine, {NORM.format('text')} AS text,
      row_number() OVER (PARTITION BY evidence_id, {NORM.format('text')}, engine, x1, y1, x2, y2 ORDER BY read_id) AS n
      FROM reads) WHERE text <> '' AND n = 1""",
)
def dedupe_reads(spark, sf):
    return U.dedupe_reads(load(spark, sf, "reads")).select(*_READ_COLUMNS)


_IDLE = {"engine_a": "skipped", "engine_n": "skipped", "engine_r": "available", "engine_x": "unavailable"}


@query(
    "engine_status",
    with_tables("engine_runs", "reads")
    + f""", dim(engine, idle) AS (VALUES {', '.join(f"('{e}', '{s}')" for e, s in _IDLE.items())}),
    ran AS (SELECT DISTINCT evidence_id, engine FROM reads WHERE {NORM.format('text')} <> '')
    SELECT e.evidence_id, d.engine, CASE WHEN d.engine = 'engine_a' AND disabled THEN 'disabled'
      WHEN d.engine = 'engine_a' AND error <> '' THEN 'failed'
      WHEN r.engine IS NOT NULL OR d.engine = selected_engine THEN 'executed' ELSE idle END AS status
    FROM engine_runs e CROSS JOIN dim d LEFT JOIN ran r ON r.evidence_id = e.evidence_id AND r.engine = d.engine""",
)
def engine_status(spark, sf):
    return U.engine_status(load(spark, sf, "engine_runs"), clean(spark, sf), _IDLE, "engine_a")


def validation_ctes(source: str, column: str = "text", prefix: str = "v") -> str:
    """CTE body giving text, pattern, valid, score, suspicious, issues for each row of `source`."""
    c = column
    value = "CASE WHEN substr({0},{1},1) BETWEEN '0' AND '9' THEN ascii(substr({0},{1},1))-48 ELSE ascii(substr({0},{1},1))-64 END"
    total = " + ".join(f"({value.format(c, i + 1)})*{i + 2}" for i in range(5))
    return f"""{prefix}_pattern AS (SELECT *, CASE
        WHEN length({c}) NOT BETWEEN 7 AND 8 THEN 'invalid'
        WHEN regexp_full_match({c}, '[A-Z]{{4}}[0-9]{{3}}') THEN 'old_4l3n'
        WHEN regexp_full_match({c}, '[A-Z]{{3}}[0-9]{{4}}') THEN 'old_3l4n'
        WHEN regexp_full_match({c}, '[A-Z]{{3}}[0-9][A-Z][0-9]{{2}}') THEN 'mercosul' ELSE 'invalid' END AS pattern
      FROM {source}),
    {prefix}_parts AS (SELECT *, CASE WHEN pattern = 'invalid' THEN 0 ELSE
        length(regexp_replace({c}, '[^O0I1LS5Z2]', '', 'g')) END AS suspicious,
        CASE pattern WHEN 'old_4l3n' THEN 0.9 WHEN 'old_3l4n' THEN 0.85 WHEN 'mercosul' THEN 0.95 END::DOUBLE AS base,
        CASE WHEN pattern = 'mercosul' THEN ({total}) % 9 = TRY_CAST(substr({c},6,2) AS INT) % 9 ELSE false END AS checked
      FROM {prefix}_pattern),
    {prefix}_raw AS (SELECT *, base - 0.1::DOUBLE*suspicious + CASE WHEN checked THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS raw
      FROM {prefix}_parts),
    {prefix} AS (SELECT *, coalesce(raw >= 0.5, false) AS valid,
        CASE WHEN pattern = 'invalid' THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, raw)) END AS vscore,
        concat_ws('; ', CASE WHEN length({c}) < 7 THEN 'Comprimento insuficiente' WHEN length({c}) > 8
          THEN 'Comprimento excessivo' WHEN pattern = 'invalid' THEN 'Padrão de placa não reconhecido' END,
          CASE WHEN suspicious > 0 THEN suspicious || ' caracteres potencialmente OCR-confuso' END,
          CASE WHEN pattern = 'mercosul' AND NOT checked THEN 'Check-digit Mercosul falhou (pode ser válido)' END)
        AS issues FROM {prefix}_raw)"""


_SPACELESS = "replace(upper(trim(text)), ' ', '')"
_VALIDATED_SQL = (
    with_tables("reads")
    + f""", counted AS (SELECT {_SPACELESS} AS text, count(*) AS reads FROM reads GROUP BY ALL), """
    + validation_ctes("counted")
)


@query(
    "validate_reads",
    _VALIDATED_SQL
    + f" SELECT text, reads, pattern, valid, {r('vscore', 6)} AS score, suspicious::BIGINT AS suspicious, issues FROM v",
)
def validate_reads(spark, sf):
    return U.validate_reads(load(spark, sf, "reads"))


@query(
    "validation_counts",
    _VALIDATED_SQL
    + " SELECT pattern, valid, count(*) AS texts, CAST(sum(reads) AS BIGINT) AS reads FROM v GROUP BY ALL",
)
def validation_counts(spark, sf):
    return U.validation_counts(U.validate_reads(load(spark, sf, "reads")))


@query(
    "suggest_corrections",
    with_tables("misreads", recursive=True)
    + f""", counted AS (SELECT DISTINCT {_SPACELESS} AS text FROM misreads), """
    + validation_ctes("counted")
    + """, swap(ch, alt, i) AS (VALUES ('O','0',0), ('0','O',0), ('I','1',0), ('I','L',1), ('1','I',0), ('1','L',1),
      ('L','I',0), ('L','1',1), ('S','5',0), ('5','S',0), ('Z','2',0), ('2','Z',0)),
    grow AS (SELECT text, 0 AS n, '' AS head, 0::BIGINT AS pos FROM v WHERE NOT valid AND suspicious > 0
      UNION ALL
      SELECT g.text, n+1, head || coalesce(s.alt, substr(g.text, n+1, 1)), pos*2 + coalesce(s.i, 0)
      FROM grow g LEFT JOIN swap s ON s.ch = substr(g.text, n+1, 1) WHERE n < length(g.text)),
    whole AS (SELECT text AS source, head AS text, pos FROM grow WHERE n = length(text)), """
    + validation_ctes("whole", prefix="w")
    + f""", ranked AS (SELECT source AS text, text AS suggestion, {r('vscore', 6)} AS score, row_number() OVER
      (PARTITION BY source ORDER BY {r('vscore', 6)} DESC, pos) AS rank FROM w WHERE valid)
    SELECT text, rank, suggestion, score FROM ranked WHERE rank <= 3""",
)
def suggest_corrections(spark, sf):
    return U.suggest_corrections(load(spark, sf, "misreads"))


def _confidence_cases(spark, sf):
    reads = load(spark, sf, "reads")
    scores = load(spark, sf, "image_scores")
    det = load(spark, sf, "detections").select("evidence_id", F.col("det_id").alias("read_id"), F.col("confidence").alias("det_conf"))
    cases = (
        reads.withColumn("text", spaceless(F.col("text")))
        .withColumn("ocr_conf", U.norm_conf(F.col("confidence")))
        .join(det, ["evidence_id", "read_id"])
        .join(scores, "evidence_id", "left")
        .withColumn("quality_issue", F.lit(""))
        .withColumn("blur", F.lit("unknown"))
    )
    return with_validation(cases, "text", out="validation")


_LEVELS = """CASE WHEN overall_confidence >= 0.85 THEN 'high' WHEN overall_confidence >= 0.65 THEN 'medium'
  WHEN overall_confidence >= 0.45 THEN 'low' ELSE 'reject' END"""


def _graded(name, value, weak, fair):
    shown = f"format('{{:.2f}}', {r(value, 2)})"
    return f"CASE WHEN {value} < 0.5 THEN '{name} {weak} (' || {shown} || ')' WHEN {value} < 0.7 THEN '{name} {fair} (' || {shown} || ')' END"


def level_ctes(source: str) -> str:
    """CTEs scoring rows that carry det_conf, ocr_conf, vscore, valid, suspicious, issues, quality."""
    reason = f"""concat_ws('; ', {_graded('detecção', 'det_conf', 'fraca', 'moderada')},
      {_graded('OCR', 'ocr_conf', 'fraco', 'moderado')},
      CASE WHEN NOT valid THEN CASE WHEN issues <> '' THEN 'validação inválida: ' || split_part(issues, '; ', 1)
        ELSE 'padrão de placa inválido' END
        WHEN vscore < 0.7 THEN 'validação fraca (' || format('{{:.2f}}', {r('vscore', 2)}) || ')' END,
      CASE WHEN valid AND vscore < 0.7 AND suspicious > 0 THEN suspicious || ' chars suspeitos' END,
      CASE WHEN coalesce(quality, 0.5) < 0.5 THEN 'qualidade fraca (blur=unknown)' END)"""
    return f"""scored AS (SELECT *, det_conf*0.30 + ocr_conf*0.25 + vscore*0.25 + coalesce(quality, 0.5)*0.20
      AS overall_confidence, {reason} AS why FROM {source}),
    levels AS (SELECT *, {_LEVELS} AS confidence_level, overall_confidence >= 0.65 AS accept,
      overall_confidence >= 0.45 AND overall_confidence < 0.85 AS requires_review,
      CASE WHEN why = '' THEN 'Resultado válido e confiável' ELSE why END AS reason FROM scored)"""


_LEVEL_SQL = (
    with_tables("reads", "detections", "image_scores")
    + f""", base AS (SELECT q.evidence_id, q.read_id, q.engine, {_SPACELESS.replace('text', 'q.text')} AS text,
      greatest(0.0, least(1.0, CASE WHEN q.confidence > 1 THEN q.confidence/100.0 ELSE q.confidence END)) AS ocr_conf,
      d.confidence AS det_conf, s.quality FROM reads q JOIN detections d ON d.evidence_id = q.evidence_id
      AND d.det_id = q.read_id LEFT JOIN image_scores s ON s.evidence_id = q.evidence_id), """
    + validation_ctes("base")
    + ", "
    + level_ctes("v")
)


@query(
    "confidence_level",
    _LEVEL_SQL
    + f""" SELECT evidence_id, read_id, {r('overall_confidence', 9)} AS overall_confidence, confidence_level, accept,
    requires_review, reason FROM levels""",
)
def confidence_level(spark, sf):
    return U.confidence_level(_confidence_cases(spark, sf)).select(
        "evidence_id",
        "read_id",
        U.rnd(F.col("overall_confidence"), 9).alias("overall_confidence"),
        "confidence_level",
        "accept",
        "requires_review",
        "reason",
    )


@query(
    "batch_confidence_stats",
    _LEVEL_SQL
    + f""" SELECT engine, count(*) AS total, count(*) FILTER (confidence_level = 'high') AS high_confidence,
    count(*) FILTER (confidence_level = 'medium') AS medium_confidence,
    count(*) FILTER (confidence_level = 'low') AS low_confidence,
    count(*) FILTER (confidence_level = 'reject') AS rejected,
    {r(xsum('overall_confidence') + '/count(*)', 6)} AS average_confidence FROM levels GROUP BY engine""",
)
def batch_confidence_stats(spark, sf):
    stats = U.batch_confidence_stats(U.confidence_level(_confidence_cases(spark, sf)), "engine")
    return stats.withColumn("average_confidence", U.rnd(F.col("average_confidence"), 6))


@query(
    "detection_ocr_join",
    FUSED_SQL.replace("WITH ", with_tables("image_scores") + ", ", 1)
    + """, joined AS (SELECT b.evidence_id, b.best_text AS text, b.best_avg_conf AS ocr_conf,
      coalesce(m.c, 0.3) AS det_conf, s.quality FROM best b LEFT JOIN (SELECT evidence_id, max(confidence) AS c
      FROM detections GROUP BY evidence_id) m USING (evidence_id)
      LEFT JOIN image_scores s USING (evidence_id)), """
    + validation_ctes("joined")
    + ", "
    + level_ctes("v")
    + f""" SELECT evidence_id, text AS best_text, CASE WHEN text = '' THEN 0.0 ELSE {r('overall_confidence', 9)} END
    AS overall_confidence, CASE WHEN text = '' THEN 'reject' ELSE confidence_level END AS confidence_level,
    text <> '' AND accept AS accept, text <> '' AND requires_review AS requires_review,
    CASE WHEN text = '' THEN 'Sem resultado de OCR válido' ELSE reason END AS reason FROM levels""",
)
def detection_ocr_join(spark, sf):
    joined = U.detection_ocr_join(best(spark, sf), load(spark, sf, "detections"), load(spark, sf, "image_scores"))
    return joined.withColumn("overall_confidence", U.rnd(F.col("overall_confidence"), 9))


@query(
    "light_frame_confidence",
    CLEAN_SQL
    + """, top AS (SELECT * FROM (SELECT evidence_id, text, confidence, row_number() OVER (PARTITION BY evidence_id
      ORDER BY confidence DESC, read_id) AS n FROM clean WHERE length(text) >= 5) WHERE n = 1),
    first AS (SELECT evidence_id, arg_min(confidence, det_id) AS det FROM detections
      GROUP BY evidence_id),
    joined AS (SELECT o.o_orderkey AS evidence_id, coalesce(t.text, '') AS text, coalesce(t.confidence, 0.0) AS conf,
      coalesce(f.det, 0.2) AS det FROM orders o LEFT JOIN top t ON t.evidence_id = o.o_orderkey
      LEFT JOIN first f ON f.evidence_id = o.o_orderkey), """
    + validation_ctes("joined")
    + f""" SELECT evidence_id, text AS best_text, valid, greatest(0.0, least(1.0,
    {r('(conf*0.6 + det*0.4)*(CASE WHEN valid THEN 1.1 ELSE 0.7 END)', 4)})) AS frame_confidence FROM v""",
)
def light_frame_confidence(spark, sf):
    return U.light_frame_confidence(evidence(spark, sf), load(spark, sf, "detections"), clean(spark, sf))


@query(
    "norm_plate_variants",
    with_tables("reads")
    + f""" SELECT text, {NORM.format('text')} AS norm_plate, {_SPACELESS} AS spaceless, count(*) AS reads
    FROM reads GROUP BY ALL""",
)
def norm_plate_variants(spark, sf):
    """The two cleanings side by side: one strips hyphens, the validator's own does not."""
    reads = load(spark, sf, "reads").groupBy("text").agg(F.count(F.lit(1)).alias("reads"))
    return reads.select("text", norm_plate(F.col("text")).alias("norm_plate"), spaceless(F.col("text")).alias("spaceless"), "reads")
