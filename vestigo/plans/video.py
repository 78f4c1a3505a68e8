"""Video and partial-plate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.operators import partials as P, video as T
from vestigo.plans.derived import _PLATE, add, load, with_tables
from vestigo.plans.detections import iou_sql
from vestigo.plans.fusion import clean
from vestigo.plans.registry import query, r, xsum

add(
    "video_frames",
    "events",
    [
        "user_id AS video_id",
        "event_id AS frame_index",
        "event_id AS frame_order",
        "event_id*0.05 AS timestamp_seconds",
        "value AS sharpness",
        "CAST(event_id%256 AS DOUBLE) AS luma",
        "value AS confidence",
        "value*1.5 AS score",
        "CASE WHEN event_type='error' THEN '' ELSE upper(substr(event_type,1,3)) || '-' || "
        "lpad(CAST(user_id%100+event_id%2 AS STRING),4,'0') END AS ocr",
        "CASE WHEN event_type='click' THEN 'Mercosul' WHEN event_type='view' THEN 'Antigo' ELSE '' END AS pattern",
        "CAST(event_id%3 AS DOUBLE)/2 AS style_rank_priority",
        "CAST(event_id%101 AS DOUBLE) AS agreement_ratio",
        "CAST((event_id*7)%100 AS DOUBLE) AS assessment",
        "CASE WHEN event_id%4=0 THEN 'conclusivo' ELSE 'INCONCLUSIVO' END AS status",
        "CAST(floor(event_id/500.0) AS BIGINT) AS burst",
    ],
    [
        "video_id",
        "frame_index",
        "frame_order",
        "CAST(timestamp_seconds AS DOUBLE) AS timestamp_seconds",
        "sharpness",
        "luma",
        "confidence",
        "score",
        "ocr",
        "pattern",
        "style_rank_priority",
        "agreement_ratio",
        "assessment",
        "status",
        "burst",
    ],
)
add(
    "track_detections",
    "lineitem",
    [
        "l_orderkey AS video_id",
        "(CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS det_id",
        "CAST(l_linenumber AS DOUBLE) AS timestamp_seconds",
        "l_quantity*10 AS x1",
        "l_tax*1000 AS y1",
        "l_quantity*10+80+l_suppkey%40 AS x2",
        "l_tax*1000+20+l_partkey%20 AS y2",
        "CASE WHEN l_partkey%4=0 THEN '' ELSE 'PLT' || CAST(l_partkey%3 AS STRING) END AS text",
        "1-l_discount*10 AS confidence",
    ],
)
add(
    "engine_results",
    "lineitem",
    [
        "l_orderkey AS evidence_id",
        "'engine_' || lower(l_returnflag) AS engine",
        "CASE WHEN l_suppkey%3=0 THEN 'full_image' WHEN l_suppkey%3=1 THEN 'crop_' || CAST(l_linenumber AS STRING) "
        "ELSE '' END AS region",
        "l_discount*1000 AS avg_conf",
        "l_tax*1000 AS score",
        "l_partkey",
        "l_suppkey",
        "l_quantity AS qty",
        "l_orderkey*7 + CASE WHEN l_suppkey%4=0 THEN l_partkey%3 ELSE 0 END AS seed",
    ],
    [
        "evidence_id",
        "engine",
        "region",
        "avg_conf",
        "score",
        "qty",
        "CASE WHEN l_partkey%4=0 THEN '' WHEN l_suppkey%11=0 THEN 'CARRO' ELSE "
        f"substr({_PLATE}, CAST(1+l_partkey%3 AS INT), CAST(1+l_suppkey%5 AS INT)) END AS w1",
        f"CASE WHEN l_partkey%4 IN (0, 1) THEN '' ELSE lower(substr({_PLATE}, 3, CAST(2+l_suppkey%6 AS INT))) END AS w2",
        f"substr({_PLATE}, 1, CAST(3+l_suppkey%5 AS INT)) AS text",
        f"substr({_PLATE}, 1, 1) AS c1",
        f"substr({_PLATE}, 5, 1) AS c2",
    ],
)
add(
    "short_candidates",
    "orders",
    [
        "o_orderkey AS evidence_id",
        "o_orderkey*7 AS seed",
        "o_custkey",
        "CAST(o_custkey%100 AS DOUBLE) AS avg_conf",
        "1+o_custkey%3 AS support_count",
        "o_totalprice/10000 AS score",
    ],
    [
        "evidence_id",
        f"substr({_PLATE}, 1, CAST(3+o_custkey%5 AS INT)) AS text",
        "CASE WHEN o_custkey%4=0 THEN '' ELSE 'engine_f' END AS engine",
        "CASE WHEN o_custkey%6=0 THEN 'scene_wide' ELSE '' END AS region",
        "avg_conf",
        "support_count",
        "score",
    ],
)

QUALITY_SQL = "sharpness*(1.0-least(0.7, abs(luma-128.0)/128.0))"


def clock(seconds: str) -> str:
    total = f"greatest(0, CAST(round_even({seconds}, 0) AS BIGINT))"
    return f"format('{{:02d}}:{{:02d}}', {total}//60, {total}%60)"


def span(minute: str) -> str:
    return f"{clock(minute + '*60')} || '-' || {clock(minute + '*60+59.999')}"


ALNUM = "regexp_replace(upper({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def frames(spark, sf):
    return load(spark, sf, "video_frames")


@query(
    "frame_quality_topk",
    with_tables("video_frames")
    + f""", q AS (SELECT video_id, frame_index, {QUALITY_SQL} AS frame_quality FROM video_frames)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_quality DESC, frame_index) AS rank FROM q)
    WHERE rank <= 12""",
)
def frame_quality_topk(spark, sf):
    return T.frame_quality_topk(frames(spark, sf)).select("video_id", "frame_index", "frame_quality", "rank")


@query(
    "sharpest_in_burst",
    with_tables("video_frames")
    + """ SELECT video_id, burst, frame_index, sharpness FROM (SELECT *, row_number() OVER (PARTITION BY video_id, burst
    ORDER BY sharpness DESC, frame_index) AS n FROM video_frames) WHERE n = 1""",
)
def sharpest_in_burst(spark, sf):
    return T.sharpest_in_burst(frames(spark, sf))


@query(
    "sample_frames",
    with_tables("video_frames")
    + """, n AS (SELECT video_id, frame_index, row_number() OVER (PARTITION BY video_id ORDER BY frame_index)-1 AS position,
      count(*) OVER (PARTITION BY video_id) AS c FROM video_frames),
    v AS (SELECT DISTINCT video_id, c, least(greatest(CAST(round_even(c*0.04::DOUBLE, 0) AS BIGINT), 0), c-1) AS first,
      CAST(round_even(c*(1.0::DOUBLE-0.02), 0) AS BIGINT)-1 AS e FROM n),
    w AS (SELECT video_id, c, first, greatest(first, least(e, c-1)) AS final FROM v),
    x AS (SELECT video_id, c, CASE WHEN final <= first THEN 0 ELSE first END AS lo, CASE WHEN final <= first THEN c-1 ELSE final END AS hi FROM w),
    picks AS (SELECT DISTINCT video_id, CASE WHEN i = 11 THEN hi ELSE CAST(floor(i*((hi-lo)/11.0::DOUBLE)+lo) AS BIGINT) END AS position
      FROM x, range(12) t(i) WHERE c > 12
      UNION SELECT video_id, position FROM n WHERE c <= 12)
    SELECT n.video_id, n.position, n.frame_index FROM n JOIN picks p ON p.video_id = n.video_id AND p.position = n.position""",
)
def sample_frames(spark, sf):
    return T.sample_frames(frames(spark, sf))


_CANDIDATE_SQL = (
    with_tables("video_frames")
    + f""", f AS (SELECT video_id, {ALNUM.format('ocr')} AS text, CASE WHEN pattern = '' THEN 'Indefinido' ELSE pattern END AS pattern,
      CAST(floor(timestamp_seconds/60) AS BIGINT) AS minute_index, frame_index, timestamp_seconds, confidence, score,
      style_rank_priority AS style FROM video_frames WHERE ocr <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id, text, pattern, minute_index ORDER BY confidence DESC, score DESC,
      frame_index) AS n FROM f),
    g AS (SELECT video_id, text, pattern, minute_index, count(*) AS frames_count,
      {r(xsum('confidence') + '/count(*)', 2)} AS avg_confidence, {r(xsum('score') + '/count(*)', 2)} AS avg_score,
      min(frame_index) AS first_frame, max(frame_index) AS last_frame,
      {r('max(CASE WHEN n=1 THEN confidence END)', 2)} AS best_confidence, {r('max(CASE WHEN n=1 THEN score END)', 2)} AS best_score,
      {r('max(CASE WHEN n=1 THEN style END)', 3)} AS style_rank_priority, max(CASE WHEN n=1 THEN frame_index END) AS frame_index,
      max(CASE WHEN n=1 THEN timestamp_seconds END) AS timestamp_seconds FROM o GROUP BY ALL),
    candidates AS (SELECT *, left(sha1(text || '|' || pattern || '|' || minute_index), 16) AS candidate_id,
      {span('minute_index')} AS minute_range, row_number() OVER (PARTITION BY video_id ORDER BY frames_count DESC,
      style_rank_priority DESC, best_confidence DESC, best_score DESC, timestamp_seconds, first_frame) AS rank FROM g)"""
)


@query(
    "video_candidates",
    _CANDIDATE_SQL
    + " SELECT *, minute_range || ' | ' || text || ' | ' || pattern AS label FROM candidates WHERE rank <= 24",
)
def video_candidates(spark, sf):
    return T.video_candidates(frames(spark, sf))


@query(
    "candidate_frames",
    with_tables("video_frames")
    + f""" SELECT DISTINCT video_id, {ALNUM.format('ocr')} AS text, pattern, CAST(floor(timestamp_seconds/60) AS BIGINT) AS minute_index,
    frame_index FROM video_frames WHERE ocr <> ''""",
)
def candidate_frames(spark, sf):
    return T.candidate_frames(frames(spark, sf))


@query(
    "best_frame",
    with_tables("video_frames")
    + f""", s AS (SELECT *, confidence*0.55 + least(100.0, score)*0.2 + agreement_ratio*0.14 + assessment*0.08 +
      ((CASE WHEN ocr <> '' THEN 4.0 ELSE 0.0 END) + (CASE WHEN length(ocr) = 7 THEN 3.0 ELSE 0.0 END) +
       (CASE WHEN upper(status) = 'CONCLUSIVO' THEN 6.0 ELSE 0.0 END) + (CASE WHEN agreement_ratio >= 80 THEN 4.0 ELSE 0.0 END) +
       (CASE WHEN assessment >= 70 THEN 3.0 ELSE 0.0 END)) + least(6.0, sharpness/55.0) AS fs FROM video_frames),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fs DESC, frame_index) AS place FROM s),
    t AS (SELECT video_id, ocr, count(*) AS n, min(place) AS p, {xsum('confidence')}/count(*) AS c FROM o WHERE ocr <> '' GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, length(ocr) DESC, p) AS w,
      count(*) OVER (PARTITION BY video_id) AS texts FROM t)
    SELECT o.video_id, o.frame_index AS best_frame_index, {r('o.fs', 6)} AS best_frame_score, coalesce(k.ocr, '') AS consensus_text,
      coalesce(k.n, 0) AS consensus_count, {r('coalesce(k.c, 0)', 2)} AS consensus_confidence, coalesce(k.texts, 0) AS texts
    FROM o LEFT JOIN k ON k.video_id = o.video_id AND k.w = 1 WHERE o.place = 1""",
)
def best_frame(spark, sf):
    return T.best_frame(frames(spark, sf))


@query(
    "elect_frame",
    with_tables("video_frames")
    + """, s AS (SELECT video_id, frame_index, confidence + CASE WHEN ocr <> '' THEN 0.10 ELSE 0.0 END AS e FROM video_frames)
    SELECT video_id, frame_index, e AS elected_score FROM (SELECT *, row_number() OVER (PARTITION BY video_id
    ORDER BY e DESC, frame_index) AS n FROM s) WHERE n = 1""",
)
def elect_frame(spark, sf):
    return T.elect_frame(frames(spark, sf))


TRACK_SQL = (
    with_tables("track_detections", recursive=True)
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_seconds, det_id) AS rn FROM track_detections),
    b AS (SELECT video_id, rn, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b FROM o),
    walk AS (SELECT video_id, rn, [b] AS last, 1::BIGINT AS track FROM b WHERE rn = 1
      UNION ALL
      SELECT video_id, rn, CASE WHEN slot > 0 THEN last[1:slot-1] || [b] || last[slot+1:] ELSE list_append(last, b) END,
        CASE WHEN slot > 0 THEN slot ELSE len(last)+1 END
      FROM (SELECT n.video_id, n.rn, n.b, w.last, coalesce(list_position([{iou_sql('n.b.', 'k.')} >= 0.4 for k in w.last], true), 0) AS slot
        FROM walk w JOIN b n ON n.video_id = w.video_id AND n.rn = w.rn+1)),
    t AS (SELECT o.*, w.track FROM o JOIN walk w ON w.video_id = o.video_id AND w.rn = o.rn)"""
)


@query(
    "track_vehicles",
    TRACK_SQL
    + f""",
    v AS (SELECT video_id, track, text, row_number() OVER (PARTITION BY video_id, track ORDER BY count(*) DESC, min(rn)) AS place
      FROM t WHERE text <> '' GROUP BY video_id, track, text)
    SELECT t.video_id, t.track AS track_id, coalesce(max(CASE WHEN v.place = 1 THEN v.text END), '') AS consolidated_plate,
      count(DISTINCT v.text) AS plate_candidates, min(timestamp_seconds) AS start_seconds, max(timestamp_seconds) AS end_seconds,
      count(*) AS detections_count, {r(xsum('confidence') + '/count(*)', 4)} AS avg_confidence
    FROM t LEFT JOIN v ON v.video_id = t.video_id AND v.track = t.track AND v.text = t.text GROUP BY t.video_id, t.track""",
)
def track_vehicles(spark, sf):
    return T.track_vehicles(load(spark, sf, "track_detections"))


_REQUEST_SQL = """, requests AS (SELECT video_id, candidate_id, 100 - rank AS position FROM candidates WHERE rank <= 24 AND rank % 2 = 0
  UNION ALL SELECT video_id, candidate_id, 200 - rank FROM candidates WHERE rank <= 24 AND rank % 4 = 0)"""


def _requests(candidates):
    half = candidates.where("rank % 2 = 0").select("video_id", "candidate_id", (100 - F.col("rank")).alias("position"))
    again = candidates.where("rank % 4 = 0").select("video_id", "candidate_id", (200 - F.col("rank")).alias("position"))
    return half.unionByName(again)


@query(
    "select_candidates",
    _CANDIDATE_SQL
    + _REQUEST_SQL
    + """ SELECT c.video_id, c.candidate_id, c.text, row_number() OVER (PARTITION BY c.video_id ORDER BY q.position) AS selection
    FROM (SELECT video_id, candidate_id, min(position) AS position FROM requests GROUP BY ALL) q
    JOIN candidates c ON c.video_id = q.video_id AND c.candidate_id = q.candidate_id WHERE c.rank <= 24""",
)
def select_candidates(spark, sf):
    candidates = T.video_candidates(frames(spark, sf))
    return T.select_candidates(candidates, _requests(candidates)).select("video_id", "candidate_id", "text", "selection")


@query(
    "normalize_targets",
    _CANDIDATE_SQL
    + f""", t AS (SELECT c.*, f.ocr AS bo FROM candidates c JOIN video_frames f ON f.video_id = c.video_id
      AND f.frame_index = c.frame_index WHERE rank <= 24),
    u AS (SELECT video_id, candidate_id, CASE WHEN rank % 3 = 0 THEN bo ELSE text END AS text, pattern,
      'f_' || frame_index || '.jpg' AS frame_path, {r('timestamp_seconds', 4)} AS timestamp_seconds, {clock('timestamp_seconds')} AS timestamp_label,
      frame_index, minute_index, minute_range, best_confidence, best_score, avg_confidence,
      CASE WHEN rank % 2 = 0 THEN 1 ELSE frames_count END AS frames_count FROM t)
    SELECT *, minute_range || ' | ' || text || ' | ' || pattern AS display_label,
      frames_count || ' quadros | minuto ' || lpad(minute_index::VARCHAR, 2, '0') AS support_label FROM u""",
)
def normalize_targets(spark, sf):
    c = T.video_candidates(frames(spark, sf)).alias("c")
    f = frames(spark, sf).select("video_id", "frame_index", "ocr", F.col("pattern").alias("bp"), F.col("timestamp_seconds").alias("bt"), "confidence", "score")
    best = F.struct(
        F.col("ocr"),
        F.col("bp").alias("pattern"),
        F.col("bt").alias("timestamp_seconds"),
        F.col("frame_index"),
        F.concat(F.lit("f_"), F.col("frame_index").cast("string"), F.lit(".jpg")).alias("frame_path"),
        F.col("f.confidence").alias("confidence"),
        F.col("f.score").alias("score"),
    )
    targets = c.join(f.alias("f"), ["video_id", "frame_index"]).select(
        "video_id",
        "candidate_id",
        F.when(F.col("rank") % 3 == 0, "").otherwise(F.col("text")).alias("text"),
        "pattern",
        F.lit("").alias("frame_path"),
        F.lit(None).cast("double").alias("timestamp_seconds"),
        F.lit(None).cast("bigint").alias("frame_index"),
        F.lit(None).cast("bigint").alias("minute_index"),
        F.lit("").alias("minute_range"),
        F.lit(None).cast("double").alias("best_confidence"),
        F.lit(None).cast("double").alias("best_score"),
        "avg_confidence",
        F.when(F.col("rank") % 2 == 0, None).otherwise(F.col("frames_count")).alias("frames_count"),
        best.alias("best_frame"),
    )
    return T.normalize_targets(targets)


@query(
    "frame_summary",
    with_tables("video_frames")
    + " SELECT video_id, frame_index, timestamp_seconds, sharpness, ocr AS plate_read, confidence FROM video_frames",
)
def frame_summary(spark, sf):
    return T.frame_summary(frames(spark, sf))


# -- partial plates ----------------------------------------------------------------------------


def keep_sql(t: str, c: str, s: str, n: str) -> str:
    mixed = f"(length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace({t}, '[^\\p{{N}}]', '', 'g')) > 0)"
    return f"""(CASE WHEN length({t}) < 1 OR length({t}) > 6 THEN false
      WHEN length({t}) = 1 THEN {c} >= 18 OR {s} >= 1 OR {n} >= 1 WHEN length({t}) = 2 THEN {c} >= 16 OR {s} >= 1 OR {n} >= 1
      WHEN length({t}) = 3 THEN {mixed} OR {c} >= 32 OR {s} >= 2 WHEN length({t}) = 4 THEN {mixed} OR {c} >= 36 OR {s} >= 2
      ELSE {mixed} OR {c} >= 46 OR {s} >= 2 END)"""


def priority_sql(t: str, c: str, s: str, n: str) -> str:
    mixed = f"(length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace({t}, '[^\\p{{N}}]', '', 'g')) > 0)"
    return r(
        f"""(CASE WHEN length({t}) <= 2 THEN 3.2 WHEN length({t}) <= 4 THEN 2.0 ELSE 1.1 END)::DOUBLE + least(5.0::DOUBLE, {s}*1.6)
      + least(3.0::DOUBLE, {n}*0.55) + least(9.0::DOUBLE, {c}/12.0)
      + (CASE WHEN {mixed} THEN 1.3 WHEN length({t}) <= 2 THEN 0.8 ELSE 0.2 END)::DOUBLE""",
        4,
    )


def _scene(region: str) -> str:
    return "(" + " OR ".join(f"contains(lower({region}), '{w}')" for w in P.SCENE_WORDS) + ")"


_SOURCES_SQL = (
    with_tables("engine_results", "short_candidates")
    + f""", raw AS (
      SELECT evidence_id, {ALNUM.format('w1')} AS text, engine, region AS r0, 'word' AS origin,
        CASE WHEN qty = 0 THEN avg_conf ELSE qty END AS conf, score, 'raw_entry' AS source_type, 1 AS s FROM engine_results WHERE w1 <> ''
      UNION ALL SELECT evidence_id, {ALNUM.format('w2')}, engine, 'crop_w2', 'raw_entry', avg_conf, score, 'raw_entry', 1
        FROM engine_results WHERE w2 <> ''
      UNION ALL SELECT evidence_id, {ALNUM.format('text')}, engine, region, 'engine_text', avg_conf, score, 'engine_text', 1
        FROM engine_results WHERE w1 = '' AND w2 = ''
      UNION ALL SELECT evidence_id, {ALNUM.format('text')}, CASE WHEN engine = '' THEN 'ensemble' ELSE engine END, region,
        'top_candidate', avg_conf, score, 'top_candidate', support_count FROM short_candidates),
    kept AS (SELECT evidence_id, text, engine, origin, conf, score, source_type,
        CASE WHEN source_type <> 'top_candidate' AND r0 = '' THEN 'ocr_result' ELSE r0 END AS region FROM raw
      WHERE text <> '' AND length(text) <= 6 AND NOT ({_scene('r0')} AND length(text) >= 4 AND regexp_full_match(text, '\\p{{L}}+'))
        AND {keep_sql('text', 'conf', 's', 's')}),
    chars AS (SELECT evidence_id, {ALNUM.format('c')} AS text, engine, 'char_option' AS origin, conf, conf AS score,
        'char_option' AS source_type, CASE WHEN region = '' THEN 'chars' ELSE region END AS region
      FROM (SELECT evidence_id, c1 AS c, engine, region, avg_conf AS conf FROM engine_results UNION ALL
        SELECT evidence_id, c2, engine, region, score FROM engine_results)
      WHERE NOT {_scene('region')} AND conf > 0 AND length({ALNUM.format('c')}) = 1
        AND evidence_id NOT IN (SELECT evidence_id FROM kept)),
    sources AS (SELECT * FROM kept UNION ALL BY NAME SELECT * FROM chars)"""
)


def sources(spark, sf):
    results = load(spark, sf, "engine_results")

    def entry(word, conf, region, origin):
        return F.when(
            F.col(word) != "",
            F.struct(F.col(word).alias("word"), conf.alias("conf"), F.lit(region).alias("region"), F.lit(origin).alias("origin")),
        )

    nested = results.withColumn(
        "raw_entries",
        F.array_compact(F.array(entry("w1", F.col("qty"), "", "word"), entry("w2", F.lit(0.0), "crop_w2", ""))),
    ).withColumn(
        "chars",
        F.array(
            F.struct(F.col("c1").alias("char"), F.col("avg_conf").alias("conf")),
            F.struct(F.col("c2").alias("char"), F.col("score").alias("conf")),
        ),
    )
    return P.partial_sources(nested, load(spark, sf, "short_candidates"))


@query("partial_sources", _SOURCES_SQL + " SELECT * FROM sources")
def partial_sources(spark, sf):
    return sources(spark, sf)


_PARTIAL_SQL = (
    _SOURCES_SQL
    + f""", g AS (SELECT evidence_id, text, count(*) AS source_count, count(DISTINCT engine) AS support_count,
      string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, list_sort(list(DISTINCT engine)) AS engine_list,
      coalesce(string_agg(DISTINCT nullif(region, ''), ',' ORDER BY nullif(region, '')), '') AS regions,
      string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, max(conf) AS best, max(score) AS sc,
      {xsum('conf')}/count(*) AS av FROM sources GROUP BY evidence_id, text),
    c AS (SELECT evidence_id, text, length(text) AS fragment_length, CASE WHEN length(text) = 1 THEN 'caractere_isolado'
        WHEN length(text) = 2 THEN 'par_de_caracteres' WHEN length(text) <= 4 THEN 'fragmento_curto' ELSE 'fragmento_parcial' END AS fragment_kind,
      regexp_replace(regexp_replace(text, '\\p{{L}}', 'L', 'g'), '\\p{{N}}', 'D', 'g') AS slot_hint, support_count, source_count,
      {r('av', 2)} AS avg_confidence, {r('best', 2)} AS best_confidence, {r('sc', 2)} AS best_score,
      {r('best + support_count*9.0 + source_count*3.0', 2)} AS score, {priority_sql('text', 'best', 'support_count', 'source_count')} AS rank_priority,
      engines, engine_list, regions, origins FROM g WHERE {keep_sql('text', 'best', 'support_count', 'source_count')}),
    partials AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY rank_priority DESC, support_count DESC,
      best_confidence DESC, avg_confidence DESC, fragment_length, text) AS rank FROM c) WHERE rank <= 8)"""
)


def partials(spark, sf):
    return P.partial_candidates(sources(spark, sf))


@query("partial_candidates", _PARTIAL_SQL + " SELECT * EXCLUDE (engine_list) FROM partials")
def partial_candidates(spark, sf):
    listed = [F.concat_ws(",", c).alias(c) for c in ("engines", "regions", "origins")]
    found = partials(spark, sf)
    return found.select(*[c for c in found.columns if c not in ("engines", "regions", "origins")], *listed)


@query(
    "partial_overview",
    _PARTIAL_SQL
    + """ SELECT evidence_id, count(*) AS fragments, arg_min(text, rank) AS primary_text,
    string_agg(CASE WHEN rank <= 4 THEN text || ' (' || support_count || ' motor(es) | ' || source_count || ' leitura(s))' END, '; '
    ORDER BY rank) AS summary FROM partials GROUP BY evidence_id""",
)
def partial_overview(spark, sf):
    return P.partial_overview(partials(spark, sf))


@query(
    "video_partials",
    _PARTIAL_SQL
    + f""", items AS (SELECT o.o_custkey AS video_id, p.evidence_id AS frame_index, CAST(p.evidence_id%300 AS DOUBLE) AS ts, p.*
      FROM partials p JOIN orders o ON o.o_orderkey = p.evidence_id),
    m AS (SELECT video_id, frame_index, ts, text, CAST(floor(ts/60) AS BIGINT) AS minute_index, slot_hint, engine_list,
      CASE WHEN best_confidence = 0 THEN avg_confidence ELSE best_confidence END AS conf,
      CASE WHEN best_score = 0 THEN score ELSE best_score END AS sc, source_count, rank_priority FROM items),
    e AS (SELECT video_id, text, minute_index, slot_hint, string_agg(DISTINCT en, ',' ORDER BY en) AS engines, count(DISTINCT en) AS support_count
      FROM (SELECT *, unnest(engine_list) AS en FROM m) GROUP BY ALL),
    h AS (SELECT video_id, text, minute_index, slot_hint, CAST(sum(source_count) AS BIGINT) AS source_count, max(conf) AS best, max(sc) AS bs,
      {xsum('conf')} AS cs, max(rank_priority) AS rp, count(DISTINCT frame_index) AS frames_count, min(frame_index) AS f0 FROM m GROUP BY ALL),
    bf AS (SELECT video_id, text, minute_index, slot_hint, frame_index, ts, row_number() OVER (PARTITION BY video_id, text, minute_index,
      slot_hint ORDER BY conf DESC, sc DESC, frame_index) AS n FROM m),
    z AS (SELECT h.video_id, left(sha1(h.text || '|' || h.minute_index || '|' || h.slot_hint), 16) AS candidate_id, h.text, h.minute_index,
      {span('h.minute_index')} AS minute_range, h.slot_hint, e.support_count, h.source_count, h.frames_count,
      {r('cs/h.source_count', 2)} AS avg_confidence, {r('best', 2)} AS best_confidence, {r('bs', 2)} AS best_score,
      {r('best + e.support_count*9.0 + h.source_count*3.0', 2)} AS score,
      greatest({r('rp', 4)}, {priority_sql('h.text', 'best', 'e.support_count', 'h.source_count')}) AS rank_priority,
      bf.frame_index, bf.ts AS timestamp_seconds, e.engines, f0
      FROM h JOIN e USING (video_id, text, minute_index, slot_hint) JOIN bf USING (video_id, text, minute_index, slot_hint)
      WHERE bf.n = 1 AND {keep_sql('h.text', 'best', 'e.support_count', 'h.source_count')})
    SELECT * EXCLUDE (f0) FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank_priority DESC, support_count DESC,
      best_confidence DESC, avg_confidence DESC, frames_count DESC, length(text), f0, text) AS rank FROM z) WHERE rank <= 24""",
)
def video_partials(spark, sf):
    cases = load(spark, sf, "bench_samples").select(F.col("sample_id").alias("evidence_id"), F.col("o_custkey").alias("video_id"))
    items = partials(spark, sf).join(cases, "evidence_id").select(
        "*",
        F.col("evidence_id").alias("frame_index"),
        F.col("evidence_id").alias("frame_order"),
        (F.col("evidence_id") % 300).cast("double").alias("timestamp_seconds"),
    )
    most = cases.groupBy("video_id").agg((F.count(F.lit(1)) * P.FRAGMENT_CAP).alias("_rows"))
    return P.video_partials(items, sizes=most)


@query(
    "partial_match",
    _PARTIAL_SQL.replace("WITH ", with_tables("reads") + ", ", 1)
    + """, plates AS (SELECT DISTINCT evidence_id, regexp_replace(upper(trim(text)), '[^A-Z0-9]', '', 'g') AS plate FROM reads
      WHERE regexp_replace(upper(trim(text)), '[^A-Z0-9]', '', 'g') <> ''),
    grams AS (SELECT evidence_id, plate, i AS position, substr(plate, i, n) AS fragment FROM plates, range(1, 9) a(i), range(1, 7) b(n)
      WHERE i + n - 1 <= length(plate))
    SELECT evidence_id, fragment, plate, min(position) AS position, count(*) AS occurrences FROM grams g
    JOIN (SELECT DISTINCT evidence_id, text AS fragment FROM partials) USING (evidence_id, fragment) GROUP BY ALL""",
)
def partial_match(spark, sf):
    return P.partial_match(partials(spark, sf), clean(spark, sf), P.FRAGMENT_CAP)
