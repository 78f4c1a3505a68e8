"""Vehicle-hypothesis and web-evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.operators import hypotheses as H, web as W
from vestigo.plans.derived import add, load, read, with_tables
from vestigo.plans.history import _HOST, _NORM_UPPER
from vestigo.plans.registry import query, r, xsum
from vestigo.session import stash

_HYP = ["l_orderkey AS case_id", "(CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS hyp_id", "l_partkey", "l_suppkey", "l_discount*1000 AS confidence"]
add(
    "local_hypotheses",
    "lineitem",
    [*_HYP, "l_returnflag"],
    [
        "case_id",
        "hyp_id",
        "CASE WHEN l_suppkey%9=0 THEN '' WHEN l_suppkey%4=0 THEN 'VW' ELSE 'Make ' || CAST(l_suppkey%4 AS STRING) END AS maker",
        "'M-' || CAST(l_partkey%5 AS STRING) AS model",
        "confidence",
        "'ev_' || CAST(l_partkey%3 AS STRING) AS evidence",
        "l_returnflag",
    ],
)
add(
    "component_reads",
    "lineitem",
    [
        "l_orderkey AS case_id",
        "(CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS read_id",
        "CASE l_linenumber WHEN 1 THEN 'grade_dianteira' WHEN 2 THEN 'farois_dianteiros' WHEN 3 THEN 'lanternas_traseiras' "
        "WHEN 4 THEN 'emblema_frontal' WHEN 5 THEN 'retrovisores' WHEN 6 THEN 'design_carroceria' ELSE 'parachoque' END AS component",
        "CASE l_partkey%7 WHEN 0 THEN 'presente' WHEN 1 THEN 'indefinido' WHEN 2 THEN 'limitado_vista_lateral' WHEN 3 THEN 'fraca' "
        "WHEN 4 THEN 'ausente' WHEN 5 THEN 'simetricos' ELSE 'par_detectado' END AS status",
        "l_discount*1000 AS confidence",
    ],
)
add(
    "vehicle_scenes",
    "orders",
    [
        "o_orderkey AS case_id",
        "CAST(o_custkey%40 AS DOUBLE)/10 AS aspect",
        "o_custkey%3=0 AS compact",
        "CASE WHEN o_custkey%4=0 THEN 'frontal' WHEN o_custkey%4=1 THEN 'Traseira' ELSE 'lateral' END AS view",
        "CASE o_custkey%6 WHEN 0 THEN 'moto honda cg' WHEN 1 THEN 'truck volvo' WHEN 2 THEN 'hatch' WHEN 3 THEN 'caminhão scania' "
        "WHEN 4 THEN 'scooter' ELSE '' END AS told",
    ],
)

_SEEDS = [
    (c, i, f"SEED {c[0]}", m)
    for c in ("AUTOMOVEL", "MOTOCICLETA", "CAMINHAO")
    for i, m in enumerate(("ALFA", "BETA", "GAMA", "DELTA"))
]
_SIBLINGS = [("VOLKSWAGEN", i, f"M {i}") for i in range(5)] + [("MAKE 1", 0, "M 4"), ("MAKE 1", 1, "EXTRA")]
_RULES = [
    ("VOLKSWAGEN", "M 1", 0, "grade_dianteira", ["presente", "fraca"], 18.0),
    ("VOLKSWAGEN", "M 1", 1, "farois_dianteiros", ["simetricos"], 16.0),
    ("VOLKSWAGEN", "M 1", 2, "emblema_frontal", ["par_detectado"], 12.0),
    ("MAKE 1", "M 2", 0, "lanternas_traseiras", ["par_detectado"], 24.0),
    ("MAKE 1", "M 2", 1, "design_carroceria", ["presente"], 10.0),
]


def _tables(spark):
    return (
        spark.createDataFrame(_SEEDS, "category string, seq int, maker string, model string"),
        spark.createDataFrame(_SIBLINGS, "maker string, seq int, model string"),
        spark.createDataFrame(_RULES, "maker string, model string, seq int, component string, statuses array<string>, weight double"),
    )


def _values(rows, width):
    def one(x):
        if isinstance(x, list):
            return "[" + ", ".join(f"'{y}'" for y in x) + "]"
        return f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows)


_DIMS = f""", seeds(category, seq, maker, model) AS (VALUES {_values(_SEEDS, 4)}), siblings(maker, seq, model) AS (VALUES {_values(_SIBLINGS, 3)}),
  rules(maker, model, seq, component, statuses, weight) AS (VALUES {_values(_RULES, 6)})"""

CATEGORY_SQL = (
    with_tables("vehicle_scenes", "local_hypotheses", "component_reads")
    + _DIMS
    + f""", tx AS (SELECT *, {_NORM_UPPER.format('told')} AS t FROM vehicle_scenes),
    cs AS (SELECT *, 35.0::DOUBLE + (CASE WHEN compact THEN 8 ELSE 0 END) + (CASE WHEN upper(view) IN ('FRONTAL', 'TRASEIRA') THEN 2.5 ELSE 0 END) +
        {'+'.join(f"(CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END)*2.6::DOUBLE" for w in H.KEYWORDS['AUTOMOVEL'])} AS a,
      27.0::DOUBLE + (CASE WHEN aspect BETWEEN 0.9 AND 1.45 AND NOT compact THEN 9 ELSE 0 END) +
        {'+'.join(f"(CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END)*2.6::DOUBLE" for w in H.KEYWORDS['MOTOCICLETA'])} AS m,
      27.0::DOUBLE + (CASE WHEN aspect >= 2.75 THEN 10 ELSE 0 END) +
        {'+'.join(f"(CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END)*2.6::DOUBLE" for w in H.KEYWORDS['CAMINHAO'])} AS c FROM tx),
    ct AS (SELECT *, CASE WHEN a >= m AND a >= c THEN 'AUTOMOVEL' WHEN m >= c THEN 'MOTOCICLETA' ELSE 'CAMINHAO' END AS top,
      greatest(a, m, c) AS t1, a+m+c-greatest(a, m, c)-least(a, m, c) AS t2, greatest(35.0, least(99.0, greatest(a, m, c)/(a+m+c)*100.0)) AS cf FROM cs),
    categories AS (SELECT case_id, CASE WHEN top <> 'AUTOMOVEL' AND {r('t1-t2', 6)} < 1.6 AND t1 < 40 THEN 'AUTOMOVEL' ELSE top END AS category,
      {r("CASE WHEN top <> 'AUTOMOVEL' AND " + r('t1-t2', 6) + " < 1.6 AND t1 < 40 THEN greatest(38.0, cf-8.0) ELSE cf END", 2)} AS category_conf,
      {r('a', 2)} AS score_automovel, {r('m', 2)} AS score_motocicleta, {r('c', 2)} AS score_caminhao FROM ct)"""
)


def categories(spark, sf):
    return H.infer_category(load(spark, sf, "vehicle_scenes"))


@query("infer_category", CATEGORY_SQL + " SELECT * FROM categories")
def infer_category(spark, sf):
    return categories(spark, sf)


MERGED_SQL = (
    CATEGORY_SQL
    + f""", hp AS (SELECT *, CASE maker WHEN 'VW' THEN 'VOLKSWAGEN' ELSE {_NORM_UPPER.format('maker')} END AS mk, {_NORM_UPPER.format('model')} AS mo,
      row_number() OVER (PARTITION BY case_id, l_returnflag ORDER BY hyp_id)-1 AS pos FROM local_hypotheses),
    hx AS (SELECT case_id, mk, mo, 0 AS turn, pos, confidence AS l, NULL::DOUBLE AS v, evidence FROM hp WHERE l_returnflag = 'A' AND pos < 8 AND maker <> ''
      UNION ALL SELECT case_id, mk, mo, 1, pos, NULL, confidence, evidence FROM hp WHERE l_returnflag = 'N' AND pos < 8 AND maker <> ''
      UNION ALL SELECT case_id, mk, mo, 2, 0, confidence, NULL, '' FROM hp WHERE l_returnflag = 'R' AND pos = 0 AND maker <> ''),
    hg AS (SELECT case_id, mk AS maker, mo AS model, coalesce(max(l), 0.0) AS lc, coalesce(max(v), 0.0) AS vc, min(turn*100+pos) AS seq FROM hx GROUP BY ALL),
    he AS (SELECT case_id, mk AS maker, mo AS model, evidence, min(turn*100+pos) AS p FROM hx WHERE evidence <> '' GROUP BY ALL),
    hl AS (SELECT case_id, maker, model, string_agg(evidence, ',' ORDER BY p) AS evidence FROM he GROUP BY ALL),
    merged AS (SELECT g.case_id, g.maker, g.model, {r('CASE WHEN lc > 0 AND vc > 0 THEN lc*0.62 + vc*0.38 ELSE greatest(lc, vc) END', 2)} AS base_conf,
        coalesce(l.evidence, '') AS evidence, false AS synthetic, seq FROM hg g LEFT JOIN hl l USING (case_id, maker, model)
      UNION ALL SELECT k.case_id, s.maker, s.model, 12.0, 'seed_categoria_sem_hipotese_local', true, s.seq FROM categories k JOIN seeds s ON s.category = k.category
        WHERE s.seq < 2 AND k.case_id NOT IN (SELECT case_id FROM hg))"""
)


def _hyp(spark, sf):
    from pyspark.sql import Window

    # Dealt by case, as every later step is by case and needs no further move.
    rows = load(spark, sf, "local_hypotheses").repartition("case_id").withColumn("evidence", F.array("evidence"))
    # Positions as the recogniser gave them; a case has a handful of hypotheses of each kind.
    pos = F.row_number().over(Window.partitionBy("case_id", "l_returnflag").orderBy("hyp_id")) - 1
    placed = rows.withColumn("pos", pos)
    of = lambda kind: placed.where(F.col("l_returnflag") == kind).drop("l_returnflag", "hyp_id")
    return of("A"), of("N"), of("R").where("pos = 0").drop("pos", "evidence")


def merged(spark, sf):
    seeds, _, _ = _tables(spark)
    local, vision, principal = _hyp(spark, sf)
    return H.merge_hypotheses(categories(spark, sf), local, vision, principal, seeds.where("seq < 2"))


@query("merge_hypotheses", MERGED_SQL + " SELECT case_id, maker, model, base_conf, evidence, synthetic FROM merged")
def merge_hypotheses(spark, sf):
    return merged(spark, sf).drop("seq").withColumn("evidence", F.concat_ws(",", "evidence"))


EXPANDED_SQL = (
    MERGED_SQL
    + f""", ld AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY base_conf DESC, seq) AS n, count(*) OVER (PARTITION BY case_id) AS n0 FROM merged),
    x1 AS (SELECT l.case_id, s.maker, s.model, {r('greatest(8.0, l.base_conf*0.72)', 2)} AS base_conf, true AS synthetic, s.seq, l.n0,
      row_number() OVER (PARTITION BY l.case_id ORDER BY s.seq, s.maker, s.model) AS k FROM ld l JOIN siblings s ON s.maker = l.maker
      WHERE l.n = 1 AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.case_id = l.case_id AND m.maker = s.maker AND m.model = s.model)),
    one AS (SELECT case_id, maker, model, base_conf, synthetic, seq FROM x1 WHERE k <= greatest(1, 3-n0)),
    c1 AS (SELECT k.case_id, k.category, (SELECT count(*) FROM merged m WHERE m.case_id = k.case_id) + (SELECT count(*) FROM one o WHERE o.case_id = k.case_id) AS n1 FROM categories k),
    kn1 AS (SELECT case_id, maker, model FROM merged UNION SELECT case_id, maker, model FROM one),
    lo AS (SELECT case_id, mk AS maker, mo AS model, arg_min(confidence, pos) AS confidence, min(pos) AS seq FROM hp WHERE l_returnflag = 'A' AND maker <> '' GROUP BY ALL),
    x2 AS (SELECT l.*, row_number() OVER (PARTITION BY l.case_id ORDER BY l.seq, l.maker, l.model) AS k FROM lo l ANTI JOIN kn1 USING (case_id, maker, model)),
    two AS (SELECT x2.case_id, maker, model, {r('confidence*0.75', 2)} AS base_conf, false AS synthetic, seq FROM x2 JOIN c1 ON c1.case_id = x2.case_id WHERE k <= 3-n1),
    c2 AS (SELECT c1.case_id, c1.category, n1 + (SELECT count(*) FROM two t WHERE t.case_id = c1.case_id) AS n2 FROM c1),
    kn2 AS (SELECT * FROM kn1 UNION SELECT case_id, maker, model FROM two),
    x3 AS (SELECT y.*, row_number() OVER (PARTITION BY case_id ORDER BY seq, maker, model) AS k FROM (SELECT c2.case_id, c2.n2, s.maker, s.model, s.seq FROM c2 JOIN seeds s
      ON s.category = c2.category WHERE n2 < 3) y ANTI JOIN kn2 USING (case_id, maker, model)),
    three AS (SELECT case_id, maker, model, 10.0::DOUBLE AS base_conf, true AS synthetic, seq FROM x3 WHERE k <= 3-n2),
    pool AS (SELECT case_id, maker, model, base_conf, synthetic, seq, 0 AS turn FROM merged UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three),
    expanded AS (SELECT * FROM (SELECT case_id, maker, model, base_conf, synthetic, row_number() OVER (PARTITION BY case_id ORDER BY base_conf DESC, turn, seq, maker, model) AS rank
      FROM pool) WHERE rank <= 5)"""
)


def expanded(spark, sf):
    seeds, siblings, _ = _tables(spark)
    local, _, _ = _hyp(spark, sf)
    return H.expand_similar(categories(spark, sf), merged(spark, sf), local, siblings, seeds)


@query("expand_similar", EXPANDED_SQL + " SELECT * FROM expanded")
def expand_similar(spark, sf):
    return expanded(spark, sf).drop("category")


_CASE_ROWS = [(c, i, n, w) for c, t in H.COMPONENT_WEIGHTS.items() for i, (n, w) in enumerate(t.items())]
CHECKS_SQL = (
    EXPANDED_SQL
    + f""", cw(category, seq, component, weight) AS (VALUES {_values(_CASE_ROWS, 4)}),
    cand AS (SELECT e.*, k.category, k.category_conf FROM expanded e JOIN categories k USING (case_id)),
    cr AS (SELECT case_id, component, status, confidence FROM (SELECT *, row_number() OVER (PARTITION BY case_id, component
      ORDER BY read_id DESC, confidence DESC, status DESC) AS n FROM component_reads) WHERE n = 1),
    jd AS (SELECT c.case_id, c.maker, c.model, u.seq, u.component, u.weight, u.statuses FROM cand c JOIN rules u ON u.maker = c.maker AND u.model = c.model
      UNION ALL SELECT c.case_id, c.maker, c.model, w.seq, w.component, w.weight, NULL FROM cand c JOIN cw w ON w.category = c.category
        WHERE NOT EXISTS (SELECT 1 FROM rules u WHERE u.maker = c.maker AND u.model = c.model)),
    js AS (SELECT jd.*, coalesce(cr.status, 'indefinido') AS status, coalesce(cr.confidence, 0.0) AS conf FROM jd LEFT JOIN cr ON cr.case_id = jd.case_id AND cr.component = jd.component),
    checks AS (SELECT *, weight*(CASE WHEN statuses IS NOT NULL AND list_contains(statuses, status) THEN least(1.0, greatest(0.3, conf/100.0))
        WHEN starts_with(status, 'limitado_vista') THEN 0.45 WHEN statuses IS NOT NULL AND status IN ('sinal_fraco', 'linha_parcial', 'fraca', 'parcial') THEN 0.35
        WHEN statuses IS NOT NULL THEN 0 WHEN status NOT IN ('indefinido', 'nao_detectado', 'nao_detectada', 'ausente') THEN least(1.0, greatest(0.28, conf/100.0))
        WHEN conf >= 36 THEN 0.22 ELSE 0 END)::DOUBLE AS points,
      CASE WHEN starts_with(status, 'limitado_vista') THEN 'limited' WHEN CASE WHEN statuses IS NOT NULL THEN list_contains(statuses, status) AND conf >= 42
        ELSE status NOT IN ('indefinido', 'nao_detectado', 'nao_detectada', 'ausente') AND conf >= 40 END THEN 'match' ELSE 'mismatch' END AS verdict FROM js),
    align AS (SELECT case_id, maker, model, {r(xsum('points') + '/' + xsum('weight') + '*100.0', 2)} AS component_conf FROM checks GROUP BY ALL),
    vr AS (SELECT *, row_number() OVER (PARTITION BY case_id, maker, model, verdict ORDER BY seq) AS n FROM checks),
    lists AS (SELECT case_id, maker, model, {', '.join(f"coalesce(string_agg(CASE WHEN verdict = '{v}' AND n <= {k} THEN component || ':' || status END, ',' ORDER BY seq), '') AS {a}" for v, k, a in (('match', 8, 'matches'), ('mismatch', 8, 'mismatches'), ('limited', 6, 'limited')))},
      count(*) FILTER (verdict = 'mismatch') AS mismatch_count FROM vr GROUP BY ALL)"""
)


def _evaluated(spark, sf):
    _, _, rules = _tables(spark)
    reads = load(spark, sf, "component_reads").repartition("case_id")
    latest = reads.groupBy("case_id", "component").agg(
        F.max_by(F.struct("status", "confidence"), F.struct("read_id", "confidence", "status")).alias("r")
    ).select("case_id", "component", "r.*")
    return H.component_evaluation(H.component_checks(expanded(spark, sf), latest, rules))


@query("component_alignment", CHECKS_SQL + " SELECT * FROM align")
def component_alignment(spark, sf):
    return _evaluated(spark, sf).select("case_id", "maker", "model", "component_conf")


@query("component_matches", CHECKS_SQL + " SELECT * FROM lists")
def component_matches(spark, sf):
    return _evaluated(spark, sf).select("case_id", "maker", "model", "matches", "mismatches", "limited", "mismatch_count")


_OWN_BLEND = "c.base_conf*0.56 + coalesce(a.component_conf, 0.0)*0.44"
_WEB_BLEND = """c.base_conf*0.34::DOUBLE + coalesce(a.component_conf, 0.0)*0.33::DOUBLE + coalesce(web_score, 0)*0.33::DOUBLE
  + coalesce(confirmation_count, 0)*2.0::DOUBLE - coalesce(conflict_count, 0)*2.2::DOUBLE"""
_WEB_ANSWERS = [
    "case_id",
    "maker",
    "model",
    "CAST(length(model)*7%100 AS DOUBLE) AS web_score",
    "CAST(length(concat(maker, model))%4 AS BIGINT) AS confirmation_count",
    "CAST(length(model)%3 AS BIGINT) AS conflict_count",
]


def _final_sql(blend: str, web: str = "(SELECT NULL::BIGINT AS case_id, '' AS maker, '' AS model, 0 AS confirmation_count, 0 AS conflict_count)") -> str:
    return CHECKS_SQL + f""", web AS (SELECT * FROM {web}), fr AS (SELECT c.case_id, c.maker, c.model, c.synthetic, c.category_conf, l.mismatch_count,
      coalesce(confirmation_count, 0) AS confirmation_count, coalesce(conflict_count, 0) AS conflict_count,
      {r('greatest(0.0, least(99.0, ' + blend + ' + ' + r('least(4.8, greatest(0.6, c.category_conf/22.0))', 2) +
      ''' - (CASE WHEN l.mismatch_count >= 3 THEN 5.0 ELSE 0.0 END) - (CASE WHEN c.synthetic THEN 10.0 ELSE 0.0 END)))''', 2)} AS final_conf
      FROM cand c LEFT JOIN align a USING (case_id, maker, model) LEFT JOIN lists l USING (case_id, maker, model)
      LEFT JOIN web USING (case_id, maker, model)),
    fk AS (SELECT *, row_number() OVER w AS rank, lead(final_conf) OVER w AS next_conf FROM fr WINDOW w AS (PARTITION BY case_id ORDER BY final_conf DESC, maker, model))"""


FINAL_SQL = _final_sql(_OWN_BLEND)
WEB_FINAL_SQL = _final_sql(_WEB_BLEND, f"(SELECT {', '.join(_WEB_ANSWERS)} FROM cand WHERE length(model)%5 <> 0)")


def _final(spark, sf):
    return H.final_candidate_rank(_evaluated(spark, sf), categories(spark, sf))


def _final_with_web(spark, sf):
    """As if the web had been asked about the candidates; about some of them it is silent."""
    columns = ["case_id", "maker", "model", "category", "base_conf", "synthetic", "component_conf", "mismatch_count"]
    evaluated = stash(_evaluated(spark, sf).select(*columns), "evaluated")
    answers = evaluated.where("length(model)%5 <> 0").selectExpr(*_WEB_ANSWERS)
    return H.final_candidate_rank(evaluated, categories(spark, sf), answers)


_VERDICT = (
    f""" SELECT case_id, maker, model, final_conf, {r('coalesce(final_conf-next_conf, 99.0)', 2)} AS gap,
    CASE WHEN final_conf < 80 OR coalesce(final_conf-next_conf, 99.0) < 6 OR category_conf < 52 THEN 'incerto' ELSE 'ok' END AS status FROM fk WHERE rank = 1"""
)


@query("final_candidate_rank", FINAL_SQL + _VERDICT)
def final_candidate_rank(spark, sf):
    return H.case_verdict(_final(spark, sf))


@query("final_candidate_rank_web", WEB_FINAL_SQL + _VERDICT)
def final_candidate_rank_web(spark, sf):
    return H.case_verdict(_final_with_web(spark, sf))


_REASONS = (
    """, b AS (SELECT case_id, final_conf AS best, confirmation_count AS hits FROM fk WHERE rank = 1), d AS (SELECT k.*, b.best, b.hits, concat_ws(',',
      CASE WHEN final_conf <= best-6 THEN 'confianca_global_inferior_ao_melhor_candidato' END,
      CASE WHEN mismatch_count > 0 THEN 'divergencia_de_componentes_visuais' END,
      CASE WHEN k.confirmation_count < hits THEN 'menos_confirmacoes_independentes' END,
      CASE WHEN k.conflict_count > 0 THEN 'conflito_com_modelos_semelhantes' END,
      CASE WHEN synthetic THEN 'candidato_expandido_por_semelhanca_sem_confirmacao_suficiente' END) AS rs FROM fk k JOIN b USING (case_id) WHERE rank BETWEEN 2 AND 6)
    SELECT case_id, maker, model, rank, final_conf, CASE WHEN rs = '' AND final_conf < 55 THEN 'baixo_desempenho_no_ranqueamento_cruzado' ELSE rs END AS reasons FROM d"""
)


@query("discarded_reasons", FINAL_SQL + _REASONS)
def discarded_reasons(spark, sf):
    return H.discarded_reasons(_final(spark, sf))


@query("discarded_reasons_web", WEB_FINAL_SQL + _REASONS)
def discarded_reasons_web(spark, sf):
    return H.discarded_reasons(_final_with_web(spark, sf))


# -- web evidence ------------------------------------------------------------------------------

_TRUST = {"example.org": 3.1, "example.com": 2.0}
_HINTS = ["geral", "farois_dianteiros", "grade_dianteira", "tanque_carenagem", "cabine"]


def _trust_sql(domain: str) -> str:
    table = {d: W.BRAND_TRUST for d in W.BRAND_DOMAINS} | W.SPECIALIST_DOMAINS | _TRUST
    whens = " ".join(f"WHEN {domain} = '{d}' OR ends_with({domain}, '.{d}') THEN {w}" for d, w in table.items())
    return f"(CASE {whens} WHEN contains({domain}, 'forum') OR contains({domain}, 'club') THEN 2.8 ELSE 0 END)::DOUBLE"


_PAGES_SQL = f"""WITH p0 AS (SELECT page_id, trim(url) AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    regexp_replace(html, '<[^>]*>', ' ', 'g') AS snippet,
    ['geral', 'farois_dianteiros', 'grade_dianteira', 'tanque_carenagem', 'cabine'][1+page_id%5] AS component_hint FROM pages),
  p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM p0) WHERE n = 1),
  p2 AS (SELECT *, {_HOST} AS domain FROM p1), p3 AS (SELECT *, {_trust_sql('domain')} AS trust FROM p2),
  kept AS (SELECT * FROM p3 WHERE trust > 0 OR {' OR '.join(f"contains({_NORM_UPPER.format(chr(116) + 'itle || chr(32) || snippet')}, '{w}')" for w in W.SPECIALIST_WORDS)})"""


def _pages(spark, sf):
    hints = F.array(*[F.lit(h) for h in _HINTS])
    return read(spark, sf, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_replace("html", "<[^>]*>", " ").alias("snippet"),
        F.get(hints, (F.col("page_id") % 5).cast("int")).alias("component_hint"),
    )


def kept_pages(spark, sf):
    return W.page_dedupe_and_filter(_pages(spark, sf), _TRUST)


@query("page_dedupe_and_filter", _PAGES_SQL + " SELECT page_id, url, domain, trust, component_hint FROM kept")
def page_dedupe_and_filter(spark, sf):
    return kept_pages(spark, sf).select("page_id", "url", "domain", "trust", "component_hint")


_WEB_SQL = (
    _PAGES_SQL
    + f""", tt AS (SELECT page_id, {_NORM_UPPER.format('title')} AS t FROM p0),
    wc AS (SELECT maker, model, min(page_id) AS candidate_id FROM (SELECT page_id, split_part(t, ' ', 1) AS maker, split_part(t, ' ', 2) AS model FROM tt
      WHERE length(split_part(t, ' ', 1)) > 1 AND length(split_part(t, ' ', 2)) > 1) GROUP BY maker, model),
    wn AS (SELECT *, CASE WHEN candidate_id%2=0 THEN '2000-' || (2005+candidate_id%20) ELSE '' END AS year_hint,
      CASE candidate_id%3 WHEN 0 THEN 'AUTOMOVEL' WHEN 1 THEN 'MOTOCICLETA' ELSE 'CAMINHAO' END AS category FROM wc),
    tx AS (SELECT page_id, domain, trust, component_hint, {_NORM_UPPER.format("(title || ' ' || snippet || ' ' || url)")} AS text FROM kept),
    pr AS (SELECT w.*, t.* FROM wn w, tx t),
    sp AS (SELECT candidate_id, maker, model, category, page_id, domain, text, {r('''trust + (CASE WHEN contains(text, maker) THEN 4 ELSE 0 END)::DOUBLE +
      (CASE WHEN contains(text, model) THEN 6 ELSE 0 END)::DOUBLE +
      len(list_filter(string_split(CASE component_hint WHEN 'farois_dianteiros' THEN 'FAROL DIANTEIRO ASSINATURA OPTICA' WHEN 'grade_dianteira' THEN 'GRADE DIANTEIRA DESENHO FRONTAL'
        WHEN 'tanque_carenagem' THEN CASE WHEN category = 'MOTOCICLETA' THEN 'TANQUE CARENAGEM LATERAL MOTO' ELSE '' END
        WHEN 'cabine' THEN CASE WHEN category = 'CAMINHAO' THEN 'CABINE FRONTAL CAMINHAO DESENHO' ELSE '' END ELSE '' END, ' '),
        lambda x: x <> '' AND contains(text, x)))*0.8::DOUBLE + (CASE WHEN year_hint <> '' AND len(list_filter(regexp_extract_all(text, '(19\\d{2}|20\\d{2})', 1),
        lambda y: y::INT >= 2000 AND y::INT <= split_part(year_hint, '-', 2)::INT)) > 0 THEN 1.6 ELSE 0 END)::DOUBLE''', 3)} AS score FROM pr),
    sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, page_id) AS rank FROM sp) WHERE rank <= 14)"""
)


def _web_candidates(spark, sf):
    from vestigo.functions.text import norm_upper

    words = F.split(norm_upper(F.col("title")), " ")
    named = _pages(spark, sf).select("page_id", F.get(words, F.lit(0)).alias("maker"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("model"))
    unique = (
        named.where((F.length("maker") > 1) & (F.length("model") > 1)).groupBy("maker", "model").agg(F.min("page_id").alias("candidate_id"))
    )
    c = F.col("candidate_id")
    return unique.select(
        "candidate_id",
        "maker",
        "model",
        F.when(c % 2 == 0, F.concat(F.lit("2000-"), (2005 + c % 20).cast("string"))).otherwise("").alias("year_hint"),
        F.when(c % 3 == 0, "AUTOMOVEL").when(c % 3 == 1, "MOTOCICLETA").otherwise("CAMINHAO").alias("category"),
    )


@query("score_pages", _WEB_SQL + " SELECT candidate_id, maker, model, page_id, domain, score, rank FROM sr")
def score_pages(spark, sf):
    return W.score_pages(_web_candidates(spark, sf), kept_pages(spark, sf)).drop("text")


_TOPICAL = "(CASE category " + " ".join(
    f"WHEN '{c}' THEN {' OR '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in words)}" for c, words in W.CATEGORY_WORDS.items()
) + " END)"


@query(
    "web_confirmation",
    _WEB_SQL
    + f""", tp AS (SELECT *, {_TOPICAL} AS topical, contains(text, maker) AS hm, contains(text, model) AS ho,
      EXISTS (SELECT 1 FROM wn o WHERE o.maker = sr.maker AND o.model <> sr.model AND contains(sr.text, o.model)) AS rival FROM sr),
    ps AS (SELECT *, score + CASE WHEN topical THEN 0.8::DOUBLE ELSE 0 END AS page FROM tp WHERE domain <> ''),
    bd AS (SELECT candidate_id, domain, max(CASE WHEN hm AND ho AND page >= 7.2 THEN page END) AS confirm,
      max(CASE WHEN hm AND NOT ho AND rival AND page >= 7.0 THEN page END) AS conflict, count(*) FILTER (topical) AS topical FROM ps GROUP BY ALL),
    rl AS (SELECT candidate_id, count(confirm) AS n, count(conflict) AS c, coalesce({xsum('confirm')}/count(confirm), 0) AS nm, coalesce({xsum('conflict')}/count(conflict), 0) AS cm,
      sum(topical) AS t, coalesce(string_agg(CASE WHEN confirm IS NOT NULL THEN domain END, ',' ORDER BY domain), '') AS domains FROM bd GROUP BY candidate_id),
    z AS (SELECT wn.candidate_id, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(nm, 0) AS nm, coalesce(cm, 0) AS cm, coalesce(t, 0) AS t, coalesce(domains, '') AS domains
      FROM wn LEFT JOIN rl ON rl.candidate_id = wn.candidate_id)
    SELECT candidate_id, {r('greatest(0.0, least(99.0, n*16.0::DOUBLE + nm*5.2::DOUBLE + least(4, t)*2.2::DOUBLE - (c*9.5::DOUBLE + cm*2.8::DOUBLE)))', 2)} AS web_score,
      n AS confirmation_count, c AS conflict_count, t::BIGINT AS category_support, domains AS confirmation_domains,
      concat_ws(',', CASE WHEN n = 0 THEN 'sem_confirmacao_independente_em_fontes_abertas' END, CASE WHEN c > 0 THEN 'fontes_apontam_modelos_semelhantes_em_conflito' END,
        CASE WHEN t = 0 THEN 'fontes_sem_contexto_claro_de_categoria_veicular' END) AS reasons FROM z""",
)
def web_confirmation(spark, sf):
    candidates = _web_candidates(spark, sf)
    return W.web_confirmation(candidates, W.score_pages(candidates, kept_pages(spark, sf)))
