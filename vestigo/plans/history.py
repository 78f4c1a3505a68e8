"""History, provider, webhook and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.functions.text import ACCENTED, PLAIN, host_of
from vestigo.operators import history as H, providers as V, webhooks as K
from vestigo.plans.derived import add, load, read, with_tables
from vestigo.plans.registry import query, r, xsum

_PLATE = "'CAR' || lpad(CAST(o_custkey%200 AS STRING),4,'0')"
add(
    "case_history",
    "orders",
    [
        "o_orderkey AS id",
        "o_custkey AS user_id",
        "'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS filename",
        "CASE WHEN o_orderkey%17=0 THEN '{broken' ELSE '{\"best\": {\"text\": \"' || CASE WHEN o_orderkey%5=0 THEN "
        f"'ZZZ0000' ELSE {_PLATE} END || '\", \"engine\": \"' || CASE WHEN o_orderkey%3=0 THEN 'engine_a' WHEN o_orderkey%3=1 "
        "THEN 'engine_n' ELSE '' END || '\", \"pattern\": \"' || CASE WHEN o_orderkey%4=0 THEN '' WHEN o_orderkey%4=1 THEN "
        "'Antiga (cinza)' ELSE 'Mercosul' END || '\", \"avg_conf\": ' || CAST(o_orderkey%100 AS STRING) || "
        "'}, \"forensic\": {\"analysis_id\": \"a' || CAST(o_orderkey AS STRING) || '\"}}' END AS ocr",
        "CASE WHEN o_orderkey%7=0 THEN '{\"padrao_placa\": \"Antiga (cinza)\"}' WHEN o_orderkey%7=1 THEN "
        "'{\"detected_pattern\": \"Mercosul\"}' ELSE '' END AS color_info",
        "o_orderdate AS case_time",
    ],
)
add("history_targets", "customer", ["c_custkey AS user_id", "'CAR' || lpad(CAST(c_custkey%200 AS STRING),4,'0') AS plate"])
add(
    "provider_answers",
    "lineitem",
    [
        "l_partkey AS plate_no",
        "(CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS sub_id",
        "l_orderkey",
        "CASE WHEN l_suppkey%6=0 THEN 'consulta.gov.br' WHEN l_suppkey%6=1 THEN 'api.sinesp.net' WHEN l_suppkey%6=2 "
        "THEN 'fipe.parallelum.com.br' WHEN l_suppkey%6=3 THEN 'www.denatran.org' ELSE 'provider' || "
        "CAST(l_suppkey%20 AS STRING) || '.com' END AS host",
        "'PRT' || lpad(CAST(l_partkey%10000 AS STRING),4,'0') AS plate",
        "CASE WHEN l_returnflag='A' THEN '{\"license_plate\": \"PRT' || lpad(CAST(l_partkey%10000 AS STRING),4,'0') || "
        "'\", \"make\": \"Fiát\", \"model\": \"Uno ' || CAST(l_partkey%3 AS STRING) || '\", \"year\": ' || "
        "CAST(2000+l_linenumber AS STRING) || ', \"color\": \"\"}' "
        "WHEN l_returnflag='N' THEN '{\"vehicle\": {\"placa\": \"prt-' || lpad(CAST(l_partkey%10000 AS STRING),4,'0') || "
        "'\", \"marca\": \"FIAT\", \"modelo\": \"UNO ' || CAST(l_suppkey%2 AS STRING) || '\", \"ano_modelo\": \"' || "
        "CAST(2000+l_linenumber%3 AS STRING) || '\", \"corPredominante\": \"Vermelha\", \"chassi\": \"9BW ' || "
        "CAST(l_orderkey AS STRING) || '\"}, \"owner\": {\"nome_proprietario\": \"P' || CAST(l_suppkey AS STRING) || "
        "'\", \"documento\": \"123\"}, \"uf\": \"SP\"}' "
        "ELSE '{\"placa\": \"' || CASE WHEN l_suppkey%5=0 THEN 'XXX9999' ELSE '' END || '\", \"brand\": \"Ford\", "
        "\"veiculo\": {\"marca_modelo\": \"FORD/KA\", \"municipio\": \"Campinas\", \"renavam\": \"' || "
        "CAST(l_partkey AS STRING) || '\"}, \"source\": \"base\"}' END AS payload",
        "CASE WHEN l_suppkey%9=0 THEN 'pending_async' ELSE '' END AS lookup_state",
    ],
    ["plate", "l_orderkey || '-' || CAST(sub_id AS STRING) AS record_id", "host", "payload", "lookup_state"],
)
add(
    "webhook_bodies",
    "events",
    [
        "event_id AS arrival",
        "ts AS event_time",
        "CASE WHEN event_type='click' THEN '{\"event\": \"vehicle_debt_found\", \"request_id\": \"r' || CAST(event_id%700 AS STRING) "
        "|| '\", \"data\": {\"vehicle\": {\"license_plate\": \"usr-' || lpad(CAST(user_id AS STRING),4,'0') || '\", \"make\": \"VW\"}, "
        "\"debts\": [{\"name\": \"IPVA\", \"amount\": \"' || CAST(event_id%50 AS STRING) || '\"}, {\"description\": \"Multa\"}, "
        "{\"type\": \"\"}]}}' "
        "WHEN event_type='view' THEN '{\"status\": \"pending_async\", \"data\": {\"event\": \"vehicle_debt_requested\", "
        "\"requestId\": \"r' || CAST(event_id%900 AS STRING) || '\", \"placa\": \"USR' || lpad(CAST(user_id AS STRING),4,'0') || '\"}}' "
        "WHEN event_type='error' THEN '{\"event\": \"\", \"status\": \"error\", \"detail\": \" search  failed \", \"plate\": \"USR' || "
        "lpad(CAST(user_id AS STRING),4,'0') || '\", \"webhook\": {\"id\": \"w' || CAST(event_id%10 AS STRING) || '\", \"version\": \"v3\"}}' "
        "ELSE '{\"event\": \"' || event_type || '\", \"plate_number\": \"' || CASE WHEN user_id%10=0 THEN '' ELSE 'USR' || "
        "lpad(CAST(user_id AS STRING),4,'0') END || '\"}' END AS payload",
    ],
)
add(
    "reviews",
    "orders",
    [
        "o_orderkey AS case_id",
        "CASE WHEN o_orderkey%3=0 THEN 'engine_a' WHEN o_orderkey%3=1 THEN 'engine_n' ELSE 'ensemble' END AS engine",
        "CASE WHEN o_custkey%6=0 THEN ' Confirmado ' WHEN o_custkey%6=1 THEN 'corrigido' WHEN o_custkey%6=2 THEN 'sem_candidato' "
        "WHEN o_custkey%6=3 THEN 'nao_conclusivo' ELSE 'other' END AS decision",
        "CASE WHEN o_orderkey%4=0 THEN '' ELSE 'abc-' || lpad(CAST(o_orderkey%10000 AS STRING),4,'0') END AS confirmed_text",
        "'ABC' || lpad(CAST(o_custkey%10000 AS STRING),4,'0') AS selected_text",
        "'sha' || CAST(o_orderkey AS STRING) AS sha",
        "'IMG_' || CAST(o_custkey AS STRING) || '.jpg' AS photo",
        "'IMG_' || CAST(o_custkey AS STRING) AS stem",
    ],
)

_BEST = "(CASE WHEN json_valid(ocr) THEN json_extract_string(ocr, '$.best.{0}') END)"
_HISTORY_SQL = (
    with_tables("case_history", "history_targets")
    + f""", p AS (SELECT id, user_id, filename, case_time, coalesce({_BEST.format('text')}, '') AS plate, coalesce({_BEST.format('engine')}, '') AS engine,
      coalesce(CAST({_BEST.format('avg_conf')} AS DOUBLE), 0.0) AS avg_conf,
      coalesce(CASE WHEN json_valid(ocr) THEN json_extract_string(ocr, '$.forensic.analysis_id') END, '') AS analysis_id FROM case_history),
    m AS (SELECT p.*, row_number() OVER (PARTITION BY p.user_id, p.plate ORDER BY case_time DESC, id DESC) AS rank
      FROM p JOIN history_targets t ON t.user_id = p.user_id AND t.plate = p.plate),
    hits AS (SELECT * FROM m WHERE rank <= 20)"""
)


def _history(spark, sf):
    return H.history_by_plate(load(spark, sf, "case_history"), load(spark, sf, "history_targets"))


def _seconds(df, name):
    return df.withColumn(name, F.coalesce(F.col(name).cast("timestamp").cast("bigint"), F.lit(-1).cast("bigint")))


@query(
    "history_by_plate",
    _HISTORY_SQL + " SELECT * REPLACE (epoch_us(case_time)//1000000 AS case_time) FROM hits",
)
def history_by_plate(spark, sf):
    return _seconds(_history(spark, sf), "case_time")


@query(
    "history_cross_check",
    _HISTORY_SQL
    + f""" SELECT t.user_id, t.plate, CASE WHEN count(h.id) = 0 THEN 'sem_historico' ELSE 'ok' END AS status,
    count(h.id) AS previous_occurrences, coalesce(max(epoch_us(h.case_time)//1000000), -1) AS last_seen,
    coalesce(string_agg(DISTINCT nullif(h.engine, ''), ',' ORDER BY nullif(h.engine, '')), '') AS engines_seen,
    coalesce({r(xsum('h.avg_conf') + '/count(h.id)', 2)}, 0.0) AS historical_avg_confidence
    FROM history_targets t LEFT JOIN hits h ON h.user_id = t.user_id AND h.plate = t.plate GROUP BY t.user_id, t.plate""",
)
def history_cross_check(spark, sf):
    return _seconds(H.history_cross_check(load(spark, sf, "history_targets"), _history(spark, sf)), "last_seen")


@query(
    "history_pattern",
    with_tables("case_history")
    + f""", p AS (SELECT id, coalesce(nullif(trim({_BEST.format('pattern')}), ''), CASE WHEN json_valid(color_info) THEN
      coalesce(json_extract_string(color_info, '$.padrao_placa'), json_extract_string(color_info, '$.detected_pattern')) END, 'Indefinido') AS raw
      FROM case_history) SELECT id, CASE WHEN raw = 'Antiga (cinza)' THEN 'Antigo' ELSE raw END AS pattern FROM p""",
)
def history_pattern(spark, sf):
    return H.history_pattern(load(spark, sf, "case_history"))


# -- provider records --------------------------------------------------------------------------


def _alias_sql(name: str) -> str:
    paths = [
        f"json_extract_string(payload, '$.{prefix}{a}')"
        for a in V.ALIASES[name]
        for prefix in [*(f"{n}." for n in reversed(V.NESTED)), ""]
    ]
    value = f"nullif(coalesce({', '.join(paths)}), '')"
    return f"coalesce({value}, 'provedor_externo')" if name == "fonte" else value


def _kind_sql() -> str:
    return "CASE " + " ".join(f"WHEN contains(host, '{p}') THEN '{k}'" for p, k in V.HOST_KINDS) + " ELSE 'external_provider' END"


def _trust_sql(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.TRUST.items()) + " END::DOUBLE"


_UNIFIED_SQL = (
    with_tables("provider_answers")
    + f""", wide0 AS (SELECT plate, record_id, host, lookup_state, {_kind_sql()} AS source_kind,
      {', '.join(f'{_alias_sql(n)} AS {n}' for n in V.ALIASES)} FROM provider_answers),
    wide AS (SELECT *, {_trust_sql('source_kind')} AS trust_weight FROM wide0)"""
)


def _mask_sql(name: str) -> str:
    tail = V.MASKS[name]
    if tail == 0:
        return f"CASE WHEN {name} IS NOT NULL THEN '[restrito]' END AS {name}"
    c = f"regexp_replace({name}, '\\s+', '', 'g')"
    return f"CASE WHEN length({c}) <= {tail} THEN repeat('*', length({c})) ELSE repeat('*', length({c})-{tail}) || right({c}, {tail}) END AS {name}"


def _wide(spark, sf, masked):
    return V.unify_provider_records(load(spark, sf, "provider_answers"), masked=masked)


_SHOWN = ["placa", "fabricante", "marca_modelo", "modelo", "ano", "cor", "uf", "cidade", "municipio", "fonte"]


@query(
    "unify_provider_records",
    _UNIFIED_SQL + f" SELECT record_id, source_kind, trust_weight, {', '.join(_SHOWN)} FROM wide",
)
def unify_provider_records(spark, sf):
    return _wide(spark, sf, True).select("record_id", "source_kind", "trust_weight", *_SHOWN)


@query("mask_sensitive", _UNIFIED_SQL + f" SELECT record_id, {', '.join(_mask_sql(n) for n in V.MASKS)} FROM wide")
def mask_sensitive(spark, sf):
    return _wide(spark, sf, True).select("record_id", *V.MASKS)


def _found_sql(names, negate=False):
    test = "IS NULL" if negate else "IS NOT NULL"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {n} {test} THEN '{n}' END" for n in names) + ")"


def _count_sql(names):
    return "(" + " + ".join(f"(CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END)" for n in names) + ")"


_OFFICIAL_SQL = (
    _UNIFIED_SQL
    + f""", ok AS (SELECT *, starts_with(source_kind, 'official_') AS is_official, {_count_sql(V.BASIC)} AS public_count,
      {_count_sql(V.SENSITIVE)} AS sensitive_count, host AS source_label FROM wide)"""
)


@query(
    "official_validation",
    _OFFICIAL_SQL
    + f""" SELECT record_id, CASE WHEN lookup_state = 'pending_async' THEN 'pendente_webhook' WHEN is_official THEN 'ok'
      ELSE 'sem_validacao_oficial' END AS status, is_official, {_found_sql(V.BASIC)} AS public_found,
      {_found_sql(V.BASIC, True)} AS public_missing, {_found_sql(V.SENSITIVE)} AS sensitive_found,
      concat_ws(',', CASE WHEN NOT is_official THEN 'fonte_nao_classificada_como_oficial' END,
        CASE WHEN lookup_state = 'pending_async' THEN 'consulta_assincrona_pendente' END,
        CASE WHEN chassi IS NOT NULL THEN 'chassi_detectado_em_fluxo_restrito' END,
        CASE WHEN proprietario IS NOT NULL OR cpf_cnpj IS NOT NULL THEN 'dados_pessoais_detectados' END,
        CASE WHEN public_count = 0 THEN 'campos_publicos_incompletos' END) AS notes FROM ok""",
)
def official_validation(spark, sf):
    v = V.official_validation(_wide(spark, sf, True))
    arrays = ("public_found", "public_missing", "sensitive_found", "notes")
    return v.select("record_id", "status", "is_official", *[F.concat_ws(",", a).alias(a) for a in arrays])


_NORM_UPPER = f"trim(regexp_replace(upper(replace(translate({{0}}, '{ACCENTED}', '{PLAIN}'), 'ß', 'ss')), '[^A-Z0-9]+', ' ', 'g'))"
_OWN = "regexp_replace(upper(coalesce(placa, '')), '[^A-Z0-9]', '', 'g')"
_SCORE_SQL = (
    _OFFICIAL_SQL
    + f""", sc0 AS (SELECT *, {r('trust_weight*28.0', 1)} + least(36.0::DOUBLE, public_count*4.5) + least(12.0::DOUBLE, sensitive_count*2.0)
      + (CASE WHEN fabricante IS NOT NULL AND modelo IS NOT NULL THEN 7 ELSE 0 END) + (CASE WHEN ano IS NOT NULL THEN 4 ELSE 0 END)
      + (CASE WHEN cor IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN uf IS NOT NULL OR cidade IS NOT NULL OR municipio IS NOT NULL THEN 3 ELSE 0 END)
      + (CASE WHEN is_official THEN 18 ELSE 0 END) + (CASE WHEN public_count >= 5 THEN 3 ELSE 0 END)
      + (CASE WHEN is_official AND sensitive_count > 0 THEN 2 ELSE 0 END)
      + (CASE WHEN {_OWN} = '' THEN -8 WHEN {_OWN} = plate THEN 8 ELSE -25 END) AS raw FROM ok),
    sc AS (SELECT *, {r('greatest(0.0, least(100.0, raw))', 1)} AS lookup_score FROM sc0)"""
)
_FIELDS = [f for f in V.VOTED if f in V.ALIASES]
_PUBLIC_FIELDS = [f for f in _FIELDS if f not in V.SENSITIVE]


def _scored(spark, sf):
    wide = _wide(spark, sf, False)
    return V.score_records(V.official_validation(wide)).withColumn("source_label", F.col("host"))


@query("score_records", _SCORE_SQL + " SELECT record_id, lookup_score FROM sc")
def score_records(spark, sf):
    return _scored(spark, sf).select("record_id", "lookup_score")


@query(
    "provider_consensus",
    _SCORE_SQL
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY lookup_score DESC, is_official DESC, public_count DESC,
      sensitive_count DESC, source_label, record_id) AS pos, greatest(1.0::DOUBLE, lookup_score/20.0) AS w FROM sc),
    u AS (UNPIVOT (SELECT plate, pos, w, lookup_score, {', '.join(_FIELDS)} FROM o) ON {', '.join(_FIELDS)} INTO NAME field VALUE value),
    n AS (SELECT *, {_NORM_UPPER.format('trim(value)')} AS norm FROM u),
    v AS (SELECT plate, field, norm, count(*) AS n, {xsum('w')} AS weight, max(lookup_score) AS top,
      arg_max(trim(value), lookup_score*1e6+pos) AS value, min(pos) AS first FROM n WHERE norm <> '' GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY plate, field ORDER BY weight DESC, n DESC, top DESC, first) AS place,
      count(*) OVER (PARTITION BY plate, field) AS vals, CAST(sum(CAST(weight AS DECIMAL(28,12))) OVER (PARTITION BY plate, field) AS DOUBLE) AS total FROM v),
    det AS (SELECT plate, field, string_agg(value || 'x' || n, ' | ' ORDER BY place) AS detail FROM k WHERE place <= 4 GROUP BY ALL),
    f AS (SELECT k.plate, k.field, k.value, vals = 1 OR n > 1 AS listed, vals = 1 OR n > 1 OR weight/total >= 0.66 AS agreed, vals > 1 AS split,
      det.detail, list_position({_FIELDS}, k.field) AS fp FROM k JOIN det ON det.plate = k.plate AND det.field = k.field WHERE place = 1),
    g AS (SELECT plate, count(*) AS fc, count(*) FILTER (agreed) AS ag, coalesce(string_agg(CASE WHEN listed THEN field END, ',' ORDER BY fp), '') AS consensus_fields,
      coalesce(string_agg(CASE WHEN split THEN field END, ',' ORDER BY fp), '') AS divergent_fields,
      coalesce(string_agg(CASE WHEN split THEN field || ': ' || detail END, '; ' ORDER BY fp), '') AS divergent_details,
      {', '.join(f"max(CASE WHEN field = '{x}' THEN value END) AS w_{x}" for x in _PUBLIC_FIELDS)} FROM f GROUP BY plate),
    c AS (SELECT plate, count(*) AS candidates_count, count(DISTINCT CASE WHEN is_official THEN source_label END) AS official_candidates FROM o GROUP BY plate),
    z AS (SELECT b.*, c.candidates_count, c.official_candidates, g.* EXCLUDE (plate), {r('ag/fc*100.0', 1)} AS consensus_ratio
      FROM o b JOIN c ON c.plate = b.plate LEFT JOIN g ON g.plate = b.plate WHERE b.pos = 1)
    SELECT plate, CASE WHEN candidates_count > 1 THEN 'multifonte' ELSE 'unifonte' END AS status, candidates_count, official_candidates,
      source_label AS best_source_label, source_kind AS best_source_kind, lookup_score AS best_score, consensus_ratio,
      {r('least(100.0, lookup_score*0.7 + consensus_ratio*0.3)', 1)} AS confidence, consensus_fields, divergent_fields, divergent_details,
      {', '.join(f"coalesce({x}, w_{x}, {'plate' if x == 'placa' else chr(39) * 2}) AS {x}" for x in _PUBLIC_FIELDS)} FROM z""",
)
def provider_consensus(spark, sf):
    return V.provider_consensus(_scored(spark, sf))


# -- webhooks ----------------------------------------------------------------------------------


def _j(path: str) -> str:
    return f"json_extract_string(payload, '$.{path}')"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def _norm(c: str) -> str:
    return f"nullif(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '')"


_EVENT_SQL = (
    with_tables("webhook_bodies")
    + f""", e0 AS (SELECT arrival, event_time, {_clean(f"coalesce({_j('event')}, {_j('data.event')}, 'webhook_event')")} AS ev,
      {_clean(f"coalesce({_j('status')}, {_j('data.status')})")} AS st, {_clean(f"coalesce({_j('detail')}, {_j('data.detail')})")} AS detail,
      coalesce({_j('request_id')}, {_j('data.request_id')}, {_j('data.requestId')}, '') AS request_id,
      coalesce({_norm(_j('data.vehicle.license_plate'))}, {_norm(_j('plate'))}, {_norm(_j('plate_number'))}, {_norm(_j('data.placa'))}, '') AS plate,
      coalesce({_j('webhook.id')}, '') AS webhook_id, 'vehicle_debt' AS resource, coalesce({_j('webhook.version')}, 'v2') AS version,
      coalesce(json_array_length(payload, '$.data.debts'), 0)::BIGINT AS debts_count,
      CASE WHEN json_array_length(payload, '$.data.debts') > 0 THEN 'IPVA (' || {_j('data.debts[0].amount')} || ') | Multa' ELSE '' END AS debts_summary
      FROM webhook_bodies),
    e1 AS (SELECT * EXCLUDE (ev, st), CASE WHEN ev = '' THEN 'webhook_event' ELSE ev END AS event,
      CASE WHEN st <> '' THEN st WHEN ev = '' THEN 'webhook_event' ELSE ev END AS status FROM e0),
    ev AS (SELECT *, CASE WHEN request_id <> '' THEN 'request_id:' || request_id ELSE 'fallback:' || plate || '|' || event || '|' ||
      status || '|' || detail END AS event_key FROM e1)"""
)
_EVENT_COLUMNS = [
    "arrival", "event", "status", "detail", "request_id", "plate", "webhook_id", "resource", "version", "event_key", "debts_count", "debts_summary",
]


def webhook_events(spark, sf):
    return K.normalize_webhook(load(spark, sf, "webhook_bodies"))


@query("normalize_webhook", _EVENT_SQL + f" SELECT {', '.join(_EVENT_COLUMNS)} FROM ev")
def normalize_webhook(spark, sf):
    return webhook_events(spark, sf).select(*_EVENT_COLUMNS)


_UPSERT = ["event_key", "arrival", "event", "status", "plate", "debts_summary", "arrivals"]


@query(
    "event_upsert",
    _EVENT_SQL
    + f""", u AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY arrival DESC) AS n,
      count(*) OVER (PARTITION BY event_key) AS arrivals FROM ev) SELECT {', '.join(_UPSERT)} FROM u WHERE n = 1""",
)
def event_upsert(spark, sf):
    return K.event_upsert(webhook_events(spark, sf)).select(*_UPSERT)


@query(
    "recent_events",
    _EVENT_SQL
    + """ SELECT event_key, max(arrival) AS arrival, min(arrival) AS first_arrival FROM ev GROUP BY event_key
    ORDER BY first_arrival DESC LIMIT 250""",
)
def recent_events(spark, sf):
    return K.recent_events(webhook_events(spark, sf)).select("event_key", "arrival", "first_arrival")


@query(
    "latest_by_plate",
    _EVENT_SQL
    + """, l AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY arrival DESC) AS n, count(*) OVER (PARTITION BY plate) AS arrivals
      FROM ev WHERE plate <> ''),
    q AS (SELECT plate, arg_max(request_id, arrival) AS rid FROM ev WHERE request_id <> '' GROUP BY plate)
    SELECT l.plate, event_key, event, status, arrival, coalesce(q.rid, '') AS latest_request_id, arrivals
    FROM l LEFT JOIN q ON q.plate = l.plate WHERE n = 1""",
)
def latest_by_plate(spark, sf):
    return K.latest_by_plate(webhook_events(spark, sf))


HISTORY_SQL = (
    _EVENT_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, o AS (SELECT plate, event_key, arrival, row_number() OVER (PARTITION BY plate ORDER BY arrival) AS rn FROM ev WHERE plate <> ''),
    walk AS (SELECT plate, rn, [{'k': event_key, 'a': arrival}] AS h FROM o WHERE rn = 1
      UNION ALL SELECT o.plate, o.rn, CASE WHEN len(list_filter(w.h, lambda x: x.k = o.event_key)) > 0
        THEN [CASE WHEN x.k = o.event_key THEN {'k': o.event_key, 'a': o.arrival} ELSE x END for x in w.h]
        ELSE list_append(CASE WHEN len(w.h) = 8 THEN w.h[2:] ELSE w.h END, {'k': o.event_key, 'a': o.arrival}) END
      FROM walk w JOIN o ON o.plate = w.plate AND o.rn = w.rn + 1),
    last AS (SELECT plate, arg_max(h, rn) AS h FROM walk GROUP BY plate),
    x AS (SELECT plate, unnest(h) AS e, generate_subscripts(h, 1) AS position FROM last)
    SELECT plate, position, e.k AS event_key, e.a AS arrival FROM x"""
)


@query("plate_history", HISTORY_SQL)
def plate_history(spark, sf):
    return K.plate_history(webhook_events(spark, sf))


@query(
    "recent_activity",
    _EVENT_SQL
    + """, l AS (SELECT * FROM ev ORDER BY event_time DESC, arrival DESC LIMIT 1)
    SELECT plate AS latest_plate, request_id AS latest_request_id, event AS latest_event, lower(status) AS latest_status,
      detail AS latest_detail, epoch_us(event_time)//1000000 AS updated_at, (SELECT count(DISTINCT event_key) FROM ev) AS history_count,
      (SELECT count(DISTINCT plate) FROM ev WHERE plate <> '') AS plate_count FROM l""",
)
def recent_activity(spark, sf):
    return _seconds(K.recent_activity(webhook_events(spark, sf)), "updated_at")


@query(
    "pending_requests",
    _EVENT_SQL
    + """ SELECT arrival, plate, request_id FROM ev q WHERE status = 'pending_async' AND NOT EXISTS (SELECT 1 FROM ev a
    WHERE a.request_id = q.request_id AND a.status <> 'pending_async')""",
)
def pending_requests(spark, sf):
    events = webhook_events(spark, sf)
    waiting = F.col("status") == "pending_async"
    return K.pending_requests(events.where(waiting), events.where(~waiting)).select("arrival", "plate", "request_id")


# -- reviews, sources, status ------------------------------------------------------------------

_REVIEW_SQL = (
    with_tables("reviews")
    + """, d AS (SELECT case_id, engine, sha, photo, stem, CASE lower(trim(decision)) WHEN 'corrigido' THEN 'corrigido_manual'
      WHEN 'sem_candidato' THEN 'inconclusivo' WHEN 'nao_conclusivo' THEN 'inconclusivo' ELSE 'confirmado_manual' END AS decision,
      regexp_replace(upper(confirmed_text), '[^A-Z0-9]', '', 'g') AS typed, selected_text FROM reviews),
    rv AS (SELECT *, CASE WHEN decision = 'inconclusivo' THEN '' WHEN typed = '' THEN selected_text ELSE typed END AS confirmed_text FROM d)"""
)


@query(
    "human_review_outcomes",
    _REVIEW_SQL
    + """, ov AS (SELECT 'sha' || c_custkey AS key, 'OVR' || lpad((c_custkey%10000)::VARCHAR, 4, '0') AS manual_text FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT 'img_' || c_custkey || '.jpg', 'PHO0000' FROM customer WHERE c_acctbal > 9000
      UNION ALL SELECT 'img_' || c_custkey, 'STM0000' FROM customer WHERE c_acctbal > 8000
      UNION ALL SELECT 'ref_' || c_custkey, 'REF0000' FROM customer WHERE c_acctbal BETWEEN 0 AND 8000),
    keyed AS (SELECT case_id, 0 AS turn, sha AS key FROM rv UNION ALL SELECT case_id, 1, lower(photo) FROM rv UNION ALL SELECT case_id, 2, lower(stem) FROM rv),
    hit AS (SELECT case_id, arg_min(key, turn) AS match_key, arg_min(manual_text, turn) AS manual_text FROM keyed JOIN ov USING (key) GROUP BY case_id)
    SELECT rv.case_id, decision, confirmed_text, coalesce(match_key, '') AS match_key, coalesce(manual_text, confirmed_text) AS final_text
    FROM rv LEFT JOIN hit ON hit.case_id = rv.case_id""",
)
def human_review_outcomes(spark, sf):
    customers = read(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    number = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    entry = lambda name, typed: F.struct(name.alias("key"), typed.alias("manual_text"))
    balance = F.col("c_acctbal")
    # Each customer gives at least one entry; some name a picture twice, some no picture at all.
    entries = F.array(
        F.when(balance < 0, entry(F.concat(F.lit("SHA"), key), F.concat(F.lit("OVR"), number))),
        F.when(balance > 9000, entry(F.concat(F.lit("img_"), key, F.lit(".jpg")), F.lit("PHO0000"))),
        F.when(balance > 8000, entry(F.concat(F.lit("img_"), key), F.lit("STM0000"))),
        F.when(balance.between(0, 8000), entry(F.concat(F.lit("ref_"), key), F.lit("REF0000"))),
    )
    overrides = customers.select(F.explode(F.array_compact(entries)).alias("e")).select("e.*")
    done = H.apply_overrides(H.human_reviews(load(spark, sf, "reviews")), overrides, ["sha", "photo", "stem"])
    return done.select("case_id", "decision", "confirmed_text", "match_key", "final_text")


@query(
    "review_rates",
    _REVIEW_SQL
    + f""" SELECT engine, count(*) AS reviews, count(*) FILTER (decision = 'confirmado_manual') AS confirmed,
    count(*) FILTER (decision = 'corrigido_manual') AS corrected, count(*) FILTER (decision = 'inconclusivo') AS inconclusive,
    {r('count(*) FILTER (confirmed_text <> selected_text)/count(*)', 6)} AS changed_rate FROM rv GROUP BY engine""",
)
def review_rates(spark, sf):
    return H.review_rates(H.human_reviews(load(spark, sf, "reviews")))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"
_SOURCES_SQL = f"""WITH s AS (SELECT page_id AS pos, split_part({_HOST}, '.', 1) AS source, split_part(split_part(url, '?', 1), '#', 1) AS url,
  CASE WHEN ends_with({_HOST}, '.org') THEN '' ELSE regexp_extract({_HOST}, '[a-z]+$') END AS family FROM pages),
  d AS (SELECT source, url, pos, family FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY pos) AS n FROM s WHERE trim(url) <> '') WHERE n = 1)"""


def _sources(spark, sf):
    host = host_of(F.col("url"))
    pages = read(spark, sf, "pages").withColumn("host", host)
    return pages.select(
        F.col("page_id").alias("pos"),
        F.substring_index("host", ".", 1).alias("source"),
        F.substring_index(F.substring_index("url", "?", 1), "#", 1).alias("url"),
        F.when(F.col("host").endswith(".org"), "").otherwise(F.regexp_extract("host", "[a-z]+$", 0)).alias("family"),
    )


@query("dedupe_sources", _SOURCES_SQL + " SELECT * FROM d")
def dedupe_sources(spark, sf):
    return H.dedupe_sources(_sources(spark, sf))


@query(
    "source_families",
    _SOURCES_SQL + " SELECT CASE WHEN family = '' THEN 'unknown' ELSE family END AS family, count(*) AS sources FROM d GROUP BY 1",
)
def source_families(spark, sf):
    return H.count_families(H.dedupe_sources(_sources(spark, sf)))


@query(
    "visual_fallback_record",
    f"""WITH answered AS (SELECT DISTINCT l_orderkey FROM lineitem),
    c AS (SELECT o_orderkey AS case_id, CASE WHEN o_custkey%3=0 THEN '' ELSE 'ABC' || lpad((o_custkey%10000)::VARCHAR, 4, '0') END AS plate,
      CASE WHEN o_custkey%7=0 THEN '' ELSE o_orderpriority END AS make, o_orderstatus AS model,
      CASE WHEN o_custkey%2=0 THEN '' ELSE '2010-2014' END AS yr, CASE WHEN o_custkey%5=0 THEN '' ELSE 'prata' END AS colour,
      o_totalprice/5000 AS confidence FROM orders)
    SELECT case_id, CASE WHEN plate = '' THEN 'indisponivel' ELSE plate END AS placa, make AS fabricante, model AS modelo,
      make || ' / ' || model AS marca_modelo, CASE WHEN yr = '' THEN 'estimado_por_heuristica_visual' ELSE yr END AS ano,
      CASE WHEN colour = '' THEN 'indefinida' ELSE colour END AS cor, 'analise_visual_local_heuristica' AS fonte,
      'estimado_fontes_abertas' AS status, format('{{:.1f}}', {r('confidence', 1)}) AS confianca FROM c
    WHERE make <> '' AND confidence >= 35 AND case_id NOT IN (SELECT l_orderkey FROM answered)""",
)
def visual_fallback_record(spark, sf):
    o = read(spark, sf, "orders")
    cust = F.col("o_custkey")
    cases = o.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(cust % 3 == 0, "").otherwise(F.concat(F.lit("abc-"), F.lpad((cust % 10000).cast("string"), 4, "0"))).alias("plate"),
        F.when(cust % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("make"),
        F.col("o_orderstatus").alias("model"),
        F.when(cust % 2 == 0, "").otherwise("2010-2014").alias("year_range"),
        F.when(cust % 5 == 0, "").otherwise("prata").alias("colour"),
        (F.col("o_totalprice") / 5000).alias("confidence"),
    )
    answered = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"))
    return H.visual_fallback_record(cases, answered)


_CLASS = "CASE " + " ".join(
    f"WHEN lower(status) IN ({', '.join(repr(a) for a in aliases)}) THEN '{name}'" for name, aliases in H.STATUS_CLASSES.items()
) + " WHEN status = '' THEN 'Indefinido' ELSE replace(lower(status), '_', ' ') END"


@query("status_rollup", _EVENT_SQL + f" SELECT {_CLASS} AS status_class, count(*) AS events FROM ev GROUP BY 1")
def status_rollup(spark, sf):
    return H.status_rollup(webhook_events(spark, sf))
