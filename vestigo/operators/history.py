"""Case history, human review, evidence sources and status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.functions.numbers import exact_avg, rnd
from vestigo.functions.plates import norm_plate
from vestigo.functions.text import filled
from vestigo.operators.spread import within

HISTORY_LIMIT = 20
MIN_PLATE = 7
VISUAL_FLOOR = 35.0

# Review decisions and their aliases.
DECISIONS = {
    "confirmado": "confirmado_manual",
    "confirmado_manual": "confirmado_manual",
    "corrigido": "corrigido_manual",
    "corrigido_manual": "corrigido_manual",
    "inconclusivo": "inconclusivo",
    "sem_candidato": "inconclusivo",
    "nao_confirmado": "inconclusivo",
    "nao_conclusivo": "inconclusivo",
}
# Raw states by the class they are shown as.
STATUS_CLASSES = {
    "Pendente": ("pending_async", "pendente_webhook", "aguardando_webhook"),
    "Concluido": ("resultado_cache", "cache_hit", "ok", "vehicle_debt_found", "concluido"),
    "Sem retorno": (
        "sem_retorno",
        "nao_disponivel",
        "not_found",
        "vehicle_not_found",
        "vehicle_debt_not_found",
        "sem_historico",
    ),
    "Erro": ("erro", "error", "vehicle_debt_search_error"),
    "Nao configurado": ("nao_configurado",),
}
# Pattern alias and texts of the visual fallback record.
OLD_ALIAS, OLD_PATTERN, NO_PATTERN = "Antiga (cinza)", "Antigo", "Indefinido"
FALLBACK_YEAR = "estimado_por_heuristica_visual"
FALLBACK_COLOUR = "indefinida"
FALLBACK_SOURCE = "analise_visual_local_heuristica"
FALLBACK_STATUS = "estimado_fontes_abertas"

OCR_SCHEMA = "best struct<text:string,engine:string,pattern:string,avg_conf:double>, forensic struct<analysis_id:string>"


def history_by_plate(cases: DataFrame, targets: DataFrame, limit: int | None = HISTORY_LIMIT) -> DataFrame:
    """Earlier cases of the same user with the same best text, newest first, for all targets at once.

    `cases`: id, user_id, filename, ocr (JSON), case_time. `targets`: user_id, plate.
    """
    parsed = cases.withColumn("o", F.from_json("ocr", OCR_SCHEMA)).select(
        "id",
        "user_id",
        "filename",
        "case_time",
        norm_plate(F.col("o.best.text")).alias("plate"),
        F.coalesce("o.best.engine", F.lit("")).alias("engine"),
        F.coalesce("o.best.avg_conf", F.lit(0.0)).alias("avg_conf"),
        F.coalesce("o.forensic.analysis_id", F.lit("")).alias("analysis_id"),
    )
    wanted = (
        targets.select("user_id", norm_plate(F.col("plate")).alias("plate"))
        .where(F.length("plate") >= MIN_PLATE)
        .distinct()
    )
    newest = Window.partitionBy("user_id", "plate").orderBy(F.col("case_time").desc(), F.col("id").desc())
    return (
        parsed.join(wanted, ["user_id", "plate"])
        .withColumn("rank", F.row_number().over(newest).cast("bigint"))
        .where(within(F.col("rank"), limit))
    )


def history_cross_check(targets: DataFrame, matches: DataFrame) -> DataFrame:
    """Per target: earlier occurrences, last one, engines, mean confidence; `sem_historico` if none."""
    found = matches.groupBy("user_id", "plate").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("case_time").alias("last_seen"),
        F.array_sort(F.collect_set(F.nullif(F.col("engine"), F.lit("")))).alias("_engines"),
        rnd(exact_avg(F.col("avg_conf")), 2).alias("_conf"),
    )
    return targets.join(found, ["user_id", "plate"], "left").select(
        "user_id",
        "plate",
        F.when(F.col("_n").isNull(), "sem_historico").otherwise("ok").alias("status"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("previous_occurrences"),
        "last_seen",
        F.concat_ws(",", "_engines").alias("engines_seen"),
        F.coalesce("_conf", F.lit(0.0)).alias("historical_avg_confidence"),
    )


def history_pattern(cases: DataFrame) -> DataFrame:
    """Plate pattern of each case: from the read, else from the colour record, else unknown."""
    colour = F.from_json("color_info", "padrao_placa string, detected_pattern string")
    found = cases.withColumn("o", F.from_json("ocr", OCR_SCHEMA)).withColumn("c", colour)
    from_colour = F.trim(F.coalesce("c.padrao_placa", "c.detected_pattern"))
    raw = F.coalesce(filled(F.col("o.best.pattern")), F.nullif(from_colour, F.lit("")), F.lit(NO_PATTERN))
    return found.select("id", F.when(raw == OLD_ALIAS, OLD_PATTERN).otherwise(raw).alias("pattern"))


def _lookup(table: dict[str, str], c: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), default)


def human_reviews(reviews: DataFrame) -> DataFrame:
    """Decision brought to its canonical form and the text it confirms.

    An inconclusive review confirms nothing; a blank text takes the selected candidate.
    """
    decision = _lookup(DECISIONS, F.lower(F.trim(F.coalesce("decision", F.lit("")))), F.lit("confirmado_manual"))
    typed, selected = norm_plate(F.col("confirmed_text")), norm_plate(F.col("selected_text"))
    return (
        reviews.withColumn("decision", decision)
        .withColumn("selected_text", selected)
        .withColumn(
            "confirmed_text",
            F.when(F.col("decision") == "inconclusivo", "").when(typed == "", selected).otherwise(typed),
        )
    )


def apply_overrides(reviews: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Manual texts keyed by digest or file name; the first key listed that has one wins.

    `overrides`: key, manual_text.
    """
    options = F.array(*[F.struct(F.lit(i).alias("turn"), F.lower(F.trim(F.col(k))).alias("key")) for i, k in enumerate(keys)])
    table = overrides.select(F.lower(F.trim("key")).alias("key"), "manual_text")
    hits = (
        reviews.select("case_id", F.explode(options).alias("o"))
        .select("case_id", "o.*")
        .where(F.coalesce("key", F.lit("")) != "")
        .join(table, "key")
        .groupBy("case_id")
        .agg(F.min_by(F.struct("key", "manual_text"), "turn").alias("m"))
    )
    return reviews.join(hits, "case_id", "left").select(
        *[reviews[c] for c in reviews.columns],
        F.coalesce("m.key", F.lit("")).alias("match_key"),
        F.coalesce("m.manual_text", "confirmed_text").alias("final_text"),
    )


def review_rates(reviews: DataFrame) -> DataFrame:
    """How often each engine's selected text was confirmed, corrected or left open."""
    d = F.col("decision")
    n = F.count(F.lit(1))
    return reviews.groupBy("engine").agg(
        n.alias("reviews"),
        F.count_if(d == "confirmado_manual").alias("confirmed"),
        F.count_if(d == "corrigido_manual").alias("corrected"),
        F.count_if(d == "inconclusivo").alias("inconclusive"),
        rnd(F.count_if(F.col("confirmed_text") != F.col("selected_text")) / n, 6).alias("changed_rate"),
    )


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """First entry per (source, url); blank urls go."""
    return (
        sources.where(F.trim("url") != "")
        .groupBy("source", F.trim("url").alias("url"))
        .agg(F.min_by(F.struct("pos", "family"), "pos").alias("_e"))
        .select("source", "url", "_e.*")
    )


def count_families(sources: DataFrame) -> DataFrame:
    family = F.coalesce(F.nullif(F.trim("family"), F.lit("")), F.lit("unknown"))
    return sources.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("sources"))


def visual_fallback_record(cases: DataFrame, providers: DataFrame, floor: float = VISUAL_FLOOR) -> DataFrame:
    """A record from the leading visual hypothesis for cases no provider answered.

    `cases`: case_id, plate, make, model, year_range, colour, confidence. `providers`: case_id.
    """
    open_cases = cases.join(providers.select("case_id").distinct(), "case_id", "left_anti")
    usable = open_cases.where((F.trim("make") != "") & (F.trim("model") != "") & (F.col("confidence") >= floor))
    plate = norm_plate(F.col("plate"))
    return usable.select(
        "case_id",
        F.when(plate == "", "indisponivel").otherwise(plate).alias("placa"),
        F.trim("make").alias("fabricante"),
        F.trim("model").alias("modelo"),
        F.concat(F.trim("make"), F.lit(" / "), F.trim("model")).alias("marca_modelo"),
        F.coalesce(filled(F.col("year_range")), F.lit(FALLBACK_YEAR)).alias("ano"),
        F.coalesce(filled(F.col("colour")), F.lit(FALLBACK_COLOUR)).alias("cor"),
        F.lit(FALLBACK_SOURCE).alias("fonte"),
        F.lit(FALLBACK_STATUS).alias("status"),
        F.format_string("%.1f", rnd(F.col("confidence"), 1)).alias("confianca"),
    )


def status_class(c: Column) -> Column:
    lowered = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    shown = F.when(lowered == "", "Indefinido").otherwise(F.replace(lowered, F.lit("_"), F.lit(" ")))
    for name, aliases in STATUS_CLASSES.items():
        shown = F.when(lowered.isin(*aliases), name).otherwise(shown)
    return shown


def status_rollup(events: DataFrame) -> DataFrame:
    """Events by status class; works on a table and, in update mode, on a stream."""
    return events.groupBy(status_class(F.col("status")).alias("status_class")).agg(F.count(F.lit(1)).alias("events"))
