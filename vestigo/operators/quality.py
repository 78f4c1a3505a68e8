"""Image quality, scene scenarios, triage, compatibility, exclusion, conclusion and readiness rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.functions.geometry import dms_to_decimal
from vestigo.functions.numbers import clamp, exact_sum, rnd
from vestigo.functions.plates import CONFUSABLE, slot_hint
from vestigo.operators.spread import settle

# Image quality.
QUALITY_WEIGHTS = {"blur": 0.35, "contrast": 0.25, "brightness": 0.15, "resolution": 0.15, "rotation": 0.10}
RESOLUTION_SCORES = {"very_low": 0.3, "low": 0.6, "medium": 0.85, "high": 1.0}
# Scene thresholds and the order that settles equal severity.
SCENE = {
    "dark_brightness": 92.0,
    "bright_brightness": 194.0,
    "low_contrast": 34.0,
    "foggy_contrast_max": 28.0,
    "foggy_saturation_max": 60.0,
    "noisy": 24.0,
    "blurred_sharpness": 160.0,
    "underexposed_ratio": 12.0,
    "overexposed_ratio": 12.0,
    "edge_weak": 1.8,
    "adulterated_edge_min": 2.0,
}
SCENE_ORDER = ["dark", "bright", "low_contrast", "noisy", "blurred", "balanced"]
# Triage.
TRIAGE_WEIGHTS = {"quality": 0.42, "integrity": 0.38, "consensus": 0.10, "confidence": 0.10}
# Compatibility levels and criteria (label, weight, component, full, partial, bonus).
LEVELS = [
    (90.0, "MUITO_PROVAVELMENTE_CORRESPONDENTE"),
    (75.0, "FORTEMENTE_COMPATIVEL"),
    (60.0, "COMPATIVEL"),
    (40.0, "POUCO_COMPATIVEL"),
    (0.0, "INCOMPATIVEL"),
]
PARTIAL_LEVEL = "COMPATIVEL_PARCIAL"
CRITERIA = [
    ("Farois", 10.0, "farois_dianteiros", ["simetricos"], ["parcial"], "dual_headlamps"),
    ("Lanternas traseiras", 10.0, "lanternas_traseiras", ["par_vertical", "par_detectado"], ["parcial"], "vertical_pair"),
    ("Linha lateral / vidros / colunas", 10.0, "linhas_portas", ["vincos_visiveis"], ["linha_parcial"], "design"),
    ("Grade dianteira", 8.0, "grade_dianteira", ["presente"], ["fraca"], ""),
    ("Parachoques", 8.0, "parachoque", ["presente", "detectado"], ["fraca", "parcial"], ""),
    ("Emblemas / inscricoes", 8.0, "emblema_frontal", ["detectado"], ["parcial"], "emblem"),
    ("Rodas / calotas", 6.0, "rodas_originais", ["detectado", "presente"], ["parcial"], ""),
    ("Macanetas / retrovisores / detalhes", 5.0, "retrovisores", ["detectado", "presente"], ["parcial"], ""),
    ("Linhas do capo / dianteira", 5.0, "linhas_capo", ["presente", "detectado"], ["parcial"], ""),
    ("Assinatura LED / luz diurna", 5.0, "assinatura_led", ["presente", "detectado"], ["parcial"], ""),
    ("Amassados / retoques", 5.0, "amassados", ["presente"], ["parcial"], ""),
    ("Adesivos / propaganda", 5.0, "adesivos_propaganda", ["presente"], ["parcial"], ""),
]
PLATE_CRITERION, PLATE_WEIGHT = "Placa/OCR total ou parcial", 25.0
INTERIOR_WEIGHT, INTERIOR_SCORE = 10.0, 6.0
STRICT_UNKNOWN = ("farois_dianteiros", "lanternas_traseiras", "grade_dianteira")
WEAK = ("fraca", "sinal_fraco", "linha_parcial", "parcial")
EMPTY = ("nao_detectado", "nao_detectada", "ausente", "indefinido", "indefinida")
# Readiness policy defaults and texts.
READINESS = {"confidence_min": 0.75, "consensus_ratio_min": 50.0, "image_quality_min": 0.60}
BLOCK_TEXT = "Sem leitura OCR consolidada da placa"
BLOCK_META = "Metadados forenses incompletos (analysis_id/timestamp)"
CAUTION_CONFIDENCE = "Confianca global abaixo do limiar pericial recomendado"
CAUTION_PATTERN = "Padrao de placa nao validado automaticamente"
CAUTION_CONSENSUS = "Baixo consenso entre motores OCR"
CAUTION_QUALITY = "Qualidade de imagem abaixo do ideal para uso judicial"
# Traits by body style.
BODY_TRAITS = {
    "hatch": ("curto", "acentuado", "compacta", "integrada"),
    "sedan/van": ("medio", "suave", "ampla", "proeminente"),
    "picape/caminhonete": ("longo", "plano", "vertical", "robusta"),
}


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def quality_score(images: DataFrame) -> DataFrame:
    """Levels, weighted score, issues and advice from measured metrics.

    `images`: image_id, laplacian, contrast, brightness, width, height, angle, angle_conf.
    """
    blur = F.least(F.lit(1.0), F.col("laplacian") / 500.0)
    b, pixels = F.col("brightness"), F.col("width") * F.col("height")
    steps = (
        images.withColumn("blur_score", blur)
        .withColumn(
            "blur_level",
            F.when(F.col("blur_score") < 0.2, "very_blurry")
            .when(F.col("blur_score") < 0.4, "blurry")
            .when(F.col("blur_score") < 0.7, "acceptable")
            .otherwise("sharp"),
        )
        .withColumn(
            "brightness_level",
            F.when(b < 50, "too_dark").when(b < 100, "dark").when(b > 200, "too_bright").when(b > 180, "bright").otherwise("ok"),
        )
        .withColumn(
            "_light",
            F.when(b.between(100, 180), 1.0)
            .when(((b >= 50) & (b < 100)) | ((b > 180) & (b <= 220)), 0.8)
            .when(((b >= 30) & (b < 50)) | ((b > 220) & (b <= 240)), 0.5)
            .otherwise(0.2),
        )
        .withColumn(
            "resolution",
            F.when(pixels < 20000, "very_low").when(pixels < 100000, "low").when(pixels < 500000, "medium").otherwise("high"),
        )
    )
    table = F.create_map(*[F.lit(x) for kv in RESOLUTION_SCORES.items() for x in kv])
    w = QUALITY_WEIGHTS
    overall = (
        F.col("blur_score") * w["blur"]
        + F.col("contrast") * w["contrast"]
        + F.col("_light") * w["brightness"]
        + F.element_at(table, F.col("resolution")) * w["resolution"]
        + (1.0 - F.least(F.lit(1.0), F.col("angle_conf") * 0.5)) * w["rotation"]
    )
    harsh = F.col("brightness_level").isin("too_dark", "too_bright")
    turned = F.format_string("%.1f", rnd(F.col("angle"), 1))
    issues = _list(
        F.when(F.col("blur_level") == "very_blurry", "CRÍTICO: Imagem muito desfocada"),
        F.when(F.col("contrast") < 0.2, "CRÍTICO: Contraste insuficiente"),
        F.when(harsh, "AVISO: Brilho inadequado"),
        F.when(F.col("resolution") == "very_low", "AVISO: Resolução muito baixa"),
        F.when(F.abs("angle") > 30, F.concat(F.lit("AVISO: Rotação excessiva ("), turned, F.lit("°)"))),
    )
    advice = _list(
        F.when(F.col("blur_score") < 0.4, "Imagem muito desfocada. Considere super-resolução ou re-captura."),
        F.when(F.col("blur_score") < 0.7, "Aplicar deconvolução ou super-resolução pode melhorar OCR."),
        F.when(F.col("contrast") < 0.3, "Contraste baixo. Aplicar equalização adaptativa (CLAHE)."),
        F.when(
            harsh, F.concat(F.lit("Brilho inadequado ("), F.col("brightness_level"), F.lit("). Ajustar luminosidade."))
        ),
        F.when(
            F.col("resolution") == "very_low", "Resolução muito baixa (<200px). Super-resolução recomendada."
        ).when(F.col("resolution") == "low", "Resolução baixa. Upscaling ou re-captura em melhor qualidade."),
        F.when(
            F.abs("angle") > 15,
            F.concat(F.lit("Imagem rotacionada "), turned, F.lit("°. Realizar rotação corretiva.")),
        ),
    )
    return steps.select(
        "image_id",
        "blur_level",
        "brightness_level",
        "resolution",
        rnd(overall, 6).alias("overall_quality_score"),
        issues.alias("issues"),
        advice.alias("recommendations"),
    )


def scene_scenarios(images: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Scenario tags of an image in order of severity, the leading one and a joint label.

    `images`: image_id, brightness, contrast, sharpness, noise, under, over, edges, saturation.
    """
    t = SCENE | (limits or {})
    c = F.col
    above = lambda value: F.greatest(F.lit(0.0), value)
    foggy = (c("contrast") <= t["foggy_contrast_max"]) & (c("saturation") <= t["foggy_saturation_max"])
    weak_edges = c("edges") <= t["edge_weak"]
    odd = (c("edges") > t["edge_weak"]) & (c("edges") < t["adulterated_edge_min"] * 2.0) & (c("noise") > t["noisy"] * 0.4)
    tests = {
        "foggy": (
            foggy,
            above(t["foggy_contrast_max"] - c("contrast")) * 1.5 + above(t["foggy_saturation_max"] - c("saturation")),
        ),
        "dark": (
            (c("brightness") <= t["dark_brightness"]) | (c("under") >= t["underexposed_ratio"]),
            above((t["dark_brightness"] - c("brightness")) * 0.9) + above(c("under") - t["underexposed_ratio"]) * 1.1,
        ),
        "bright": (
            (c("brightness") >= t["bright_brightness"]) | (c("over") >= t["overexposed_ratio"]),
            above(c("brightness") - t["bright_brightness"]) * 0.9 + above(c("over") - t["overexposed_ratio"]) * 1.1,
        ),
        "low_contrast": (
            ((c("contrast") <= t["low_contrast"]) & ~foggy) | weak_edges,
            above(t["low_contrast"] - c("contrast")) * 1.3,
        ),
        "noisy": (c("noise") >= t["noisy"], above(c("noise") - t["noisy"]) * 1.4),
        "blurred": (c("sharpness") <= t["blurred_sharpness"], above(t["blurred_sharpness"] - c("sharpness")) * 0.9),
        "adulterated_lighting": (odd, F.lit(1.2)),
    }

    def tag(name: str, severity: Column) -> Column:
        place = SCENE_ORDER.index(name) if name in SCENE_ORDER else len(SCENE_ORDER)
        return F.struct((-severity).alias("neg"), F.lit(place).alias("place"), F.lit(name).alias("tag"))

    hit = _list(*[F.when(test, tag(name, severity)) for name, (test, severity) in tests.items()])
    named = F.transform(F.array_sort(hit), lambda x: x["tag"])
    tags = F.when(F.size(named) == 0, F.array(F.lit("balanced"))).otherwise(named)
    return images.withColumn("tags", tags).select(
        "image_id", "tags", F.element_at("tags", 1).alias("primary"), F.array_join("tags", "+").alias("label")
    )


def select_variant(candidates: DataFrame, profiles: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Best variant of each image by quality, bonuses of its scenario and distance.

    `candidates`: image_id, scenario, variant, family, quality, distance; `profiles`: scenario,
    multiplier, bias, distance_weight, family, family_bonus (family `default` for the rest);
    `prefixes`: scenario, prefix, bonus. The longest matching prefix counts.
    """
    base = profiles.groupBy("scenario").agg(
        F.max("multiplier").alias("_m"), F.max("bias").alias("_b"), F.max("distance_weight").alias("_w"),
        F.max(F.when(F.col("family") == "default", F.col("family_bonus"))).alias("_default"),
    )
    own = profiles.select("scenario", F.col("family").alias("_family"), F.col("family_bonus").alias("_own"))
    # Settings are few and go to the candidates, which stay where they are; a scenario's prefixes go longest first.
    listed = F.array_sort(F.collect_list(F.struct((-F.length("prefix")).alias("n"), "prefix", "bonus")))
    known = prefixes.where(F.col("prefix").isNotNull()).groupBy("scenario").agg(listed.alias("_prefixes"))
    told = F.lower(F.trim("variant"))
    scored = (
        candidates.withColumn("_family", F.lower(F.trim("family")))
        .join(F.broadcast(base), "scenario")
        .join(F.broadcast(own), ["scenario", "_family"], "left")
        .join(F.broadcast(known), "scenario", "left")
        .withColumn("p", F.get(F.filter("_prefixes", lambda x: told.startswith(x["prefix"])), F.lit(0)))
        .withColumn("bonus", rnd(F.coalesce("p.bonus", F.lit(0.0)) + F.coalesce("_own", "_default", F.lit(0.0)), 4))
    )
    scored = settle(scored.select("image_id", "position", "variant", "quality", "distance", "_m", "_b", "_w", "p", "bonus"), "p", "bonus")
    score = F.col("quality") * F.col("_m") + F.col("_b") + F.col("bonus") - F.col("distance") * F.col("_w")
    return scored.groupBy("image_id").agg(
        F.max_by(
            F.struct("variant", "bonus", F.coalesce("p.prefix", F.lit("")).alias("prefix")),
            F.struct(score, -F.col("position")),
        ).alias("r"),
        F.max(score).alias("score"),
    ).select("image_id", "r.variant", "r.bonus", "r.prefix", rnd(F.col("score"), 6).alias("score"))


def tier(score: Column) -> Column:
    s = clamp(score, 0.0, 100.0)
    return F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 50, "C").otherwise("D")


def quality_triage(cases: DataFrame) -> DataFrame:
    """Triage class of a case with reasons and the need for review.

    `cases`: case_id, quality, integrity, consensus, avg_conf, grade, integrity_status, roi_status,
    integrity_review, quality_issues array, integrity_issues array.
    """
    w = TRIAGE_WEIGHTS
    composite = (
        F.col("quality") * w["quality"]
        + F.coalesce("integrity", F.lit(100.0)) * w["integrity"]
        + F.col("consensus") * w["consensus"]
        + F.col("avg_conf") * w["confidence"]
    )
    critical, recheck = F.col("grade") == "CRITICA", F.col("integrity_status") == "revisao_obrigatoria"
    no_roi, whole = F.col("roi_status") == "sem_candidato", F.col("roi_status") == "fallback_full_scene"
    forced = critical | recheck | no_roi
    first = F.when(forced, "D").otherwise(tier(composite))
    demoted = whole & first.isin("A", "B")
    strict = _list(
        F.when(critical, "qualidade_da_imagem_critica"),
        F.when(recheck, "integridade_da_captura_requer_revisao"),
        F.when(no_roi, "sem_roi_confiavel"),
        F.when(demoted, "fallback_em_imagem_completa"),
    )
    soft = F.concat(
        F.slice("quality_issues", 1, 4), F.slice("integrity_issues", 1, 4), _list(F.when(F.col("consensus") < 40.0, "consenso_ocr_baixo"))
    )
    final = F.when(demoted, "C").otherwise(first)
    return cases.select(
        "case_id",
        final.alias("triage_class"),
        rnd(clamp(composite, 0.0, 100.0), 1).alias("triage_score"),
        ((final == "D") | F.col("integrity_review") | no_roi | critical).alias("manual_review"),
        F.array_distinct(F.when(F.size(strict) > 0, strict).otherwise(soft)).alias("reasons"),
    )


def ambiguous_positions(text: Column) -> Column:
    """Positions of a text whose character readers confuse, with the first two alternatives."""
    alternatives = F.create_map(*[x for k, v in CONFUSABLE.items() for x in (F.lit(k), F.lit(" ou ".join(v[:2])))])
    spots = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))),
        lambda i: F.struct(
            i.alias("position"),
            slot_hint(F.substring(text, i, F.lit(1))).alias("slot"),
            F.try_element_at(alternatives, F.substring(text, i, F.lit(1))).alias("alternatives"),
        ),
    )
    return F.filter(spots, lambda s: s["alternatives"].isNotNull())


def ocr_record(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reading record of a case: estimate, uncertain characters, tamper alert, conflicting readings.

    `cases`: case_id, text, avg_conf, consensus, law_score, odd_light; `candidates`: case_id, rank, text,
    engine. Ranks 2 to 4 that read otherwise are conflicts.
    """
    estimate = F.col("avg_conf") * 0.48 + F.col("consensus") * 0.27 + F.col("law_score") * 0.25
    line = F.concat("text", F.lit(" detectado por: "), "engine")
    rivals = (
        candidates.where(F.col("rank").between(2, 4))
        .join(cases.select("case_id", F.col("text").alias("_main")), "case_id")
        .where((F.col("text") != "") & (F.col("text") != F.col("_main")))
        .groupBy("case_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))).alias("_rivals"))
    )
    spotted = settle(cases.withColumn("_spots", ambiguous_positions(F.col("text"))), "_spots")
    details = F.concat(
        F.transform("_spots", lambda s: F.concat(F.lit("P"), s["position"].cast("string"), F.lit(": "), s["alternatives"])),
        _list(F.when(F.col("odd_light"), "Anomalia de luz/adulteracao")),
    )
    marks = F.array_join(
        F.transform("_spots", lambda s: F.concat(F.lit("P"), s["position"].cast("string"), F.lit("["), s["slot"], F.lit("]"))), "; "
    )
    alert = F.concat(F.lit("Atencao: Possivel adulteracao ("), F.array_join(details, "; "), F.lit(") - Verificar imagem"))
    return spotted.join(rivals, "case_id", "left").select(
        "case_id",
        F.when(F.col("text") == "", "indefinido").otherwise(F.col("text")).alias("main_text"),
        rnd(clamp(estimate, 0.0, 100.0), 1).alias("estimate"),
        F.when(marks == "", "-").otherwise(marks).alias("uncertain"),
        F.when(F.size(details) > 0, alert).otherwise("Nao detectada").alias("tamper_alert"),
        F.concat_ws("; ", F.transform("_rivals", lambda x: x["s"])).alias("conflicts"),
        ((F.col("text") != "") & (F.length("text") < 7)).alias("partial_plate"),
    )


def strong_ocr() -> Column:
    """A long reading with high confidence and consensus and a known pattern."""
    return (
        (F.length("text") >= 6)
        & (F.col("avg_conf") >= 80.0)
        & (F.col("consensus") >= 90.0)
        & (F.col("pattern_valid") | ~F.col("pattern").isin("", "Indefinido"))
    )


def vehicle_profile(cases: DataFrame) -> DataFrame:
    """Body style, size and derived traits from aspect bands and rear lights.

    `cases`: case_id, aspect, compact, rear_vertical, rear_conf, view.
    """
    a = F.col("aspect")
    upright = F.col("compact") & F.col("rear_vertical")
    style = (
        F.when(a <= 0, "indefinido")
        .when(upright, "hatch")
        .when(a >= 2.7, "picape/caminhonete")
        .when(a >= 2.15, "sedan/van")
        .when(a >= 1.45, "hatch")
        .otherwise("indefinido")
    )
    conf = (
        F.when(a <= 0, 0.0)
        .when(upright, F.when(F.col("rear_conf") >= 45, 82.0).otherwise(66.0))
        .when(a >= 2.7, F.least(F.lit(88.0), 48.0 + (a - 2.7) * 14.0))
        .when(a >= 2.15, F.least(F.lit(82.0), 46.0 + (a - 2.15) * 18.0))
        .when(a >= 1.45, F.least(F.lit(78.0), 44.0 + (2.1 - F.abs(a - 1.9)) * 10.0))
        .otherwise(0.0)
    )
    size = F.when(a <= 0, "indefinido").when(a >= 2.7, "grande").when(a >= 2.05, "medio").otherwise("compacto")
    view = F.upper(F.trim("view"))
    where = F.when(view == "TRASEIRA", "traseira").when(view == "FRONTAL", "dianteira").otherwise("indefinida")
    styled = cases.withColumn("body_style", style)

    def trait(i: int, default: str) -> Column:
        out = F.lit(default)
        for name, values in BODY_TRAITS.items():
            out = F.when(F.col("body_style") == name, values[i]).otherwise(out)
        return out

    return styled.select(
        "case_id",
        "body_style",
        rnd(conf, 1).alias("body_confidence"),
        size.alias("size_class"),
        trait(0, "indefinido").alias("rear_volume"),
        trait(1, "indefinido").alias("roof_slope"),
        trait(2, "indefinida").alias("rear_window"),
        trait(3, "indefinida").alias("c_pillar"),
        where.alias("plate_position"),
    )


def body_style_rollup(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("body_style", "size_class").agg(
        F.count(F.lit(1)).alias("cases"), rnd(exact_sum(F.col("body_confidence")) / F.count(F.lit(1)), 4).alias("avg_confidence")
    )


def compatibility_matrix(cases: DataFrame, components: DataFrame) -> DataFrame:
    """Weighted compatibility of each case: total, availability, coverage, level, leading criteria.

    `cases`: case_id, text, pattern_valid, law_score, consensus, avg_conf, dual_headlamps, vertical_pair,
    design_conf, emblem_conf, interior; `components`: case_id, component, status, confidence.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(weight).alias("weight"), F.lit(component).alias("component"),
                F.array(*map(F.lit, full)).alias("full"), F.array(*map(F.lit, part)).alias("part"), F.lit(bonus).alias("bonus"),
            )
            for i, (label, weight, component, full, part, bonus) in enumerate(CRITERIA)
        ]
    )
    flags = ["dual_headlamps", "vertical_pair", "design_conf", "emblem_conf"]
    judged = (
        cases.select("case_id", *flags, F.explode(rows).alias("_r"))
        .select("case_id", *flags, "_r.*")
        .join(components, ["case_id", "component"], "left")
    )
    status = F.lower(F.coalesce("status", F.lit("indefinido")))
    share, w = clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 100.0) / 100.0, F.col("weight")
    points = (
        F.when(F.array_contains("full", status), w * 0.70 + share * w * 0.30)
        .when(F.array_contains("part", status), w * 0.45 + share * w * 0.20)
        .when(status.startswith("limitado_vista"), w * 0.20 + share * w * 0.15)
        .when(status.isin(*WEAK), w * 0.25 + share * w * 0.15)
        .when(status.isin(*EMPTY), 0.0)
        .otherwise(w * 0.15 + share * w * 0.10)
    )
    base = rnd(F.least(w, F.greatest(F.lit(0.0), points)), 2)
    extra = (
        F.when((F.col("bonus") == "dual_headlamps") & F.col("dual_headlamps"), 1.0)
        .when((F.col("bonus") == "vertical_pair") & F.col("vertical_pair"), 1.2)
        .when(F.col("bonus") == "design", F.least(F.lit(1.5), F.coalesce("design_conf", F.lit(0.0)) * 0.015))
        .when(F.col("bonus") == "emblem", F.least(F.lit(1.0), F.coalesce("emblem_conf", F.lit(0.0)) * 0.01))
        .otherwise(0.0)
    )
    unknown = F.when(F.col("component").isin(*STRICT_UNKNOWN), status.isin("indefinido", "nao_detectado", "nao_detectada")).otherwise(
        status.isin("indefinido", "")
    )
    scored = judged.withColumn("_points", rnd(F.least(w, base + extra), 1)).withColumn("_known", ~unknown)
    leading = lambda i: F.max(F.when(F.col("i") == i, F.col("_points")))
    summed = scored.groupBy("case_id").agg(
        exact_sum(F.col("_points")).alias("_sum"),
        exact_sum(F.when(F.col("_known"), w).otherwise(0.0)).alias("_max"),
        *[leading(i).alias(f"_lead{i}") for i in range(3)],
    )
    text = F.col("text")
    plate = F.when(text == "", 0.0).otherwise(
        F.when(F.col("pattern_valid"), 11.0).otherwise(0.0)
        + F.when(F.length(text) == 7, 4.0).when(F.length(text) >= 5, 2.5).otherwise(0.0)
        + F.least(F.lit(6.0), F.col("law_score") * 0.16)
        + F.least(F.lit(4.0), F.col("consensus") * 0.06)
        + F.least(F.lit(4.0), F.col("avg_conf") * 0.05)
    )
    whole = cases.join(summed, "case_id").withColumn("_plate", rnd(F.least(F.lit(PLATE_WEIGHT), plate), 1))
    inside = F.when(F.col("interior"), INTERIOR_SCORE).otherwise(0.0)
    ready = whole.withColumn("score_total", rnd(F.col("_sum") + F.col("_plate") + inside, 1)).withColumn(
        "available_max",
        rnd(
            F.col("_max")
            + F.when(text != "", PLATE_WEIGHT).otherwise(0.0)
            + F.when(F.col("interior"), INTERIOR_WEIGHT).otherwise(0.0),
            1,
        ),
    )
    level = F.lit(LEVELS[-1][1])
    for floor, name in reversed(LEVELS):
        level = F.when(F.col("score_total") >= floor, name).otherwise(level)
    shown = [(PLATE_CRITERION, "_plate")] + [(CRITERIA[i][0], f"_lead{i}") for i in range(3)]
    summary = F.concat_ws("; ", *[F.concat(F.lit(f"{label}="), F.format_string("%.1f", F.col(c))) for label, c in shown])
    return ready.select(
        "case_id",
        "score_total",
        "available_max",
        F.when(F.col("available_max") > 0, rnd(F.col("score_total") / F.col("available_max") * 100.0, 1)).otherwise(0.0).alias("available_ratio"),
        F.col("available_max").alias("coverage_percent"),
        level.alias("level"),
        summary.alias("summary"),
    )


def exclusion_checks(cases: DataFrame, matrix: DataFrame) -> DataFrame:
    """The eight checks of each case as rows: code, status, strong flag, impact.

    `cases`: triage and reading fields with ambiguity_count and abstained. Low consensus has status
    `baixo`, which does not count as triggered.
    """
    joined = cases.join(matrix.select("case_id", "coverage_percent"), "case_id")
    thin = F.col("coverage_percent") < 35.0
    alone = thin & ~strong_ocr()
    critical, recheck = F.col("grade") == "CRITICA", F.col("integrity_status") == "revisao_obrigatoria"
    valid, low = F.col("pattern_valid"), F.col("consensus") < 40.0

    def check(code: str, status: Column, strong: Column, impact: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), status.alias("status"), strong.alias("strong"), impact.alias("impact"))

    pick = lambda condition, yes, no: F.when(condition, yes).otherwise(no)
    no = F.lit(False)
    checks = F.array(
        check("capture_integrity", F.col("integrity_status"), recheck, pick(recheck, "alto", "medio")),
        check("image_quality", F.col("grade"), critical | (F.col("quality") < 48.0), pick(critical, "alto", "medio")),
        check("ocr_pattern", pick(valid, "valida", "invalida"), ~valid, pick(valid, "baixo", "alto")),
        check("ocr_ambiguity", pick(F.col("ambiguity_count") >= 2, "alta", "ok"), F.col("ambiguity_count") >= 3, F.lit("medio")),
        check("ocr_consensus", pick(low, "baixo", "ok"), no, F.lit("baixo")),
        check("visual_abstention", pick(F.col("abstained"), "ativa", "inativa"), no, F.lit("medio")),
        check("compatibility_coverage", pick(thin, "baixa", "ok"), alone, pick(alone, "alto", "medio")),
        check("interior_presence", F.lit("indisponivel"), no, F.lit("baixo")),
    )
    quiet = ("ok", "valida", "inativa", "baixo", "indisponivel")
    return joined.select("case_id", F.explode(checks).alias("c")).select(
        "case_id", "c.*", (~F.col("c.status").isin(*quiet)).alias("triggered")
    )


def exclusion_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("case_id").agg(
        F.count_if("triggered").alias("triggered_count"), F.count_if("strong").alias("strong_count")
    )


def conclusion(cases: DataFrame, triage: DataFrame, matrix: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Decision and level of each case from triage, excluders, reading strength and matrix score."""
    joined = (
        cases.select("case_id", "text", strong_ocr().alias("strong_ocr"))
        .join(triage.select("case_id", "triage_class", F.col("manual_review").alias("_review")), "case_id")
        .join(matrix.select("case_id", "score_total", F.col("level").alias("_level")), "case_id")
        .join(exclusions, "case_id")
    )
    strong, excluded = F.col("strong_ocr"), F.col("strong_count") > 0
    poor = F.col("score_total") < 40.0
    steps = joined.withColumn("manual_review", F.when(strong & ~excluded, False).otherwise(F.col("_review") | excluded))
    held = (F.col("triage_class") == "D") | F.col("manual_review") | poor
    lifted = strong & poor
    partial = (F.col("text") != "") & (F.length("text") < 7)
    decision = F.when(lifted, "conclusivo").when(held, "inconclusivo").otherwise("conclusivo")
    final = F.when(partial & (F.col("triage_class") == "D"), "inconclusivo").otherwise(decision)
    level = (
        F.when(lifted & (F.col("_level") == "INCOMPATIVEL"), PARTIAL_LEVEL)
        .when((decision == "inconclusivo") & poor & ~strong, "INCOMPATIVEL")
        .otherwise(F.col("_level"))
    )
    return steps.select(
        "case_id",
        final.alias("decision"),
        F.when(partial & (level == "INCOMPATIVEL"), PARTIAL_LEVEL).otherwise(level).alias("level"),
        "manual_review",
        "strong_ocr",
    )


def judicial_readiness(cases: DataFrame, policy: dict[str, float] | None = None) -> DataFrame:
    """Fitness of each case for preliminary use in court, with what blocks it and what cautions.

    `cases`: case_id, text, has_metadata, level, confidence, pattern_valid, consensus, image_quality.
    """
    p = READINESS | (policy or {})
    blockers = _list(F.when(F.trim("text") == "", BLOCK_TEXT), F.when(~F.col("has_metadata"), BLOCK_META))
    weak = F.col("level").isin("reject", "low") | (F.col("confidence") < p["confidence_min"])
    cautions = _list(
        F.when(weak, f"{CAUTION_CONFIDENCE} ({p['confidence_min']:.2f})"),
        F.when(~F.col("pattern_valid"), CAUTION_PATTERN),
        F.when(F.col("consensus") < p["consensus_ratio_min"], CAUTION_CONSENSUS),
        F.when(F.col("image_quality") < p["image_quality_min"], CAUTION_QUALITY),
    )
    return (
        cases.withColumn("blockers", blockers)
        .withColumn("cautions", cautions)
        .select(
            "case_id",
            F.when(F.size("blockers") > 0, "nao_apto")
            .when(F.size("cautions") > 0, "apto_com_revisao")
            .otherwise("apto_prova_preliminar")
            .alias("status"),
            "blockers",
            "cautions",
        )
    )


def readiness_rollup(ready: DataFrame) -> DataFrame:
    """Cases by status and reason, with subtotals and the rate among all."""
    told = ready.withColumn("reason", F.explode_outer(F.concat("blockers", "cautions")))
    counted = told.groupBy("status", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count(F.lit(1)).alias("cases"))
    totals = ready.groupBy("status").agg(F.count(F.lit(1)).alias("cases")).withColumn("reason", F.lit("(total)"))
    whole = ready.agg(F.count(F.lit(1)).alias("_all"), F.lit(1).alias("_one"))
    both = counted.select("status", "reason", "cases").unionByName(totals.select("status", "reason", "cases"))
    return both.withColumn("_one", F.lit(1)).join(whole, "_one").select(
        "status", "reason", "cases", rnd(F.col("cases") / F.col("_all"), 6).alias("rate")
    )


def gps_context(exif: DataFrame) -> DataFrame:
    """Decimal position of each image. `exif`: image_id, has_gps, lat_d, lat_m, lat_s, lat_ref, lon_*, altitude."""
    parts = lambda axis: [F.col(f"{axis}_{p}").try_cast("double") for p in ("d", "m", "s")]
    lat = dms_to_decimal(*parts("lat"), F.coalesce("lat_ref", F.lit("N")))
    lon = dms_to_decimal(*parts("lon"), F.coalesce("lon_ref", F.lit("E")))
    broken = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)
    status = F.when(~F.col("has_gps"), "no_gps_metadata").when(broken, "gps_invalid").otherwise("gps_extracted")
    ok = F.col("status") == "gps_extracted"
    return exif.withColumn("status", status).select(
        "image_id",
        "status",
        F.when(ok, rnd(lat, 7)).alias("latitude"),
        F.when(ok, rnd(lon, 7)).alias("longitude"),
        F.when(ok, rnd(F.col("altitude"), 2)).alias("altitude_m"),
    )
