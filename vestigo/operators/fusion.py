"""Fusing many readings of one plate into ranked candidates with consensus and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.functions.geometry import BOX, bbox_key
from vestigo.functions.numbers import clamp, exact_avg, exact_sum, norm_conf, rnd
from vestigo.functions.plates import (
    all_position_variants,
    bbox_likelihood,
    confusable_count,
    neighbour_variants,
    norm_plate,
    pattern_quality,
    spaceless,
    validator_pattern,
    with_validation,
)
from vestigo.operators.spread import falling_bucket, spread_rank, within
from vestigo.session import stash

# Weights of the fused score and the repeat bonus.
CONF_WEIGHT, PATTERN_WEIGHT, BOX_WEIGHT = 0.60, 0.30, 0.10
REPEAT_BONUS, REPEAT_CAP = 0.03, 0.15
# Filters and plausibility.
MIN_LENGTH, MIN_PATTERN, MIN_SCORE = 3, 0.30, 0.16
# Confidence weights, levels and texts.
LEVEL_WEIGHTS = {"detection": 0.30, "ocr": 0.25, "validation": 0.25, "quality": 0.20}
HIGH, MEDIUM, LOW = 0.85, 0.65, 0.45
RELIABLE = "Resultado válido e confiável"
RECOMMENDATION = {
    "high": "ACEITAR: Resultado altamente confiável. Usar diretamente.",
    "medium": "REVISAR: Resultado moderadamente confiável. Recomenda-se revisão antes de usar.",
    "low": "REVISAR MANUALMENTE: Resultado de baixa confiança. Inspeção humana recomendada.",
    "reject": "REJEITAR: Resultado não confiável. Não usar. Tentar re-capturar imagem.",
}
PLATE_CANDIDATE_CAP = 8
# A fused score cannot pass 1.15, so score buckets cover this range.
SCORE_CEILING = 1.2


def normalize_reads(reads: DataFrame) -> DataFrame:
    """Plate text and 0-1 confidence; blank texts go, as they carry no evidence."""
    return (
        reads.withColumn("text", norm_plate(F.col("text")))
        .withColumn("confidence", norm_conf(F.col("confidence")))
        .where(F.col("text") != "")
    )


def text_candidates(reads: DataFrame) -> DataFrame:
    """Candidate texts of each evidence with support and score, before engines are compared.

    One row per (evidence, text, engine) first, so repeated readings shrink before the shuffle.
    """
    likelihood = bbox_likelihood(*[F.col(c) for c in BOX])
    votes = reads.groupBy("evidence_id", "text", "engine").agg(
        F.count(F.lit(1)).alias("votes"),
        exact_sum(F.col("confidence")).alias("sum_conf"),
        F.max(likelihood).alias("bbox"),
        F.min("read_id").alias("first_read"),
        F.max("read_id").alias("last_read"),
    )
    fused = votes.groupBy("evidence_id", "text").agg(
        F.sum("votes").alias("support_count"),
        exact_sum(F.col("sum_conf")).alias("sum_conf"),
        F.max("bbox").alias("bbox_likelihood"),
        F.min("first_read").alias("first_read"),
        # The engine that reached the highest vote last.
        F.max_by("engine", F.struct("votes", "last_read")).alias("engine"),
        # Engines are a short, fixed list.
        F.array_sort(F.collect_set(F.nullif(F.trim("engine"), F.lit("")))).alias("engines"),
    )
    avg = F.col("sum_conf") / F.col("support_count")
    quality = pattern_quality(F.col("text"))
    bonus = 1.0 + F.least(F.lit(REPEAT_CAP), REPEAT_BONUS * (F.col("support_count") - 1))
    blend = avg * CONF_WEIGHT + quality * PATTERN_WEIGHT + F.col("bbox_likelihood") * BOX_WEIGHT
    return fused.select(
        "evidence_id",
        "text",
        "engine",
        "engines",
        rnd(avg, 4).alias("avg_conf"),
        rnd(blend * bonus, 4).alias("score"),
        "support_count",
        F.size("engines").cast("bigint").alias("engine_support_count"),
        rnd(F.col("sum_conf"), 4).alias("weighted_support"),
        quality.alias("pattern_quality"),
        rnd(F.col("bbox_likelihood"), 4).alias("bbox_likelihood"),
        "first_read",
    )


def _all_engines() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("engines"))))


def fuse_reads(reads: DataFrame) -> DataFrame:
    """Candidates per evidence from normalised reads: support, scores, agreement, chosen engine."""
    candidates = text_candidates(reads)
    executed = candidates.groupBy("evidence_id").agg(F.size(_all_engines()).cast("bigint").alias("engines_executed"))
    share = rnd(F.col("engine_support_count") / F.col("engines_executed") * 100.0, 1)
    return candidates.join(executed, "evidence_id").withColumn(
        "agreement_ratio", F.when(F.col("engines_executed") > 1, share).otherwise(0.0)
    )


def candidate_engine(reads: DataFrame) -> DataFrame:
    """Representative engine of each candidate text."""
    votes = reads.groupBy("evidence_id", "text", "engine").agg(
        F.count(F.lit(1)).alias("votes"), F.max("read_id").alias("last_read")
    )
    return votes.groupBy("evidence_id", "text").agg(
        F.max_by("engine", F.struct("votes", "last_read")).alias("engine"), F.max("votes").alias("votes")
    )


def _weak() -> Column:
    short = (F.length("text") < MIN_LENGTH) & (F.col("pattern_quality") < MIN_PATTERN)
    return short | (F.col("score") < MIN_SCORE)


def _plausible() -> Column:
    quality = F.col("pattern_quality")
    return (quality >= 0.60) | ((F.length("text") >= 6) & (quality >= 0.20))


def rank_and_filter(candidates: DataFrame) -> DataFrame:
    """Drop weak candidates unless that would drop all of an evidence's; rank the rest by score."""
    # Candidates are fused once; totals, sizes and ranks read the stored rows.
    marked = stash(candidates.withColumn("_keep", ~_weak()), "ranked-candidates")
    totals = marked.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("_keep").alias("_kept")
    )
    chosen = marked.join(totals, "evidence_id").where(
        F.col("_keep") | (F.col("_all") == 1) | (F.col("_kept") == 0)
    )
    return spread_rank(
        chosen.drop("_keep", "_all", "_kept"),
        ["evidence_id"],
        falling_bucket(F.col("score"), 0.0, SCORE_CEILING),
        [F.col("score").desc(), F.col("first_read")],
        "rank",
        sizes=totals.select("evidence_id", F.col("_all").alias("_rows")),
    )


def _verdicts(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate of every evidence and the engines behind it, in one aggregation.

    The leader is found as a minimum, both among all candidates and among those that are not weak;
    which of the two counts is known once the evidence's totals are. No ranking is needed.
    """
    keep = ~_weak()
    order = F.struct((-F.col("score")).alias("neg"), F.col("first_read"))
    row = F.struct("text", "engine", "avg_conf", "score", "engines")
    found = candidates.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(keep).alias("_kept"),
        F.min_by(row, F.when(_plausible(), order)).alias("_any"),
        F.min_by(row, F.when(_plausible() & keep, order)).alias("_strong"),
        _all_engines().alias("_engines"),
    )
    whole = (F.col("_all") == 1) | (F.col("_kept") == 0)
    chosen = found.select(
        "evidence_id",
        F.when(whole, F.col("_all")).otherwise(F.col("_kept")).alias("_n"),
        F.when(whole, F.col("_any")).otherwise(F.col("_strong")).alias("b"),
        F.size("_engines").alias("_ran"),
    )
    n = F.coalesce("_n", F.lit(0))
    ran = F.coalesce("_ran", F.lit(0))
    backers = F.when(F.col("b").isNull(), 0).otherwise(F.size("b.engines"))
    crossed = (ran > 1) & (backers > 0)
    return evidence.join(chosen, "evidence_id", "left").select(
        *evidence.columns,
        F.coalesce("b.text", F.lit("")).alias("best_text"),
        F.coalesce("b.engine", F.lit("none")).alias("best_engine"),
        F.coalesce("b.avg_conf", F.lit(0.0)).alias("best_avg_conf"),
        F.coalesce("b.score", F.lit(0.0)).alias("best_score"),
        n.cast("bigint").alias("candidates"),
        F.when(n == 0, "ocr_sem_resultado")
        .when(F.col("b").isNull(), "best_candidate_low_plausibility")
        .otherwise("")
        .alias("warning"),
        ran.cast("bigint").alias("engines_executed"),
        backers.cast("bigint").alias("engines_supporting_best"),
        F.concat_ws(",", "b.engines").alias("supporting_engines"),
        F.when(crossed, rnd(backers / ran * 100.0, 1)).otherwise(0.0).alias("consensus_ratio"),
        F.when(crossed, "cross_engine_consensus").otherwise("single_engine_or_no_consensus").alias("consensus_basis"),
    )


def best_candidate(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """First plausible candidate of every evidence, with a warning where there is none."""
    columns = ["best_text", "best_engine", "best_avg_conf", "best_score", "candidates", "warning"]
    return _verdicts(evidence, candidates).select(*evidence.columns, *columns)


def fused_verdict(evidence: DataFrame, reads: DataFrame) -> DataFrame:
    """Flagship: raw reads to one best text per evidence, with the share of executed engines that
    support it; consensus needs more than one engine."""
    return _verdicts(evidence, text_candidates(normalize_reads(reads)))


def plate_analyses(detections: DataFrame, reads: DataFrame, cap: int | None = PLATE_CANDIDATE_CAP) -> DataFrame:
    """Reads joined to their detection by rounded box, best `cap` per detection.

    Evidence without detections falls back to one group per read box, or `full_image`.
    `detections` carry priority_rank, `reads` are normalised.
    """
    boxes = [F.col(c) for c in BOX]
    composite = rnd(
        F.col("confidence") * CONF_WEIGHT
        + pattern_quality(F.col("text")) * PATTERN_WEIGHT
        + bbox_likelihood(*boxes) * BOX_WEIGHT,
        4,
    )
    scored = reads.select(
        "evidence_id",
        bbox_key(*boxes).alias("bbox"),
        "read_id",
        "text",
        "engine",
        rnd(F.col("confidence"), 4).alias("confidence"),
        composite.alias("composite"),
    )
    boxed = detections.select(
        "evidence_id",
        "det_id",
        bbox_key(*boxes).alias("bbox"),
        "priority_rank",
        F.col("confidence").alias("detection_confidence"),
    )
    boxed = stash(boxed, "analysis-boxes")
    # Reads are scored and told apart once; groups and matches read the stored rows.
    detected = boxed.groupBy("evidence_id").agg(F.lit(True).alias("_boxed"))
    blank = F.col("_boxed").isNull() & (F.col("bbox") == "")
    pool = scored.join(detected, "evidence_id", "left").withColumn("bbox", F.when(blank, "full_image").otherwise(F.col("bbox")))
    pool = stash(pool, "analysis-reads")
    loose = pool.where(F.col("_boxed").isNull())
    # Groups are numbered by their first read, those without one by box; a read's group is few rows once pre-aggregated.
    order = Window.partitionBy("evidence_id").orderBy("first_read", "bbox")
    groups = (
        loose.groupBy("evidence_id", "bbox")
        .agg(F.min("read_id").alias("first_read"))
        .select("evidence_id", "bbox", F.row_number().over(order).cast("bigint").alias("priority_rank"))
        .withColumn("detection_confidence", F.lit(0.0))
        .withColumn("det_id", F.lit(-1).cast("bigint"))
    )
    targets = boxed.unionByName(groups)
    top = Window.partitionBy("evidence_id", "det_id", "bbox").orderBy(F.col("composite").desc(), "read_id")
    kept = (
        targets.select("evidence_id", "det_id", "bbox")
        .join(pool.drop("_boxed"), ["evidence_id", "bbox"])
        .withColumn("_n", F.row_number().over(top))
        .where(within(F.col("_n"), cap))
        .groupBy("evidence_id", "det_id", "bbox")
        .agg(
            F.array_sort(F.collect_list(F.struct("_n", "text", "engine", "confidence", "composite"))).alias("cands")
        )
    )
    best = F.element_at("cands", 1)
    return targets.join(kept, ["evidence_id", "det_id", "bbox"], "left").select(
        "evidence_id",
        "det_id",
        "bbox",
        "priority_rank",
        "detection_confidence",
        F.coalesce(F.get("cands", F.lit(0))["text"], F.lit("")).alias("best_text"),
        F.coalesce(F.get("cands", F.lit(0))["engine"], F.lit("")).alias("best_engine"),
        F.coalesce(F.get("cands", F.lit(0))["confidence"], F.lit(0.0)).alias("best_confidence"),
        F.coalesce(F.get("cands", F.lit(0))["composite"], F.lit(0.0)).alias("best_composite_score"),
        F.concat_ws("|", F.transform("cands", lambda c: c["text"])).alias("candidate_texts"),
    )


def _first_of(reads: DataFrame, key: list[Column]) -> DataFrame:
    """First row by read_id for each key, as an aggregate so that copies combine before the shuffle."""
    named = [c.alias(f"_k{i}") for i, c in enumerate(key)]
    rows = reads.select(*named, F.struct(*reads.columns).alias("_row"))
    return (
        rows.groupBy(*[f"_k{i}" for i in range(len(key))])
        .agg(F.min_by("_row", "_row.read_id").alias("_row"))
        .select("_row.*")
    )


def _read_key() -> list[Column]:
    return [
        F.col("evidence_id"),
        F.coalesce("engine", F.lit("")),
        F.coalesce("det_rank", F.lit(0)),
        norm_plate(F.col("text")),
        F.concat_ws(",", *BOX),
    ]


def merge_reads(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows stay as they are; incoming rows come in once, if their key is new."""
    key = _read_key()
    names = [f"_k{i}" for i in range(len(key))]
    keyed = [c.alias(n) for c, n in zip(key, names)]
    seen = existing.select(*keyed).distinct()
    fresh = incoming.select(*keyed, *incoming.columns).join(seen, names, "left_anti").select(*incoming.columns)
    return existing.unionByName(_first_of(fresh, key))


def dedupe_reads(reads: DataFrame) -> DataFrame:
    """Blank texts go; the first of each (text, engine, box) stays."""
    clean = reads.withColumn("text", norm_plate(F.col("text"))).where(F.col("text") != "")
    return _first_of(
        clean, [F.col("evidence_id"), F.col("text"), F.col("engine"), F.concat_ws(",", *BOX)]
    )


def engine_status(runs: DataFrame, reads: DataFrame, idle: dict[str, str], guarded: str) -> DataFrame:
    """Status of every engine for every evidence. `idle` gives each engine's status when it produced
    nothing; the `guarded` engine can also be disabled or have failed."""
    produced = reads.select("evidence_id", "engine").distinct().withColumn("_ran", F.lit(True))
    dim = F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(s).alias("idle")) for e, s in idle.items()])
    grid = runs.withColumn("_e", F.explode(dim)).select("*", "_e.*")
    is_guarded = F.col("engine") == guarded
    ran = F.coalesce("_ran", F.lit(False)) | (F.col("engine") == F.col("selected_engine"))
    return grid.join(produced, ["evidence_id", "engine"], "left").select(
        "evidence_id",
        "engine",
        F.when(is_guarded & F.col("disabled"), "disabled")
        .when(is_guarded & (F.col("error") != ""), "failed")
        .when(ran, "executed")
        .otherwise(F.col("idle"))
        .alias("status"),
    )


def validate_reads(texts: DataFrame, strict: bool = False) -> DataFrame:
    """Validation verdict once per distinct text, with the number of reads behind it."""
    counted = texts.groupBy(spaceless(F.col("text")).alias("text")).agg(F.count(F.lit(1)).alias("reads"))
    v = with_validation(counted, "text", strict=strict)
    return v.select(
        "text",
        "reads",
        "v.pattern",
        "v.valid",
        rnd(F.col("v.score"), 6).alias("score"),
        F.col("v.suspicious").cast("bigint").alias("suspicious"),
        F.concat_ws("; ", "v.issues").alias("issues"),
    )


def validation_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("pattern", "valid").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("reads").alias("reads")
    )


def suggest_corrections(texts: DataFrame, top: int = 3, mode: str = "all_positions") -> DataFrame:
    """Valid readings of invalid texts after swapping confusable characters, best `top` by score.

    `all_positions` swaps every confusable character at once; `neighbours` any one or two of them.
    """
    variants = all_position_variants if mode == "all_positions" else neighbour_variants
    distinct = texts.select(spaceless(F.col("text")).alias("text")).distinct()
    # Only legal shapes have confusables to swap; test the shape before anything costly.
    shaped = distinct.where((validator_pattern(F.col("text")) != "invalid") & (confusable_count(F.col("text")) > 0))
    open_cases = with_validation(shaped, "text").where(~F.col("v.valid"))
    tried = open_cases.select("text", F.posexplode(variants(F.col("text"))).alias("_pos", "suggestion")).where(
        validator_pattern(F.col("suggestion")) != "invalid"
    )
    best = Window.partitionBy("text").orderBy(F.col("score").desc(), "_pos")
    return (
        with_validation(tried, "suggestion").where("v.valid")
        .withColumn("score", rnd(F.col("v.score"), 6))
        .withColumn("rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("rank") <= top)
        .select("text", "rank", "suggestion", "score")
    )


def confidence_level(cases: DataFrame) -> DataFrame:
    """Integrated confidence. `cases`: det_conf, ocr_conf, validation struct, quality, quality_issue, blur."""
    det, ocr = [clamp(F.coalesce(c, F.lit(0.0)), 0.0, 1.0) for c in ("det_conf", "ocr_conf")]
    val, quality = F.col("validation.score"), F.coalesce("quality", F.lit(0.5))
    overall = (
        det * LEVEL_WEIGHTS["detection"]
        + ocr * LEVEL_WEIGHTS["ocr"]
        + val * LEVEL_WEIGHTS["validation"]
        + quality * LEVEL_WEIGHTS["quality"]
    )

    def graded(name: str, value: Column, weak: str, fair: str) -> Column:
        shown = F.format_string("%.2f", rnd(value, 2))
        return F.when(value < 0.5, F.concat(F.lit(f"{name} {weak} ("), shown, F.lit(")"))).when(
            value < 0.7, F.concat(F.lit(f"{name} {fair} ("), shown, F.lit(")"))
        )

    first_issue = F.get("validation.issues", F.lit(0))
    weak_valid = F.col("validation.valid") & (val < 0.7)
    reason = F.concat_ws(
        "; ",
        graded("detecção", det, "fraca", "moderada"),
        graded("OCR", ocr, "fraco", "moderado"),
        F.when(
            ~F.col("validation.valid"),
            F.coalesce(F.concat(F.lit("validação inválida: "), first_issue), F.lit("padrão de placa inválido")),
        ).when(weak_valid, F.concat(F.lit("validação fraca ("), F.format_string("%.2f", rnd(val, 2)), F.lit(")"))),
        F.when(
            weak_valid & (F.col("validation.suspicious") > 0),
            F.concat(F.col("validation.suspicious").cast("string"), F.lit(" chars suspeitos")),
        ),
        F.when(F.col("quality_issue") != "", F.concat(F.lit("qualidade: "), F.col("quality_issue"))).when(
            quality < 0.5, F.concat(F.lit("qualidade fraca (blur="), F.col("blur"), F.lit(")"))
        ),
    )
    level = F.when(overall >= HIGH, "high").when(overall >= MEDIUM, "medium").when(overall >= LOW, "low").otherwise("reject")
    table = F.create_map(*[F.lit(x) for kv in RECOMMENDATION.items() for x in kv])
    return (
        cases.withColumn("overall_confidence", overall)
        .withColumn("confidence_level", level)
        .withColumn("accept", overall >= MEDIUM)
        .withColumn("requires_review", (overall >= LOW) & (overall < HIGH))
        .withColumn("reason", F.when(reason == "", RELIABLE).otherwise(reason))
        .withColumn("recommendation", F.element_at(table, F.col("confidence_level")))
    )


def batch_confidence_stats(scored: DataFrame, *keys: str) -> DataFrame:
    """Totals by level and the mean confidence, overall or per group."""
    level = F.col("confidence_level")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(level == "high").alias("high_confidence"),
        F.count_if(level == "medium").alias("medium_confidence"),
        F.count_if(level == "low").alias("low_confidence"),
        F.count_if(level == "reject").alias("rejected"),
        exact_avg(F.col("overall_confidence")).alias("average_confidence"),
    )


def detection_ocr_join(
    best: DataFrame, detections: DataFrame, image_scores: DataFrame, override_above: float = 30.0
) -> DataFrame:
    """Confidence of every evidence from its best detection, best text and image quality.

    A rejected but valid plate without detections becomes `medium` if its read confidence passes
    `override_above`; the default compares on a 0-100 scale and so never fires on 0-1 input.
    """
    strongest = detections.groupBy("evidence_id").agg(F.max("confidence").alias("_det"))
    joined = (
        best.join(strongest, "evidence_id", "left")
        .join(image_scores, "evidence_id", "left")
        .withColumn("det_conf", F.coalesce("_det", F.lit(0.3)))
        .withColumn("ocr_conf", F.col("best_avg_conf"))
        .withColumn("quality_issue", F.lit(""))
        .withColumn("blur", F.lit("unknown"))
    )
    scored = confidence_level(with_validation(joined, "best_text", out="validation"))
    blank = F.col("best_text") == ""
    lifted = (
        F.col("_det").isNull()
        & (F.col("confidence_level") == "reject")
        & F.col("validation.valid")
        & (F.col("ocr_conf") > override_above)
    )
    return scored.select(
        "evidence_id",
        "best_text",
        F.when(blank, 0.0).otherwise(F.col("overall_confidence")).alias("overall_confidence"),
        F.when(blank, "reject").when(lifted, "medium").otherwise(F.col("confidence_level")).alias("confidence_level"),
        (~blank & F.col("accept")).alias("accept"),
        (~blank & ~lifted & F.col("requires_review")).alias("requires_review"),
        F.when(blank, "Sem resultado de OCR válido").otherwise(F.col("reason")).alias("reason"),
    )


def light_frame_confidence(frames: DataFrame, detections: DataFrame, reads: DataFrame) -> DataFrame:
    """Quick confidence of a frame from its strongest read and its first detection."""
    usable = reads.where(F.length("text") >= 5)
    top = usable.groupBy("evidence_id").agg(
        F.max_by(F.struct("text", "confidence"), F.struct(F.col("confidence"), -F.col("read_id"))).alias("r")
    )
    first = detections.groupBy("evidence_id").agg(
        F.min_by(F.coalesce("confidence", F.lit(0.5)), "det_id").alias("_det")
    )
    joined = (
        frames.join(top, "evidence_id", "left")
        .join(first, "evidence_id", "left")
        .select(
            "evidence_id",
            F.coalesce("r.text", F.lit("")).alias("best_text"),
            F.coalesce("r.confidence", F.lit(0.0)).alias("_conf"),
            F.coalesce("_det", F.lit(0.2)).alias("_det"),
        )
    )
    valid = F.col("v.valid")
    blend = F.col("_conf") * 0.6 + F.col("_det") * 0.4
    return with_validation(joined, "best_text").select(
        "evidence_id",
        "best_text",
        valid.alias("valid"),
        clamp(rnd(blend * F.when(valid, 1.1).otherwise(0.7), 4), 0.0, 1.0).alias("frame_confidence"),
    )
