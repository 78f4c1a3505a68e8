"""Benchmark roll-ups, calibrations and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.functions.numbers import clamp, exact_avg, exact_sum, ratio, rnd
from vestigo.functions.text import matching_blocks_ratio
from vestigo.operators.spread import spread_quantiles
from vestigo.session import stash

# Manifest targets and difficulty classes.
HARD = ("hard", "critical")
TARGETS = ("scene_preprocess", "plate_detector", "ocr_reranking")
KINDS = ("scene", "crop", "pdf")
# Engine calibration.
QUALITY_WEIGHTS = {"match": 0.60, "recall": 0.25, "rank": 0.15}
DELTA_SLOPE, DELTA_CENTRE, DELTA_CAP = 0.28, 0.55, 0.10
WEIGHT_RANGE = (0.55, 1.35)
SUPPORT_RANGE = (5.8, 8.5)
ENSEMBLE_DEFAULTS = {
    "rank_decay_step": 0.22,
    "support_bonus_per_engine": 1.35,
    "single_engine_min_weighted_support": 6.4,
    "pdf_probable_min_weighted_support": 6.6,
}
FACTOR_MIN, FACTOR_MAX = 0.18, 1.0
# Floors and fallbacks of the recommended thresholds.
THRESHOLDS = {
    "confidence_min": ("overall_confidence", 0.55, 0.75, 4),
    "consensus_ratio_min": ("consensus_ratio", 35.0, 50.0, 2),
    "image_quality_min": ("image_quality_score", 0.45, 0.60, 4),
}


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return rnd(part / F.greatest(F.lit(1), whole) * 100.0, places)


# -- manifests ---------------------------------------------------------------------------------


def build_manifests(catalog: DataFrame, core_images: DataFrame) -> DataFrame:
    """Catalog rows by manifest, first per (image, kind). `catalog`: pos, image, kind, expected_text,
    difficulty, targets array; `core_images`: image."""
    named = catalog.join(core_images.select("image").distinct().withColumn("_core", F.lit(True)), "image", "left")
    has = lambda t: F.array_contains("targets", t)
    text = F.col("expected_text") != ""
    raster = F.col("kind") != "pdf"
    readable = has("ocr_reranking") & text
    rules = {
        "scene_preprocess": has("scene_preprocess") & text,
        "plate_detector": has("plate_detector") & raster,
        "ocr_reranking": readable,
        "ocr_reranking_real": readable & raster,
        "ocr_reranking_core_real": readable & raster & F.coalesce("_core", F.lit(False)),
        "ocr_reranking_crops_real": readable & (F.col("kind") == "crop"),
    }
    hard = F.col("difficulty").isin(*HARD)
    tags = [F.when(rule, name) for name, rule in rules.items()]
    tags += [F.when(rule & hard, f"{name}_hard") for name, rule in rules.items()]
    spread = named.withColumn("manifest", F.explode(F.array_compact(F.array(*tags))))
    return spread.groupBy("manifest", "image", "kind").agg(
        F.min_by(F.struct("expected_text", "difficulty", "pos"), "pos").alias("_e")
    ).select("manifest", "image", "kind", "_e.*")


def manifest_summary(manifests: DataFrame, difficulties: list[str]) -> DataFrame:
    level = F.col("difficulty")
    return manifests.groupBy("manifest").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("expected_text") != "").alias("with_expected_text"),
        F.count_if(F.col("kind") == "pdf").alias("pdf_count"),
        *[F.count_if(level == d).alias(f"{d}_count") for d in difficulties],
    )


# -- reading accuracy --------------------------------------------------------------------------


def candidate_rank(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """1-based rank of the expected text among each sample's candidates, -1 if it is not there."""
    found = (
        candidates.join(expected.select("evidence_id", F.col("expected_text").alias("text")), ["evidence_id", "text"])
        .groupBy("evidence_id")
        .agg(F.min("rank").alias("_rank"))
    )
    return expected.join(found, "evidence_id", "left").select(
        "evidence_id", "expected_text", F.coalesce("_rank", F.lit(-1)).cast("bigint").alias("expected_rank")
    )


def ocr_accuracy(samples: DataFrame) -> DataFrame:
    """One-row accuracy report. Samples: expected_text, top_text, matched, expected_rank, weighted_support."""
    n = F.count(F.lit(1))
    hit = F.col("matched")
    top = (F.col("expected_text") != "") & (F.col("top_text") == F.col("expected_text"))
    mean = lambda when: F.coalesce(exact_avg(F.when(when, F.col("weighted_support"))), F.lit(0.0))
    base = samples.agg(
        n.alias("total"),
        F.count_if(hit).alias("matched"),
        F.count_if(top).alias("top_candidate_match_count"),
        F.count("expected_rank").alias("expected_in_top_count"),
        rnd(F.coalesce(exact_avg(F.col("expected_rank")), F.lit(0.0)), 3).alias("avg_expected_rank"),
        rnd(mean(hit), 3).alias("avg_support_matched"),
        rnd(mean(~hit), 3).alias("avg_support_mismatched"),
    )
    median = spread_quantiles(samples, [], "expected_rank", {"_median": 0.5})
    # Two one-row results side by side.
    one = F.lit(1)
    joined = base.withColumn("_one", one).join(median.withColumn("_one", one), "_one", "left").drop("_one")
    return joined.select(
        "total",
        "matched",
        percent(F.col("matched"), F.col("total")).alias("accuracy_percent"),
        "top_candidate_match_count",
        percent(F.col("top_candidate_match_count"), F.col("total")).alias("top_candidate_match_rate_percent"),
        "expected_in_top_count",
        percent(F.col("expected_in_top_count"), F.col("total")).alias("expected_in_top_rate_percent"),
        "avg_expected_rank",
        rnd(F.coalesce("_median", F.lit(0.0)), 3).alias("median_expected_rank"),
        "avg_support_matched",
        "avg_support_mismatched",
    )


def _engine_totals(matches: DataFrame) -> DataFrame:
    return matches.groupBy("engine").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("top_match").alias("top_match"),
        F.count_if("candidate_found").alias("candidate_found"),
        F.coalesce(exact_avg(F.col("candidate_rank")), F.lit(0.0)).alias("mean_rank"),
        F.coalesce(exact_avg(F.col("best_score")), F.lit(0.0)).alias("mean_score"),
        F.coalesce(exact_avg(F.col("avg_conf")), F.lit(0.0)).alias("mean_conf"),
    )


def per_engine_summary(matches: DataFrame) -> DataFrame:
    """Rates, ranks and mean scores by engine."""
    medians = spread_quantiles(matches, ["engine"], "candidate_rank", {"_median": 0.5})
    return _engine_totals(matches).join(medians, "engine", "left").select(
        "engine",
        "total",
        "top_match",
        "candidate_found",
        percent(F.col("top_match"), F.col("total")).alias("top_match_rate_percent"),
        percent(F.col("candidate_found"), F.col("total")).alias("candidate_recall_rate_percent"),
        rnd(F.col("mean_rank"), 3).alias("mean_candidate_rank"),
        rnd(F.coalesce("_median", F.lit(0.0)), 3).alias("median_candidate_rank"),
        rnd(F.col("mean_score"), 2).alias("mean_top_score"),
        rnd(F.col("mean_conf"), 2).alias("mean_top_confidence"),
    )


def engine_calibration(matches: DataFrame, base_weight: float = 1.0) -> DataFrame:
    """New weight and factor range of each engine from its hit rates."""
    t = _engine_totals(matches)
    match = F.col("top_match") / F.col("total")
    recall = F.col("candidate_found") / F.col("total")
    rank = F.when(
        F.col("mean_rank") > 0, clamp(1.2 / F.greatest(F.lit(1.0), F.col("mean_rank")), 0.2, 1.0)
    ).otherwise(1.0)
    quality = match * QUALITY_WEIGHTS["match"] + recall * QUALITY_WEIGHTS["recall"] + rank * QUALITY_WEIGHTS["rank"]
    delta = clamp((quality - DELTA_CENTRE) * DELTA_SLOPE, -DELTA_CAP, DELTA_CAP)
    strong, weak = match >= 0.75, match <= 0.45
    low = F.when(strong, min(1.0, FACTOR_MIN + 0.01)).when(weak, max(0.05, FACTOR_MIN - 0.01)).otherwise(FACTOR_MIN)
    high = F.when(strong, FACTOR_MAX + 0.03).when(weak, FACTOR_MAX - 0.04).otherwise(FACTOR_MAX)
    return t.select(
        "engine",
        rnd(quality, 6).alias("quality"),
        rnd(clamp(F.lit(base_weight) + delta, *WEIGHT_RANGE), 3).alias("weight"),
        rnd(low, 3).alias("factor_min"),
        rnd(high, 3).alias("factor_max"),
    )


def support_thresholds(samples: DataFrame) -> DataFrame:
    """Ensemble thresholds from the support of right, wrong and pdf samples, with their quantiles."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("matched"), F.lit("right")).otherwise("wrong"), F.when(F.col("kind") == "pdf", F.lit("pdf"))
        )
    )
    tagged = samples.select(F.explode(kinds).alias("k"), "weighted_support")
    q = spread_quantiles(tagged, ["k"], "weighted_support", {"p20": 0.20, "p75": 0.75, "p80": 0.80})
    means = tagged.groupBy("k").agg(exact_avg(F.col("weighted_support")).alias("mean"))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    stats = q.join(means, "k").agg(
        pick("right", "p20").alias("floor_right"),
        pick("wrong", "p80").alias("ceiling_wrong"),
        pick("pdf", "p75").alias("pdf_p75"),
        pick("right", "mean").alias("mean_right"),
        pick("wrong", "mean").alias("mean_wrong"),
        F.lit(1).alias("_one"),
    )
    ranks = samples.agg(exact_avg(F.col("expected_rank")).alias("mean_rank"), F.lit(1).alias("_one"))
    d = ENSEMBLE_DEFAULTS
    gap = F.coalesce("mean_right", F.lit(0.0)) - F.coalesce("mean_wrong", F.lit(0.0))
    step, bonus = d["rank_decay_step"], d["support_bonus_per_engine"]
    single, pdf = d["single_engine_min_weighted_support"], d["pdf_probable_min_weighted_support"]
    any_side = F.col("mean_right").isNotNull() | F.col("mean_wrong").isNotNull()
    return stats.join(ranks, "_one").select(
        rnd(
            F.when(
                F.col("mean_rank").isNotNull(), clamp(F.lit(step) + (1.15 - F.col("mean_rank")) * 0.015, 0.16, 0.28)
            ).otherwise(step),
            3,
        ).alias("rank_decay_step"),
        rnd(F.when(any_side, clamp(F.lit(bonus) + gap * 0.12, 1.05, 1.75)).otherwise(bonus), 3).alias(
            "support_bonus_per_engine"
        ),
        # greatest() passes over the side that has no samples.
        rnd(
            F.greatest(
                F.lit(single),
                F.when(F.col("ceiling_wrong").isNotNull(), clamp(F.col("ceiling_wrong") + 0.25, *SUPPORT_RANGE)),
                F.when(F.col("floor_right").isNotNull(), clamp(F.col("floor_right") - 0.15, *SUPPORT_RANGE)),
            ),
            3,
        ).alias("single_engine_min_weighted_support"),
        rnd(
            F.greatest(
                F.lit(pdf), F.when(F.col("pdf_p75").isNotNull(), clamp(F.col("pdf_p75") + 0.15, *SUPPORT_RANGE))
            ),
            3,
        ).alias("pdf_probable_min_weighted_support"),
    )


# -- detector ----------------------------------------------------------------------------------


def detector_summary(results: DataFrame) -> DataFrame:
    scene = F.col("kind") == "scene"
    t = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(scene).alias("scene_total"),
        F.count_if(~scene).alias("crop_total"),
        F.count_if("roi_detected").alias("roi_detected_total"),
        F.count_if("used_full_image").alias("full_image_total"),
        F.count_if(scene & F.col("roi_detected")).alias("_roi"),
        F.count_if(scene & F.col("used_full_image")).alias("_full"),
        exact_sum(F.coalesce("selected_score", F.lit(0.0))).alias("_score"),
        exact_sum(F.coalesce("selected_quality", F.lit(0.0))).alias("_quality"),
    )
    n = F.greatest(F.lit(1), F.col("total"))
    return t.select(
        "total",
        "scene_total",
        "crop_total",
        "roi_detected_total",
        "full_image_total",
        percent(F.col("_roi"), F.col("scene_total")).alias("scene_roi_rate_percent"),
        percent(F.col("_full"), F.col("scene_total")).alias("scene_fallback_rate_percent"),
        rnd(F.col("_score") / n, 2).alias("avg_selected_score"),
        rnd(F.col("_quality") / n, 2).alias("avg_selected_quality"),
    )


def detector_counts(results: DataFrame) -> DataFrame:
    """Counts by source, quality label and kind in one pass over three grouping sets."""
    dims = ["selected_source", "quality_label", "kind"]
    grouped = results.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n")
    )
    name = F.when(F.col("_g") == 3, dims[0]).when(F.col("_g") == 5, dims[1]).otherwise(dims[2])
    value = F.when(F.col("_g") == 3, F.col(dims[0])).when(F.col("_g") == 5, F.col(dims[1])).otherwise(F.col(dims[2]))
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def detector_calibration(results: DataFrame, min_area: float = 4500.0) -> DataFrame:
    scene = F.col("kind") == "scene"
    usable = results.where(
        (F.col("status_code") == 200) & (F.col("aspect") > 0) & ~(scene & F.col("used_full_image"))
    )
    good = usable.where(F.col("selected_quality") > 0)
    one = F.lit(1)
    counts = usable.agg(
        F.count(F.lit(1)).alias("usable"),
        F.count_if(scene).alias("_scene"),
        F.count_if(scene & F.col("roi_detected")).alias("_roi"),
        F.count_if("roi_detected").alias("_any_roi"),
    )
    # Scenes with a region; else all scenes; else everything usable.
    samples = F.when(F.col("_roi") > 0, F.col("_roi")).when(F.col("_scene") > 0, F.col("_scene")).otherwise(F.col("usable"))
    found = F.when(F.col("_scene") > 0, F.col("_roi")).otherwise(F.col("_any_roi"))
    aspect = spread_quantiles(usable, [], "aspect", {"aspect_median": 0.5})
    tolerance = spread_quantiles(good, [], "aspect", {"q_median": 0.5, "p10": 0.1, "p90": 0.9})
    area = spread_quantiles(good.where(F.col("area") > 0), [], "area", {"a15": 0.15})
    joined = counts.withColumn("_one", one)
    for part in (aspect, tolerance, area):
        joined = joined.join(part.withColumn("_one", one), "_one", "left")
    floor = F.when(F.col("a15").isNotNull(), F.least(F.lit(min_area), F.col("a15") * 0.90))
    return joined.select(
        "usable",
        samples.alias("scene_samples"),
        found.alias("scene_roi_detected"),
        percent(found, samples).alias("scene_roi_rate_percent"),
        rnd(F.col("aspect_median"), 3).alias("aspect_target"),
        rnd(F.col("q_median"), 3).alias("quality_aspect_target"),
        rnd(clamp((F.col("p90") - F.col("p10")) / 2.2, 1.0, 2.6), 3).alias("aspect_tolerance"),
        F.bround(clamp(floor, 3000.0, 30000.0), 0).cast("bigint").alias("min_area"),
    )


# -- scene -------------------------------------------------------------------------------------


def scene_summary(results: DataFrame) -> DataFrame:
    """By scenario: accuracy, mean confidence and the variants used, most used first."""
    by_variant = results.groupBy("scenario", "variant").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("matched").alias("hits"),
        exact_sum(F.col("confidence")).alias("conf"),
    )
    used = F.struct((-F.col("n")).alias("neg"), "variant")
    total = F.sum("n")
    return by_variant.groupBy("scenario").agg(
        total.alias("total"),
        F.sum("hits").alias("correct"),
        percent(F.sum("hits"), total).alias("accuracy_percent"),
        rnd(exact_sum(F.col("conf")) / total, 2).alias("avg_confidence"),
        F.concat_ws(
            ",",
            F.transform(
                F.array_sort(F.collect_list(used)),
                lambda v: F.concat(v["variant"], F.lit(":"), (-v["neg"]).cast("string")),
            ),
        ).alias("variants"),
    )


def longest_prefix(name: Column, pool: list[str]) -> Column:
    """Longest known prefix of a variant name; else the part before the first underscore."""
    lowered = F.lower(F.trim(name))
    found = F.substring_index(lowered, "_", 1)
    for prefix in sorted(pool, key=len):
        found = F.when(lowered.startswith(prefix), prefix).otherwise(found)
    return found


def scene_calibration(
    results: DataFrame, profiles: DataFrame, prefixes: list[str], margin: float = 0.75
) -> DataFrame:
    """Margin per scenario and bonuses per family and prefix, in one pass over three grouping sets.

    `profiles` holds current values as (scenario, path, value); a missing one takes the default.
    """
    ready = results.select(
        "scenario",
        F.lower("family").alias("family"),
        longest_prefix(F.col("variant"), prefixes).alias("prefix"),
        "matched",
    )
    s, f, p = F.col("scenario"), F.col("family"), F.col("prefix")
    grains = ready.groupingSets([[s], [s, f], [s, p]], s, f, p).agg(
        F.grouping("family").alias("_gf"),
        F.grouping("prefix").alias("_gp"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("matched").alias("correct"),
    )
    whole = grains.where((F.col("_gf") == 1) & (F.col("_gp") == 1)).select(
        F.col("scenario").alias("_s"), (F.col("correct") / F.col("total")).alias("_overall")
    )
    path = (
        F.when(F.col("_gf") == 0, F.concat(F.lit("family_bonus."), F.col("family")))
        .when(F.col("_gp") == 0, F.concat(F.lit("variant_prefix_bonus."), F.col("prefix")))
        .otherwise("original_margin")
    )
    rate = F.col("correct") / F.col("total")
    now = F.coalesce("value", F.when(F.col("path") == "original_margin", margin).otherwise(0.0))
    margin_new = (
        F.when(rate < 0.8, clamp(now - (0.8 - rate) * 0.45, 0.2, 1.0))
        .when(rate > 0.92, clamp(now + (rate - 0.92) * 0.15, 0.25, 1.0))
        .otherwise(now)
    )
    new = (
        F.when(F.col("_gf") == 0, clamp(now + (rate - F.col("_overall")) * 1.1, -1.5, 2.5))
        .when(F.col("_gp") == 0, clamp(now + (rate - 0.5) * 1.8, -2.0, 5.0))
        .otherwise(margin_new)
    )
    return (
        grains.withColumn("path", path)
        .join(whole, F.col("scenario") == F.col("_s"))
        .drop("_s")
        .join(profiles, ["scenario", "path"], "left")
        .select("scenario", "path", "total", "correct", rnd(new, 3).alias("value"))
    )


# -- video precision ---------------------------------------------------------------------------


def group_precision(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """Precision per quality class and scenario against its target; failed runs do not count.

    `cases`: ok, expected, predicted, quality_class, scenarios array. `targets`: dimension, value, min_precision.
    """
    blank = F.col("expected") == ""
    matched = F.when(blank, F.col("predicted") == "").otherwise(F.col("predicted") == F.col("expected"))
    tags = F.concat(
        F.array(F.struct(F.lit("quality_class").alias("dimension"), F.col("quality_class").alias("value"))),
        F.transform("scenarios", lambda s: F.struct(F.lit("scenario").alias("dimension"), s.alias("value"))),
    )
    tagged = cases.where("ok").select(F.explode(tags).alias("t"), matched.alias("m"), blank.alias("b"))
    named = F.when(F.coalesce("t.value", F.lit("")) == "", "indefinida").otherwise(F.col("t.value"))
    counts = tagged.groupBy(F.col("t.dimension").alias("dimension"), named.alias("value")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("m").alias("matched"), F.count_if("b").alias("unlabelled")
    )
    precision = F.col("matched") / F.col("total")
    target = F.coalesce("min_precision", F.lit(0.0))
    return counts.join(targets, ["dimension", "value"], "left").select(
        "dimension",
        "value",
        "total",
        "matched",
        rnd(precision, 6).alias("precision"),
        target.alias("target_precision"),
        (precision >= target).alias("passed"),
        rnd(F.col("unlabelled") / F.col("total"), 6).alias("unlabelled_share"),
    )


def recommended_thresholds(cases: DataFrame) -> DataFrame:
    """Nearest-rank tenth percentile of labelled true positives, never below the floor."""
    hits = cases.where(F.col("ok") & F.col("matched"))
    stacked = hits.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), F.col(c[0]).alias("v")) for n, c in THRESHOLDS.items()])
        ).alias("s")
    ).select("s.*")
    q = spread_quantiles(stacked, ["name"], "v", {"p10": 0.10}, nearest=True)
    wide = q.agg(
        *[F.max(F.when(F.col("name") == n, F.col("p10"))).alias(n) for n in THRESHOLDS]
    )
    return wide.select(
        *[
            rnd(F.greatest(F.lit(floor), F.coalesce(F.col(n), F.lit(fallback))), places).alias(n)
            for n, (_, floor, fallback, places) in THRESHOLDS.items()
        ]
    )


# -- configurations ----------------------------------------------------------------------------


def case_scores(rows: DataFrame) -> DataFrame:
    """Score of a reading against the expected text: exact, similar (share of matching blocks), confident, plate-like."""
    similarity = F.when(F.col("expected") != "", matching_blocks_ratio(F.col("expected"), F.col("observed"))).otherwise(0.0)
    exact = F.when((F.col("expected") != "") & (F.col("observed") == F.col("expected")), 1.0).otherwise(0.0)
    final = exact * 0.65 + similarity * 0.20 + F.col("confidence") * 0.10 + F.col("pattern") * 0.05
    return rows.withColumn("exact", exact).withColumn("similarity", similarity).withColumn("final", final)


def config_summary(scored: DataFrame) -> DataFrame:
    """Rates per configuration, by segment and over all segments. The scores are stored, as several passes read them."""
    scored = stash(scored.select("config", "segment", "exact", "similarity", "confidence", "final"), "config-scores")
    means = {"exact": "exact_rate", "similarity": "avg_similarity", "confidence": "avg_confidence", "final": "avg_score"}
    # Exact sums add up, so all segments are the sum of each and rows are summed once.
    parts = scored.groupBy("config", "segment").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(m).cast("decimal(28,12)")).alias(f"_sum_{m}") for m in means],
        *[F.count(m).alias(f"_told_{m}") for m in means],
    )
    c, s = F.col("config"), F.col("segment")
    mean = lambda m: F.sum(f"_sum_{m}").cast("double") / F.sum(f"_told_{m}")
    sums = parts.groupingSets([[c, s], [c]], c, s).agg(
        F.grouping("segment").alias("_all"),
        F.sum("_n").alias("n"),
        *[rnd(mean(m), 4).alias(a) for m, a in means.items()],
    ).withColumn("segment", F.when(F.col("_all") == 1, "all").otherwise(F.col("segment"))).drop("_all")
    by_segment = spread_quantiles(scored, ["config", "segment"], "final", {"_m": 0.5})
    overall = spread_quantiles(scored, ["config"], "final", {"_m": 0.5}).withColumn("segment", F.lit("all"))
    medians = by_segment.unionByName(overall)
    return sums.join(medians, ["config", "segment"], "left").withColumn("median_score", rnd(F.col("_m"), 4)).drop("_m")


def config_selection(scored: DataFrame) -> DataFrame:
    """Best configuration per segment by score, exact rate, similarity (ties: first name)."""
    order = F.struct(
        (-F.col("avg_score")).alias("a"), (-F.col("exact_rate")).alias("b"), (-F.col("avg_similarity")).alias("c"), "config"
    )
    return config_summary(scored).groupBy("segment").agg(
        F.min_by("config", order).alias("best_config"),
        F.max("avg_score").alias("best_score"),
        F.count(F.lit(1)).alias("configs"),
    )


# -- suites and gates --------------------------------------------------------------------------


def suite_rollup(jobs: DataFrame) -> DataFrame:
    """Jobs, ok, failed and time, by group and by benchmark, in one pass."""
    g, b = F.col("job_group"), F.col("benchmark")
    rolled = jobs.groupingSets([[g], [b]], g, b).agg(
        F.grouping("benchmark").alias("_g"),
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        rnd(exact_sum(F.coalesce("duration_sec", F.lit(0.0))), 3).alias("duration_sec"),
    )
    by_group = F.col("_g") == 1
    return rolled.select(
        F.when(by_group, "group").otherwise("benchmark").alias("level"),
        F.when(by_group, F.col("job_group")).otherwise(F.col("benchmark")).alias("name"),
        "jobs",
        "ok",
        "failed",
        "duration_sec",
    )


def job_metrics(samples: DataFrame, job: str) -> DataFrame:
    """Long (job, metric, value) rows from per-sample results."""
    wide = samples.groupBy(F.col(job).alias("job")).agg(
        percent(F.count_if("matched"), F.count(F.lit(1))).alias("summary.accuracy_percent"),
        rnd(exact_avg(F.col("weighted_support")), 4).alias("summary.avg_weighted_support"),
    )
    return wide.unpivot(["job"], ["`summary.accuracy_percent`", "`summary.avg_weighted_support`"], "metric", "value").withColumn(
        "metric", F.regexp_replace("metric", "`", "")
    )


def regression_gate(jobs: DataFrame, metrics: DataFrame, policy: DataFrame, baseline: DataFrame) -> DataFrame:
    """Checks of every job: status, absolute bounds, drop against the baseline.

    A metric or baseline that is missing fails its check. `policy`: job, metric, min, max, max_drop.
    """
    status = jobs.select(
        "job",
        F.lit("job_status_ok").alias("check"),
        (F.col("status") == "ok").alias("passed"),
        F.lit(None).cast("double").alias("actual"),
        F.lit(None).cast("double").alias("expected"),
    )
    known = jobs.select("job").join(policy, "job")
    base_jobs = baseline.select("job").distinct().withColumn("_base_job", F.lit(True))
    wide = (
        known.join(metrics.withColumnRenamed("value", "actual"), ["job", "metric"], "left")
        .join(baseline.withColumnRenamed("value", "base"), ["job", "metric"], "left")
        .join(base_jobs, "job", "left")
    )
    metric, actual = F.col("metric"), F.col("actual")
    drop = F.col("base") - actual
    null = F.lit(None).cast("double")

    def check(name: Column, passed: Column, got: Column, want: Column) -> Column:
        return F.struct(name.alias("check"), passed.alias("passed"), got.alias("actual"), want.alias("expected"))

    here = actual.isNotNull()
    has_drop = here & F.col("max_drop").isNotNull()
    made = F.array_compact(
        F.array(
            F.when(~here, check(metric, F.lit(False), null, null)),
            F.when(
                here & F.col("min").isNotNull(),
                check(F.concat(metric, F.lit(":min")), actual >= F.col("min"), actual, F.col("min")),
            ),
            F.when(
                here & F.col("max").isNotNull(),
                check(F.concat(metric, F.lit(":max")), actual <= F.col("max"), actual, F.col("max")),
            ),
            F.when(
                has_drop & F.col("_base_job").isNull(),
                check(F.concat(metric, F.lit(":baseline_present")), F.lit(False), null, null),
            ),
            F.when(
                has_drop & F.col("_base_job").isNotNull() & F.col("base").isNull(),
                check(F.concat(metric, F.lit(":baseline_metric_present")), F.lit(False), null, null),
            ),
            F.when(
                has_drop & F.col("base").isNotNull(),
                check(
                    F.concat(metric, F.lit(":max_drop_vs_baseline")),
                    drop <= F.col("max_drop"),
                    rnd(drop, 4),
                    F.col("max_drop"),
                ),
            ),
        )
    )
    return status.unionByName(wide.select("job", F.explode(made).alias("_c")).select("job", "_c.*"))


def gate_rollup(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Per run: executed, checks made and passed, gate verdict (no checks passes), readiness."""
    counted = checks.groupBy("job").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("passed").alias("_p"), F.bool_and("passed").alias("_all")
    )
    passed = F.coalesce("_all", F.lit(True))
    executed = F.col("status") == "ok"
    return runs.join(counted, "job", "left").select(
        "job",
        executed.alias("executed"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("checks_count"),
        F.coalesce("_p", F.lit(0)).cast("bigint").alias("checks_passed"),
        passed.alias("gate_passed"),
        F.when(executed & passed, "READY_FOR_PRODUCTION").otherwise("REQUIRES_REVIEW").alias("readiness"),
    )


def battery_summary(cases: DataFrame, *keys: str) -> DataFrame:
    """Accuracy over valid cases and their mean time."""
    valid = F.col("error") == ""
    t = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(valid).alias("valid_cases"),
        F.count_if(valid & F.col("matched")).alias("matched_cases"),
        exact_sum(F.when(valid, F.coalesce("elapsed_seconds", F.lit(0.0))).otherwise(0.0)).alias("_time"),
    )
    return t.select(
        *keys,
        "total_cases",
        "valid_cases",
        "matched_cases",
        percent(F.col("matched_cases"), F.col("valid_cases"), 1).alias("accuracy_percent"),
        rnd(F.col("_time") / F.greatest(F.lit(1), F.col("valid_cases")), 2).alias("average_elapsed_seconds"),
    )


def battery_gate(summary: DataFrame, baseline: DataFrame, limits: dict[str, float], key: str) -> DataFrame:
    """Checks of a battery summary per key, with drops against the baseline of the same key."""
    base = baseline.select(
        key, F.col("accuracy_percent").alias("_acc"), F.col("matched_cases").alias("_hit"), F.lit(True).alias("_has")
    )
    acc, hit, secs = F.col("accuracy_percent"), F.col("matched_cases"), F.col("average_elapsed_seconds")
    acc_drop, hit_drop = rnd(F.col("_acc") - acc, 2), F.col("_hit") - hit

    def check(name: str, limit: str, ok: Column, got: Column, when: Column | None = None) -> Column | None:
        if limit not in limits:
            return None
        made = F.struct(
            F.lit(name).alias("check"),
            ok.alias("passed"),
            got.cast("double").alias("actual"),
            F.lit(float(limits[limit])).alias("expected"),
        )
        return made if when is None else F.when(when, made)

    has = F.col("_has")
    checks = [
        check("min_accuracy_percent", "min_accuracy", acc >= limits.get("min_accuracy", 0), rnd(acc, 2)),
        check("min_matched_cases", "min_matched", hit >= limits.get("min_matched", 0), hit),
        check("max_average_elapsed_seconds", "max_average_seconds", secs <= limits.get("max_average_seconds", 0), secs),
        check("max_accuracy_drop_percent", "max_accuracy_drop", acc_drop <= limits.get("max_accuracy_drop", 0), acc_drop, has),
        check("max_matched_drop_cases", "max_matched_drop", hit_drop <= limits.get("max_matched_drop", 0), hit_drop, has),
    ]
    made = F.array_compact(F.array(*[c for c in checks if c is not None]))
    return summary.join(base, key, "left").select(key, F.explode(made).alias("_c")).select(key, "_c.*")


# -- timings and comparisons -------------------------------------------------------------------


def latency_summary(spans: DataFrame) -> DataFrame:
    """By stage: count, errors, mean, quantiles and share of all time."""
    stages = spans.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        exact_sum(F.col("duration_ms")).alias("_sum"),
    )
    q = spread_quantiles(spans, ["stage"], "duration_ms", {"p50": 0.50, "p90": 0.90, "p99": 0.99})
    whole = F.sum("_sum").over(Window.partitionBy())  # a handful of stage rows
    return stages.withColumn("_whole", whole).join(q, "stage").select(
        "stage",
        "n",
        "errors",
        rnd(F.col("_sum") / F.col("n"), 4).alias("mean_ms"),
        *[rnd(F.col(p), 4).alias(f"{p}_ms") for p in ("p50", "p90", "p99")],
        rnd(ratio(F.col("_sum"), F.col("_whole")), 6).alias("share"),
    )


def run_comparison(timings: DataFrame, base: str, other: str, tie: float = 0.05) -> DataFrame:
    """Mean time of two variants per job, their ratio and the winner."""
    means = timings.groupBy("job").agg(
        exact_avg(F.when(F.col("variant") == base, F.col("ms"))).alias("base_ms"),
        exact_avg(F.when(F.col("variant") == other, F.col("ms"))).alias("other_ms"),
    )
    b, o = F.col("base_ms"), F.col("other_ms")
    speed = o / b
    winner = (
        F.when(b.isNull() & o.isNull(), "")
        .when(o.isNull(), base)
        .when(b.isNull(), other)
        .when(F.abs(speed - 1.0) < tie, "tie")
        .when(speed < 1.0, other)
        .otherwise(base)
    )
    return means.select(
        "job", rnd(b, 4).alias("base_ms"), rnd(o, 4).alias("other_ms"), rnd(speed, 3).alias("ratio"), winner.alias("winner")
    )


def audit_rollup(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows of event time; works on a stream and on a table."""
    return log.groupBy(F.window("event_time", width), "event_type").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").alias("window_start"), "event_type", "events"
    )


def merge_calibration(defaults: DataFrame, loaded: DataFrame, caps: DataFrame) -> DataFrame:
    """Loaded values over defaults; weights of disabled engines capped. Tables are (scope, path, value);
    `caps` lists (scope, path, cap) of what is disabled, a missing cap meaning 0.35."""
    merged = defaults.withColumnRenamed("value", "_d").join(
        loaded.withColumnRenamed("value", "_l"), ["scope", "path"], "full_outer"
    )
    cap = clamp(F.coalesce("cap", F.lit(0.35)), 0.1, 1.0)
    limited = caps.select("scope", "path", cap.alias("_cap"))
    now = F.coalesce("_l", "_d")
    return merged.join(limited, ["scope", "path"], "left").select(
        "scope",
        "path",
        F.when(now > F.col("_cap"), rnd(F.col("_cap"), 4)).otherwise(now).alias("value"),
        F.col("_l").isNotNull().alias("overridden"),
        F.coalesce(now > F.col("_cap"), F.lit(False)).alias("capped"),
    )
