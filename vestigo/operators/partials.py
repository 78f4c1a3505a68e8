"""Partial-plate evidence: fragments gathered from every reader, ranked, and matched to case plates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.functions.numbers import exact_sum, rnd
from vestigo.functions.plates import (
    fragment_kind,
    fragment_priority,
    keep_fragment,
    norm_fragment,
    slot_hint,
)
from vestigo.functions.times import minute_index, minute_range
from vestigo.operators.spread import gathered, settle, within
from vestigo.session import stash

# Region words that mean the whole scene; caps.
SCENE_WORDS = ("raw_input", "full_image", "scene", "ocr_result", "whole_image")
FRAGMENT_CAP, OVERVIEW_CAP, VIDEO_CAP = 8, 4, 24
# Evidence ids that may be broadcast.
LIST_ROWS = 500_000


def _scene_region(region: Column) -> Column:
    lowered = F.lower(F.coalesce(region, F.lit("")))
    hit = F.lit(False)
    for word in SCENE_WORDS:
        hit = hit | lowered.contains(word)
    return hit


def _scene_word(text: Column, region: Column) -> Column:
    """A long, purely alphabetic word read from the whole scene is a sign, not a plate."""
    return _scene_region(region) & (F.length(text) >= 4) & text.rlike("^\\p{L}+$")


def _non_zero(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit(0.0)) for o in options])


def _text_or(c: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), other)


def partial_sources(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every usable fragment of an evidence.

    `results`: one row per engine result with raw_entries (word, conf, region, origin), text, chars
    (char, conf). `candidates`: short texts already fused. Single characters count only where an
    evidence has nothing else.
    """
    one = F.lit(1)
    plain = results.withColumn("avg_conf", F.coalesce("avg_conf", F.lit(0.0))).withColumn("score", F.coalesce("score", F.lit(0.0)))
    # one look at the results: their entries or, where they have none, the whole text as an entry that is null
    is_whole = F.size("raw_entries") <= 0
    nothing = F.array(F.lit(None).cast(results.schema["raw_entries"].dataType.elementType))
    entries = plain.select(
        "evidence_id",
        "engine",
        "avg_conf",
        "score",
        F.coalesce("region", F.lit("")).alias("_region"),
        F.when(is_whole, F.col("text")).alias("_text"),
        is_whole.alias("_whole"),
        F.explode_outer(F.when(is_whole, nothing).otherwise(F.col("raw_entries"))).alias("e"),
    )
    read = entries.select(
        "evidence_id",
        norm_fragment(F.when(F.col("_whole"), F.col("_text")).otherwise(F.col("e.word"))).alias("text"),
        "engine",
        _text_or(F.col("e.region"), F.col("_region")).alias("_r"),
        F.when(F.col("_whole"), "engine_text").otherwise(_text_or(F.col("e.origin"), F.lit("raw_entry"))).alias("origin"),
        F.coalesce(_non_zero(F.col("e.conf")), F.col("avg_conf")).alias("conf"),
        "score",
        F.when(F.col("_whole"), "engine_text").otherwise("raw_entry").alias("source_type"),
        one.alias("_support"),
    )
    short = candidates.select(
        "evidence_id",
        norm_fragment(F.col("text")).alias("text"),
        _text_or(F.col("engine"), F.lit("ensemble")).alias("engine"),
        F.coalesce("region", F.lit("")).alias("_r"),
        F.lit("top_candidate").alias("origin"),
        F.coalesce("avg_conf", F.lit(0.0)).alias("conf"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.lit("top_candidate").alias("source_type"),
        F.coalesce("support_count", one).alias("_support"),
    )
    pooled = settle(read.unionByName(short), "text")
    t, support = F.col("text"), F.col("_support")
    named_region = F.when(F.col("source_type") == "top_candidate", F.col("_r")).otherwise(_text_or(F.col("_r"), F.lit("ocr_result")))
    usable = (t != "") & (F.length(t) <= 6) & ~_scene_word(t, F.col("_r")) & keep_fragment(t, F.col("conf"), support, support)
    flagged = pooled.withColumn("region", named_region).withColumn("_kept", F.coalesce(usable, F.lit(False)))
    fields = ["text", "engine", "origin", "conf", "score", "source_type", "region"]
    # the others stay as blank rows, which tell the evidence without fragments
    blanked = settle(flagged, "_kept").select("evidence_id", *[F.when(F.col("_kept"), F.col(c)).alias(c) for c in fields], "_kept")
    pieces = stash(blanked, "partial-kept", "zstd")
    kept = pieces.where("_kept").drop("_kept")
    # Evidence with fragments is left out before its characters are taken apart.
    told = stash(pieces.groupBy("evidence_id").agg(F.max("_kept").alias("_told")), "partial-told")
    known = told.where("_told").select("evidence_id")
    silent = told.where("NOT _told OR evidence_id IS NULL").select(F.col("evidence_id").alias("_silent"))
    lonely = plain.where(~_scene_region(F.col("region"))).select("evidence_id", "engine", "region", "chars")
    if known.count() > LIST_ROWS >= silent.count():  # the shorter list spares the results a shuffle
        lonely = lonely.join(F.broadcast(silent), F.col("evidence_id").eqNullSafe(F.col("_silent")), "left_semi")
    else:
        lonely = lonely.join(known, "evidence_id", "left_anti")
    chars = lonely.select("evidence_id", "engine", "region", F.explode("chars").alias("c"))
    single = chars.select(
        "evidence_id",
        norm_fragment(F.col("c.char")).alias("text"),
        "engine",
        F.lit("char_option").alias("origin"),
        F.coalesce("c.conf", F.lit(0.0)).alias("conf"),
        F.coalesce("c.conf", F.lit(0.0)).alias("score"),
        F.lit("char_option").alias("source_type"),
        _text_or(F.col("region"), F.lit("chars")).alias("region"),
    ).where((F.length("text") == 1) & (F.col("conf") > 0))
    return kept.unionByName(single)


def _sorted_set(name: str) -> Column:
    return F.array_sort(F.collect_set(F.nullif(F.trim(F.col(name)), F.lit(""))))


def _support_label() -> Column:
    return F.format_string("%d motor(es) | %d leitura(s)", "support_count", "source_count")


def partial_candidates(sources: DataFrame, cap: int | None = FRAGMENT_CAP) -> DataFrame:
    """Fragments of each evidence with their backing, best `cap` (all for None)."""
    n = F.count(F.lit(1))
    grouped = gathered(sources, "evidence_id").groupBy("evidence_id", "text").agg(
        n.alias("source_count"),
        _sorted_set("engine").alias("engines"),
        _sorted_set("region").alias("regions"),
        _sorted_set("origin").alias("origins"),
        F.max("conf").alias("_best"),
        F.max("score").alias("_score"),
        (exact_sum(F.col("conf")) / n).alias("_avg"),
    )
    backed = grouped.withColumn("support_count", F.size("engines").cast("bigint"))
    t, best = F.col("text"), F.greatest(F.lit(0.0), F.col("_best"))
    support, count = F.col("support_count"), F.col("source_count")
    kept = backed.where(keep_fragment(t, best, support, count)).select(
        "evidence_id",
        "text",
        F.length(t).cast("bigint").alias("fragment_length"),
        fragment_kind(t).alias("fragment_kind"),
        slot_hint(t).alias("slot_hint"),
        "support_count",
        "source_count",
        rnd(F.col("_avg"), 2).alias("avg_confidence"),
        rnd(best, 2).alias("best_confidence"),
        rnd(F.greatest(F.lit(0.0), F.col("_score")), 2).alias("best_score"),
        rnd(best + support * 9.0 + count * 3.0, 2).alias("score"),
        fragment_priority(t, best, support, count).alias("rank_priority"),
        "engines",
        "regions",
        "origins",
    )
    best_first = Window.partitionBy("evidence_id").orderBy(
        F.col("rank_priority").desc(),
        F.col("support_count").desc(),
        F.col("best_confidence").desc(),
        F.col("avg_confidence").desc(),
        "fragment_length",
        "text",
    )
    return kept.withColumn("rank", F.row_number().over(best_first).cast("bigint")).where(within(F.col("rank"), cap))


def partial_overview(candidates: DataFrame, limit: int | None = OVERVIEW_CAP) -> DataFrame:
    """Count, leading fragment and a one-line summary per evidence."""
    shown = F.concat(F.col("text"), F.lit(" ("), _support_label(), F.lit(")"))
    tops = F.collect_list(F.when(within(F.col("rank"), limit), F.struct("rank", shown.alias("s"))))
    return candidates.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("fragments"),
        F.min_by("text", "rank").alias("primary_text"),
        F.concat_ws("; ", F.transform(F.array_sort(tops), lambda x: x["s"])).alias("summary"),
    )


def video_partials(items: DataFrame, cap: int | None = VIDEO_CAP, sizes: DataFrame | None = None) -> DataFrame:
    """Fragments of all frames of a video grouped by text, minute and shape, best `cap`.

    `items`: video_id, frame_index, frame_order, timestamp_seconds and the fields of a fragment. `sizes` may give
    the number of items per video_id, or more, as `_rows`; without it they are counted.
    """
    ready = items.select(
        "video_id",
        "frame_index",
        "frame_order",
        "timestamp_seconds",
        norm_fragment(F.col("text")).alias("text"),
        "engines",
        F.coalesce(_non_zero(F.col("best_confidence"), F.col("avg_confidence")), F.lit(0.0)).alias("conf"),
        F.coalesce(_non_zero(F.col("best_score"), F.col("score")), F.lit(0.0)).alias("score"),
        F.greatest(F.lit(1), F.coalesce("source_count", F.lit(1))).alias("source_count"),
        F.coalesce("rank_priority", F.lit(0.0)).alias("priority"),
    ).where(F.col("text") != "")
    if sizes is None:
        sizes = items.groupBy("video_id").agg(F.count(F.lit(1)).alias("_rows"))
    minute = minute_index(F.col("timestamp_seconds"))
    dealt = gathered(ready, "video_id", "text", minute, sizes=sizes).withColumn("minute_index", minute)
    # Equal texts have equal shapes, so the groups need none. One sort serves all their windows.
    group = Window.partitionBy("video_id", "text", "minute_index")
    by_frame = group.orderBy("frame_index")
    another = F.col("frame_index").isNotNull() & ~F.col("frame_index").eqNullSafe(F.lag("frame_index").over(by_frame))
    marked = dealt.select("*", another.cast("int").alias("_another"), F.row_number().over(by_frame).alias("_place"))
    count = F.sum("source_count").over(group)
    best_read = F.max_by(F.struct("frame_index", "timestamp_seconds"), F.struct(F.col("conf"), F.col("score"), -F.col("frame_order")))
    summed = marked.select(
        "video_id",
        "text",
        "minute_index",
        "_place",
        count.alias("source_count"),
        # Engine lists are few and short, so their set stays small however many rows there are.
        F.collect_set("engines").over(group).alias("_engines"),
        F.max("conf").over(group).alias("_best"),
        F.max("score").over(group).alias("_score"),
        F.sum(F.col("conf").cast("decimal(28,12)")).over(group).alias("_conf"),
        F.max("priority").over(group).alias("_priority"),
        F.sum("_another").over(group).alias("frames_count"),
        best_read.over(group).alias("b"),
        F.min("frame_order").over(group).alias("_first"),
    ).where("_place = 1")
    grouped = (
        summed.withColumn("engines", F.array_sort(F.array_distinct(F.flatten("_engines"))))
        .withColumn("support_count", F.size("engines").cast("bigint"))
        .withColumn("_avg", F.col("_conf").cast("double") / F.col("source_count"))
    )
    t, best = F.col("text"), F.greatest(F.lit(0.0), F.col("_best"))
    support, sources = F.col("support_count"), F.col("source_count")
    kept = grouped.where(keep_fragment(t, best, support, sources)).select(
        "video_id",
        "text",
        "minute_index",
        "support_count",
        "source_count",
        "frames_count",
        rnd(F.col("_avg"), 2).alias("avg_confidence"),
        rnd(best, 2).alias("best_confidence"),
        best.alias("_best"),
        "_score",
        F.greatest(rnd(F.col("_priority"), 4), fragment_priority(t, best, support, sources)).alias("rank_priority"),
        "b",
        "engines",
        "_first",
    )
    best_first = Window.partitionBy("video_id").orderBy(
        F.col("rank_priority").desc(),
        F.col("support_count").desc(),
        F.col("best_confidence").desc(),
        F.col("avg_confidence").desc(),
        F.col("frames_count").desc(),
        F.length("text"),
        "_first",
        "text",
    )
    ranked = kept.withColumn("rank", F.row_number().over(best_first).cast("bigint")).where(within(F.col("rank"), cap))
    # what follows from the others is made of those that are shown
    return ranked.withColumn("slot_hint", slot_hint(t)).select(
        "video_id",
        F.left(F.sha1(F.concat_ws("|", "text", "minute_index", "slot_hint")), F.lit(16)).alias("candidate_id"),
        "text",
        "minute_index",
        minute_range(F.col("minute_index")).alias("minute_range"),
        "slot_hint",
        "support_count",
        "source_count",
        "frames_count",
        "avg_confidence",
        "best_confidence",
        rnd(F.greatest(F.lit(0.0), F.col("_score")), 2).alias("best_score"),
        rnd(F.col("_best") + support * 9.0 + sources * 3.0, 2).alias("score"),
        "rank_priority",
        F.col("b.frame_index").alias("frame_index"),
        F.col("b.timestamp_seconds").alias("timestamp_seconds"),
        F.concat_ws(",", "engines").alias("engines"),
        "rank",
    )


def partial_match(fragments: DataFrame, plates: DataFrame, cap: int | None = None) -> DataFrame:
    """Plates of the same case that contain a fragment of one to six characters, with the position.

    Where an evidence has `cap` fragments at most, its plates meet them by the evidence alone. Without a cap each
    plate is cut into its runs of one to six characters, which meet the fragments by equality. Equal characters
    have equal shapes, so the match also honours the slot hint.
    """
    cases = plates.select("evidence_id", F.col("text").alias("plate")).distinct()
    wanted = fragments.select("evidence_id", F.col("text").alias("fragment")).where(F.length("fragment").between(1, 6)).distinct()
    if cap is not None:
        plate, fragment = F.col("plate"), F.col("fragment")
        met = cases.join(wanted, "evidence_id").withColumn("position", F.instr(plate, fragment)).where("position > 0")
        size = F.length(fragment)
        again = F.instr(F.substring(plate, F.col("position") + 1, F.length(plate)), fragment) > 0
        places = F.filter(F.sequence(F.col("position"), F.length(plate)), lambda at: F.substring(plate, at, size) == fragment)
        return met.select(
            "evidence_id",
            "fragment",
            "plate",
            F.col("position").cast("bigint").alias("position"),
            F.when(again, F.size(places)).otherwise(1).cast("bigint").alias("occurrences"),
        )
    starts = F.sequence(F.lit(1), F.length("plate"))
    cut = cases.where(F.length("plate") > 0).withColumn("position", F.explode(starts))
    sizes = F.sequence(F.lit(1), F.least(F.lit(6), F.length("plate") - F.col("position") + 1))
    grams = cut.withColumn("_n", F.explode(sizes)).select(
        "evidence_id",
        "plate",
        F.col("position").cast("bigint").alias("position"),
        F.substring(F.col("plate"), F.col("position"), F.col("_n")).alias("fragment"),
    )
    return grams.join(wanted, ["evidence_id", "fragment"]).groupBy("evidence_id", "fragment", "plate").agg(
        F.min("position").alias("position"), F.count(F.lit(1)).alias("occurrences")
    )
