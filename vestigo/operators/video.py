"""Video time series: frame choice, candidates by minute, tracks, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.functions.geometry import BOX
from vestigo.functions.numbers import exact_avg, exact_sum, rnd
from vestigo.functions.plates import norm_fragment
from vestigo.functions.times import minute_index, minute_range, timecode
from vestigo.operators.boxes import BoxIndex
from vestigo.operators.ordered import ordered_fold
from vestigo.operators.spread import spread_rank, within

# Exposure, sampling, election and tracking.
MID_LUMA, MAX_PENALTY = 128.0, 0.7
SKIP_FIRST, SKIP_LAST = 0.04, 0.02
TEXT_BOOST = 0.10
TRACK_IOU = 0.4
CANDIDATE_CAP = 24


def frame_quality() -> Column:
    penalty = F.abs(F.col("luma") - MID_LUMA) / MID_LUMA
    return F.col("sharpness") * (1.0 - F.least(F.lit(MAX_PENALTY), penalty))


def frame_quality_topk(frames: DataFrame, k: int = 12) -> DataFrame:
    """The k best frames of each video by sharpness and exposure; pruned before the shuffle."""
    scored = frames.withColumn("frame_quality", frame_quality())
    w = Window.partitionBy("video_id").orderBy(F.col("frame_quality").desc(), "frame_index")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def sharpest_in_burst(frames: DataFrame) -> DataFrame:
    """Sharpest frame of each burst; the first wins a tie."""
    return frames.groupBy("video_id", "burst").agg(
        F.max_by("frame_index", F.struct(F.col("sharpness"), -F.col("frame_index"))).alias("frame_index"),
        F.max("sharpness").alias("sharpness"),
    )


def sample_frames(frames: DataFrame, max_frames: int = 12, bucket: Column | None = None) -> DataFrame:
    """Evenly spaced frames of each video, without its first 4 % and last 2 %.

    Frames are numbered from 0 in index order; `bucket` ascends with the frame index.
    """
    numbered = spread_rank(
        frames.select("video_id", "frame_index"),
        ["video_id"],
        bucket if bucket is not None else F.floor(F.col("frame_index") / 1000),
        [F.col("frame_index")],
        "_n",
    ).withColumn("position", F.col("_n") - 1)
    n = F.col("frame_count")
    last = n - 1
    begin = F.bround(n * SKIP_FIRST, 0).cast("bigint")
    end = F.bround(n * (1.0 - SKIP_LAST), 0).cast("bigint") - 1
    first = F.greatest(F.lit(0), F.least(begin, last))
    final = F.greatest(first, F.least(end, last))
    flat = final <= first
    lo, hi = F.when(flat, 0).otherwise(first), F.when(flat, last).otherwise(final)
    step = (hi - lo) / F.lit(max(1, max_frames - 1)).cast("double")
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(max_frames - 1)),
        lambda i: F.when(i == max_frames - 1, hi).otherwise(F.floor(i * step + lo)),
    )
    whole = F.sequence(F.lit(0).cast("bigint"), last)
    picks = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frame_count")).select(
        "video_id", F.explode(F.array_distinct(F.when(n <= max_frames, whole).otherwise(spaced))).alias("position")
    )
    return numbered.join(picks, ["video_id", "position"]).select("video_id", "position", "frame_index")


def video_candidates(frames: DataFrame, cap: int | None = CANDIDATE_CAP) -> DataFrame:
    """Readings grouped by text, pattern and minute of the video, ranked, best `cap` per video.

    `frames`: video_id, frame_index, frame_order, timestamp_seconds, ocr, pattern, confidence, score,
    style_rank_priority.
    """
    text = norm_fragment(F.col("ocr"))
    pattern = F.when(F.trim(F.coalesce("pattern", F.lit(""))) == "", "Indefinido").otherwise(F.trim("pattern"))
    ready = frames.where(F.trim(F.coalesce("ocr", F.lit(""))) != "").select(
        "video_id",
        text.alias("text"),
        pattern.alias("pattern"),
        minute_index(F.col("timestamp_seconds")).alias("minute_index"),
        "frame_index",
        "frame_order",
        "timestamp_seconds",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("style_rank_priority", F.lit(0.0)).alias("style"),
    )
    # A frame without confidence and score is counted but is never the best one.
    worthy = (F.col("confidence") > 0) | ((F.col("confidence") == 0) & (F.col("score") > 0))
    order = F.when(worthy, F.struct(F.col("confidence"), F.col("score"), -F.col("frame_order")))
    n = F.count(F.lit(1))
    grouped = ready.groupBy("video_id", "text", "pattern", "minute_index").agg(
        n.alias("frames_count"),
        F.max_by(F.struct("frame_index", "timestamp_seconds", "confidence", "score", "style"), order).alias("b"),
        rnd(exact_sum(F.col("confidence")) / n, 2).alias("avg_confidence"),
        rnd(exact_sum(F.col("score")) / n, 2).alias("avg_score"),
        F.min("frame_order").alias("first_order"),
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
    )
    key = F.concat_ws("|", "text", "pattern", "minute_index")
    named = grouped.select(
        "video_id",
        F.left(F.sha1(key), F.lit(16)).alias("candidate_id"),
        "text",
        "pattern",
        "minute_index",
        minute_range(F.col("minute_index")).alias("minute_range"),
        "frames_count",
        rnd(F.coalesce("b.confidence", F.lit(0.0)), 2).alias("best_confidence"),
        rnd(F.coalesce("b.score", F.lit(0.0)), 2).alias("best_score"),
        "avg_confidence",
        "avg_score",
        rnd(F.coalesce("b.style", F.lit(0.0)), 3).alias("style_rank_priority"),
        F.coalesce("b.frame_index", F.lit(0)).alias("frame_index"),
        F.coalesce("b.timestamp_seconds", F.lit(0.0)).alias("timestamp_seconds"),
        "first_order",
        "first_frame",
        "last_frame",
    )
    best_first = Window.partitionBy("video_id").orderBy(
        F.col("frames_count").desc(),
        F.col("style_rank_priority").desc(),
        F.col("best_confidence").desc(),
        F.col("best_score").desc(),
        "timestamp_seconds",
        "first_order",
        "candidate_id",
    )
    return (
        named.withColumn("rank", F.row_number().over(best_first).cast("bigint"))
        .where(within(F.col("rank"), cap))
        .drop("first_order")
        .withColumn("label", F.concat_ws(" | ", "minute_range", "text", "pattern"))
    )


def candidate_frames(frames: DataFrame) -> DataFrame:
    """The frames behind each candidate as rows: distinct (video, text, pattern, minute, frame)."""
    return (
        frames.where(F.trim(F.coalesce("ocr", F.lit(""))) != "")
        .select(
            "video_id",
            norm_fragment(F.col("ocr")).alias("text"),
            "pattern",
            minute_index(F.col("timestamp_seconds")).alias("minute_index"),
            "frame_index",
        )
        .distinct()
    )


def best_frame_score() -> Column:
    text = F.trim(F.coalesce("ocr", F.lit("")))
    bonus = (
        F.when(text != "", 4.0).otherwise(0.0)
        + F.when(F.length(text) == 7, 3.0).otherwise(0.0)
        + F.when(F.upper("status") == "CONCLUSIVO", 6.0).otherwise(0.0)
        + F.when(F.col("agreement_ratio") >= 80.0, 4.0).otherwise(0.0)
        + F.when(F.col("assessment") >= 70.0, 3.0).otherwise(0.0)
    )
    return (
        F.col("confidence") * 0.55
        + F.least(F.lit(100.0), F.col("score")) * 0.2
        + F.col("agreement_ratio") * 0.14
        + F.col("assessment") * 0.08
        + bonus
        + F.least(F.lit(6.0), F.col("sharpness") / 55.0)
    )


def best_frame(frames: DataFrame) -> DataFrame:
    """Best frame of each video and the text most of its frames agree on."""
    scored = frames.withColumn("frame_score", best_frame_score()).withColumn("_text", F.trim(F.coalesce("ocr", F.lit(""))))
    place = F.struct(F.col("frame_score"), -F.col("frame_index"))
    texts = scored.groupBy("video_id", "_text").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(F.col("frame_score").alias("s"), (-F.col("frame_index")).alias("p"))).alias("place"),
        exact_avg(F.col("confidence")).alias("conf"),
        F.max_by("frame_index", place).alias("frame_index"),
    )
    blank = F.col("_text") == ""
    vote = F.when(~blank, F.struct(F.col("n"), F.length("_text").alias("len"), F.col("place")))
    top = texts.groupBy("video_id").agg(
        F.max_by("frame_index", "place").alias("best_frame_index"),
        rnd(F.max("place")["s"], 6).alias("best_frame_score"),
        F.max_by(F.struct("_text", "n", "conf"), vote).alias("v"),
        F.count_if(~blank).alias("texts"),
    )
    return top.select(
        "video_id",
        "best_frame_index",
        "best_frame_score",
        F.coalesce("v._text", F.lit("")).alias("consensus_text"),
        F.coalesce("v.n", F.lit(0)).cast("bigint").alias("consensus_count"),
        rnd(F.coalesce("v.conf", F.lit(0.0)), 2).alias("consensus_confidence"),
        "texts",
    )


def elect_frame(frames: DataFrame) -> DataFrame:
    """Frame with the best confidence, a little more if it was read; the first wins a tie."""
    score = F.col("confidence") + F.when(F.trim(F.coalesce("ocr", F.lit(""))) != "", TEXT_BOOST).otherwise(0.0)
    return frames.groupBy("video_id").agg(
        F.max_by("frame_index", F.struct(score, -F.col("frame_index"))).alias("frame_index"),
        F.max(score).alias("elected_score"),
    )


def assign_tracks(detections: DataFrame, order: list[str], threshold: float = TRACK_IOU) -> DataFrame:
    """Track number of every detection: the first track whose last box overlaps it, else a new one.

    The choice depends on every earlier one, so a video is read in order by one task that holds only
    the last box of each track, found by size and place; rows leave as they are read.
    """

    def add(last: BoxIndex, row: tuple) -> list[tuple]:
        det, *box = row
        track = last.first(tuple(box))
        track = len(last) + 1 if track is None else track
        last.put(track, tuple(box))
        return [(det, track)]

    schema = detections.select("video_id", "det_id", F.lit(1).cast("bigint").alias("track_id")).schema
    return ordered_fold(detections, "video_id", order, ["det_id", *BOX], lambda: BoxIndex(threshold), add, lambda last: [], schema)


def track_summary(tracked: DataFrame) -> DataFrame:
    """Per track: plate by vote (first to appear wins a tie), time span, size, mean confidence."""
    by_text = tracked.groupBy("video_id", "track_id", "text").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp_seconds").alias("t0"),
        F.max("timestamp_seconds").alias("t1"),
        exact_sum(F.col("confidence")).alias("conf"),
        F.min(F.struct("timestamp_seconds", "det_id")).alias("first"),
    )
    vote = F.when(F.col("text") != "", F.struct((-F.col("n")).alias("neg"), F.col("first")))
    total = F.sum("n")
    return by_text.groupBy("video_id", "track_id").agg(
        F.coalesce(F.min_by("text", vote), F.lit("")).alias("consolidated_plate"),
        F.count_if(F.col("text") != "").alias("plate_candidates"),
        F.min("t0").alias("start_seconds"),
        F.max("t1").alias("end_seconds"),
        total.alias("detections_count"),
        rnd(exact_sum(F.col("conf")) / total, 4).alias("avg_confidence"),
    )


def track_vehicles(detections: DataFrame, order: list[str] | None = None, threshold: float = TRACK_IOU) -> DataFrame:
    """Tracks of each video. `detections`: video_id, det_id, box, timestamp_seconds, text, confidence.
    Frames are read in time order unless `order` says otherwise."""
    tracks = assign_tracks(detections, order or ["timestamp_seconds", "det_id"], threshold)
    return track_summary(detections.join(tracks, ["video_id", "det_id"]))


def select_candidates(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates asked for by id, in the order asked, each once. `requests`: video_id, position, candidate_id."""
    wanted = (
        requests.withColumn("candidate_id", F.trim("candidate_id"))
        .where(F.col("candidate_id") != "")
        .groupBy("video_id", "candidate_id")
        .agg(F.min("position").alias("position"))
    )
    w = Window.partitionBy("video_id").orderBy("position")
    return wanted.join(candidates, ["video_id", "candidate_id"]).withColumn(
        "selection", F.row_number().over(w).cast("bigint")
    )


def _filled(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options])


def normalize_targets(targets: DataFrame) -> DataFrame:
    """Targets completed from their best frame, with minute and labels worked out again.

    `targets` carry their own fields and a struct `best_frame` (ocr, pattern, timestamp_seconds,
    frame_index, frame_path, confidence, score).
    """
    b = F.col("best_frame")
    seconds = F.coalesce("timestamp_seconds", b["timestamp_seconds"], F.lit(0.0))
    minute = F.coalesce("minute_index", F.floor(seconds / 60))
    text = F.coalesce(_filled(F.col("text"), b["ocr"]), F.lit("SEM_TEXTO"))
    pattern = F.coalesce(_filled(F.col("pattern"), b["pattern"]), F.lit("Indefinido"))
    best = F.coalesce("best_confidence", b["confidence"], F.lit(0.0))
    frames = F.coalesce("frames_count", F.lit(1))
    span = F.coalesce(_filled(F.col("minute_range")), minute_range(F.greatest(F.lit(0), minute)))
    return targets.select(
        "video_id",
        "candidate_id",
        text.alias("text"),
        pattern.alias("pattern"),
        F.coalesce(_filled(F.col("frame_path"), b["frame_path"]), F.lit("")).alias("frame_path"),
        rnd(seconds, 4).alias("timestamp_seconds"),
        timecode(seconds).alias("timestamp_label"),
        F.coalesce("frame_index", b["frame_index"], F.lit(0)).alias("frame_index"),
        minute.alias("minute_index"),
        span.alias("minute_range"),
        rnd(best, 2).alias("best_confidence"),
        rnd(F.coalesce("best_score", b["score"], F.lit(0.0)), 2).alias("best_score"),
        rnd(F.coalesce("avg_confidence", best), 2).alias("avg_confidence"),
        frames.alias("frames_count"),
        F.concat_ws(" | ", span, text, pattern).alias("display_label"),
        F.format_string("%d quadros | minuto %02d", frames, minute).alias("support_label"),
    )


def frame_summary(frames: DataFrame) -> DataFrame:
    return frames.select("video_id", "frame_index", "timestamp_seconds", "sharpness", F.col("ocr").alias("plate_read"), "confidence")
