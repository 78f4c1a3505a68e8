"""Streams: webhook intake and upsert, windows and sessions of frames, latency and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from vestigo.operators.webhooks import event_upsert, normalize_webhook
from vestigo.sources.webhooks import accepted, check

LATENESS = "10 minutes"


def minute_windows(frames: DataFrame, width: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Readings per video, text and tumbling window of event time."""
    return (
        frames.withWatermark("event_time", lateness)
        .groupBy("video_id", "text", F.window("event_time", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("frames"), F.max("confidence").alias("best_confidence"))
        .select("video_id", "text", F.col("w.start").alias("window_start"), "frames", "best_confidence")
    )


def audit_windows(log: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    return (
        log.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events")
    )


def audit_sessions(log: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Runs of activity per case, closed by a gap."""
    return (
        log.withWatermark("event_time", lateness)
        .groupBy("case_id", F.session_window("event_time", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("case_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
    )


#: Quantiles of a window are values whose rank is off by at most the number of rows divided by this.
QUANTILE_ACCURACY = 10_000
#: Size of a kept sketch: ranks read from it are off by about 1.3 % (single rank, 99 % of the time).
SKETCH_SIZE = 200


def latency_windows(spans: DataFrame, width: str = "1 hour", lateness: str = LATENESS, accuracy: int = QUANTILE_ACCURACY) -> DataFrame:
    """Span timings by stage and window. The window state holds a mergeable summary of the durations, not the
    durations; quantiles are off by at most n/accuracy ranks, and exact in windows of few rows."""
    return (
        spans.withWatermark("event_time", lateness)
        .groupBy("stage", F.window("event_time", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") != "ok").alias("errors"),
            F.avg("duration_ms").alias("mean_ms"),
            F.percentile_approx("duration_ms", [0.5, 0.9, 0.99], accuracy).alias("q"),
        )
        .select(
            "stage", F.col("w.start").alias("window_start"), "n", "errors", "mean_ms",
            F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"),
        )
    )


def latency_sketches(spans: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """A quantile sketch of each stage and window, to be stored and merged upwards."""
    return (
        spans.withWatermark("event_time", lateness)
        .groupBy("stage", F.window("event_time", width).alias("w"))
        .agg(F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), SKETCH_SIZE).alias("sketch"))
        .select("stage", F.col("w.start").alias("window_start"), "sketch")
    )


def merged_quantiles(sketches: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles over all windows of each key, read from their merged sketches: the durations are not needed again."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    read = [F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(name) for name, q in quantiles.items()]
    return merged.select(*keys, F.kll_sketch_get_n_double("_s").alias("n"), *read)


def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream to a table, exactly once, until all that is there now is read."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def write_upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each aggregate row whenever it changes, so windows still open at the end of the input are there, too.

    Each micro-batch lands in its own folder, which a retry writes over; `latest_rows` gives the table.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest_rows(landed: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key over the landed micro-batches."""
    rest = [c for c in landed.columns if c not in (*keys, "batch")]
    return landed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def intake(raw: DataFrame, events: str, rejects: str, checkpoint: str, secret: str = "", token: str = "", prefix: str = "") -> StreamingQuery:
    """Checked webhook bodies to an event log, the rest to a reject table.

    Each micro-batch reduces to one row per event key and lands in its own folder, which a retry
    writes over; `current_events` gives the table of latest events.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        marked = check(batch, secret, token, prefix)
        good = marked.where(accepted()).select("arrival", "event_time", F.col("body").alias("payload"))
        event_upsert(normalize_webhook(good)).write.mode("overwrite").parquet(f"{events}/batch={batch_id}")
        marked.where(~accepted()).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    writer = raw.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current_events(log: DataFrame) -> DataFrame:
    """Latest event per key over the landed batches; arrivals add up over them."""
    rest = [c for c in log.columns if c not in ("event_key", "arrivals", "batch")]
    return (
        log.groupBy("event_key")
        .agg(F.max_by(F.struct(*rest), "arrival").alias("_e"), F.sum("arrivals").alias("arrivals"))
        .select("event_key", "_e.*", "arrivals")
    )
