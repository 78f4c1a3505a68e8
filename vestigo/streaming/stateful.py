"""Streams whose keys hold state of their own: plates, tracks, open requests; and late rows.

State lives in RocksDB on the executors' disks, backed up to the checkpoint, so it outlives a restart
and isn't bounded by memory. Event-time timers fire when the watermark passes them. A finite run ends
with a marker row far in the future, which moves the watermark past all that is waiting.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import pickle
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vestigo.operators.boxes import BoxIndex
from vestigo.operators.video import TRACK_IOU
from vestigo.operators.webhooks import HISTORY_KEYS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WATERMARKS = "spark.sql.streaming.multipleWatermarkPolicy"
_VERSIONS = "spark.sql.streaming.minBatchesToRetain"
_OWN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_COMPACTED = "spark.sql.streaming.stateStore.rocksdb.compactOnCommit"
#: Event time of the marker row that ends a finite run.
END_OF_INPUT = datetime.datetime(2200, 1, 1)
#: Microseconds that stand for the time of a request without one.
NO_TIME = -9_223_372_036_854_776


@contextlib.contextmanager
def keyed_state(spark: SparkSession, rewritten: bool = False) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state and timers need. Where a stream
    is joined with itself, the sides share one watermark, that of the one further on.

    On disk are the state after the last batch and the one before, from which a restart goes on, and the shuffle
    files of the batch that runs. `rewritten`: most of the state changes in each batch, so what it was is let go at once.
    """
    wanted = {_STORE: _ROCKSDB, _WATERMARKS: "max", _VERSIONS: "2", _OWN_SHUFFLES: "true", _COMPACTED: str(rewritten).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def end_marker(spark: SparkSession, schema: T.StructType, event_time: str) -> DataFrame:
    """One row, zero or blank but for its far event time, that closes a finite run of a stream with this schema."""
    blank = {T.StringType: "", T.BooleanType: False, T.DoubleType: 0.0, T.FloatType: 0.0}
    values = [END_OF_INPUT if f.name == event_time else blank.get(type(f.dataType), 0) for f in schema]
    return spark.createDataFrame([tuple(values)], schema)


def close_input(spark: SparkSession, schema: T.StructType, path: str, event_time: str) -> None:
    """Append the end marker to the files of a finite stream."""
    end_marker(spark, schema, event_time).coalesce(1).write.mode("append").parquet(path)


def _rows_of(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [row for batch in batches for row in batch[columns].itertuples(index=False, name=None)]


# -- plates --------------------------------------------------------------------------------------

PLATE_SCHEMA = (
    "plate string, event_key string, event string, status string, arrival bigint, latest_request_id string, arrivals bigint, "
    "history array<struct<event_key: string, arrival: bigint>>"
)


class _PlateState(StatefulProcessor):
    """Plates that share a key; of each the last arrival, the last request id that was not blank, the last distinct keys."""

    def __init__(self, keep: int, days: int | None):
        self.keep = keep
        self.ttl = None if days is None else days * 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one call reads a plate, one writes it; the history is a JSON list of pairs
        latest = "event_key string, event string, status string, arrival bigint, request_id string, request_arrival bigint, arrivals bigint, history string"
        self.plates = handle.getMapState("plates", "plate string", latest, self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        by_plate: dict[str, list[tuple]] = {}
        for plate, *row in sorted(_rows_of(rows, ["plate", "arrival", "event_key", "event", "status", "request_id"]), key=lambda r: r[1]):
            by_plate.setdefault(plate, []).append(row)
        out = []
        for plate, arrived in by_plate.items():
            kept = self.plates.getValue((plate,)) or ("", "", "", None, "", None, 0, "[]")
            event_key, event, status, arrival, request, request_arrival, count, history = kept
            known = dict(json.loads(history))
            for at, key_now, event_now, status_now, request_now in arrived:
                if arrival is None or at >= arrival:
                    event_key, event, status, arrival = key_now, event_now, status_now, at
                if request_now and (request_arrival is None or at >= request_arrival):
                    request, request_arrival = request_now, at
                known[key_now] = at  # a known key keeps its place
                if len(known) > self.keep:
                    del known[next(iter(known))]
            count += len(arrived)
            self.plates.updateValue((plate,), (event_key, event, status, arrival, request, request_arrival, count, json.dumps(list(known.items()))))
            listed = [{"event_key": k, "arrival": a} for k, a in known.items()]
            out.append((plate, event_key, event, status, arrival, request, count, listed))
        if out:
            yield pd.DataFrame(out, columns=["plate", "event_key", "event", "status", "arrival", "latest_request_id", "arrivals", "history"])

    def close(self) -> None:
        pass


def plate_state(events: DataFrame, keep: int = HISTORY_KEYS, forget_days: int | None = None, keys: int = 1024) -> DataFrame:
    """Stream of each plate's state whenever it changes (update mode): content of the last arrival, last
    request id that was not blank, number of arrivals, and the last `keep` distinct keys, the oldest
    first. A known key is replaced in place, a new one pushes out the oldest.

    Rows of a micro-batch are taken by arrival. A plate not heard of for `forget_days` is forgotten.
    Plates share `keys` state keys by a hash, as each key has its own cost in a micro-batch.
    `events`: normalised webhook events; those without a plate are left out.
    """
    named = events.where(F.col("plate") != "").select("plate", "arrival", "event_key", "event", "status", "request_id")
    named = named.withColumn("_key", F.pmod(F.xxhash64("plate"), F.lit(keys)))
    return named.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=_PlateState(keep, forget_days), outputStructType=PLATE_SCHEMA, outputMode="Update", timeMode="ProcessingTime" if forget_days else "None"
    )


# -- tracks --------------------------------------------------------------------------------------


_NUMBERS = {"rising": "<i8", "whole": "<i8", "real": "<f8"}
#: What a waiting detection and a last box are made of: (video, seconds, det_id, at, box ...) and (video, track, box ...).
_WAITING = ("rising", "real", "whole", "whole", "real", "real", "real", "real")
_LAST = ("rising", "rising", "real", "real", "real", "real")
_SEEN = ("rising", "whole")


def _pack(rows: Sequence[tuple], kinds: Sequence[str]) -> bytes:
    """Rows of numbers in few bytes: column by column, rising ones as differences, alike bytes of a column together."""
    parts = []
    for values, kind in zip(zip(*rows), kinds):
        column = np.array(values, _NUMBERS[kind])
        column = np.diff(column, prepend=column.dtype.type(0)) if kind == "rising" else column
        parts.append(column.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zlib.compress(b"".join(parts))


def _unpack(packed: bytes, kinds: Sequence[str]) -> list[tuple]:
    held = np.frombuffer(zlib.decompress(packed), np.uint8)
    columns = []
    for bytes_of, kind in zip(held.reshape(len(kinds), 8, -1), kinds):
        column = np.ascontiguousarray(bytes_of.T).view(_NUMBERS[kind]).ravel()
        columns.append((np.cumsum(column) if kind == "rising" else column).tolist())
    return list(zip(*columns))


class _Tracks(StatefulProcessor):
    """Videos that share a key: detections that wait for the watermark, the last box of each track, and
    when each video was last seen."""

    def __init__(self, threshold: float, idle_ms: int):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One packed value a key, as a state call for each of its rows costs more than all else: detections
        # as lots that arrived together, last boxes, moments.
        self.kept = handle.getValueState("kept", "packed binary")
        self.due = handle.getValueState("due", "wakes_at bigint")

    def _held(self) -> tuple[list[bytes], bytes, bytes]:
        known = self.kept.get()
        return ([], _pack((), _LAST), _pack((), _SEEN)) if known is None else pickle.loads(bytes(known[0]))

    def _hold(self, lots: list[bytes], last: bytes, seen: bytes) -> None:
        self.kept.update((pickle.dumps((lots, last, seen), pickle.HIGHEST_PROTOCOL),))

    def _load(self) -> tuple[list[tuple], dict[int, dict[int, tuple]], dict[int, int]]:
        """(video, seconds, det_id, at, box ...) of those that wait, last boxes by video and track, when each video was seen."""
        lots, last, seen = self._held()
        boxes: dict[int, dict[int, tuple]] = {}
        for video, track, *box in _unpack(last, _LAST):
            boxes.setdefault(video, {})[track] = tuple(box)
        return [row for lot in lots for row in _unpack(lot, _WAITING)], boxes, dict(_unpack(seen, _SEEN))

    def _store(self, waiting: list[tuple], last: dict[int, dict[int, tuple]], seen: dict[int, int]) -> None:
        if waiting or last or seen:
            boxes = [(video, track, *last[video][track]) for video in sorted(last) for track in sorted(last[video])]
            self._hold([_pack(sorted(waiting), _WAITING)] if waiting else [], _pack(boxes, _LAST), _pack(sorted(seen.items()), _SEEN))
        else:
            self.kept.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        arrived = []
        for batch in rows:
            real = batch[batch["event_time"] < pd.Timestamp(END_OF_INPUT)]
            at = real["event_time"].to_numpy("datetime64[ms]").astype("int64").tolist()
            numbers = [real[c].astype(t).tolist() for c, t in (("video_id", "int64"), ("timestamp_seconds", float), ("det_id", "int64"))]
            arrived += zip(*numbers, at, *(real[c].astype(float).tolist() for c in ("x1", "y1", "x2", "y2")))
        if arrived:
            lots, last, moments = self._held()
            seen = dict(_unpack(moments, _SEEN))
            for r in arrived:
                if r[3] > seen.get(r[0], r[3] - 1):
                    seen[r[0]] = r[3]
            self._hold([*lots, _pack(sorted(arrived), _WAITING)], last, _pack(sorted(seen.items()), _SEEN))
            self._wake(min(r[3] for r in arrived))
        yield from ()

    def _wake(self, at: int) -> None:
        """Keeps one timer a key, at the earliest moment asked for since the last one fired."""
        before = (self.due.get() or (None,))[0]
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        waiting, last, seen = self._load()
        ready, left = [r for r in waiting if r[3] <= watermark], [r for r in waiting if r[3] > watermark]
        kept = {r[0] for r in left} | {v for v, at in seen.items() if at + self.idle_ms > watermark}
        tracks: dict[int, BoxIndex] = {}
        out = []
        for video, _, det, _, *box in sorted(ready):
            index = tracks.get(video)
            if index is None:
                index = tracks[video] = BoxIndex(self.threshold)
                for number, known in last.get(video, {}).items():
                    index.put(number, known)
            track = index.first(tuple(box))
            track = len(index) + 1 if track is None else track
            index.put(track, tuple(box))
            out.append((video, det, track))
        last |= {v: index.boxes for v, index in tracks.items()}
        seen = {v: at for v, at in seen.items() if v in kept}
        self._store(left, {v: boxes for v, boxes in last.items() if v in kept}, seen)
        moments = [r[3] for r in left] + [max(seen[v] + self.idle_ms, watermark + 1) for v in kept]
        if moments:
            self._wake(min(moments))
        if out:
            yield pd.DataFrame(out, columns=["video_id", "det_id", "track_id"])

    def close(self) -> None:
        pass


def tracks(detections: DataFrame, lateness: str, threshold: float = TRACK_IOU, idle_seconds: int = 3600, keys: int = 1024) -> DataFrame:
    """Track number of every detection, as the batch job gives it, though detections arrive in any order
    within the lateness: they wait until the watermark has passed them and leave by (timestamp_seconds,
    det_id). A video counts as ended, and its state goes, when nothing came for `idle_seconds` of event time.

    Videos share `keys` state keys by a hash of their id, as each key costs a few calls a micro-batch.
    `detections`: video_id, det_id, event_time (rising with timestamp_seconds), timestamp_seconds, x1, y1, x2, y2.
    """
    known = detections.withWatermark("event_time", lateness).withColumn("_key", F.pmod(F.xxhash64("video_id"), F.lit(keys)))
    return known.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=_Tracks(threshold, idle_seconds * 1000),
        outputStructType="video_id bigint, det_id bigint, track_id bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


# -- open requests -------------------------------------------------------------------------------


def open_requests(messages: DataFrame, lateness: str, within_seconds: int = 3600) -> DataFrame:
    """Requests that no reply followed within the time allowed, each as soon as the watermark passes it.

    `messages`: request_id, event_time, plate, is_reply; requests and replies in one stream, in any
    order within the lateness. Repeated requests are reported each for itself. Requests and replies meet in
    Spark's own join of streams, which keeps either side until the watermark has passed what it may meet.
    """
    known = lambda: messages.withWatermark("event_time", lateness)
    reply = F.coalesce("is_reply", F.lit(False))
    real = F.year("event_time") < END_OF_INPUT.year - 1
    asked = known().where(~reply & real).select("request_id", F.col("event_time").alias("request_time"), "plate")
    told = known().where(reply & real).select(F.col("request_id").alias("_reply_to"), F.col("event_time").alias("_told"))
    in_time = (F.col("_told") >= F.col("request_time")) & (F.col("_told") <= F.col("request_time") + F.expr(f"INTERVAL {int(within_seconds)} SECONDS"))
    met = asked.join(told, F.col("request_id").eqNullSafe(F.col("_reply_to")) & in_time, "left")
    open_ = met.where(F.col("_told").isNull()).select("request_id", "request_time", "plate")
    # No reply can be in time for a request without a time of its own: it is reported as it comes.
    timeless = messages.where(F.col("event_time").isNull() & ~reply)
    return open_.unionByName(timeless.select("request_id", F.timestamp_micros(F.lit(NO_TIME)).alias("request_time"), "plate"))


# -- late rows -----------------------------------------------------------------------------------


def split_late(stream: DataFrame, event_time: str, on_time: str, late: str, marks: str, checkpoint: str, lateness: str):
    """Sends rows that are later than the lateness behind the newest row of earlier micro-batches to a side
    table, where a watermark would drop them, and all others on.

    Each micro-batch lands in a folder of its own, with the newest event time so far beside it, so a retry
    repeats the same decisions. A stream over `on_time` with the same lateness drops nothing.
    """

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = None
        if number > 0:
            newest = spark.read.schema("newest timestamp").parquet(f"{marks}/batch={number - 1}").first()[0]
        kept = batch.persist()
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        is_late = F.coalesce(F.col(event_time) <= limit, F.lit(False))  # a watermark drops what lies at it, too
        kept.where(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        kept.where(is_late).write.mode("overwrite").parquet(f"{late}/batch={number}")
        mark = kept.agg(F.greatest(F.max(event_time), F.lit(newest).cast("timestamp")).alias("newest"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        kept.unpersist()

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
