"""Streams with state of their own: restarts, timers, late rows, sessions, sketches."""

from __future__ import annotations

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from vestigo.operators import video as V, webhooks as K
from vestigo.operators.boxes import BoxIndex, overlap_share
from vestigo.session import checkpoint_dir
from vestigo.streaming import events as E, stateful as Y

START = datetime.datetime(2024, 5, 1, 10)


def at(minutes: float) -> datetime.datetime:
    return START + datetime.timedelta(minutes=minutes)


@pytest.fixture
def base(spark):
    return f"{checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"


def land(frame, path):
    frame.coalesce(1).write.mode("append").parquet(path)


def read_stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, base, write=E.write_append):
    with Y.keyed_state(spark):
        running = write(stream, f"{base}/out", f"{base}/ckpt")
    running.awaitTermination()
    return running


def test_box_index_equals_a_scan():
    rnd = random.Random(2)
    for threshold in (0.1, 0.4, 0.45, 0.9, 1.0):
        index, boxes = BoxIndex(threshold), {}
        for i in range(400):
            x, y, side = rnd.uniform(-50, 50), rnd.uniform(-50, 50), 2 ** rnd.uniform(-3, 6)
            box = rnd.choice([(x, y, x + side, y + side * rnd.uniform(0.3, 2)), (x, y, x, y + 1), (float(int(x)),) * 2 + (float(int(x)) + 4,) * 2])
            want = sorted(n for n, other in boxes.items() if overlap_share(box, other) >= threshold)
            assert index.overlapping(box) == want
            number = rnd.randrange(200)
            index.put(number, box)
            boxes[number] = box
            if i % 7 == 0:
                index.drop(number)
                boxes.pop(number)


def test_plate_state_outlives_a_restart(spark, base):
    schema = "plate string, arrival long, event_key string, event string, status string, request_id string"
    rnd = random.Random(4)
    rows = [(rnd.choice(["AAA", "BBB", ""]), i, f"k{rnd.randrange(6)}", "e", f"s{i}", rnd.choice(["", f"r{i}"])) for i in range(60)]
    for part in (rows[:25], rows[25:40], rows[40:]):  # three runs from one checkpoint
        land(spark.createDataFrame(part, schema), f"{base}/in")
        stream = read_stream(spark, spark.createDataFrame([], schema).schema, f"{base}/in")
        drain(spark, Y.plate_state(stream, keep=3), base, E.write_upsert)
    got = {r.plate: r for r in E.latest_rows(spark.read.parquet(f"{base}/out"), ["plate"]).collect()}
    events = spark.createDataFrame(rows, schema)
    history = {}
    for r in K.plate_history(events, keep=3).orderBy("plate", "position").collect():
        history.setdefault(r.plate, []).append((r.event_key, r.arrival))
    want = K.latest_by_plate(events).collect()
    assert set(got) == {"AAA", "BBB"}
    for r in want:
        mine = got[r.plate]
        assert (mine.event_key, mine.status, mine.arrival, mine.latest_request_id, mine.arrivals) == (r.event_key, r.status, r.arrival, r.latest_request_id, r.arrivals)
        assert [tuple(h) for h in mine.history] == history[r.plate]


def test_tracks_from_disordered_batches_and_state_of_ended_videos(spark, base):
    rnd = random.Random(8)
    rows = []
    for video in range(4):
        for frame in range(12):
            for lane in range(3):
                x = 100 * lane + rnd.uniform(0, 12) + 3 * frame
                rows.append((video, len(rows), float(frame * 60), at(frame), x, 0.0, x + 40, 30.0 + rnd.uniform(0, 5)))
    schema = "video_id long, det_id long, timestamp_seconds double, event_time timestamp, x1 double, y1 double, x2 double, y2 double"
    frame = spark.createDataFrame(rows, schema)
    rows.sort(key=lambda r: r[2] + rnd.uniform(0, 240))  # up to four minutes out of order
    for n in range(5):
        land(spark.createDataFrame(rows[n * len(rows) // 5 : (n + 1) * len(rows) // 5], schema), f"{base}/in")
    Y.close_input(spark, frame.schema, f"{base}/in", "event_time")
    running = drain(spark, Y.tracks(read_stream(spark, frame.schema, f"{base}/in"), "5 minutes"), base)
    got = {tuple(r) for r in spark.read.parquet(f"{base}/out").select("video_id", "det_id", "track_id").collect()}
    want = {tuple(r) for r in V.assign_tracks(frame, ["timestamp_seconds", "det_id"]).collect()}
    assert got == want and len(got) == len(rows)
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress]
    assert max(totals) > 0 and totals[-1] == 0


def test_open_requests_close_by_timer(spark, base):
    ask = lambda key, minute: (key, at(minute), "P", False)
    tell = lambda key, minute: (key, at(minute), "P", True)
    batches = [
        [ask("answered", 0), ask("too late", 0), ask("twice", 1), tell("before", 3), ask("edge", 5), tell("reply first", 14)],
        [tell("answered", 10), ask("before", 4), ask("reply first", 9), ask("twice", 9)],
        [tell("too late", 70), tell("edge", 65), ask("at the end", 80), tell("nobody asked", 81)],
    ]
    schema = "request_id string, event_time timestamp, plate string, is_reply boolean"
    for rows in batches:
        land(spark.createDataFrame(rows, schema), f"{base}/in")
    shape = spark.createDataFrame([], schema).schema
    Y.close_input(spark, shape, f"{base}/in", "event_time")
    running = drain(spark, Y.open_requests(read_stream(spark, shape, f"{base}/in"), "10 minutes"), base)
    got = sorted((r.request_id, r.request_time) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == sorted([("too late", at(0)), ("before", at(4)), ("twice", at(1)), ("twice", at(9)), ("at the end", at(80))])
    assert running.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_late_rows_go_to_a_side_table(spark, base):
    batches = [[(1, at(0)), (2, at(30))], [(3, at(19)), (4, at(21)), (5, at(31)), (6, None)], [(7, at(20)), (8, at(45))], [(9, at(34)), (10, at(36))]]
    schema = spark.createDataFrame([], "id long, event_time timestamp").schema
    for rows in batches:
        land(spark.createDataFrame(rows, schema), f"{base}/in")
        # a run a file: the newest time so far is read back after each restart
        Y.split_late(read_stream(spark, schema, f"{base}/in"), "event_time", f"{base}/kept", f"{base}/late", f"{base}/marks", f"{base}/ckpt", "10 minutes").awaitTermination()
    ids = lambda name: sorted(r.id for r in spark.read.parquet(f"{base}/{name}").collect())
    assert ids("late") == [3, 7, 9] and ids("kept") == [1, 2, 4, 5, 6, 8, 10]
    # nothing that was let through is dropped by a watermark of the same lateness
    kept = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{base}/kept")
    counts = E.audit_windows(kept.withColumn("event_type", F.lit("e")), lateness="10 minutes")
    E.write_upsert(counts, f"{base}/counted", f"{base}/ckpt2").awaitTermination()
    assert E.latest_rows(spark.read.parquet(f"{base}/counted"), ["window_start", "event_type"]).agg(F.sum("events")).first()[0] == 6


def test_sessions_bridge_batches(spark, base):
    minutes = [0, 20, 45, 80, 100, 200]
    schema = spark.createDataFrame([], "case_id long, event_time timestamp").schema
    for part in (minutes[:2], minutes[2:4], minutes[4:]):
        land(spark.createDataFrame([(1, at(m)) for m in part], schema), f"{base}/in")
    Y.close_input(spark, schema, f"{base}/in", "event_time")
    E.write_append(E.audit_sessions(read_stream(spark, schema, f"{base}/in")), f"{base}/out", f"{base}/ckpt").awaitTermination()
    got = sorted((r.session_start, r.session_end, r.events) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(at(0), at(75), 3), (at(80), at(130), 2), (at(200), at(230), 1)]


def test_merged_sketches_keep_their_rank_error(spark):
    n = 50_000
    rows = spark.range(n).select(F.lit("s").alias("stage"), (F.col("id") % 24).alias("hour"), F.pmod(F.hash("id"), F.lit(n)).cast("double").alias("v"))
    hours = rows.groupBy("stage", "hour").agg(F.kll_sketch_agg_double("v", E.SKETCH_SIZE).alias("sketch"))
    found = E.merged_quantiles(hours, ["stage"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}).first()
    values = sorted(r.v for r in rows.collect())
    assert found.n == n
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        rank = sum(v <= found[name] for v in values) / n
        assert abs(rank - q) < 0.03
