"""Source, sink and stream queries. Each writes derived rows through a sink and reads them back through a source."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F, types as T

from vestigo.functions.numbers import rnd
from vestigo.operators import bench as B, integrity as I, webhooks as K
from vestigo.plans.bench import catalog
from vestigo.plans.derived import add, load, read, with_tables
from vestigo.plans.history import _EVENT_SQL, _UPSERT, HISTORY_SQL, webhook_events
from vestigo.plans.integrity import FIELDS, _CHAIN_SQL, entries
from vestigo.plans.registry import query, r, xsum
from vestigo.plans.video import TRACK_SQL
from vestigo.plans.vehicles import REFERENCE_SQL, NORM, reference
from vestigo.session import checkpoint_dir
from vestigo.sources import files as S, webhooks as W
from vestigo.streaming import events as E, stateful as Y


def scratch(spark, name):
    """A new folder in the shared checkpoint area."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "load_catalog",
    with_tables("catalog_items")
    + """ SELECT image, kind, expected_text, difficulty, concat_ws(',', 'scene_preprocess', CASE WHEN p_size%2=0 THEN 'plate_detector' END) AS targets
    FROM catalog_items WHERE p_type <> 'PROMO'""",
)
def load_catalog(spark, sf):
    path = scratch(spark, "catalog")
    items = catalog(spark, sf)
    targets = F.array_compact(F.array(F.lit(" scene_preprocess "), F.when(F.col("p_size") % 2 == 0, "plate_detector"), F.lit("other")))
    rows = items.select(
        F.concat(F.lit(" "), "image").alias("image"),
        F.when(F.col("p_type") == "PROMO", "sketch").otherwise(F.upper("kind")).alias("kind"),
        "expected_text",
        "difficulty",
        targets.alias("targets"),
    )
    rows.write.json(path)
    good, _ = S.load_catalog(spark, path, multi_line=False)
    return good.select("image", "kind", "expected_text", "difficulty", F.concat_ws(",", "targets").alias("targets"))


@query(
    "case_history_table",
    with_tables("case_history") + " SELECT user_id, filename, epoch_us(case_time)//1000000 AS case_time, ocr FROM case_history",
)
def case_history_table(spark, sf):
    path = scratch(spark, "cases")
    cases = load(spark, sf, "case_history").select("user_id", "filename", "ocr", "color_info", F.col("case_time").cast("timestamp").alias("case_time"))
    S.append_case_history(cases, path)
    return S.load_case_history(spark, path).select("user_id", "filename", F.col("case_time").cast("bigint").alias("case_time"), "ocr")


#: The user whose cases the next query asks for.
_ONE_USER = 7


@query(
    "case_history_by_user",
    with_tables("case_history")
    + f""", mine AS (SELECT user_id, filename, epoch_us(case_time)//1000000 AS case_time, ocr FROM case_history WHERE user_id = {_ONE_USER})
    SELECT *, rank() OVER (ORDER BY case_time DESC) AS place FROM mine""",
)
def case_history_by_user(spark, sf):
    """One user's cases, newest first; the place in that order is read off the rows as they come."""
    path = scratch(spark, "cases")
    cases = load(spark, sf, "case_history").select("user_id", "filename", "ocr", "color_info", F.col("case_time").cast("timestamp").alias("case_time"))
    S.append_case_history(cases, path)
    mine = S.load_case_history(spark, path, user_id=_ONE_USER).withColumn("case_time", F.col("case_time").cast("bigint"))
    place = F.rank().over(Window.partitionBy("user_id").orderBy(F.col("case_time").desc()))
    return mine.select("user_id", "filename", "case_time", "ocr", place.cast("bigint").alias("place"))


@query(
    "load_reference",
    with_tables("vehicle_rows")
    + REFERENCE_SQL
    + f" SELECT {NORM.format('make')} AS make_norm, {NORM.format('model')} AS model_norm, array_to_string(years, ',') AS years FROM reference",
)
def load_reference(spark, sf):
    path = scratch(spark, "reference")
    rows = F.collect_list(
        F.struct(F.col("model").alias("nome"), F.col("years").alias("anos"), F.col("fuels").alias("combustiveis"), F.col("variants").alias("variantes"))
    )
    # One document per make, as the reference file nests the models under their make.
    documents = reference(spark, sf).groupBy("make").agg(rows.alias("rows")).select(F.create_map("make", "rows").alias("models"))
    documents.write.json(path)
    found = S.load_reference(spark, path, multi_line=False)
    return found.select("make_norm", "model_norm", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query(
    "load_metadata_csv",
    with_tables("vehicle_rows") + " SELECT model_identifier::VARCHAR AS model_id, make, year, coalesce(nullif(split, ''), '') AS split FROM vehicle_rows",
)
def load_metadata_csv(spark, sf):
    path = scratch(spark, "metadata")
    load(spark, sf, "vehicle_rows").select(F.col("model_identifier").cast("string").alias("model_id"), "make", "year", "split").write.option("header", True).csv(path)
    return S.load_metadata_csv(spark, path).fillna("", ["split"])


@query(
    "load_annotations",
    """SELECT 'img_' || l_orderkey AS stem, 'car_' || l_partkey%4 AS name, l_quantity AS xmin, l_quantity+50 AS xmax, 640 AS width
    FROM lineitem""",
)
def load_annotations(spark, sf):
    return _annotations(spark, sf).select("stem", "name", "xmin", "xmax", "width")


@query(
    "pair_annotations",
    """SELECT 'img_' || o_orderkey AS stem, 'car_' || l_partkey%4 AS name, l_quantity AS xmin, l_quantity+50 AS xmax
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
)
def pair_annotations(spark, sf):
    key = F.col("o_orderkey").cast("string")
    images = read(spark, sf, "orders").select(F.concat(F.lit("train/img_"), key, F.lit(".jpg")).alias("path"))
    return S.pair_annotations(images, _annotations(spark, sf)).select("stem", "name", "xmin", "xmax")


#: Annotation entries written to one file at most.
_ENTRIES = 20_000


def _annotations(spark, sf):
    """One annotation file entry per order, its lines the labelled objects, written and read back."""
    path = scratch(spark, "voc")
    box = F.struct(F.col("l_quantity").alias("xmin"), F.lit(1.0).alias("ymin"), (F.col("l_quantity") + 50).alias("xmax"), F.lit(9.0).alias("ymax"))
    labelled = F.struct(F.concat(F.lit("car_"), (F.col("l_partkey") % 4).cast("string")).alias("name"), box.alias("bndbox"))
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(labelled).alias("objects"))
    notes = rows.select(
        F.concat(F.lit("img_"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("filename"),
        F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")).alias("size"),
        F.col("objects").alias("object"),
    )
    # A reader takes an annotation file whole, so none holds more than some megabytes.
    notes.write.format("xml").option("rowTag", "annotation").option("rootTag", "annotations").option("maxRecordsPerFile", _ENTRIES).save(path)
    return S.load_annotations(spark, path)


@query("load_embeddings", "SELECT vec_id, len(embedding) AS dimensions, CAST(list_sum([CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) for x in embedding]) AS BIGINT) AS micro_sum FROM embeddings")
def load_embeddings(spark, sf):
    found = S.load_embeddings(spark, f"{sf}/embeddings.parquet")
    micro = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint"))
    total = F.aggregate(micro, F.lit(0).cast("bigint"), lambda n, x: n + x)
    return found.select("vec_id", F.size("embedding").cast("bigint").alias("dimensions"), total.alias("micro_sum"))


@query("chain_log", _CHAIN_SQL + " SELECT chain_id, seq, entry_hash FROM walk")
def chain_log(spark, sf):
    path = scratch(spark, "chain")
    S.append_chain_log(I.chain_build(entries(spark, sf), FIELDS), path)
    return S.load_chain_log(spark, path).select("chain_id", "seq", "entry_hash")


@query(
    "audit_log",
    "SELECT epoch_us(date_trunc('hour', ts))//1000000 AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL",
)
def audit_log(spark, sf):
    path = scratch(spark, "audit")
    log = read(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("event_time"), F.col("props").alias("payload"))
    S.append_audit_log(log, path)
    return B.audit_rollup(S.load_audit_log(spark, path)).withColumn("window_start", F.col("window_start").cast("bigint"))


@query(
    "telemetry_log",
    with_tables("spans") + f" SELECT stage, count(*) AS n, {r(xsum('duration_ms'), 4)} AS total_ms FROM spans GROUP BY stage",
)
def telemetry_log(spark, sf):
    path = scratch(spark, "traces")
    span = F.struct("stage", "duration_ms", "status")
    # A trace holds the spans of one analysis, at most one line each.
    load(spark, sf, "spans").groupBy("analysis_id").agg(F.collect_list(span).alias("spans")).write.json(path)
    found = S.load_telemetry(spark, path)
    return found.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), B.rnd(B.exact_sum(F.col("duration_ms")), 4).alias("total_ms"))


@query(
    "results_union",
    """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_custkey%3=0 THEN NULL WHEN o_custkey%3=1 THEN 0 ELSE o_orderkey%101 END AS a, CASE WHEN o_custkey%5=0 THEN 0 ELSE o_custkey%100 END AS b FROM orders),
    c AS (SELECT k, coalesce(nullif(a, 0), nullif(b, 0), 0)::DOUBLE AS confidence, CASE WHEN k%4=0 THEN 'INCONCLUSIVO' ELSE 'P' || k%50 END AS reading FROM s)
    SELECT k || '.jpg' AS image, reading, confidence, CASE WHEN confidence < 95 THEN 'INCONCLUSIVO' ELSE 'IDENTIFICAÇÃO FORTE' END AS conclusion FROM c WHERE confidence >= 10""",
)
def results_union(spark, sf):
    path = scratch(spark, "results")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    row = F.struct(
        F.concat(F.lit("in/"), k.cast("string"), F.lit(".jpg")).alias("image"),
        F.when(c % 3 == 0, None).when(c % 3 == 1, "0").otherwise((k % 101).cast("string")).alias("confidence"),
        F.when(c % 5 == 0, 0).otherwise(c % 100).alias("observed_best_confidence"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("P"), (k % 50).cast("string"))).alias("observed_text"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("P"), (k % 50).cast("string"))).alias("observed_best_text"),
    )
    docs = read(spark, sf, "orders").select(F.lit("2024-01-01").alias("generated_at_utc"), F.array(row).alias("results"))
    docs.write.json(path)
    return S.results_union(spark, f"{path}/*.json", 10.0).select("image", "reading", "confidence", "conclusion")


@query(
    "write_report_tables",
    with_tables("suite_jobs")
    + """ SELECT job_group, benchmark, count(*) AS jobs, count(*) FILTER (status = 'ok') AS ok FROM suite_jobs GROUP BY ALL""",
)
def write_report_tables(spark, sf):
    path = scratch(spark, "report")
    report = load(spark, sf, "suite_jobs").groupBy("job_group", "benchmark").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "ok").alias("ok")
    )
    S.write_report(report, path, keys=["job_group"])
    return spark.read.parquet(path).select("job_group", "benchmark", "jobs", "ok")


add(
    "uploads",
    "lineitem",
    [
        "'in/' || CAST(l_orderkey AS STRING) || '_' || CAST((CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS STRING) || "
        "CASE l_partkey%5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.pdf' WHEN 3 THEN '.exe' ELSE '.tif' END AS path",
        "CASE WHEN l_suppkey%13=0 THEN 0 ELSE CAST(floor(l_extendedprice*1000) AS BIGINT) END AS size_bytes",
        "CASE l_suppkey%6 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '25504446' WHEN 3 THEN '52494646AAAAAAAA57454250' "
        "WHEN 4 THEN '49492A00' ELSE '0000' END AS header_hex",
        "CASE WHEN l_linenumber%3=0 THEN 'image/jpeg' WHEN l_linenumber%3=1 THEN '' ELSE 'application/octet-stream' END AS content_type",
    ],
)
_MIME = "CASE signature WHEN 'pdf' THEN 'application/pdf' WHEN 'unknown' THEN '' ELSE 'image/' || signature END"


@query(
    "ingest_files_guard",
    with_tables("uploads")
    + f""", s AS (SELECT *, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS extension, CASE header_hex WHEN 'FFD8FFE0' THEN 'jpeg' WHEN '89504E470D0A1A0A' THEN 'png'
      WHEN '25504446' THEN 'pdf' WHEN '52494646AAAAAAAA57454250' THEN 'webp' WHEN '49492A00' THEN 'tiff' ELSE 'unknown' END AS signature FROM uploads),
    e AS (SELECT *, CASE WHEN size_bytes <= 0 THEN 'Arquivo enviado esta vazio' WHEN extension = '.exe' THEN 'Extensao nao permitida para analise'
      WHEN size_bytes > 83886080 THEN 'Arquivo enviado excede o limite configurado' WHEN signature = 'unknown' THEN 'Assinatura do arquivo nao reconhecida'
      WHEN extension = '.pdf' AND signature <> 'pdf' THEN 'Arquivo PDF invalido ou corrompido' WHEN extension <> '.pdf' AND signature = 'pdf' THEN 'Arquivo de imagem invalido ou corrompido' ELSE '' END AS error FROM s)
    SELECT path, extension, signature, size_bytes, error = '' AS allowed, error, CASE WHEN error <> '' THEN '' ELSE concat_ws(',', CASE WHEN content_type = 'image/jpeg' AND {_MIME} <> 'image/jpeg'
      THEN 'content_type_divergente' END, CASE WHEN size_bytes >= 67108864 THEN 'arquivo_proximo_do_limite' END) END AS warnings FROM e""",
)
def ingest_files_guard(spark, sf):
    uploads = load(spark, sf, "uploads").withColumn("header", F.unhex("header_hex"))
    return S.ingest_guard(uploads).withColumn("warnings", F.concat_ws(",", "warnings"))


_SECRET, _TOKEN = "intake-test-secret", "intake-test-token"


def _bodies(spark, sf):
    """Bodies as a sender would sign them; some with a wrong digest, a wrong token or broken text."""
    k = F.col("arrival")
    raw = load(spark, sf, "webhook_bodies").select("arrival", "event_time", F.when(k % 23 == 0, "{broken").otherwise(F.col("payload")).alias("body"))
    signed = raw.withColumn("_s", I.hmac_sha256(F.col("body"), _SECRET))
    return signed.select(
        "arrival",
        F.col("event_time").cast("timestamp").alias("event_time"),
        "body",
        F.when(k % 10 == 0, F.sha2("_s", 256)).otherwise(F.col("_s")).alias("signature"),
        F.when(k % 17 == 0, "Bearer wrong").otherwise(f"bearer {_TOKEN}").alias("authorization"),
    )


@query(
    "webhook_source",
    "SELECT event_id AS arrival, event_id%23<>0 AS json_valid, event_id%10<>0 AS signature_valid, event_id%17<>0 AS auth_valid FROM events",
)
def webhook_source(spark, sf):
    checked = W.check(_bodies(spark, sf), _SECRET, _TOKEN, "Bearer")
    return checked.select("arrival", "json_valid", "signature_valid", "auth_valid")


# -- streams -----------------------------------------------------------------------------------


def _run(query_started):
    query_started.awaitTermination()


@query(
    "event_upsert_stream",
    _EVENT_SQL
    + f""", g AS (SELECT * FROM ev WHERE arrival%23<>0 AND arrival%10<>0 AND arrival%17<>0),
    u AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY arrival DESC) AS n, count(*) OVER (PARTITION BY event_key) AS arrivals FROM g)
    SELECT {', '.join(_UPSERT)} FROM u WHERE n = 1""",
)
def event_upsert_stream(spark, sf):
    base = scratch(spark, "intake")
    _bodies(spark, sf).repartition(4).write.json(f"{base}/raw")
    stream = W.read_stream(spark, f"{base}/raw", files_per_trigger=2)
    _run(E.intake(stream, f"{base}/events", f"{base}/rejects", f"{base}/ckpt", _SECRET, _TOKEN, "Bearer"))
    return E.current_events(spark.read.parquet(f"{base}/events")).select(*_UPSERT)


def _drained(spark, stream, base, mode="append", rewritten=False):
    """Run a stream with state of its own until all that has landed is read; rows go to {base}/out."""
    with Y.keyed_state(spark, rewritten):
        start = E.write_append if mode == "append" else E.write_upsert
        running = start(stream, f"{base}/out", f"{base}/ckpt")
    _run(running)
    return running


#: Rows of a turn that one file holds, about, and the fewest worth a file of their own.
_FILE_ROWS, _LEAST_ROWS = 100_000, 1_000


def _files_a_turn(rows, turn, turns):
    """Files that each turn is landed in, the same number for all, so a stream of so many files a batch reads
    a turn a batch. Only where every turn has rows enough for all of its files is it more than one."""
    sizes = {r[turn]: r["count"] for r in rows.groupBy(turn).count().collect()}
    sizes = [sizes.get(n, 0) for n in range(turns)]
    return max(1, min(-(-max(sizes) // _FILE_ROWS), min(sizes) // _LEAST_ROWS))


def _files_as_they_lie(rows, turn, turns):
    """Number of the rows' partitions if each holds rows enough of every turn for a file of its own: then turns land
    in that many files without a shuffle. Otherwise None."""
    parts = rows.rdd.getNumPartitions()
    held = rows.where(F.col(turn).between(0, turns - 1)).groupBy(F.spark_partition_id().alias("_part"), turn).count()
    full = held.where(F.col("count") >= _LEAST_ROWS).count() == parts * turns
    return parts if full else None


def _land(rows, turn, path, first, last, files, as_they_lie=False):
    """Append rows turn by turn, each in so many files, so a stream of as many files a batch reads them in that order."""
    for n in range(first, last):
        mine = rows.where(F.col(turn) == n).drop(turn)
        (mine if as_they_lie else mine.coalesce(1) if files == 1 else mine.repartition(files)).write.mode("append").parquet(path)


def _plate_rows(spark, sf):
    """Plate states after a run over three turns and, from the same checkpoint, one over two more."""
    base = scratch(spark, "plates")
    bodies = _bodies(spark, sf)
    newest = bodies.agg(F.max("arrival")).first()[0]
    turned = bodies.withColumn("_turn", F.least(F.floor(F.col("arrival") * 5 / (newest + 1)), F.lit(4)))
    files = _files_a_turn(turned, "_turn", 5)
    for first, last in ((0, 3), (3, 5)):
        _land(turned, "_turn", f"{base}/raw", first, last, files)
        stream = spark.readStream.schema(bodies.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/raw")
        checked = W.check(stream, _SECRET, _TOKEN, "Bearer").where(W.accepted())
        state = Y.plate_state(K.normalize_webhook(checked.select("arrival", "event_time", F.col("body").alias("payload"))))
        _drained(spark, state, base, "update")
    landed = T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])
    return E.latest_rows(spark.read.schema(landed).parquet(f"{base}/out"), ["plate"])


_GOOD_SQL = _EVENT_SQL + ", good AS (SELECT * FROM ev WHERE arrival%23<>0 AND arrival%10<>0 AND arrival%17<>0 AND plate <> '')"


@query(
    "latest_by_plate_stream",
    _GOOD_SQL
    + """ SELECT plate, max(arrival) AS arrival, arg_max(event_key, arrival) AS event_key, arg_max(status, arrival) AS status,
      coalesce(arg_max(request_id, arrival) FILTER (request_id <> ''), '') AS latest_request_id, count(*) AS arrivals FROM good GROUP BY plate""",
)
def latest_by_plate_stream(spark, sf):
    return _plate_rows(spark, sf).select("plate", "arrival", "event_key", "status", "latest_request_id", "arrivals")


@query("plate_history_stream", HISTORY_SQL.replace("FROM ev WHERE", "FROM ev WHERE arrival%23<>0 AND arrival%10<>0 AND arrival%17<>0 AND"))
def plate_history_stream(spark, sf):
    keys = _plate_rows(spark, sf).select("plate", F.posexplode("history").alias("position", "_h"))
    return keys.select("plate", (F.col("position") + 1).cast("bigint").alias("position"), "_h.event_key", "_h.arrival")


def _event_stream(spark, sf):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("event_time", F.col("ts").cast("timestamp"))


def _drain_windows(spark, stream, name, keys):
    """All windows of a finite run, the last ones as they stand when the input ends."""
    base = scratch(spark, name)
    _run(E.write_upsert(stream, f"{base}/out", f"{base}/ckpt"))
    columns = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    done = E.latest_rows(spark.read.schema(columns).parquet(f"{base}/out"), keys)
    return done.withColumn("window_start", F.col("window_start").cast("bigint"))


@query(
    "minute_windows",
    """SELECT user_id AS video_id, event_type AS text, epoch_us(date_trunc('minute', ts))//1000000 AS window_start, count(*) AS frames, max(value) AS best_confidence
    FROM events GROUP BY ALL""",
)
def minute_windows(spark, sf):
    frames = _event_stream(spark, sf).select(F.col("user_id").alias("video_id"), F.col("event_type").alias("text"), "event_time", F.col("value").alias("confidence"))
    return _drain_windows(spark, E.minute_windows(frames), "minutes", ["video_id", "text", "window_start"])


@query(
    "audit_windows_stream",
    """SELECT epoch_us(date_trunc('hour', ts))//1000000 AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL""",
)
def audit_windows_stream(spark, sf):
    log = _event_stream(spark, sf).select("event_type", "event_time")
    return _drain_windows(spark, E.audit_windows(log), "audit", ["window_start", "event_type"])


# Events dealt over five files by their time, some up to nine minutes after newer ones (`on time`) or, one
# in fifty, a whole file later (`late`).
_TURN_SQL = """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS span FROM events),
  turned AS (SELECT events.*, least(4, ((epoch_us(ts) - lo + (event_id%10)*60000000)*5)//span + CASE WHEN event_id%50=7 THEN 1 ELSE 0 END) AS turn FROM events, b)"""


def _turned_events(spark, sf, with_late):
    events = read(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp")).drop("ts")
    at = F.unix_micros("event_time")
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    turn = F.floor((at - lo + (F.col("event_id") % 10) * 60_000_000) * 5 / (hi - lo + 1))
    if with_late:
        turn = turn + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)
    return events.withColumn("_turn", F.least(turn, F.lit(4)))


def _dealt_stream(spark, rows, base, event_time=None, once=False):
    """The rows landed turn by turn, with the end marker if their event time is named, as a stream of one turn a batch.
    `once`: the stream is their only reader and deletes the files of a batch when it has ended."""
    lie = _files_as_they_lie(rows, "_turn", 5)
    files = lie or _files_a_turn(rows, "_turn", 5)
    _land(rows, "_turn", f"{base}/in", 0, 5, files, lie is not None)
    schema = rows.drop("_turn").schema
    if event_time:
        Y.close_input(spark, schema, f"{base}/in", event_time)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (stream.option("cleanSource", "delete") if once else stream).parquet(f"{base}/in")


@query(
    "open_requests_stream",
    """WITH k AS (SELECT concat_ws(':', user_id::VARCHAR, props) AS id, ts, user_id::VARCHAR AS plate, event_type FROM events)
    SELECT id AS request_id, epoch_us(ts) AS request_time, plate FROM k q WHERE event_type = 'view' AND NOT EXISTS
      (SELECT 1 FROM k r WHERE r.event_type = 'click' AND r.id = q.id AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 1 HOUR)""",
)
def open_requests_stream(spark, sf):
    base = scratch(spark, "open")
    events = _turned_events(spark, sf, with_late=False).where("event_type IN ('view', 'click')")
    messages = events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), "props").alias("request_id"),
        "event_time",
        F.col("user_id").cast("string").alias("plate"),
        (F.col("event_type") == "click").alias("is_reply"),
        "_turn",
    )
    waiting = Y.open_requests(_dealt_stream(spark, messages, base, "event_time"), E.LATENESS)
    _drained(spark, waiting, base)
    done = spark.read.schema(waiting.schema).parquet(f"{base}/out")
    return done.withColumn("request_time", F.unix_micros("request_time"))


@query(
    "late_rows_stream",
    _TURN_SQL
    + """, newest AS (SELECT turn, max(max(ts)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM turned GROUP BY turn)
    SELECT event_id, event_type, coalesce(ts <= mark - INTERVAL 10 MINUTE, false) AS late FROM turned JOIN newest USING (turn)""",
)
def late_rows_stream(spark, sf):
    base = scratch(spark, "late")
    stream = _dealt_stream(spark, _turned_events(spark, sf, with_late=True), base)
    _run(Y.split_late(stream, "event_time", f"{base}/kept", f"{base}/late", f"{base}/marks", f"{base}/ckpt", E.LATENESS))
    read_back = lambda name: spark.read.schema(stream.schema).parquet(f"{base}/{name}").select("event_id", "event_type", F.lit(name == "late").alias("late"))
    return read_back("kept").unionByName(read_back("late"))


@query(
    "audit_sessions_stream",
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m)
    SELECT user_id AS case_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 1800000000 AS session_end, count(*) AS events FROM s GROUP BY user_id, n""",
)
def audit_sessions_stream(spark, sf):
    base = scratch(spark, "sessions")
    log = _turned_events(spark, sf, with_late=False).select(F.col("user_id").alias("case_id"), "event_time", "_turn")
    sessions = E.audit_sessions(_dealt_stream(spark, log, base, "event_time"))
    _run(E.write_append(sessions, f"{base}/out", f"{base}/ckpt"))
    done = spark.read.schema(sessions.schema).parquet(f"{base}/out")
    return done.select("case_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "events")


def _latency_spans(spark, sf):
    return _event_stream(spark, sf).select(
        F.col("event_type").alias("stage"), "event_time", F.col("value").alias("duration_ms"), F.when(F.col("user_id") % 10 == 0, "error").otherwise("ok").alias("status")
    )


def _at_rank(q):
    return f"list_sort(list(value))[greatest(1, ceil({q}::DOUBLE*count(*)))::BIGINT]"


@query(
    "latency_windows_stream",
    f"""SELECT event_type AS stage, epoch_us(date_trunc('hour', ts))//1000000 AS window_start, count(*) AS n, count(*) FILTER (user_id%10=0) AS errors,
      {r('avg(value)', 4)} AS mean_ms, {_at_rank(0.5)} AS p50, {_at_rank(0.9)} AS p90, {_at_rank(0.99)} AS p99 FROM events GROUP BY ALL""",
)
def latency_windows_stream(spark, sf):
    done = _drain_windows(spark, E.latency_windows(_latency_spans(spark, sf)), "latency", ["stage", "window_start"])
    return done.select("stage", "window_start", "n", "errors", rnd(F.col("mean_ms"), 4).alias("mean_ms"), "p50", "p90", "p99")


#: Twice the sketch's rank error at 99 %.
_RANK_SLACK = 0.027


@query(
    "latency_daily_stream",
    """SELECT event_type AS stage, epoch_us(date_trunc('day', ts))//1000000 AS day, count(*) AS n, true AS p50_holds, true AS p90_holds, true AS p99_holds
    FROM events GROUP BY ALL""",
)
def latency_daily_stream(spark, sf):
    """Days from the sketches of their hours; each quantile is held against the rank it has in the events."""
    hours = _drain_windows(spark, E.latency_sketches(_latency_spans(spark, sf)), "sketches", ["stage", "window_start"])
    hours = hours.withColumn("day", F.col("window_start") - F.pmod("window_start", F.lit(86400)))
    asked = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    days = E.merged_quantiles(hours, ["stage", "day"], asked)
    events = read(spark, sf, "events").select(
        F.col("event_type").alias("stage"), F.unix_timestamp(F.date_trunc("day", "ts")).alias("day"), F.col("value").cast("double").alias("_v")
    )

    def holds(name):
        low, high = F.count_if(F.col("_v") < F.col(name)), F.count_if(F.col("_v") <= F.col(name))
        slack = F.greatest(F.lit(1.0), _RANK_SLACK * F.first("n"))
        return ((low <= asked[name] * F.first("n") + slack) & (high >= asked[name] * F.first("n") - slack)).alias(f"{name}_holds")

    return events.join(days, ["stage", "day"]).groupBy("stage", "day").agg(F.first("n").alias("n"), *[holds(name) for name in asked])


@query("track_vehicles_stream", TRACK_SQL + " SELECT video_id, det_id, track AS track_id FROM t")
def track_vehicles_stream(spark, sf):
    """Detections a quarter of an hour apart, dealt over five files, a third of them one step late."""
    base = scratch(spark, "tracks")
    boxes = load(spark, sf, "track_detections").select("video_id", "det_id", "timestamp_seconds", "x1", "y1", "x2", "y2")
    behind = F.when(F.col("det_id") % 3 == 0, 1).otherwise(0)
    dealt = boxes.withColumn("event_time", F.timestamp_seconds(F.col("timestamp_seconds") * 900)).withColumn(
        "_turn", F.least(F.floor((F.col("timestamp_seconds") - 1 + behind) * 5 / 7), F.lit(4))
    )
    tracked = Y.tracks(_dealt_stream(spark, dealt, base, "event_time", once=True), "20 minutes")
    _drained(spark, tracked, base, rewritten=True)
    return spark.read.schema(tracked.schema).parquet(f"{base}/out")
