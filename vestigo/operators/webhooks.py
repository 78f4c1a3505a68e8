"""Webhook events as tables: normalising, upsert by key, latest by plate, open requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vestigo.functions.plates import norm_plate
from vestigo.functions.text import squeeze
from vestigo.operators.ordered import ordered_fold

# Envelope defaults, plate and request aliases, history length.
DEFAULT_EVENT, DEFAULT_RESOURCE, DEFAULT_VERSION = "webhook_event", "vehicle_debt", "v2"
PLATE_KEYS = ["license_plate", "placa", "plate", "plate_number"]
HISTORY_KEYS = 8
DEBT_LABELS = 4


def normalize_webhook(raw: DataFrame) -> DataFrame:
    """One row per raw body: envelope fields found at the root, in `data` or in `vehicle`; debts
    counted and summed up; and the key that says which event this is.

    `raw`: arrival, payload (JSON text).
    """
    as_map = "map<string,string>"
    levels = (
        raw.withColumn("_root", F.from_json("payload", as_map))
        .withColumn("_data", F.coalesce(F.from_json(F.try_element_at("_root", F.lit("data")), as_map), F.col("_root")))
        .withColumn("_hook", F.from_json(F.try_element_at("_root", F.lit("webhook")), as_map))
        .withColumn(
            "_vehicle",
            F.coalesce(
                F.from_json(F.try_element_at("_data", F.lit("vehicle")), as_map),
                F.from_json(F.try_element_at("_root", F.lit("vehicle")), as_map),
                F.col("_data"),
            ),
        )
    )

    def at(level: str, name: str) -> Column:
        return F.try_element_at(F.col(level), F.lit(name))

    def clean(c: Column) -> Column:
        return squeeze(F.coalesce(c, F.lit("")))

    def first_filled(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(clean(o), F.lit("")) for o in options], F.lit(""))

    plates = [norm_plate(at(level, k)) for level in ("_vehicle", "_root", "_data") for k in PLATE_KEYS]
    plate = F.coalesce(*[F.nullif(p, F.lit("")) for p in plates], F.lit(""))
    request = first_filled(
        at("_root", "request_id"),
        at("_root", "requestId"),
        at("_data", "request_id"),
        at("_data", "requestId"),
        at("_data", "search_request_id"),
    )
    event = clean(F.coalesce(at("_root", "event"), at("_data", "event"), F.lit(DEFAULT_EVENT)))
    debt_rows = F.from_json(
        F.coalesce(at("_data", "debts"), at("_root", "debts")), "array<struct<name:string,description:string,type:string,detail:string,amount:string,value:string>>"
    )
    named = levels.select(
        *[c for c in raw.columns if c != "payload"],
        F.when(event == "", DEFAULT_EVENT).otherwise(event).alias("event"),
        clean(F.coalesce(at("_root", "status"), at("_data", "status"))).alias("_status"),
        clean(F.coalesce(at("_root", "detail"), at("_data", "detail"))).alias("detail"),
        request.alias("request_id"),
        plate.alias("plate"),
        clean(F.coalesce(at("_hook", "id"), at("_root", "webhook_id"))).alias("webhook_id"),
        clean(F.coalesce(at("_hook", "resource"), at("_root", "resource"), F.lit(DEFAULT_RESOURCE))).alias("resource"),
        clean(F.coalesce(at("_hook", "version"), at("_root", "version"), F.lit(DEFAULT_VERSION))).alias("version"),
        F.coalesce(debt_rows, F.array()).alias("_debts"),
    ).withColumn("status", F.when(F.col("_status") == "", F.col("event")).otherwise(F.col("_status")))
    label = lambda d: squeeze(F.coalesce(d["name"], d["description"], d["type"], d["detail"], F.lit("")))
    amount = lambda d: squeeze(F.coalesce(d["amount"], d["value"], F.lit("")))
    lines = F.filter(
        F.transform(
            "_debts",
            lambda d: F.when(label(d) == "", F.lit("")).when(amount(d) == "", label(d)).otherwise(
                F.concat(label(d), F.lit(" ("), amount(d), F.lit(")"))
            ),
        ),
        lambda s: s != "",
    )
    key = F.when(F.col("request_id") != "", F.concat(F.lit("request_id:"), "request_id")).otherwise(
        F.concat(F.lit("fallback:"), F.concat_ws("|", "plate", "event", "status", "detail"))
    )
    return (
        named.withColumn("event_key", key)
        .withColumn("debts_count", F.size("_debts").cast("bigint"))
        .withColumn("debts_summary", F.array_join(F.slice(lines, 1, DEBT_LABELS), " | "))
        .drop("_status", "_debts")
    )


def event_upsert(events: DataFrame) -> DataFrame:
    """Last arrival per event key, as an aggregate that combines before the shuffle."""
    rest = [c for c in events.columns if c != "event_key"]
    return (
        events.groupBy("event_key")
        .agg(F.max_by(F.struct(*rest), "arrival").alias("_e"), F.count(F.lit(1)).alias("arrivals"))
        .select("event_key", "_e.*", "arrivals")
    )


def recent_events(events: DataFrame, keep: int = 250) -> DataFrame:
    """The `keep` keys that first arrived last, each with its latest content."""
    first = events.groupBy("event_key").agg(F.min("arrival").alias("first_arrival"))
    return event_upsert(events).join(first, "event_key").orderBy(F.col("first_arrival").desc()).limit(keep)


def latest_by_plate(events: DataFrame) -> DataFrame:
    """Per plate: content of the last arrival, last request id that was not blank, number of arrivals."""
    named = events.where(F.col("plate") != "")
    return named.groupBy("plate").agg(
        F.max_by(F.struct("event_key", "event", "status", "arrival"), "arrival").alias("l"),
        F.coalesce(
            F.max_by("request_id", F.when(F.col("request_id") != "", F.col("arrival"))), F.lit("")
        ).alias("latest_request_id"),
        F.count(F.lit(1)).alias("arrivals"),
    ).select(
        "plate",
        F.col("l.event_key").alias("event_key"),
        F.col("l.event").alias("event"),
        F.col("l.status").alias("status"),
        F.col("l.arrival").alias("arrival"),
        "latest_request_id",
        "arrivals",
    )


def plate_history(events: DataFrame, keep: int = HISTORY_KEYS) -> DataFrame:
    """The keys each plate remembers: a known key is replaced in place, a new one pushes out the oldest.

    Depends on arrival order, so a plate is read in order by one task that holds `keep` entries.
    """

    def add(window: list, row: tuple) -> None:
        key, arrival = row
        for i, (known, _) in enumerate(window):
            if known == key:
                window[i] = (key, arrival)
                return
        window.append((key, arrival))
        if len(window) > keep:
            del window[0]

    def close(window: list) -> list[tuple]:
        return [(i + 1, key, arrival) for i, (key, arrival) in enumerate(window)]

    named = events.where(F.col("plate") != "").select("plate", "event_key", "arrival")
    schema = named.select("plate", F.lit(1).cast("bigint").alias("position"), "event_key", "arrival").schema
    return ordered_fold(named, "plate", ["arrival"], ["event_key", "arrival"], list, add, close, schema)


def recent_activity(events: DataFrame) -> DataFrame:
    """The latest event of all (the later arrival wins a tie) and how many keys and plates there are."""
    return events.agg(
        F.max_by(F.struct("plate", "request_id", "event", "status", "detail"), F.struct("event_time", "arrival")).alias("l"),
        F.max("event_time").alias("updated_at"),
        F.count_distinct("event_key").alias("history_count"),
        F.count_distinct(F.nullif(F.col("plate"), F.lit(""))).alias("plate_count"),
    ).select(
        F.col("l.plate").alias("latest_plate"),
        F.col("l.request_id").alias("latest_request_id"),
        F.col("l.event").alias("latest_event"),
        F.lower(F.trim("l.status")).alias("latest_status"),
        F.col("l.detail").alias("latest_detail"),
        "updated_at",
        "history_count",
        "plate_count",
    )


def pending_requests(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests that no webhook has answered yet."""
    answered = replies.where(F.col("request_id") != "").select("request_id").distinct()
    return requests.where(F.col("status") == "pending_async").join(answered, "request_id", "left_anti")
