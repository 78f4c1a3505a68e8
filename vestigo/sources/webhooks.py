"""Webhook intake: raw bodies with their headers, checked before anything is parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vestigo.operators.integrity import hmac_sha256

RAW = "arrival bigint, event_time timestamp, body string, signature string, authorization string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of raw bodies landed as JSON lines."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(path)


def check(raw: DataFrame, secret: str = "", token: str = "", prefix: str = "") -> DataFrame:
    """Mark each body: valid JSON object, valid keyed digest, valid token. Blank settings check nothing."""
    given = F.trim(F.coalesce("authorization", F.lit("")))
    if prefix:
        bare = F.trim(F.substring(given, F.lit(len(prefix) + 1), F.length(given)))
        given = F.when(F.lower(given).startswith(prefix.lower() + " "), bare).otherwise(given)
    signed = F.coalesce(hmac_sha256(F.col("body"), secret) == F.trim("signature"), F.lit(False)) if secret else F.lit(True)
    parsed = F.try_parse_json("body").isNotNull() & F.ltrim("body").rlike("^[\\[{]")
    return (
        raw.withColumn("json_valid", F.coalesce(parsed, F.lit(False)))
        .withColumn("signature_valid", signed)
        .withColumn("auth_valid", given == token if token else F.lit(True))
    )


def accepted() -> Column:
    return F.col("json_valid") & F.col("signature_valid") & F.col("auth_valid")
