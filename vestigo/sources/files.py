"""Batch sources and sinks. Every reader states its schema; malformed rows become defaults or rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vestigo.functions.numbers import safe_double
from vestigo.functions.text import norm_lower
from vestigo.operators.bench import KINDS, TARGETS
from vestigo.operators.providers import mask_sensitive

CATALOG = "image string, kind string, expected_text string, difficulty string, targets array<string>, notes string, _corrupt_record string"
CASES = "id bigint, user_id bigint, filename string, ocr string, pdf string, case_time timestamp, source string, color_info string"
CHAIN = (
    "chain_id bigint, seq bigint, analysis_id string, source_type string, generated_at_utc string, prev_entry_hash string, "
    "payload_hash string, signature string, entry_hash string"
)
AUDIT = "event_type string, event_time_utc string, payload string"
TRACE = (
    "analysis_id string, total_duration_ms double, wall_start_utc string, "
    "spans array<struct<stage:string,duration_ms:double,status:string,error:string>>"
)
RESULTS = (
    "generated_at_utc string, results array<struct<image:string,confidence:string,observed_best_confidence:string,"
    "observed_confidence:string,observed_text:string,observed_best_text:string,top_candidate_text:string>>"
)
# Report labels and the confidence that separates them.
INCONCLUSIVE, STRONG, STRONG_FROM = "INCONCLUSIVO", "IDENTIFICAÇÃO FORTE", 95.0

# Allowed extensions, leading bytes (hex) and what they mean, in the order they are tried.
EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".pdf"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff"]
SIGNATURES = [
    ("pdf", "application/pdf", "^25504446"),
    ("jpeg", "image/jpeg", "^FFD8FF"),
    ("png", "image/png", "^89504E470D0A1A0A"),
    ("webp", "image/webp", "^52494646.{8}57454250"),
    ("bmp", "image/bmp", "^424D"),
    ("tiff", "image/tiff", "^(4949|4D4D)(2A00|002A)"),
]
ERRORS = {
    "empty": "Arquivo enviado esta vazio",
    "extension": "Extensao nao permitida para analise",
    "size": "Arquivo enviado excede o limite configurado",
    "signature": "Assinatura do arquivo nao reconhecida",
    "pdf": "Arquivo PDF invalido ou corrompido",
    "image": "Arquivo de imagem invalido ou corrompido",
}
MAX_BYTES, NEAR_LIMIT = 80 * 1024 * 1024, 0.8


def load_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Benchmark catalog: usable entries, and the rows rejected for want of an image or a known kind."""
    raw = spark.read.schema(CATALOG).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = raw.select(
        text("image").alias("image"),
        F.lower(text("kind")).alias("kind"),
        text("expected_text").alias("expected_text"),
        F.coalesce(F.nullif(F.lower(text("difficulty")), F.lit("")), F.lit("medium")).alias("difficulty"),
        F.filter(
            F.transform(F.coalesce("targets", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t.isin(*TARGETS)
        ).alias("targets"),
        text("notes").alias("notes"),
        "_corrupt_record",
    )
    good = (F.col("image") != "") & F.col("kind").isin(*KINDS)
    return rows.where(good).drop("_corrupt_record"), rows.where(~good)


def load_case_history(spark: SparkSession, path: str, fmt: str = "parquet", user_id: int | None = None) -> DataFrame:
    """Stored cases, newest first for a user. A filter on user_id reaches the files (or partitions)."""
    reader = spark.read.schema(CASES).format(fmt)
    cases = reader.load(path)
    return cases if user_id is None else cases.where(F.col("user_id") == user_id).orderBy(F.col("case_time").desc())


def load_case_history_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, parts: int) -> DataFrame:
    """Stored cases from a database, read in ranges of the id; filters are pushed to the database."""
    options = {"partitionColumn": "id", "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def append_case_history(cases: DataFrame, path: str) -> None:
    """Append cases. The id is a content key, so no task has to know the highest id. Rows are sorted by
    user inside each file, so a reader of one user skips the rest by the files' own statistics."""
    keyed = cases.withColumn("id", F.abs(F.xxhash64("user_id", "filename", "ocr", "case_time")))
    keyed.sortWithinPartitions("user_id", "case_time").write.mode("append").parquet(path)


def load_reference(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested make-to-models JSON as one row per model; blank names go."""
    schema = (
        "models map<string,array<struct<nome:string,anos:array<int>,combustiveis:array<string>,variantes:array<string>>>>"
    )
    makes = spark.read.schema(schema).option("multiLine", multi_line).json(path).select(F.explode("models").alias("make", "rows"))
    models = makes.select("make", F.posexplode("rows").alias("position", "m"))
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return models.select(
        "make",
        norm_lower(F.col("make")).alias("make_norm"),
        F.trim("m.nome").alias("model"),
        norm_lower(F.col("m.nome")).alias("model_norm"),
        none(F.col("m.anos"), "int").alias("years"),
        none(F.col("m.combustiveis"), "string").alias("fuels"),
        none(F.col("m.variantes"), "string").alias("variants"),
        F.col("position").cast("bigint").alias("position"),
    ).where((F.col("make_norm") != "") & (F.coalesce("model", F.lit("")) != ""))


def load_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """Dataset metadata with header row."""
    schema = "model_id string, make string, year int, split string"
    return spark.read.schema(schema).option("header", True).csv(path)


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Labelled objects from annotation XML files, one row per object with the file's stem."""
    schema = (
        "filename string, size struct<width:int,height:int>, "
        "object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    )
    notes = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    objects = notes.select("filename", "size", F.explode("object").alias("o")).where(F.col("o.bndbox").isNotNull())
    width, height = F.coalesce("size.width", F.lit(1280)), F.coalesce("size.height", F.lit(720))
    return objects.select(
        F.regexp_replace("filename", "\\.[^.]*$", "").alias("stem"),
        F.col("o.name").alias("name"),
        F.coalesce("o.bndbox.xmin", F.lit(0.0)).alias("xmin"),
        F.coalesce("o.bndbox.ymin", F.lit(0.0)).alias("ymin"),
        F.coalesce("o.bndbox.xmax", width.cast("double")).alias("xmax"),
        F.coalesce("o.bndbox.ymax", height.cast("double")).alias("ymax"),
        width.alias("width"),
        height.alias("height"),
    )


def pair_annotations(images: DataFrame, objects: DataFrame) -> DataFrame:
    """Images joined to their objects by file stem; an image without annotation keeps one empty row."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    return images.withColumn("stem", stem).join(objects, "stem", "left")


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id bigint, embedding array<float>, label int").parquet(path)


def load_chain_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAIN).json(path)


def append_chain_log(chain: DataFrame, path: str) -> None:
    chain.write.mode("append").json(path)


def append_audit_log(events: DataFrame, path: str) -> None:
    """Audit lines in JSON, one folder per day. `events`: event_type, event_time, payload."""
    stamped = events.select(
        "event_type",
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_time_utc"),
        "payload",
        F.to_date("event_time").alias("day"),
    )
    stamped.write.mode("append").partitionBy("day").json(path)


def load_audit_log(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"{AUDIT}, day date").json(path)
    return raw.withColumn("event_time", F.to_timestamp("event_time_utc"))


def load_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Spans of every trace, one row each."""
    traces = spark.read.schema(TRACE).json(path)
    return traces.select("analysis_id", "total_duration_ms", F.explode("spans").alias("s")).select(
        "analysis_id", "total_duration_ms", "s.*"
    )


def results_union(spark: SparkSession, pattern: str, min_conf: float = 0.0) -> DataFrame:
    """Readings of all result files that match the pattern, labelled by confidence.

    A zero or a blank passes the turn to the next field that may hold the value.
    """
    files = spark.read.schema(RESULTS).json(pattern).select(F.input_file_name().alias("file"), "generated_at_utc", F.posexplode("results").alias("pos", "r"))
    number = lambda c: F.nullif(safe_double(F.col(f"r.{c}")), F.lit(0.0))
    text = lambda c: F.nullif(F.col(f"r.{c}"), F.lit(""))
    conf = F.coalesce(number("confidence"), number("observed_best_confidence"), number("observed_confidence"), F.lit(0.0))
    found = F.coalesce(text("observed_text"), text("observed_best_text"), text("top_candidate_text"), F.lit(INCONCLUSIVE))
    base = F.element_at(F.split("file", "/"), -1)
    rows = files.select(
        F.concat_ws("_", base, "pos").alias("result_id"),
        F.coalesce("generated_at_utc", F.lit("")).alias("generated_at_utc"),
        F.element_at(F.split(F.coalesce("r.image", F.lit("")), "/"), -1).alias("image"),
        F.when(F.trim(found) == "", INCONCLUSIVE).otherwise(found).alias("reading"),
        conf.alias("confidence"),
    ).where(F.col("confidence") >= min_conf)
    return rows.withColumn("conclusion", F.when(F.col("confidence") < STRONG_FROM, INCONCLUSIVE).otherwise(STRONG))


def write_report(report: DataFrame, path: str, fmt: str = "parquet", keys: list[str] | None = None) -> None:
    """Write a report table; personal fields are hidden first."""
    writer = mask_sensitive(report).write.mode("overwrite").format(fmt)
    (writer.partitionBy(*keys) if keys else writer).save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and leading 16 bytes of files; contents are dropped at the scan."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.substring("content", 1, 16).alias("header"))


def ingest_guard(files: DataFrame, max_bytes: int = MAX_BYTES, extensions: list[str] | None = None) -> DataFrame:
    """Verdict on uploaded files by extension, leading bytes and size.

    `files`: path, size_bytes, header (binary), content_type.
    """
    allowed = extensions or EXTENSIONS
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, "^.+(\\.[^.]*)$", 1))
    hexed = F.hex(F.col("header"))
    kind, mime = F.lit("unknown"), F.lit("")
    for k, m, pattern in reversed(SIGNATURES):
        kind = F.when(hexed.rlike(pattern), k).otherwise(kind)
        mime = F.when(hexed.rlike(pattern), m).otherwise(mime)
    seen = files.withColumn("extension", ext).withColumn("signature", kind).withColumn("mime", mime)
    size, sig, e = F.col("size_bytes"), F.col("signature"), F.col("extension")
    error = (
        F.when(size <= 0, ERRORS["empty"])
        .when(~e.isin(*allowed), ERRORS["extension"])
        .when(size > max_bytes, ERRORS["size"])
        .when(sig == "unknown", ERRORS["signature"])
        .when((e == ".pdf") & (sig != "pdf"), ERRORS["pdf"])
        .when(e.isin(*IMAGE_EXTENSIONS) & (sig == "pdf"), ERRORS["image"])
        .otherwise("")
    )
    told = F.lower(F.trim(F.coalesce("content_type", F.lit(""))))
    odd = (told != "") & (F.col("mime") != "") & (told != F.col("mime")) & (told != "application/octet-stream")
    warnings = F.array_compact(
        F.array(
            F.when(odd, "content_type_divergente"),
            F.when(size >= int(max_bytes * NEAR_LIMIT), "arquivo_proximo_do_limite"),
        )
    )
    judged = seen.withColumn("error", error)
    ok = F.col("error") == ""
    return judged.select(
        "path",
        "extension",
        "signature",
        "size_bytes",
        ok.alias("allowed"),
        "error",
        F.when(ok, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
