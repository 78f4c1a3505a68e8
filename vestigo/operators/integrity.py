"""Evidence integrity: hashes, chained custody entries, manifests, duplicate artifacts."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vestigo.operators.ordered import ordered_fold

# Stands for the former entry's hash in an entry's text until it is known; quotes inside values are escaped.
_SLOT = '"prev_entry_hash":"@"'

# Custody steps (order, label) of the two kinds of analysis.
IMAGE_STEPS = {3: "Recorte bruto", 4: "Recorte tratado"}
VIDEO_STEPS = {3: "Varredura frame a frame", 4: "Selecao do operador"}
COMMON_STEPS = {
    1: "Entrada preservada",
    2: "Tratamento tecnico",
    5: "OCR e consenso",
    6: "Conferencia humana",
    7: "Documento gerado",
}


def sha256(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def hmac_sha256(c: Column, secret: str) -> Column:
    """Keyed digest from two plain ones; the padded keys are worked out once, here."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.coalesce(c, F.lit("")).cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON text with keys in order and no blanks; missing values are written as null."""
    ordered = F.struct(*[columns[k].alias(k) for k in sorted(columns)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def payload_hash(rows: DataFrame, columns: list[str], out: str = "payload_hash") -> DataFrame:
    return rows.withColumn(out, sha256(canonical_json({c: F.col(c) for c in columns})))


def _entry_hash(material: Column, prev: Column, secret: str) -> tuple[Column, Column]:
    signature = hmac_sha256(material, secret) if secret else sha256(material)
    return signature, sha256(F.concat(material, F.lit("|"), signature, F.lit("|"), prev))


def chain_build(entries: DataFrame, fields: list[str], secret: str = "") -> DataFrame:
    """Hash-linked entries, one chain per case, by one rule for every length.

    Each entry hashes its fields with the hash of the entry before, so a chain's order is its content:
    Spark sorts by chain and one pass per chain streams through with only the last hash in memory.
    Chains run in parallel. `entries`: chain_id, seq (1-based), and the fields, all strings.
    """
    text = canonical_json({**{f: F.col(f) for f in fields}, "prev_entry_hash": F.lit("@")})
    cut = F.instr("_text", _SLOT)
    parts = entries.select("chain_id", F.col("seq").cast("bigint").alias("seq"), text.alias("_text")).select(
        "chain_id",
        "seq",
        F.substring("_text", F.lit(1), cut - 1).alias("_head"),
        F.substring("_text", cut + len(_SLOT), F.length("_text")).alias("_tail"),
    )
    key = secret.encode()

    def digest(material: bytes) -> str:
        return (hmac.new(key, material, hashlib.sha256) if key else hashlib.sha256(material)).hexdigest()

    def add(last: list[str], row: tuple) -> list[tuple]:
        seq, head, tail = row
        prev = last[0]
        material = f'{head}"prev_entry_hash":"{prev}"{tail}'.encode()
        signature = digest(material)
        last[0] = hashlib.sha256(b"|".join([material, signature.encode(), prev.encode()])).hexdigest()
        return [(seq, prev, signature, last[0])]

    schema = T.StructType(
        [entries.schema["chain_id"], T.StructField("seq", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("prev_entry_hash", "signature", "entry_hash")]]
    )
    linked = ordered_fold(parts, "chain_id", ["seq"], ["seq", "_head", "_tail"], lambda: [""], add, lambda last: [], schema)
    return entries.join(linked, ["chain_id", "seq"])


def chain_verify(chain: DataFrame, fields: list[str], secret: str = "") -> DataFrame:
    """Check every entry against its own contents and against the entry before it.

    Entries meet their predecessor by (chain, seq), so a long chain spreads over all tasks.
    """
    before = chain.select("chain_id", (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("_before"))
    joined = chain.join(before, ["chain_id", "seq"], "left")
    material = canonical_json({**{f: F.col(f) for f in fields}, "prev_entry_hash": F.col("prev_entry_hash")})
    signature, digest = _entry_hash(F.col("_m"), F.col("prev_entry_hash"), secret)
    expected = F.when(F.col("seq") == 1, "").otherwise(F.col("_before"))
    linked = F.coalesce(expected == F.col("prev_entry_hash"), F.lit(False))
    return joined.withColumn("_m", material).select(
        "chain_id",
        "seq",
        (F.col("signature") == signature).alias("signature_ok"),
        (F.col("entry_hash") == digest).alias("hash_ok"),
        linked.alias("link_ok"),
    )


def first_break(verified: DataFrame) -> DataFrame:
    """Length of each chain and the first entry that fails, -1 if none does."""
    bad = ~(F.col("signature_ok") & F.col("hash_ok") & F.col("link_ok"))
    return verified.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.min(F.when(bad, F.col("seq"))), F.lit(-1)).cast("bigint").alias("first_break"),
    )


def unique_artifacts(artifacts: DataFrame) -> DataFrame:
    """First artifact per path of each evidence."""
    return (
        artifacts.where(F.trim("path") != "")
        .groupBy("evidence_id", "path")
        .agg(F.min(F.struct("pos", *[c for c in artifacts.columns if c not in ("evidence_id", "path", "pos")])).alias("a"))
        .select("evidence_id", "path", "a.*")
    )


def _steps() -> Column:
    """The seven custody steps of an analysis as an array of step, label, status."""
    video = F.lower("kind").startswith("video")
    pick = lambda test, yes, no: F.when(test, yes).otherwise(no)
    status = {
        1: pick(F.col("source_exists"), "registrada", "indisponivel"),
        2: pick(F.col("derived") > 0, "aplicado", "pendente"),
        3: F.when(video, pick(F.col("frames") > 0, "executada", "pendente")).otherwise(
            pick(F.trim("crop_raw") != "", "registrado", "indisponivel")
        ),
        4: F.when(video, pick(F.col("targets") > 0, "registrada", "automatica")).otherwise(
            pick(F.trim("crop_treated") != "", "registrado", "indisponivel")
        ),
        5: pick(F.col("has_consensus"), "executado", "pendente"),
        6: pick(F.col("review_required"), "obrigatoria", "registrada"),
        7: pick(F.lower("stage") != "preview", "consolidado", "pre-analise"),
    }
    label = {n: F.lit(t) for n, t in COMMON_STEPS.items()}
    for n in IMAGE_STEPS:
        label[n] = pick(video, VIDEO_STEPS[n], IMAGE_STEPS[n])
    return F.array(
        *[F.struct(F.lit(n).cast("bigint").alias("step"), label[n].alias("label"), status[n].alias("status")) for n in range(1, 8)]
    )


def custody_steps(cases: DataFrame) -> DataFrame:
    """The seven custody steps of each analysis with their status.

    `cases`: evidence_id, kind, stage, source_exists, derived, frames, targets, has_consensus, crop_raw,
    crop_treated, review_required.
    """
    return cases.select("evidence_id", F.explode(_steps()).alias("s")).select("evidence_id", "s.*")


def manifest_fingerprint(cases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Digest of each evidence's whole manifest: every column of its case (source, processing, selection,
    review), its custody steps, and its artifacts.

    The first artifact of a path counts, with its position, label and content digest. Artifacts enter as
    a hash tree: full digests sorted in 4,096 slices by their first digits, slice digests sorted in one
    root, so an evidence with very many of them is never gathered whole. `cases`: as for custody_steps;
    `artifacts`: evidence_id, pos, path, label, digest.
    """
    entry = sha256(canonical_json({c: F.col(c) for c in ("pos", "path", "label", "digest")}))
    leaves = unique_artifacts(artifacts).select("evidence_id", entry.alias("_leaf"))
    slices = leaves.groupBy("evidence_id", F.left("_leaf", F.lit(3)).alias("_slice")).agg(
        F.count(F.lit(1)).alias("_n"), sha256(F.concat_ws(",", F.array_sort(F.collect_list("_leaf")))).alias("_node")
    )
    roots = slices.groupBy("evidence_id").agg(
        F.sum("_n").alias("artifact_count"),
        sha256(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "_slice", "_n", "_node"))))).alias("_root"),
    )
    joined = cases.join(roots, "evidence_id", "left").withColumn("artifact_count", F.coalesce("artifact_count", F.lit(0)))
    told = F.transform(_steps(), lambda s: F.concat_ws(":", s["step"].cast("string"), s["label"], s["status"]))
    columns = {c: F.col(c) for c in cases.columns} | {
        "artifact_count": F.col("artifact_count"),
        "artifacts": F.coalesce("_root", F.lit("")),
        "custody": F.concat_ws("; ", told),
    }
    return joined.select(
        "evidence_id",
        F.col("artifact_count").cast("bigint").alias("artifact_count"),
        F.left(sha256(canonical_json(columns)), F.lit(24)).alias("fingerprint"),
    )


def artifact_duplicates(contents: DataFrame, key: str, body: str) -> DataFrame:
    """Digests shared by several evidences. Bodies are digested where they lie; only digests move."""
    return (
        contents.select(key, sha256(F.col(body)).alias("digest"))
        .groupBy("digest")
        .agg(F.count_distinct(key).alias("copies"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
        .where(F.col("copies") > 1)
    )
