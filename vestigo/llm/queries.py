"""The registered queries: thin calls of the operators over whole tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from vestigo.llm import bpe, cuckoo, jaccard, language, linededup, mixing, ordermin, pieces, repair, secrets, sharding, vectorcodes, warc
from vestigo.llm.joins import unused_name
from vestigo.llm.registry import query, table


@query("op1_language_id")
def op1(spark, sf):
    return language.predicted_languages(table(spark, sf, "documents"))


@query("op2_ngram_jaccard")
def op2(spark, sf):
    return jaccard.jaccard_components(table(spark, sf, "documents"), words=3, similarity=(90, 100))


@query("op3_line_dedup")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    cut = unused_name(docs.columns, "_cut")
    return linededup.without_repeats(docs, cut=cut).select("doc_id", "text", F.col(cut).alias("cut_lines"))


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> {0}) & 31 AS INT), 1)"
_BASE32 = " || ".join(_DIGIT.format(shift) for shift in range(35, -1, -5))


@query(
    "op4_warc_archive",
    f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (SELECT h, string_agg({_BASE32}, '' ORDER BY i) AS payload_digest
        FROM (SELECT h, i, CAST('0x' || substr(h, 1 + 10 * i, 10) AS BIGINT) AS v FROM (SELECT DISTINCT h FROM p), range(4) AS t(i)) GROUP BY h),
    f AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to FROM f JOIN d USING (h)""",
)
def op4(spark, sf):
    return warc.archived(table(spark, sf, "pages"))


@query(
    "op5_exact_dedup",
    r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
)
def op5(spark, sf):
    return cuckoo.exact_duplicates(table(spark, sf, "documents"))


@query("op6_order_minhash")
def op6(spark, sf):
    return ordermin.edited_likeness(table(spark, sf, "documents"))


@query("op7_source_mix")
def op7(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query("op8_byte_shards")
def op8(spark, sf):
    return sharding.shard_by_bytes(table(spark, sf, "documents"), shards=24)


@query("op9_secret_scan")
def op9(spark, sf):
    return secrets.scan(table(spark, sf, "documents"))


@query("op10_pieces")
def op10(spark, sf):
    return pieces.round_trip(table(spark, sf, "documents"), corpus_pipeline.vocabulary())


@query("op11_streaming_bpe")
def op11(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op12_conversation_repair")
def op12(spark, sf):
    return repair.repair_conversations(table(spark, sf, "conversations"))


@query("op13_vector_codes")
def op13(spark, sf):
    return vectorcodes.compress(table(spark, sf, "embeddings"))


@query("pipeline")
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
