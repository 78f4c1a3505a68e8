"""Integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.operators import integrity as I
from vestigo.operators.spread import spread_rank
from vestigo.plans.derived import add, load, read, with_tables
from vestigo.plans.registry import query

FIELDS = ["analysis_id", "payload_hash", "source_type"]
add(
    "chain_source",
    "orders",
    [
        "o_custkey AS chain_id",
        "o_orderkey",
        "'a' || CAST(o_orderkey AS STRING) AS analysis_id",
        "CASE WHEN o_orderstatus='P' THEN 'video' ELSE 'image' END AS source_type",
        "o_orderpriority AS level",
    ],
)
add(
    "custody_cases",
    "orders",
    [
        "o_orderkey AS evidence_id",
        "CASE WHEN o_orderstatus='P' THEN 'video' ELSE 'image' END AS kind",
        "CASE WHEN o_custkey%4=0 THEN 'Preview' ELSE 'final' END AS stage",
        "o_custkey%5<>0 AS source_exists",
        "o_custkey%3 AS derived",
        "o_custkey%2 AS frames",
        "o_custkey%6 AS targets",
        "o_custkey%7<>0 AS has_consensus",
        "CASE WHEN o_custkey%8=0 THEN '' ELSE 'c.jpg' END AS crop_raw",
        "CASE WHEN o_custkey%9=0 THEN '' ELSE 't.jpg' END AS crop_treated",
        "o_custkey%11=0 AS review_required",
    ],
)
add(
    "artifacts",
    "lineitem",
    [
        "l_orderkey AS evidence_id",
        "(CAST(l_linenumber AS BIGINT)*10000000+l_partkey)*100000+l_suppkey AS pos",
        "CASE WHEN l_suppkey%10=0 THEN '' ELSE 'out/' || CAST(l_linenumber AS STRING) || '.jpg' END AS path",
        "'label_' || l_returnflag AS label",
        "CAST(l_partkey AS STRING) || ' of ' || CAST(l_suppkey AS STRING) AS content",
    ],
)

_CHAIN_SQL = (
    with_tables("chain_source", recursive=True)
    + """, e AS (SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY o_orderkey) AS seq, analysis_id, source_type,
      sha256('{"analysis_id":"' || analysis_id || '","level":"' || level || '"}') AS payload_hash FROM chain_source),
    m1 AS (SELECT *, '{"analysis_id":"' || analysis_id || '","payload_hash":"' || payload_hash || '","prev_entry_hash":"' AS head, '","source_type":"' || source_type || '"}' AS tail FROM e),
    walk AS (SELECT chain_id, seq, '' AS prev_entry_hash, sha256(head || tail) AS signature,
        sha256(head || tail || '|' || sha256(head || tail) || '|') AS entry_hash FROM m1 WHERE seq = 1
      UNION ALL SELECT m.chain_id, m.seq, w.entry_hash, sha256(m.head || w.entry_hash || m.tail),
        sha256(m.head || w.entry_hash || m.tail || '|' || sha256(m.head || w.entry_hash || m.tail) || '|' || w.entry_hash)
      FROM walk w JOIN m1 m ON m.chain_id = w.chain_id AND m.seq = w.seq + 1)"""
)


def entries(spark, sf):
    rows = I.payload_hash(load(spark, sf, "chain_source"), ["analysis_id", "level"])
    # Entries numbered by order key; buckets of keys keep a very long chain from being sorted in one task.
    numbered = spread_rank(rows, ["chain_id"], F.floor(F.col("o_orderkey") / 1_000_000), [F.col("o_orderkey")], "seq")
    return numbered.select("chain_id", "seq", *FIELDS)


@query("chain_build", _CHAIN_SQL + " SELECT * FROM walk")
def chain_build(spark, sf):
    built = I.chain_build(entries(spark, sf), FIELDS)
    return built.select("chain_id", "seq", "prev_entry_hash", "signature", "entry_hash")


@query(
    "chain_verify",
    _CHAIN_SQL
    + """ SELECT chain_id, count(*) AS entries, coalesce(min(CASE WHEN seq >= 3 AND seq = 3 THEN seq END), -1) AS first_break FROM walk GROUP BY chain_id""",
)
def chain_verify(spark, sf):
    """The built chains with the payload of each third entry changed: the break is found where it was made."""
    built = I.chain_build(entries(spark, sf), FIELDS)
    touched = built.withColumn("payload_hash", F.when(F.col("seq") == 3, F.sha2("payload_hash", 256)).otherwise(F.col("payload_hash")))
    return I.first_break(I.chain_verify(touched, FIELDS))


@query(
    "payload_hash",
    """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"n_chars":' || n_chars || ',"source":' || to_json(source) || ',"text":' || to_json(text) || '}') AS payload_hash FROM documents""",
)
def payload_hash(spark, sf):
    docs = I.payload_hash(read(spark, sf, "documents"), ["doc_id", "lang", "source", "n_chars", "text"])
    return docs.select("doc_id", "payload_hash")


_STEPS_SQL = (
    with_tables("custody_cases", "artifacts")
    + """, s AS (SELECT *, kind = 'video' AS v FROM custody_cases),
    st AS (SELECT evidence_id, 1::BIGINT AS step, 'Entrada preservada' AS label, CASE WHEN source_exists THEN 'registrada' ELSE 'indisponivel' END AS status FROM s
    UNION ALL SELECT evidence_id, 2, 'Tratamento tecnico', CASE WHEN derived > 0 THEN 'aplicado' ELSE 'pendente' END FROM s
    UNION ALL SELECT evidence_id, 3, CASE WHEN v THEN 'Varredura frame a frame' ELSE 'Recorte bruto' END, CASE WHEN v THEN CASE WHEN frames > 0 THEN 'executada' ELSE 'pendente' END
      ELSE CASE WHEN crop_raw <> '' THEN 'registrado' ELSE 'indisponivel' END END FROM s
    UNION ALL SELECT evidence_id, 4, CASE WHEN v THEN 'Selecao do operador' ELSE 'Recorte tratado' END, CASE WHEN v THEN CASE WHEN targets > 0 THEN 'registrada' ELSE 'automatica' END
      ELSE CASE WHEN crop_treated <> '' THEN 'registrado' ELSE 'indisponivel' END END FROM s
    UNION ALL SELECT evidence_id, 5, 'OCR e consenso', CASE WHEN has_consensus THEN 'executado' ELSE 'pendente' END FROM s
    UNION ALL SELECT evidence_id, 6, 'Conferencia humana', CASE WHEN review_required THEN 'obrigatoria' ELSE 'registrada' END FROM s
    UNION ALL SELECT evidence_id, 7, 'Documento gerado', CASE WHEN lower(stage) <> 'preview' THEN 'consolidado' ELSE 'pre-analise' END FROM s)"""
)


@query("custody_steps", _STEPS_SQL + " SELECT * FROM st")
def custody_steps(spark, sf):
    return I.custody_steps(load(spark, sf, "custody_cases"))


@query(
    "unique_artifacts",
    with_tables("artifacts")
    + " SELECT evidence_id, path, pos, label, content FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id, path ORDER BY pos) AS n FROM artifacts WHERE path <> '') WHERE n = 1",
)
def unique_artifacts(spark, sf):
    return I.unique_artifacts(load(spark, sf, "artifacts"))


_MANIFEST = [
    "artifact_count", "artifacts", "crop_raw", "crop_treated", "custody", "derived", "evidence_id", "frames", "has_consensus", "kind",
    "review_required", "source_exists", "stage", "targets",
]


@query(
    "manifest_fingerprint",
    _STEPS_SQL
    + f""", u AS (SELECT *, row_number() OVER (PARTITION BY evidence_id, path ORDER BY pos) AS n FROM artifacts WHERE path <> ''),
    leaves AS (SELECT evidence_id, sha256(to_json({{'digest': sha256(content), 'label': label, 'path': path, 'pos': pos}})) AS leaf FROM u WHERE n = 1),
    slices AS (SELECT evidence_id, left(leaf, 3) AS sl, count(*) AS n, sha256(string_agg(leaf, ',' ORDER BY leaf)) AS node FROM leaves GROUP BY ALL),
    roots AS (SELECT evidence_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(sl || ':' || n || ':' || node, ',' ORDER BY sl)) AS root FROM slices GROUP BY evidence_id),
    told AS (SELECT evidence_id, string_agg(step || ':' || label || ':' || status, '; ' ORDER BY step) AS custody FROM st GROUP BY evidence_id),
    m AS (SELECT c.*, coalesce(n, 0) AS artifact_count, coalesce(root, '') AS artifacts, custody FROM custody_cases c
      JOIN told ON told.evidence_id = c.evidence_id LEFT JOIN roots ON roots.evidence_id = c.evidence_id)
    SELECT evidence_id, artifact_count, left(sha256(to_json({{{', '.join(f"'{c}': {c}" for c in _MANIFEST)}}})), 24) AS fingerprint FROM m""",
)
def manifest_fingerprint(spark, sf):
    artifacts = load(spark, sf, "artifacts").withColumn("digest", I.sha256(F.col("content")))
    return I.manifest_fingerprint(load(spark, sf, "custody_cases"), artifacts)


@query(
    "artifact_duplicates",
    """SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents
    GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""",
)
def artifact_duplicates(spark, sf):
    return I.artifact_duplicates(read(spark, sf, "documents"), "doc_id", "text")
