"""Sources, sinks and streams on small files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vestigo.operators import video as T, webhooks as K
from vestigo.operators.providers import mask_sensitive
from vestigo.plans.catalogue import all_queries
from vestigo.plans.derived import load
from vestigo.sources import files as S

SF = "/root/testdata/sf0.001"


def test_guard_reads_only_headers(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0" + b"0" * 100)
    (tmp_path / "b.pdf").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 10)
    (tmp_path / "c.exe").write_bytes(b"MZ" + b"0" * 10)
    files = S.read_files(spark, str(tmp_path)).withColumn("content_type", F.lit("image/png"))
    got = {r.path.rsplit("/", 1)[1]: r for r in S.ingest_guard(files, max_bytes=110).collect()}
    assert got["a.jpg"].allowed and got["a.jpg"].warnings == ["content_type_divergente", "arquivo_proximo_do_limite"]
    assert got["b.pdf"].error == S.ERRORS["pdf"]
    assert got["c.exe"].error == S.ERRORS["extension"]
    empty = files.limit(1).withColumn("size_bytes", F.lit(0))
    assert S.ingest_guard(empty).first().error == S.ERRORS["empty"]


def test_catalog_rejects(spark, tmp_path):
    rows = [
        {"image": " a.jpg ", "kind": "Scene", "targets": ["ocr_reranking", "nope"]},
        {"image": "", "kind": "scene"},
        {"image": "b.jpg", "kind": "drawing"},
    ]
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(rows))
    good, bad = S.load_catalog(spark, str(path))
    (only,) = good.collect()
    assert (only.image, only.kind, only.difficulty, only.targets) == ("a.jpg", "scene", "medium", ["ocr_reranking"])
    assert bad.count() == 2


def test_personal_fields_are_hidden(spark):
    row = mask_sensitive(
        spark.createDataFrame([("9BW 123456", "Maria", "", "77")], "chassi string, proprietario string, endereco string, renavam string")
    ).first()
    assert (row.chassi, row.proprietario, row.endereco, row.renavam) == ("*****3456", "[restrito]", "", "**")


def test_history_forgets_the_oldest_key(spark):
    keys = ["a", "b", "c", "a", "d", "b"]
    events = spark.createDataFrame([("P", k, i) for i, k in enumerate(keys)], "plate string, event_key string, arrival long")
    got = [(r.event_key, r.arrival) for r in K.plate_history(events, keep=3).orderBy("position").collect()]
    assert got == [("b", 5), ("c", 2), ("d", 4)]
