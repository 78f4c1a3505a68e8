"""Work that grows no faster than its input: the same results with less moved, held or read at once."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vestigo.functions.geometry import bbox_key
from vestigo.functions.text import matching_characters
from vestigo.operators import bench as B, fusion as U, hypotheses as H, places as L, providers as R, quality as Q, spread as S, vehicles as V, web as P
from vestigo.session import stashed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_of_a_case_are_made_once(spark):
    candidates = spark.createDataFrame(
        [(1, "FIAT", "UNO", "AUTOMOVEL"), (1, "FIAT", "PALIO", "AUTOMOVEL"), (1, "VW", "GOL", "AUTOMOVEL"), (2, "VW", "GOL", "NONE"), (2, "A", "B", None), (3, "A", "B", "CAMINHAO")] * 1
        + [(1, "FIAT", "UNO", "AUTOMOVEL")],
        "case_id long, maker string, model string, category string",
    )
    read = spark.createDataFrame([(1, "grade_dianteira", "presente", 80.0), (1, "parachoque", "limitado_vista_x", 10.0), (1, "sonst", "presente", 90.0), (2, "sonst", "fraca", 50.0)], "case_id long, component string, status string, confidence double")
    rules = spark.createDataFrame([("VW", "GOL", 0, "sonst", ["presente"], 10.0)], "maker string, model string, seq int, component string, statuses array<string>, weight double")
    checks = H.component_checks(candidates, read, rules).collect()
    # two rows for case 1: one for its candidates without rules that came once, one for the one that came twice; and the ruled one
    assert sorted((len(r.candidates), len(r.checks), r.copies) for r in checks) == [(1, 1, 1), (1, 1, 1), (1, 8, 1), (1, 11, 1), (1, 11, 2)]
    got = {(r.case_id, r.maker, r.model): r for r in H.component_evaluation(H.component_checks(candidates, read, rules)).collect()}
    assert len(got) == 5
    assert got[1, "VW", "GOL"].component_conf == 90.0 and got[1, "VW", "GOL"].matches == "sonst:presente"
    assert got[2, "VW", "GOL"].component_conf == 35.0 and got[2, "VW", "GOL"].mismatch_count == 1
    once, twice = got[1, "FIAT", "PALIO"], got[1, "FIAT", "UNO"]
    assert once.component_conf == twice.component_conf == 13.45 and (once.mismatch_count, twice.mismatch_count) == (9, 18)
    assert (once.matches, twice.matches) == ("grade_dianteira:presente", "grade_dianteira:presente,grade_dianteira:presente")
    assert once.limited == "parachoque:limitado_vista_x"


def test_words_of_a_case_are_looked_up_once(spark):
    rows = [(1, 1.0, False, "lateral", "moto honda cg"), (2, 3.0, False, "frontal", "truck volvo"), (3, None, None, None, None), (4, 0.5, True, "traseira", "hatch")]
    found = H.infer_category(spark.createDataFrame(rows, "case_id long, aspect double, compact boolean, view string, told string"))
    asked = found.where("category = 'CAMINHAO'")  # not looked up again for the condition
    shown = asked._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("Contains(") == sum(len(words) for words in H.KEYWORDS.values())
    assert {r.case_id: r.category for r in found.collect()} == {1: "MOTOCICLETA", 2: "CAMINHAO", 3: "AUTOMOVEL", 4: "AUTOMOVEL"}


def test_reasons_make_the_ranking_once(spark):
    rows = [(1, "A", m, 90.0 - 10 * i, i + 1, None, i % 2, 0, 0, False, 60.0) for i, m in enumerate("XYZ")]
    shape = "case_id long, maker string, model string, final_conf double, rank long, next_conf double, confirmation_count long, conflict_count long, mismatch_count long, synthetic boolean, category_conf double"
    reasons = H.discarded_reasons(spark.createDataFrame(rows, shape))
    assert "Join" not in plan(reasons)
    assert {r.model: r.reasons for r in reasons.collect()} == {"Y": "confianca_global_inferior_ao_melhor_candidato", "Z": "confianca_global_inferior_ao_melhor_candidato"}


def test_neither_texts_nor_lists_of_models_are_sent_whole(spark):
    pages = [(i, f"http://p{i}.org", "p.org" if i % 2 else "q.org", 5.0, "", f"FIAT {m}", "") for i, m in enumerate(["UNO", "PALIO", "UNO", "MAREA"])]
    table = spark.createDataFrame(pages, "page_id long, url string, domain string, trust double, component_hint string, title string, snippet string")
    cars = [(1, "FIAT", "UNO", "AUTOMOVEL", ""), (2, "FIAT", "PALIO", "AUTOMOVEL", ""), (3, "", "UNO", "AUTOMOVEL", "")]
    wanted = spark.createDataFrame(cars, "candidate_id long, maker string, model string, category string, year_hint string")
    scored = P.score_pages(wanted, table)
    assert "Broadcast" not in plan(scored)
    told = P.web_confirmation(wanted, scored)
    joins = re.findall(r"Join (\w+), \((\w+)#", told._jdf.queryExecution().optimizedPlan().toString())
    assert joins[:3] == [("LeftOuter", "candidate_id"), ("LeftOuter", "maker"), ("Inner", "candidate_id")]
    got = {r.candidate_id: (r.confirmation_count, r.conflict_count) for r in told.collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 0)}


def test_pages_meet_candidates_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    words = ["FIAT", "UNO", "PALIO", "GOL", "2004", "1999", "GRADE", "X1", "AB", "CDAB"]
    pages = [(i, f"http://p{i}.example.org", "example.org", float(rng.randrange(40)) / 10, "grade_dianteira", "", " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(90)]
    table = spark.createDataFrame(pages, "page_id long, url string, domain string, trust double, component_hint string, title string, snippet string")
    cars = [(i, rng.choice(["Fiat", "gol", "ab", "", "FIAT UNO"]), rng.choice(["Uno", "Palio Gol", "X1 2004 zz", "", "b"]), "AUTOMOVEL", rng.choice(["2003-2005", "", "1999"])) for i in range(40)]
    wanted = spark.createDataFrame(cars, "candidate_id long, maker string, model string, category string, year_hint string")
    monkeypatch.setattr(P, "PAGE_CHUNK", 7)
    scored = P.score_pages(wanted, table, page_block=16, candidate_block=9)
    assert "FlatMapCoGroupsInPandas" in plan(scored)
    got = sorted((r.candidate_id, r["rank"], r.page_id, r.score) for r in scored.collect())
    want = []
    for c, maker, model, _, hint in cars:
        maker, model, lines = maker.upper(), model.upper(), []
        for i, url, _, trust, _, title, snippet in pages:
            text = f"{title} {snippet} " + " ".join("".join(x if x.isalnum() else " " for x in url.upper()).split())
            text = " ".join(text.split())
            tokens = [t for t in model.split(" ") if len(t) > 1 and t in text]
            years = {"2003-2005": ("2004",), "1999": ("1999",)}.get(hint, ())
            score = trust + 0.8 * ("GRADE" in text) + 4 * (maker != "" and maker in text) + (6 if model and model in text else 1.4 * len(tokens)) + 1.6 * any(y in text for y in years)
            lines.append((-round(score, 3), i))
        want += [(c, n + 1, i, -s) for n, (s, i) in enumerate(sorted(lines)[:14])]
    assert got == sorted(want)


def test_year_entries_are_settled_before_targets_meet_them(spark):
    years = [("gol", i, f"{1990 + i % 5}-{i}" if i % 3 else f"zero-{i}", "") for i in range(40)]
    table = spark.createDataFrame(years, "model string, position long, code string, name string")
    asked = [(1, "gol", "ano 1994/1970"), (2, "gol", "2050"), (3, "gol", None), (4, "none", "1994"), (1, "gol", "1991")]
    found = V.pick_year(spark.createDataFrame(asked, "target_id long, model string, asked string"), table)
    assert {r.target_id: r.year_code for r in found.collect()} == {1: "1991-1", 2: "1991-1", 3: "1991-1"}
    many = spark.createDataFrame([(i, "gol", "1994") for i in range(500)], "target_id long, model string, asked string")
    found = V.pick_year(many, table)
    assert {r.year_code for r in found.collect()} == {"1994-4"}
    assert "_own" in plan(found) and "_any" in plan(found)


def test_dense_places_are_searched_from_a_small_radius(spark):
    rng = random.Random(3)
    places = [(i, f"p{i}", rng.uniform(10, 12), rng.uniform(20, 22)) for i in range(300)] + [(900, "far", 15.0, 25.0), (901, "twin", 15.0, 25.0)]
    there = spark.createDataFrame(places, "place_id long, name string, latitude double, longitude double")
    points = [(i, rng.uniform(9, 16), rng.uniform(19, 26)) for i in range(200)] + [(500, None, 1.0), (501, -80.0, 3.0), (502, 15.0, 25.0)]
    frame = spark.createDataFrame(points, "point_id long, latitude double, longitude double")
    radii = L.search_radii(there, 250.0)
    assert radii[0] == 250.0 and len(radii) > 2
    got = {r.point_id: r.place_id for r in L.nearest_places(frame, there, 250.0).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 2 * L.EARTH_KM * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    for i, lat, lon in points:
        near = [] if lat is None else sorted((round(float(km(lat, lon, y, x)), 6), n) for n, _, y, x in places if km(lat, lon, y, x) <= 250.0)
        assert got[i] == (near[0][1] if near else None)


def test_annotation_files_are_bounded(spark, monkeypatch):
    from vestigo.plans import sources

    monkeypatch.setattr(sources, "_ENTRIES", 40)
    notes = sources._annotations(spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    assert len(notes.inputFiles()) >= orders / 40
    assert notes.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_variants_are_not_moved_to_their_settings(spark):
    profiles = spark.createDataFrame([("dark", 1.0, 0.0, 1.0, "default", 0.5), ("dark", 1.0, 0.0, 1.0, "hdr", 0.25)], "scenario string, multiplier double, bias double, distance_weight double, family string, family_bonus double")
    prefixes = spark.createDataFrame([("dark", "cl", 1.0), ("dark", "clahe", 2.0)], "scenario string, prefix string, bonus double")
    rows = [(1, 1, "dark", " CLAHE_1", "HDR", 1.0, 0.0), (1, 2, "dark", "clx", "x", 1.0, 0.0), (2, 3, "dark", None, None, 1.0, 0.0), (3, 4, "light", "clahe", "x", 1.0, 0.0)]
    best = Q.select_variant(spark.createDataFrame(rows, "image_id long, position long, scenario string, variant string, family string, quality double, distance double"), profiles, prefixes)
    assert "SortMergeJoin" not in plan(best) and "ShuffledHashJoin" not in plan(best)
    assert sorted((r.image_id, r.bonus, r.prefix, r.score) for r in best.collect()) == [(1, 2.25, "clahe", 3.25), (2, 0.5, "", 1.5)]


def test_vectors_are_compared_in_chunks_of_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = np.round(rng.normal(size=(500, 4)), 1)  # with ties
    data /= np.linalg.norm(data, axis=1, keepdims=True) + 1e-8
    data[250:] = data[:250]
    monkeypatch.setattr(V, "QUERY_CHUNK", 16)
    monkeypatch.setattr(V, "VECTOR_CHUNK", 32)
    got = V._nearest(pd.DataFrame({"query_id": range(100), "v": list(data[:100])}), pd.DataFrame({"vec_id": range(500), "v": list(data)}), 3)
    sims = data[:100] @ data.T
    for q, mine in got.groupby("query_id"):
        assert np.allclose(sorted(mine["similarity"]), np.sort(sims[q])[-3:])
    assert V._pieces(720_000, 65_536) == 11 and V._pieces(3_000, 65_536) == 1 and V._pieces(40_000, 65_536) == 8


def test_lists_are_cut_by_their_own_size(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 4)))], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 8 = 0").withColumnRenamed("vec_id", "query_id")
    exact = V.knn_search(queries, vectors, 3)
    every = V.knn_search_lists(queries, vectors, 3, lists=6, probes=6, slice_rows=25)
    # a query meets each list's own slices, not as many for every list as the table has
    similar = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert similar(every) == similar(exact)
    assert "listed-vectors" in plan(every)


def test_requests_and_replies_meet_in_a_join_of_streams(spark):
    from vestigo.streaming import stateful as Y

    rate = spark.readStream.format("rate").load()
    messages = rate.select(F.col("value").cast("string").alias("request_id"), F.col("timestamp").alias("event_time"), F.lit("P").alias("plate"), (F.col("value") % 2 == 0).alias("is_reply"))
    waiting = Y.open_requests(messages, "10 minutes")
    assert waiting.isStreaming and waiting.columns == ["request_id", "request_time", "plate"]
    shown = waiting._jdf.queryExecution().analyzed().toString()
    assert "Join LeftOuter" in shown and "TransformWithState" not in shown


def test_turns_land_in_several_files_and_stay_batches(spark, monkeypatch):
    from vestigo.plans import sources
    from vestigo.session import checkpoint_dir
    import uuid

    monkeypatch.setattr(sources, "_FILE_ROWS", 50)
    monkeypatch.setattr(sources, "_LEAST_ROWS", 20)
    rows = spark.range(1000).select("id", F.floor(F.col("id") / 200).alias("_turn"))
    base = f"{checkpoint_dir(spark)}/turns-{uuid.uuid4().hex}"
    stream = sources._dealt_stream(spark, rows, base)
    assert len(spark.read.parquet(f"{base}/in").inputFiles()) == 20
    seen = []
    stream.writeStream.foreachBatch(lambda batch, n: seen.append(sorted(r.id for r in batch.collect()))).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(n * 200, n * 200 + 200)) for n in range(5)]
    # a turn too small to fill as many files is landed in one, as are all
    assert sources._files_a_turn(rows.where("_turn <> 2"), "_turn", 5) == 1


def test_tracks_keep_one_packed_value_a_key():
    from vestigo.streaming import stateful as Y

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    states = {}

    class Handle:
        def getValueState(self, name, *_):
            return states.setdefault(name, State())

    state = Y._Tracks(0.4, 1000)
    state.init(Handle())
    state._store([(1, 0.0, 5, 10, 0.0, 0.0, 1.0, 1.0)], {1: {1: (0.0, 0.0, 1.0, 1.0)}}, {1: 10})
    assert len(states["kept"].value) == 1 and state._load()[2] == {1: 10}
    state._store([], {}, {})
    assert states["kept"].value is None


def test_plates_share_keys():
    from vestigo.streaming import stateful as Y

    kept, calls = {}, []

    class State:
        def getValue(self, key):
            calls.append(key)
            return kept.get(key)

        def updateValue(self, key, value):
            kept[key] = value

    class Handle:
        def getMapState(self, *_):
            return State()

    state = Y._PlateState(2, None)
    state.init(Handle())
    rows = pd.DataFrame([("A", 2, "k2", "e", "s2", ""), ("B", 1, "k1", "e", "s1", "r1"), ("A", 1, "k1", "e", "s1", "r1"), ("A", 3, "k3", "e", "s3", "")], columns=["plate", "arrival", "event_key", "event", "status", "request_id"])
    got = {r.plate: r for r in next(state.handleInputRows((7,), iter([rows]), None)).itertuples()}
    assert [h["event_key"] for h in got["A"].history] == ["k2", "k3"] and got["A"].latest_request_id == "r1" and got["A"].arrivals == 3
    assert got["B"].status == "s1" and sorted(calls) == [("A",), ("B",)]


def test_characters_of_evidence_with_fragments_are_not_taken_apart(spark):
    from vestigo.operators import partials as R

    shape = "evidence_id long, engine string, avg_conf double, score double, region string, raw_entries array<struct<word:string,conf:double,region:string,origin:string>>, text string, chars array<struct<char:string,conf:double>>"
    rows = [(1, "e", 90.0, 1.0, "crop", [], "ABC1", [("A", 90.0), ("B", 90.0)]), (2, "e", 90.0, 1.0, "crop", [], "", [("A", 90.0), ("B", 90.0)])]
    short = spark.createDataFrame([], "evidence_id long, text string, engine string, region string, avg_conf double, score double, support_count long")
    found = R.partial_sources(spark.createDataFrame(rows, shape), short)
    assert sorted((r.evidence_id, r.text) for r in found.collect()) == [(1, "ABC1"), (2, "A"), (2, "B")]
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert shown.index("Generate explode(chars") < shown.index("Join LeftAnti")  # the join lies below


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


_ANSWERS = [
    ("AAA1111", "1", "x.gov.br", "", '{"placa": "aaa-1111", "marca": "Fiat", "modelo": " Uno ", "veiculo": {"chassi": "9 BW 123", "renavam": "12"}}'),
    ("AAA1111", "2", "p.com", " Pending_Async ", '{"plate": "BBB2222", "cor": " ", "owner": {"nome_proprietario": "P"}}'),
    ("AAA1111", "3", None, None, None),
    (None, "4", "p.com", "", "{broken"),
]


def test_fields_of_a_record_are_looked_at_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    raw = spark.createDataFrame(_ANSWERS, "plate string, record_id string, host string, lookup_state string, payload string")
    told = R.official_validation(R.unify_provider_records(raw))
    scored = R.score_records(told)
    assert logical(told).count("trim(coalesce(placa#") == 1
    assert logical(scored.select("lookup_score")).count("regexp_replace(upper(") == 2
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert not [c for c in scored.columns if c.startswith("_")]
    got = {r.record_id: r for r in scored.collect()}
    assert got["1"].public_found == ["placa", "fabricante", "modelo"] and got["1"].sensitive_found == ["chassi", "renavam"]
    assert (got["1"].chassi, got["1"].renavam, got["1"].status) == ("**W123", "**", "ok")
    assert got["2"].notes == ["fonte_nao_classificada_como_oficial", "consulta_assincrona_pendente", "dados_pessoais_detectados"]
    assert got["2"].public_found == ["placa"] and got["2"].public_missing == [n for n in R.BASIC if n != "placa"]
    assert got["4"].notes[-1] == "campos_publicos_incompletos"
    assert [got[i].lookup_score for i in "1234"] == [28.0 + 13.5 + 4.0 + 7.0 + 18.0 + 2.0 + 8.0, 0.0, 8.8, 16.8]


def test_alike_records_are_merged_before_they_vote(spark):
    fields = ["placa", "fabricante", "modelo", "cor"]
    rows = [("P1", f"id{i:03d}", "a.com", "k", 40.0, False, 2, 0, "P1", "Fiat", "Uno", None) for i in range(50)]
    rows += [("P1", None, "a.com", "k", 40.0, False, 2, 0, "P1", "FIAT", "Palio", "")]
    rows += [("P1", "id0005", "a.com", "k", 40.0, False, 2, 0, "P1", "Fi\u00e1t", "Gol", "azul")]
    rows += [("P2", i, "b.com", "k", 40.0, True, 2, 0, "P2", v, "X", None) for i, v in (("3", "fiat"), ("1", "Fiat"), ("2", "FIAT"))]
    shape = "plate string, record_id string, source_label string, source_kind string, lookup_score double, is_official boolean, public_count int, sensitive_count int, " + ", ".join(f"{f} string" for f in fields)
    before = set(stashed(spark))
    told = R.provider_consensus(spark.createDataFrame(rows, shape))
    kept = [p for p in stashed(spark) if p not in before and "provider-scores" in p]
    assert [spark.read.parquet(p).count() for p in kept] == [6]
    got = {r.plate: r for r in told.collect()}
    one, two = got["P1"], got["P2"]
    # the record without an id comes first, the one with the greatest id lends the shown value
    assert (one.candidates_count, one.modelo, one.fabricante, one.cor) == (52, "Palio", "FIAT", "azul")
    assert one.divergent_details == "modelo: Unox50 | Paliox1 | Golx1" and one.consensus_ratio == 100.0
    assert (two.candidates_count, two.official_candidates, two.fabricante) == (3, 1, "Fiat")


def test_ranks_move_rows_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, *range(9)]), i) for k in (None, "a", "b", "c") for i in range({None: 40, "a": 60, "b": 3, "c": 10}[k])]
    frame = spark.createDataFrame(rows, "k string, v int, i long")
    monkeypatch.setattr(S, "KEY_ROWS", 10)
    ranked = S.spread_rank(frame, ["k"], F.floor(F.col("v") / 2), [F.col("v"), F.col("i")], "n")
    assert "SortMergeJoin" not in plan(ranked) and "ShuffledHashJoin" not in plan(ranked)
    assert ranked.columns == ["k", "v", "i", "n"]
    want = []
    for k in (None, "a", "b", "c"):
        own = sorted([(v is not None, v or 0, i) for kk, v, i in rows if kk == k])
        want += [(k, i, n + 1) for n, (_, _, i) in enumerate(own)]
    assert {(r.k, r.i, r.n) for r in ranked.collect()} == set(want) and len(want) == len(rows)


def test_candidates_and_reads_are_made_once(spark):
    reads = [(1, 1, "ABC1234", "e", 0.9, None, None, None, None), (1, 2, "ABC1234", "f", 0.8, 1.0, 1.0, 40.0, 11.0), (2, 3, "XYZ9A99", "e", 0.5, 1.0, 1.0, 40.0, 11.0), (None, 4, "AAA1111", "e", 0.5, None, None, None, None)]
    reads += [(3, None, "ABC1234", "e", 0.5, None, None, None, None), (3, None, "ABC1234", "e", 0.5, 1.0, 1.0, 40.0, 11.0)]
    shape = "evidence_id long, read_id long, text string, engine string, confidence double, x1 double, y1 double, x2 double, y2 double"
    frame = spark.createDataFrame(reads, shape).withColumn("confidence", F.expr("confidence + 0"))
    ranked = U.rank_and_filter(U.text_candidates(frame))
    assert "LogicalRDD" not in logical(ranked) and "LocalRelation" not in logical(ranked)
    assert [(r.evidence_id, r.text, r["rank"]) for r in ranked.orderBy("evidence_id").collect()] == [(1, "ABC1234", 1), (2, "XYZ9A99", 1), (3, "ABC1234", 1)]
    boxes = spark.createDataFrame([(2, 7, 1, 0.9, 1.2, 1.0, 40.0, 11.0)], "evidence_id long, det_id long, priority_rank long, confidence double, x1 double, y1 double, x2 double, y2 double")
    told = U.plate_analyses(boxes, frame)
    assert logical(told).count("Relation [") <= 5  # boxes twice, reads for groups and for matches on either side
    got = {(r.evidence_id, r.det_id, r.bbox): (r.best_text, r.priority_rank) for r in told.collect()}
    assert got == {(2, 7, "1,1,40,11"): ("XYZ9A99", 1), (1, -1, "full_image"): ("ABC1234", 1), (1, -1, "1,1,40,11"): ("ABC1234", 2), (None, -1, "full_image"): ("", 1), (3, -1, "1,1,40,11"): ("ABC1234", 1), (3, -1, "full_image"): ("ABC1234", 2)}


def test_configuration_rows_are_summed_once(spark):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(2)}", rng.choice("xyz"), 1.0, rng.choice([None, 0.1, 0.7]), rng.random(), rng.random()) for _ in range(200)]
    told = B.config_summary(spark.createDataFrame(rows, "config string, segment string, exact double, similarity double, confidence double, final double"))
    lines = plan(told).splitlines()
    at = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert "HashAggregate" in lines[at + 1]  # sums are expanded, not rows
    for r in told.collect():
        own = [x for x in rows if x[0] == r.config and r.segment in (x[1], "all")]
        seen = [x[3] for x in own if x[3] is not None]
        assert r.n == len(own) and r.avg_similarity == pytest.approx(sum(seen) / len(seen), abs=6e-5)
        assert r.avg_score == pytest.approx(sum(x[5] for x in own) / len(own), abs=6e-5)
        assert r.median_score == pytest.approx(float(np.median([x[5] for x in own])), abs=6e-5)


def test_matching_characters_equal_the_blocks_of_difflib():
    from difflib import SequenceMatcher

    rng = random.Random(8)
    for _ in range(2000):
        a, b = ("".join(rng.choices("AB1C", k=rng.randrange(9))) for _ in range(2))
        assert matching_characters(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert matching_characters("X" * 200_000, "X" * 200_000) == 200_000  # equal texts are not searched


def test_boxes_round_half_to_even_without_decimals(spark):
    sides = [0.5, 1.5, 2.5, -0.5, -2.5, 0.49999999999999994, 2.4999999999999996, -0.2, 1e15 + 0.5, 9007199254740993.0, 7.0]
    frame = spark.createDataFrame([(x,) for x in sides + [None]], "x double").withColumn("y", F.lit(1.0))
    key = bbox_key(F.col("x"), F.col("y"), F.col("x"), F.col("y"))
    assert "bround" not in logical(frame.select(key))
    old = F.bround("x", 0).cast("bigint").cast("string")
    told = frame.select("x", key.alias("k"), F.coalesce(F.concat(old, F.lit(",1,"), old, F.lit(",1")), F.lit("")).alias("w")).collect()
    assert [r.k for r in told] == [r.w for r in told] and told[0].k == "0,1,0,1" and told[-1].k == ""


_FRAGMENTS = [(1, "AA"), (1, "AA"), (1, "A1"), (1, "Z"), (1, ""), (1, None), (1, "AAAA123"), (2, "A1"), (None, "AA")]
_PLATES = [(1, "AAAA123"), (1, "AAAA123"), (1, "A1BA1"), (1, ""), (1, None), (2, "BB"), (3, "AA"), (None, "AA")]


def test_plates_meet_the_fragments_of_a_case_without_their_runs(spark):
    from vestigo.operators import partials as R

    fragments = spark.createDataFrame(_FRAGMENTS, "evidence_id long, text string")
    plates = spark.createDataFrame(_PLATES, "evidence_id long, text string")
    whole = R.partial_match(fragments, plates, cap=8)
    assert "Generate" not in logical(whole) and "Generate" in logical(R.partial_match(fragments, plates))
    want = [(1, "A1", "A1BA1", 1, 2), (1, "A1", "AAAA123", 4, 1), (1, "AA", "AAAA123", 1, 3)]
    for told in (whole, R.partial_match(fragments, plates)):
        assert sorted(tuple(r) for r in told.select("evidence_id", "fragment", "plate", "position", "occurrences").collect()) == want
        assert told.dtypes[3:] == [("position", "bigint"), ("occurrences", "bigint")]


_RESULTS = "evidence_id long, engine string, avg_conf double, score double, region string, raw_entries array<struct<word:string,conf:double,region:string,origin:string>>, text string, chars array<struct<char:string,conf:double>>"
_SHORT = "evidence_id long, text string, engine string, region string, avg_conf double, score double, support_count long"


def _results():
    chars = [("A", 90.0), ("B", 90.0)]
    rows = [(1, "e", 90.0, 1.0, "crop", [], "ABC1", chars), (2, "e", 90.0, 1.0, "crop", [], "", chars), (3, "e", 90.0, 1.0, "scene", [], None, chars)]
    rows += [(4, "e", 90.0, 1.0, None, [("ab-1", 0.0, " ", None), None, ("TOOLONG", 90.0, "", "")], "XYZ", chars), (5, "f", None, None, "crop", None, "XYZ", chars)]
    return rows + [(None, "e", 90.0, 1.0, "crop", [("CD2", 10.0, "spot", "own")], "", chars), (None, "f", 90.0, 1.0, "crop", [], "", chars)]


def test_results_are_not_shuffled_for_the_few_evidence_without_fragments(spark, monkeypatch):
    from vestigo.operators import partials as R

    results = spark.createDataFrame(_results(), _RESULTS)
    short = spark.createDataFrame([(i, "A1", None, None, None, None, None) for i in (1, *range(10, 16))] + [(6, "", "x", "", 1.0, 1.0, 1)], _SHORT)
    before = set(stashed(spark))
    anti = R.partial_sources(results, short)
    monkeypatch.setattr(R, "LIST_ROWS", 5)  # nine have fragments; 2, 3, 5, 6 and the one without an id may have none
    semi = R.partial_sources(results, short)
    assert not [p for p in stashed(spark) if p not in before and "partial-results" in p]
    assert "Join LeftAnti" in logical(anti) and "Join LeftSemi" in logical(semi) and "Join LeftAnti" not in logical(semi)
    want = [(i, "A1", "ensemble", "top_candidate", 0.0, 0.0, "top_candidate", "") for i in (1, *range(10, 16))]
    want += [(1, "ABC1", "e", "engine_text", 90.0, 1.0, "engine_text", "crop"), (4, "AB1", "e", "raw_entry", 90.0, 1.0, "raw_entry", "ocr_result")]
    want += [(None, "CD2", "e", "own", 10.0, 1.0, "raw_entry", "spot")]
    want += [(i, t, engine, "char_option", 90.0, 90.0, "char_option", "crop") for i, engine in ((2, "e"), (5, "f"), (None, "e"), (None, "f")) for t in "AB"]
    for told in (anti, semi):
        assert sorted((tuple(r) for r in told.collect()), key=str) == sorted(want, key=str)


def test_fragments_of_an_evidence_move_once(spark, monkeypatch):
    from vestigo.operators import partials as R

    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["A1", "AB", "X9", "Q"]), rng.choice("ef"), "r", "o", rng.uniform(0, 99), 1.0) for _ in range(200)]
    frame = spark.createDataFrame(rows, "evidence_id long, text string, engine string, region string, origin string, conf double, score double")
    once = R.partial_candidates(frame, 2)
    assert plan(once).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(S, "KEY_ROWS", 20)  # a key that one task should not hold is grouped by text first
    spread = R.partial_candidates(frame, 2)
    assert plan(spread).count("Exchange hashpartitioning") == 2
    assert sorted(map(str, once.collect())) == sorted(map(str, spread.collect()))


def test_fragments_of_a_video_move_once(spark, monkeypatch):
    from vestigo.operators import partials as R

    rng = random.Random(4)
    rows = []
    for i in range(300):
        frame = rng.choice([None, *range(12)])
        rows.append((rng.choice([None, 1, 2]), frame, i, rng.choice([None, 5.0, 70.0]), rng.choice(["a-1", "A1", "AB", "", None]), rng.choice([None, [], ["e"], ["e", "f"]]), float(rng.randrange(90)), 50.0, 0.0, 3.0, rng.choice([None, 0, 2]), rng.choice([None, 4.0])))
    shape = "video_id long, frame_index long, frame_order long, timestamp_seconds double, text string, engines array<string>, best_confidence double, avg_confidence double, best_score double, score double, source_count long, rank_priority double"
    items = spark.createDataFrame(rows, shape)
    sizes = items.groupBy("video_id").agg(F.count(F.lit(1)).alias("_rows"))
    once = R.video_partials(items, None, sizes)
    assert plan(once).count("Exchange hashpartitioning") == 1 and "Expand" not in plan(once)
    monkeypatch.setattr(S, "KEY_ROWS", 20)
    spread = R.video_partials(items, None)
    assert plan(spread).count("Exchange hashpartitioning") == 2
    got = once.collect()
    assert sorted(map(str, got)) == sorted(map(str, spread.collect()))
    norm = lambda t: (t or "").replace("-", "").upper()
    for r in got:
        own = [x for x in rows if x[0] == r.video_id and norm(x[4]) == r.text and (x[3] or 0.0) // 60 == r.minute_index]
        assert r.frames_count == len({x[1] for x in own} - {None}) and r.source_count == sum(max(1, x[10] or 1) for x in own)
        assert r.engines == ",".join(sorted({e for x in own for e in x[5] or []})) and r.support_count == len(r.engines.split(",")) * (r.engines != "")
        best = max(own, key=lambda x: (x[6] or 50.0, -x[2]))
        assert (r.frame_index, r.timestamp_seconds, r.best_confidence) == (best[1], best[3], best[6] or 50.0)
    assert {(r.video_id, r.text) for r in got} == {(v, t) for v in (None, 1, 2) for t in ("A1", "AB")}


def test_track_state_is_packed_by_column():
    import pickle

    from vestigo.streaming import stateful as Y

    rng = random.Random(6)
    rows = sorted((rng.randrange(50), float(i % 7), 10**13 + i * 977, 1_700_000_000_000 + i % 7, *(float(rng.randrange(2000)) / 10 for _ in range(4))) for i in range(600))
    rows += [(2**63 - 1, -0.0, -(2**63), 0, 1e308, -1e-308, float("inf"), 0.1)]
    packed = Y._pack(rows, Y._WAITING)
    assert Y._unpack(packed, Y._WAITING) == rows and Y._unpack(Y._pack((), Y._LAST), Y._LAST) == []
    assert len(packed) * 3 < len(pickle.dumps(rows, pickle.HIGHEST_PROTOCOL))


def test_arrivals_leave_the_last_boxes_packed(monkeypatch):
    from vestigo.streaming import stateful as Y

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            pass

        def deleteTimer(self, at):
            pass

    class Timer:
        def getCurrentWatermarkInMs(self):
            return 12_000

    state = Y._Tracks(0.4, 60_000)
    state.init(Handle())
    state._store([], {7: {1: (0.0, 0.0, 10.0, 10.0)}}, {7: 5_000})
    arrive = lambda *rows: list(state.handleInputRows((1,), iter([pd.DataFrame([(v, d, float(s), pd.Timestamp(s, unit="s"), *box) for v, d, s, *box in rows], columns=["video_id", "det_id", "timestamp_seconds", "event_time", "x1", "y1", "x2", "y2"])]), None))
    read, unpack = [], Y._unpack
    monkeypatch.setattr(Y, "_unpack", lambda packed, kinds: read.append(kinds) or unpack(packed, kinds))
    arrive((7, 3, 11, 50, 0, 60, 10), (7, 2, 10, 0, 1, 10, 11))
    arrive((8, 4, 20, 0, 0, 5, 5))
    assert set(read) == {Y._SEEN}  # neither boxes nor those that wait are opened when others arrive
    assert len(state._held()[0]) == 2
    told = next(iter(state.handleExpiredTimer((1,), Timer(), None)))
    assert sorted(told.itertuples(index=False, name=None)) == [(7, 2, 1), (7, 3, 2)]
    waiting, last, seen = state._load()
    assert [r[:3] for r in waiting] == [(8, 20.0, 4)] and last == {7: {1: (0.0, 1.0, 10.0, 11.0), 2: (50.0, 0.0, 60.0, 10.0)}} and seen == {7: 11_000, 8: 20_000}


def test_turns_land_as_they_lie_and_go_once_read(spark, monkeypatch):
    from vestigo.plans import sources
    from vestigo.session import checkpoint_dir
    import uuid

    monkeypatch.setattr(sources, "_LEAST_ROWS", 20)
    rows = spark.range(0, 1000, 1, 4).select("id", (F.col("id") % 5).alias("_turn"))
    monkeypatch.setattr(type(rows), "repartition", None)  # no shuffle
    base = f"{checkpoint_dir(spark)}/turns-{uuid.uuid4().hex}"
    stream = sources._dealt_stream(spark, rows, base, once=True)
    assert len(spark.read.parquet(f"{base}/in").inputFiles()) == 20
    seen = []
    stream.writeStream.foreachBatch(lambda batch, n: seen.append(sorted(r.id for r in batch.collect()))).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(n, 1000, 5)) for n in range(5)]
    assert len(spark.read.schema("id long").parquet(f"{base}/in").inputFiles()) < 20
    # a partition without a turn's rows would leave no file
    assert sources._files_as_they_lie(rows.where("id >= 500 OR _turn <> 2"), "_turn", 5) is None


def test_keyed_state_keeps_two_versions(spark):
    from vestigo.streaming import stateful as Y

    names = (Y._VERSIONS, Y._OWN_SHUFFLES, Y._COMPACTED)
    before = [spark.conf.get(n, None) for n in names]
    with Y.keyed_state(spark, rewritten=True):
        assert [spark.conf.get(n) for n in names] == ["2", "true", "true"]
    assert [spark.conf.get(n, None) for n in names] == before
