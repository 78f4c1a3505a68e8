"""Golden rows, invariants and brute-force checks on small fixtures."""

from __future__ import annotations

import datetime
import difflib
import hashlib
import hmac
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from vestigo.functions.plates import norm_plate, pattern_quality, spaceless, with_validation
from vestigo.functions.text import matching_blocks_ratio, matching_characters
from vestigo.functions.times import minute_range
from vestigo.operators import bench as B, detections as D, fusion as U, integrity as I, places as L, prep as N, vehicles as V, video as T, web as P
from vestigo.operators.spread import spread_quantiles, spread_rank
from vestigo.session import checkpoint_dir
from vestigo.streaming import events as E


def boxes(spark, images=3, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for image in range(images):
        for i in range(n):
            x, y = rng.uniform(0, 200), rng.uniform(0, 60)
            w, h = rng.choice([20, 30, 45, 60, 100]) * rng.uniform(0.8, 1.2), rng.choice([10, 15, 25]) * rng.uniform(0.8, 1.2)
            if rows and rng.random() < 0.2:
                _, _, x, y, x2, y2, _, _ = rows[-1]
                w, h = x2 - x, y2 - y
            rows.append((image, i, x, y, x + w, y + h, round(rng.random(), 2), rng.choice(["primary", "secondary"])))
    return spark.createDataFrame(
        rows, "evidence_id long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, source string"
    )


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def keyed(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_nms_equals_brute_force(spark):
    df = boxes(spark)
    flat = df.limit(1).select("*").withColumn("x2", F.col("x1")).withColumn("evidence_id", F.lit(99).cast(df.schema["evidence_id"].dataType))
    df = df.unionByName(flat.withColumn("det_id", F.explode(F.array([F.lit(i).cast(df.schema["det_id"].dataType) for i in range(3)]))))
    rows = df.collect()
    want = []
    for image in {r.evidence_id for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r.evidence_id == image), key=lambda r: (-r.confidence, r.det_id)):
            if all(iou(r[2:6], k[2:6]) < D.NMS_IOU for k in kept):
                kept.append(r)
        want += [(image, r.det_id) for r in kept]
    assert keyed(D.nms(df), "evidence_id", "det_id") == sorted(want)


def test_merge_equals_brute_force(spark):
    df = boxes(spark, seed=2)
    df = df.withColumn("confidence", F.when(F.col("det_id") % 5 == 0, None).otherwise(F.col("confidence")))
    want = []
    rows = df.collect()
    for image in {r.evidence_id for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r.evidence_id == image), key=lambda r: (r.source != "primary", r.det_id)):
            at = next((i for i, k in enumerate(kept) if iou(r[2:6], k[2:6]) >= D.NMS_IOU), None)
            if at is None:
                kept.append(r)
            elif (r.confidence or 0) > (kept[at].confidence or 0):
                kept[at] = r
        best = sorted(kept, key=lambda r: -(r.confidence or 0))[: D.MERGE_CAP]
        want += [(image, r.det_id, i + 1) for i, r in enumerate(best)]
    assert keyed(D.merge_detections(df), "evidence_id", "det_id", "merged_rank") == sorted(want)


def test_iou_pairs_equal_all_pairs(spark):
    df = boxes(spark, images=2, n=40, seed=3)
    rows = df.collect()
    want = sorted(
        (a.evidence_id, a.det_id, b.det_id)
        for a in rows
        for b in rows
        if a.evidence_id == b.evidence_id and a.det_id < b.det_id and iou(a[2:6], b[2:6]) >= D.NMS_IOU
    )
    assert keyed(D.iou_pairs(df, pitch=17.0), "evidence_id", "a_det_id", "b_det_id") == want


def test_spread_rank_equals_a_window(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        ((F.col("id") * 37) % 101 / 101).alias("score"),
        "id",
    )
    w = Window.partitionBy("k").orderBy(F.col("score").desc(), "id")
    want = keyed(df.withColumn("r", F.row_number().over(w)), "k", "id", "r")
    bucket = F.floor((1 - F.col("score")) * 50)
    assert keyed(spread_rank(df, ["k"], bucket, [F.col("score").desc(), F.col("id")], "r"), "k", "id", "r") == want


@pytest.mark.parametrize("nearest", [False, True])
def test_spread_quantiles_are_exact(spark, nearest):
    rng = random.Random(4)
    data = {k: [round(rng.uniform(-50, 5000), rng.choice([0, 3])) for _ in range(n)] for k, n in (("a", 1), ("b", 10), ("c", 777))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r for r in spread_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, nearest=nearest).collect()}
    for k, vs in data.items():
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            want = sorted(vs)[round(p * (len(vs) - 1))] if nearest else np.percentile(vs, p * 100)
            assert got[k][name] == pytest.approx(want)


def test_validation_golden(spark):
    texts = ["ABC1234", "ABCD123", "ABC1D23", "AB01D23", "ABC-1D23", "0BC1234", "ABCDEFGH", "LIL3567", "ABC1250"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.v for r in with_validation(df, "text").collect()}
    assert {t for t in texts if got[t].valid} == {"ABC1234", "ABCD123", "ABC1D23"}
    assert got["LIL3567"].suspicious == 4 and got["LIL3567"].score == pytest.approx(0.45)
    assert got["ABC1250"].score == pytest.approx(0.45)
    assert got["ABC-1D23"].pattern == "invalid"
    fixed = U.suggest_corrections(spark.createDataFrame([("LIL3567",), ("ABC1250",)], "text string")).collect()
    assert ("LIL3567", "ILI3S67") in {(r.text, r.suggestion) for r in fixed}
    assert next(r.score for r in fixed if r.suggestion == "ILI3S67") == pytest.approx(0.55)
    assert "ABC1250" not in {r.text for r in fixed}
    near = U.suggest_corrections(spark.createDataFrame([("LIL3567",)], "text string"), top=50, mode="neighbours").collect()
    assert all(sum(a != b for a, b in zip(r.text, r.suggestion)) <= 2 for r in near)


def test_two_cleanings_differ_on_hyphens(spark):
    row = spark.createDataFrame([(" abc-1d23 ",)], "t string").select(
        norm_plate(F.col("t")).alias("a"), spaceless(F.col("t")).alias("b"), pattern_quality(norm_plate(F.col("t"))).alias("q")
    ).first()
    assert (row.a, row.b, row.q) == ("ABC1D23", "ABC-1D23", 1.0)


def test_single_engine_has_no_agreement(spark):
    rows = [(1, i, 1, "e", 0.9, "ABC1234", 0.0, 0.0, 70.0, 20.0) for i in range(3)]
    reads = spark.createDataFrame(
        rows, "evidence_id long, read_id long, det_rank long, engine string, confidence double, text string, x1 double, y1 double, x2 double, y2 double"
    )
    one = U.fuse_reads(U.normalize_reads(reads)).first()
    assert one.agreement_ratio == 0.0 and one.support_count == 3
    assert one.score == pytest.approx(round((0.9 * 0.6 + 0.3 + 0.1) * 1.06, 4))
    verdict = U.fused_verdict(spark.createDataFrame([(1,), (2,)], "evidence_id long"), reads).orderBy("evidence_id").collect()
    assert verdict[0].consensus_basis == "single_engine_or_no_consensus"
    assert verdict[1].warning == "ocr_sem_resultado"


def test_minute_label(spark):
    row = spark.range(1).select(minute_range(F.lit(0)).alias("a"), minute_range(F.lit(61)).alias("b")).first()
    assert (row.a, row.b) == ("00:00-01:00", "61:00-62:00")


def test_hmac_and_canonical_json(spark):
    for secret in ("s", "k" * 100):
        got = spark.range(1).select(I.hmac_sha256(F.lit("päyload"), secret)).first()[0]
        assert got == hmac.new(secret.encode(), "päyload".encode(), hashlib.sha256).hexdigest()
    text = spark.range(1).select(I.canonical_json({"b": F.lit(None).cast("string"), "a": F.lit("x")})).first()[0]
    assert text == '{"a":"x","b":null}'


@pytest.mark.parametrize("secret", ["", "secret"])
def test_chain_verifies_and_finds_the_changed_entry(spark, secret):
    rows = [(c, s, f"a{c}-{s}", hashlib.sha256(f"{c}{s}".encode()).hexdigest()) for c in (1, 2) for s in range(1, 12 if c == 1 else 3000)]
    entries = spark.createDataFrame(rows, "chain_id long, seq long, analysis_id string, payload_hash string")
    fields = ["analysis_id", "payload_hash"]
    built = I.chain_build(entries, fields, secret)
    clean = I.first_break(I.chain_verify(built, fields, secret))
    last = {1: "", 2: ""}
    for r in sorted(built.collect(), key=lambda r: (r.chain_id, r.seq)):
        prev = last[r.chain_id]
        text = f'{{"analysis_id":"{r.analysis_id}","payload_hash":"{r.payload_hash}","prev_entry_hash":"{prev}"}}'
        signed = hmac.new(secret.encode(), text.encode(), hashlib.sha256) if secret else hashlib.sha256(text.encode())
        last[r.chain_id] = hashlib.sha256(f"{text}|{signed.hexdigest()}|{prev}".encode()).hexdigest()
        assert (r.prev_entry_hash, r.signature, r.entry_hash) == (prev, signed.hexdigest(), last[r.chain_id])
    assert {r.first_break for r in clean.collect()} == {-1}
    changed = built.withColumn("analysis_id", F.when((F.col("chain_id") == 2) & (F.col("seq") == 6), "x").otherwise(F.col("analysis_id")))
    broken = {r.chain_id: r.first_break for r in I.first_break(I.chain_verify(changed, fields, secret)).collect()}
    assert broken == {1: -1, 2: 6}
    dropped = I.first_break(I.chain_verify(built.where("seq <> 7"), fields, secret))
    assert {r.first_break for r in dropped.collect()} == {8}


def test_knn_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id < 25").withColumnRenamed("vec_id", "query_id")
    got = keyed(V.knn_search(queries, df, k=4, block=10, cut=13), "query_id", "rank", "vec_id")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    sims = unit[:25] @ unit.T
    want = sorted((q, r + 1, int(v)) for q in range(25) for r, v in enumerate(np.argsort(-sims[q], kind="stable")[:4]))
    assert got == want


def test_fuzzy_join_equals_all_pairs(spark):
    rng = random.Random(6)
    words = ["GOL", "GOLF", "POLO", "UNO", "MILLE", "FIRE", "KA", "SEDAN", "HB20", "ONIX", "PLUS", "X", "ONYX"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)})
    needles = sorted({"".join(c for c in n if rng.random() > 0.1) for n in names} | {"K", "HB", "ZZZZ"})
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, position long")
    got = {r.needle: r.name for r in V.fuzzy_name_join(spark.createDataFrame([(n,) for n in needles], "needle string"), table).collect()}
    a, b = F.col("a"), F.col("b")
    pairs = spark.createDataFrame([(x.strip(), y, i) for x in needles for i, y in enumerate(names) if x.strip()], "a string, b string, i long")
    squeezed = pairs.withColumn("a", F.regexp_replace("a", " +", " "))
    percent = (1.0 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))) * 100.0
    scored = squeezed.withColumn("s", V.name_score(a, b, percent)).where("s >= 36")
    best = scored.groupBy("a").agg(F.min_by("b", F.struct((-F.col("s")).alias("n"), "i")).alias("b")).collect()
    assert {" ".join(k.split()): v for k, v in got.items()} == {r.a: r.b for r in best}


def test_matching_blocks_similarity(spark):
    df = spark.createDataFrame([("WORLD", "WORD"), ("ABC", "XYZ"), ("GOL", "GOL")], "a string, b string")
    got = [r[0] for r in df.select(matching_blocks_ratio(F.col("a"), F.col("b")) * 100).collect()]
    assert got == pytest.approx([800 / 9, 0.0, 100.0])


def test_containment_pairs(spark):
    left, right = ["", "gol", "golf gti", "uno"], ["gol", "golf", "uno mille"]
    a, b = (spark.createDataFrame([(x,) for x in xs], f"{n} string") for xs, n in ((left, "a"), (right, "b")))
    got = keyed(V.containment_pairs(a, b, "a", "b"), "a", "b")
    assert got == sorted((x, y) for x in left for y in right if x in y or y in x)


def test_tracks_follow_the_last_box(spark):
    rows = [(1, i, float(i), 10.0 * i, 0.0, 10.0 * i + 40, 20.0, "P" if i else "", 0.5) for i in range(5)]
    rows.append((1, 9, 9.0, 500.0, 0.0, 540.0, 20.0, "Q", 0.7))
    df = spark.createDataFrame(
        rows, "video_id long, det_id long, timestamp_seconds double, x1 double, y1 double, x2 double, y2 double, text string, confidence double"
    )
    got = T.track_vehicles(df).orderBy("track_id").collect()
    assert [(r.track_id, r.consolidated_plate, r.detections_count, r.end_seconds) for r in got] == [(1, "P", 5, 4.0), (2, "Q", 1, 9.0)]


def _case(spark, **changes):
    fields = dict(
        evidence_id=1, kind="image", stage="final", source_exists=True, derived=1, frames=0, targets=0, has_consensus=True,
        crop_raw="c.jpg", crop_treated="", review_required=False,
    )
    return spark.createDataFrame([tuple((fields | changes).values())], ", ".join(
        f"{n} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for n, v in fields.items()
    ))


def test_manifest_covers_content_label_path_order_and_case(spark):
    schema = "evidence_id long, pos long, path string, label string, digest string"
    rows = [(1, i, f"out/{i}.jpg", "crop", hashlib.sha256(b"%d" % i).hexdigest()) for i in range(40)]

    def print_of(rows, **changes):
        found = I.manifest_fingerprint(_case(spark, **changes), spark.createDataFrame(rows, schema)).first()
        return found.artifact_count, found.fingerprint

    count, whole = print_of(rows)
    assert count == 40 and print_of(rows[::-1]) == (40, whole)
    # a later artifact of a known path does not count
    assert print_of([*rows, (1, 99, "out/0.jpg", "other", "")]) == (40, whole)
    moved = [(*rows[0][:1], 1, *rows[0][2:]), (*rows[1][:1], 0, *rows[1][2:]), *rows[2:]]
    others = [moved, *[[(*rows[0][:i], "x", *rows[0][i + 1 :]), *rows[1:]] for i in (2, 3, 4)]]
    prints = [print_of(o)[1] for o in others] + [print_of(rows, review_required=True)[1], print_of(rows, crop_raw="d.jpg")[1]]
    assert len({whole, *prints}) == 1 + len(prints)
    assert print_of([])[0] == 0


def test_split_follows_the_order_under_one_root(spark):
    paths = [f"s3a://store/one/root/{i:05d}.jpg" for i in range(997)] + ["s3a://store/one/root/00003.jpg"] * 3
    items = spark.createDataFrame([(p,) for p in paths], "path string").repartition(5)
    got = sorted((r.position, r.path, r.split) for r in N.split_dataset(items, "path").collect())
    assert [p for _, p, _ in got] == sorted(paths) and [n for n, _, _ in got] == list(range(1, 1001))
    assert [s for _, _, s in got] == ["train"] * 750 + ["val"] * 150 + ["test"] * 100


def test_pages_equal_scoring_against_every_page(spark):
    rng = random.Random(5)
    words = ["FIAT", "UNO", "FIATUNO", "MOTO", "X", "TANQUE", "CABINE", "GOL", "2004", "2011", "PALIO WEEKEND", "GRADE", "DESENHO"]
    pages = [
        (i, f"http://d{i}.org", f"d{i}.org", rng.choice([0.0, 2.0, 3.5]), rng.choice(["geral", "grade_dianteira", "tanque_carenagem", "cabine"]),
         " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randint(0, 4))))
        for i in range(150)
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, domain string, trust double, component_hint string, title string, snippet string")
    cars = [
        (1, "Fiat", "Uno", "AUTOMOVEL", "2003-2005"), (2, "Fiat", "Palio Weekend", "MOTOCICLETA", ""), (3, "", "X", "CAMINHAO", "2010"),
        (4, "Nobody", "Nothing", "MOTOCICLETA", "2000-2020"), (5, "Gol", "", "OTHER", None), (6, None, None, None, None),
    ]
    wanted = spark.createDataFrame(cars, "candidate_id long, maker string, model string, category string, year_hint string")
    got = sorted((r.candidate_id, r["rank"], r.page_id, r.score) for r in P.score_pages(wanted, table).collect())
    # With as many places as pages, every page is a leader, so each pair is scored.
    every = P.score_pages(wanted, table, cap=150).collect()
    assert len(every) == 6 * 150
    assert got == sorted((r.candidate_id, r["rank"], r.page_id, r.score) for r in every if r["rank"] <= 14)
    want = {}
    for i, url, _, trust, hint, title, snippet in pages:
        text = f"{title} {snippet} {url.upper()}".replace("://", " ").upper()
        score = trust + (4 if "FIAT" in text else 0) + (6 if "UNO" in text else 0) + (1.6 if "2004" in text else 0)
        terms = {"grade_dianteira": ("GRADE", "DIANTEIRA", "DESENHO", "FRONTAL")}.get(hint, ())
        want[i] = round(score + 0.8 * sum(t in text for t in terms), 3)
    assert {r.page_id: r.score for r in every if r.candidate_id == 1} == want


def test_stream_windows_add_up_over_micro_batches(spark):
    base = f"{checkpoint_dir(spark)}/windows-test-{random.random()}"
    start = datetime.datetime(2024, 1, 1, 10)
    rows = [(f"t{i % 2}", start + datetime.timedelta(minutes=20 * (i // 2))) for i in range(24)]
    frames = spark.createDataFrame(rows, "event_type string, event_time timestamp")
    for i in range(3):  # one file after another
        frames.where(F.hour("event_time") % 3 == (i + 1) % 3).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    E.write_upsert(E.audit_windows(stream, lateness="1 day"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    got = E.latest_rows(spark.read.parquet(f"{base}/out"), ["window_start", "event_type"])
    want = B.audit_rollup(frames)
    key = lambda df: sorted((r.window_start, r.event_type, r.events) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 8


def test_ranked_lists_give_the_best_rows_of_all(spark):
    """vehicle_search against scoring every index and reference row, blanks, ties and missing years included."""
    rnd = random.Random(6)
    makes, models, colours = ["fiat", "ford", "for", ""], ["uno", "uno mille", "ka", "Ká", "mille"], ["red", "dark red", "blue", ""]
    index = [(i, rnd.choice(makes), rnd.choice(models), rnd.choice([1998, 1999, 2000, 2001, 2004, None]), rnd.choice(colours)) for i in range(300)]
    reference = [
        (m, f"{n}", sorted(rnd.sample(range(1995, 2006), rnd.randint(0, 5))), i) for i, (m, n) in enumerate([(m, n) for m in makes[:3] for n in models])
    ]
    queries = [
        (i, rnd.choice(["", "", "fiat", "ford", "nope"]), rnd.choice(["", "", "uno", "mille", "ka", "x"]), rnd.choice(["", "red", "blue"]), rnd.choice([None, 1999, 2002, 2010]))
        for i in range(60)
    ]
    index_frame = spark.createDataFrame(index, "row_id long, make string, model string, year int, colour string")
    reference_frame = spark.createDataFrame(reference, "make string, model string, years array<int>, position long")
    query_frame = spark.createDataFrame(queries, "query_id long, make string, model string, colour string, year int")
    limit = 5
    first = V.search_metadata(query_frame, index_frame)
    counts = {r.query_id: r["count"] for r in first.groupBy("query_id").count().collect()}
    second = V.search_reference(query_frame, reference_frame)
    want = {}
    fold = lambda s: " ".join(s.lower().replace("á", "a").split())
    rows = [(r, 0) for r in first.collect()] + [(r, 1) for r in second.collect() if counts.get(r.query_id, 0) < limit]
    best = {}
    for r, turn in rows:
        key, order = (r.query_id, fold(r.make), fold(r.model), r.year, fold(r.colour)), (turn, -r.score, r.row_id)
        if key not in best or order < best[key][0]:
            best[key] = (order, r)
    for query_id in {k[0] for k in best}:
        found = sorted((v for k, v in best.items() if k[0] == query_id), key=lambda v: (-v[1].score, v[0], (v[1].year is not None, v[1].year)))
        want[query_id] = [(r.make, r.model, r.year, r.colour, r.score, r.source) for _, r in found[:limit]]
    got = {}
    for r in V.vehicle_search(query_frame, index_frame, reference_frame, limit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.make, r.model, r.year, r.colour, r.score, r.source))
    assert got == want


def test_crowded_images_equal_a_scan_of_all_kept_boxes(spark):
    """Suppression, merging and tracking of an image with thousands of boxes."""
    rnd = random.Random(9)
    rows = []
    for i in range(3000):
        x, y, side = rnd.uniform(0, 900), rnd.uniform(0, 900), 2 ** rnd.uniform(2, 7)
        rows.append((2 if i < 40 else 1, i, x, y, x + side, y + side * rnd.uniform(0.5, 1.5), round(rnd.random(), 2), rnd.choice(["primary", "secondary"])))
    boxes = spark.createDataFrame(rows, "evidence_id long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, source string")

    def share(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = w * h if w > 0 and h > 0 else 0.0
        union = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter
        return inter / union if union > 0 else 0.0

    for image in (1, 2):
        mine = [r for r in rows if r[0] == image]
        kept = []
        for r in sorted(mine, key=lambda r: (-r[6], r[1])):
            if all(share(r, k) < D.NMS_IOU for k in kept):
                kept.append(r)
        assert {r.det_id for r in D.nms(boxes).where(F.col("evidence_id") == image).collect()} == {r[1] for r in kept}
        merged = []
        for r in sorted(mine, key=lambda r: (r[7] != "primary", r[1])):
            slot = next((i for i, k in enumerate(merged) if share(r, k) >= D.NMS_IOU), None)
            if slot is None:
                merged.append(r)
            elif r[6] > merged[slot][6]:
                merged[slot] = r
        got = D.merge_detections(boxes, cap=None).where(F.col("evidence_id") == image).orderBy("merged_rank").collect()
        assert [r.det_id for r in got] == [r[1] for r in sorted(merged, key=lambda r: -r[6])]
        last, want = [], {}
        for r in sorted(mine, key=lambda r: r[1]):
            slot = next((i for i, k in enumerate(last) if share(r, k) >= T.TRACK_IOU), None)
            if slot is None:
                last.append(r)
                slot = len(last) - 1
            last[slot] = r
            want[r[1]] = slot + 1
        tracks = T.assign_tracks(boxes.withColumnRenamed("evidence_id", "video_id"), ["det_id"]).where(F.col("video_id") == image)
        assert {r.det_id: r.track_id for r in tracks.collect()} == want


def test_matching_characters_equal_the_standard_library(spark):
    rnd = random.Random(10)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("ABC1") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        assert matching_characters(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def test_names_alike_by_blocks_are_never_missed(spark):
    """Best name by matching blocks against scoring every pair, short and gapped names among them."""
    rnd = random.Random(13)
    word = lambda n: "".join(rnd.choice("ABCDE") for _ in range(n))
    gapped = lambda s: "".join(c + ("X" if i % 2 else "") for i, c in enumerate(s))
    needles = ["AB", "ABCDEFGHIJ", *[word(rnd.randint(1, 12)) for _ in range(40)], *[f"{word(3)} {word(4)}" for _ in range(10)]]
    names = ["AXB", "ABXCDXEFXGHXIJ", *[gapped(n) for n in needles[2:12]], *[word(rnd.randint(1, 12)) for _ in range(60)], *[f"{word(3)} {word(4)}" for _ in range(10)]]
    left = spark.createDataFrame([(n,) for n in needles], "needle string")
    right = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, position long")
    got = {r.needle: (r.name, r.score) for r in V.fuzzy_name_join(left, right, similarity="blocks").collect()}
    want = {}
    for a in needles:
        best = None
        for i, b in enumerate(names):
            shared = len([w for w in a.split(" ") if w in b.split(" ")])
            pct = 200.0 * matching_characters(a, b) / (len(a) + len(b))
            score = 200.0 if a == b else 80.0 * (a in b) + 40.0 * (b in a) + 28.0 * shared + 30.0 * shared / len(a.split(" ")) + 0.45 * pct
            if score >= V.NAME_FLOOR and (best is None or score > best[1]):
                best = (b, score)
        if best:
            want[a] = (best[0], round(best[1], 6))
    assert {k: (v[0], round(v[1], 5)) for k, v in got.items()} == {k: (v[0], round(v[1], 5)) for k, v in want.items()}


@pytest.mark.parametrize("radius", [3.0, 400.0, 3000.0])
def test_nearest_places_equal_a_scan_everywhere(spark, radius):
    """Cell borders, the date line, the poles and repeated places, against every place."""
    rnd = random.Random(int(radius))
    step = radius / 111.195
    lats = [-90.0, 90.0, 89.99, 0.0, step, -step, 2 * step]
    lons = [-180.0, 180.0, 179.999, -179.999, 0.0, step, 359.0]
    spot = lambda: (rnd.choice([*lats, rnd.uniform(-90, 90)]), rnd.choice([*lons, rnd.uniform(-180, 180)]))
    near = lambda p: (max(-90.0, min(90.0, p[0] + rnd.uniform(-1, 1) * step)), p[1] + rnd.uniform(-1, 1) * step / max(0.02, math.cos(math.radians(p[0]))))
    points = [(i, *spot()) for i in range(150)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    places = [(i, f"p{i}", *near(points[i % 150][1:])) for i in range(300)] + [(400 + i, "twin", *points[i][1:]) for i in range(5)] * 2
    places = [p for p in places if abs(p[3]) <= 360]

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * L.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    frame = spark.createDataFrame(points, "point_id long, latitude double, longitude double")
    there = spark.createDataFrame(places, "place_id long, name string, latitude double, longitude double")
    got = {r.point_id: (r.place_id, r.distance_km) for r in L.nearest_places(frame, there, radius).collect()}
    assert len(got) == len(points) and got[900] == got[901] == (None, None)
    for i, lat, lon in points[:150]:
        found = min(((round(km((lat, lon), p[2:]), 6), p[0]) for p in places if km((lat, lon), p[2:]) <= radius), default=None)
        if found is None:
            assert got[i] == (None, None)
        else:
            assert abs(got[i][1] - found[0]) < 0.002 and (got[i][0] == found[1] or abs(km((lat, lon), next(p for p in places if p[0] == got[i][0])[2:]) - found[0]) < 1e-5)


def test_nearest_vectors_by_chunks_ties_and_lists(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 16))
    rows = [(int(i), [float(x) for x in base[i % 40] + (0 if i % 3 else 0.2) * rnd.normal(size=16)]) for i in range(900)]  # many equal vectors
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    unit = np.array([v for _, v in rows])
    unit = unit / (np.sqrt((unit**2).sum(axis=1, keepdims=True)) + 1e-8)
    whole = V._nearest(pd.DataFrame({"query_id": [0, 1], "v": [unit[0], unit[7]]}), pd.DataFrame({"vec_id": np.arange(900), "v": list(unit)}), 7)
    sims = unit[[0, 7]] @ unit.T
    monkeypatch.setattr(V, "VECTOR_CHUNK", 64)
    chunked = V._nearest(pd.DataFrame({"query_id": [0, 1], "v": [unit[0], unit[7]]}), pd.DataFrame({"vec_id": np.arange(900), "v": list(unit)}), 7)
    for found in (whole, chunked):
        for q in (0, 1):
            mine = found[found["query_id"] == q]
            assert np.allclose(sorted(mine["similarity"]), sorted(sims[q])[-7:])
    exact = V.knn_search(queries, vectors, 5)
    every = V.knn_search_lists(queries, vectors, 5, lists=8, probes=8, slice_rows=300)
    similar = lambda df: sorted((r.query_id, r["rank"], round(r.similarity, 9)) for r in df.collect())
    assert similar(every) == similar(exact)


def test_recall_of_coarse_lists(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    recall = V.knn_recall(V.knn_search_lists(queries, vectors), V.knn_search(queries, vectors)).first()
    assert recall.neighbours == 500 and recall.recall >= 0.9


def test_caps_can_be_lifted(spark):
    reads = spark.createDataFrame([(1, i, f"AB{chr(65 + i % 26)}{i % 10}{i // 26}2{i % 7}", "e", 0.5, i) for i in range(60)], "user_id long, id long, ocr string, origin string, c double, n long")
    from vestigo.operators.spread import within

    assert reads.where(within(F.col("n"), 5)).count() == 6 and reads.where(within(F.col("n"), None)).count() == 60
