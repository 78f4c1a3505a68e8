"""Partners of weak secrets, the mix and its columns, clashing names: against brute force."""

from __future__ import annotations

import gc
import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from vestigo.llm import linededup, mixing, pieces, secrets
from vestigo.llm.joins import unused_name

import re


def brute_spans(text: str, scope: int = secrets.SCOPE):
    """All spans, by a double loop over the matches of each pattern."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(secrets.KINDS):
        for m in re.finditer(pattern.replace("\\x20", " "), text):
            if len(m.group(group)) >= least:
                found.append((kind, *m.span()))
    name = [k[0] for k in secrets.KINDS]
    ids = [f for f in found if name[f[0]] in ("access", "weak_id")]
    keys = [f for f in found if name[f[0]] in ("assign", "hex", "weak_secret")]

    def beside(span, others):
        return any(abs(o[1] - span[1]) <= scope and (o[2] <= span[1] or o[1] >= span[2]) for o in others)

    paired = [i for i in ids if beside(i, keys)]
    out = []
    for span in found:
        kind, start, _ = span
        if (
            kind < len(secrets.BASE)
            or (name[kind] == "weak_id" and beside(span, keys) and not any(name[i[0]] == "access" and i[1] == start for i in ids))
            or (name[kind] == "weak_secret" and beside(span, ids))
            or (name[kind] == "endpoint" and beside(span, paired) and beside(span, keys))
        ):
            out.append((start, kind, span[2]))
    return ",".join(f"{name[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_added_spans_equal_a_double_loop(spark):
    rnd = random.Random(11)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789+/"
    word = lambda signs, n: "".join(rnd.choice(signs) for _ in range(n))
    parts = [
        lambda: "AKIA" + word(upper, rnd.choice([6, 8, 14, 16, 20, 24])),
        lambda: "ASIA" + word(upper, rnd.choice([6, 16, 20, 26])),
        lambda: word(lower, rnd.choice([10, 24, 40])),
        lambda: "password = " + word(lower, rnd.choice([4, 12, 30])),
        lambda: word("0123456789abcdef", rnd.choice([8, 16, 32])),
        lambda: "https://" + word("abcdef.", 12) + rnd.choice(["", "/" + word(lower, 30)]),
        lambda: word("xyz ", rnd.choice([3, 40, 320])),
    ]
    texts = ["lone ASIA0123456789ABCDEFGHIJKL", "AKIA" + "A1" * 11, "", None]
    texts += [rnd.choice([" ", "\n", ", "]).join(rnd.choice(parts)() for _ in range(rnd.randint(1, 9))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert got == {i: brute_spans(t or "") for i, t in enumerate(texts)}
    assert got[0] == "" and got[1] == "access:0:26"


def brute_targets(sizes):
    """Targets by repeated sharing. sizes: source -> size, in any order."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= 3.0 * sizes[s]
        open_ -= full
    return target


def test_mix_equals_sorting_by_hash(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["hot"] * 8 + ["b", "c", "tiny", None])) for i in range(1500)]
    rows += [(9000, "a b c", "one"), (9001, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r.doc_id: r._hash for r in mixing.measured(docs, "doc_id", "text", "source").select("_row.doc_id", "_hash").collect()}
    by_source = defaultdict(list)
    for i, text, source in rows:
        by_source[source].append((hashes[i], len((text or "").split()), i))
    target = brute_targets({s: sum(n for _, n, _ in docs_) for s, docs_ in by_source.items()})
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for source, members in by_source.items():
        size = sum(n for _, n, _ in members)
        passes = min(3, int(target[source] // size)) if size else 0
        budget, best = target[source] - passes * size, 0
        sums, total = [0], 0
        for _, n, _ in sorted(members):
            total += n
            sums.append(total)
        best = min(abs(x - budget) for x in sums) if size and passes < 3 else 0
        for _, n, i in members:
            assert (got[i].size, got[i].source_size) == (n, size)
            assert abs(got[i].target - target[source]) < 1e-6
            assert got[i].taken in (passes * n, (passes + 1) * n)
        extra = sum(got[i].taken - passes * n for _, n, i in members)
        if size and passes < 3:
            assert abs(extra - budget) == best  # the nearest that any threshold reaches
            taken = sorted((h, got[i].taken > passes * n) for h, n, i in members if n)
            assert [t for _, t in taken] == sorted((t for _, t in taken), reverse=True)


def test_clashing_names_and_blank_leftovers(spark):
    assert unused_name(["_CUT", "a"], "_cut") == "_cut_"
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage, "x", 5, "own", "p"), (2, f"\t\n{passage}\n\t", "x", 5, "own", "p"), (3, "short text", "x", 5, "own", "p"), (4, None, "x", None, "own", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _cut string, _p string")
    kept = {r.doc_id: r for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert sorted(kept) == [1, 3, 4] and kept[1]._cut == "own" and kept[1].text == passage
    cut = linededup.without_repeats(docs, cut="lines").select("doc_id", F.col("lines"))
    assert {r.doc_id: r.lines for r in cut.collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    two = docs.select("doc_id", "text", F.lit("en").alias("lang"), "_p")
    assert all(r._p == "p" for r in corpus_pipeline.identify_language(spark, two, "").collect())


def test_line_dedup_hashes_texts_together(monkeypatch):
    """Texts looked at together have the selections that each has alone, and short words are not hashed one by one."""
    draw = random.Random(7)
    texts = [b" \n".join(draw.choice([b"a", b"a\0", b"b" * 8, b"b" * 9, b"c" * 16]) for _ in range(draw.randint(0, 90))) for _ in range(60)]
    monkeypatch.setattr(linededup.xxhash, "xxh3_64_intdigest", None)
    together = linededup.Words(texts, 20)
    fp, first, n = together.selections(20)
    text = together.texts_of(first)
    for i, t in enumerate(texts):
        own = text == i
        alone = linededup.Words(t, 20).selections(20)
        assert all((x == y).all() for x, y in zip(alone, (fp[own], first[own] - together.first[i], n[own]), strict=True))
        assert alone[2].sum() == own @ n == max(0, len(t.split()) - 19)


def test_line_dedup_tells_words_apart():
    words = [b"a" * i + b"\0" * j for i in range(20) for j in range(20) if i + j] + [b"b" * i + b"a" for i in range(20)]
    found = linededup.Words(b" ".join(words), 1)
    at = np.arange(found.n)
    assert found.n == len(words) and len(set(found.hashes(at, at + 1, 0).tolist())) == len(set(words))


def test_workers_let_the_codec_go(spark):
    """A worker that goes on to other tasks doesn't keep the vocabulary and its remembered chunks."""

    @arrow_udf("long")
    def codecs(ids: pa.Array) -> pa.Array:
        gc.collect()
        held = sum(isinstance(x, pieces.PieceCodec) for x in gc.get_objects())
        return pa.array([held] * len(ids), pa.int64())

    docs = spark.range(64, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    assert len(pieces.round_trip(docs, corpus_pipeline.vocabulary()).collect()) == 64
    assert {r.held for r in docs.select(codecs("doc_id").alias("held")).collect()} == {0}
