"""Streaming BPE, conversation repair and vector codes against the library and brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from vestigo.llm import bpe, repair, vectorcodes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# -- byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, "rb") as f:
        return bpe.ByteBpe(f.read(), bpe.class_differences())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def odd_texts(n: int, seed: int = 5) -> list[str]:
    rnd = random.Random(seed)
    signs = [*"abcdefghijklm   \n\n\t'’strevd0123456789!?.,-_=éüñ漢字́\x1c\x85", "<|endoftext|>", "'re", "   ", "😀", "İ", "ſ", *bpe.class_differences()[::400]]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(codec, library):
    for text in odd_texts(4000):
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_every_character_falls_into_the_library_s_class(codec, library):
    for first in range(0, 0x110000, 256):
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(first, first + 256) if not 0xD800 <= c < 0xE000)
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(first)


@pytest.mark.parametrize("cut", [16, 50, 1 << 16])
def test_slices_and_long_words(codec, library, monkeypatch, cut):
    monkeypatch.setattr(bpe, "SLICE", cut)
    rnd = random.Random(cut)
    texts = odd_texts(300, seed=cut)
    for signs in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeiou st", "=-", "0123456789", " \n", "é漢ab"):
        for size in (40, 1000, 3000):
            texts.append(rnd.choice(["", "x ", " ", "'"]) + "".join(rnd.choice(signs) for _ in range(size)) + rnd.choice(["", "'re", " b"]))
    for text in texts:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_transducer_emits_early_holds_one_window_and_equals_the_whole(codec):
    rnd = random.Random(1)
    pieces = [t for t in codec.ids if t.isalpha() and t.isascii()]
    for _ in range(300):
        word = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 400)))
        machine, out = bpe.Transducer(codec), []
        for at in range(0, len(word), 37):
            out += machine.feed(word[at : at + 37])
            assert len(machine.held) <= codec.window
        assert out + machine.close() == codec.merged(word)


def test_words_side_by_side_equal_words_alone(codec):
    rnd = random.Random(6)
    for size in (1, 2, 3, 7, 16, 40):
        words = [bytes(rnd.choice(b"theinga ronAB1\xc3\xa9\n") for _ in range(size)) for _ in range(300)]
        for word, row in zip(words, codec.merged_side_by_side(words)):
            alone = codec.merged("".join(codec.alphabet[b] for b in word))
            assert [codec.ids[t] for t in alone] == row[row >= 0].tolist()


def test_few_remembered_words_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 20)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 100)
    monkeypatch.setattr(bpe, "SLICE", 40)
    texts = odd_texts(300, seed=8) + ["", "x" * 500, "word " * 60, "<|endoftext|>"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert codec.encode_all(texts) == want
    sums = codec.summaries(texts)
    assert [s[0] for s in sums] == [len(ids) for ids in want]
    assert [s[2] for s in sums] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_lookahead_is_sufficient_for_every_split(codec):
    """Whatever follows, a token stays once its lookahead has been seen."""
    rnd = random.Random(2)
    pieces = [t for t in codec.ids if t.isalpha() and t.isascii()]
    for _ in range(300):
        known = "".join(rnd.choice(pieces) for _ in range(40))
        tokens = codec.merged(known)
        end, stable = 0, []
        for token in tokens:
            if end + len(token) + codec.ahead[token] > len(known):
                break
            stable.append(token)
            end += len(token)
        for _ in range(5):
            more = known + "".join(rnd.choice(pieces) for _ in range(5))
            assert codec.merged(more)[: len(stable)] == stable


def test_any_ids_decode_as_the_library_does(codec, library):
    rnd = random.Random(3)
    for _ in range(1000):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 30))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "of the <|endoftext|> of", 7), (3, "x" * 200_000, 7), (3, "x" * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.round_trip(docs, VOCABULARY).collect()), key=str)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        want.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), VOCABULARY).collect() == []
    there_and_back = bpe.decoded(bpe.encoded(docs, VOCABULARY), VOCABULARY).collect()
    assert all(r.decoded == (r.text or "") for r in there_and_back)
    assert bpe.disagreements(docs, VOCABULARY).collect() == []


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError):
        bpe.ByteBpe(f.read())


# -- conversations -------------------------------------------------------------------------------


def brute_repair(rows):
    """Cheapest, then least, sequence of edits by a search over (cost, letters) pairs. rows: (role, text, seen)."""
    faults = []
    for _, text, seen in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if seen else None if bare[-1] in ".!?" else "truncated")
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest(), faults
        if (i, state) in done:
            continue
        done.add((i, state))
        for name in ("user", "assistant"):
            if reached := step.get((state, name[0])):
                heapq.heappush(heap, (cost + 3, letters + "I", i, reached, (*out, name + ":")))
        if i == len(rows):
            continue
        role, text, _ = rows[i]
        heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state, out))
        if faults[i] not in ("blank", "duplicate"):
            extra = 3 if faults[i] == "truncated" else 0
            if reached := step.get((state, role[:1])):
                heapq.heappush(heap, (cost + extra, letters + "K", i + 1, reached, (*out, f"{role}:{text}")))
            for name in ("user", "assistant"):
                if reached := step.get((state, name[0])):
                    heapq.heappush(heap, (cost + extra + 3, letters + "R", i + 1, reached, (*out, f"{name}:{text}")))


def brute_conversations(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        after = {1: "", 2: re.sub("[.!?]", "", text)}.get(lot, text)
        talk = talks[conv]
        for copy in range({0: 0, 3: 2}.get(lot, 1)):
            talk.append(((turn is not None, turn or 0, role, text, copy), turn, "user" if lot == 4 else role, after))
    out = {}
    for conv, talk in talks.items():
        talk.sort(key=lambda x: x[0])
        seen, marked = set(), []
        for _, _, role, text in talk:
            marked.append((role, text, (role, text) in seen))
            seen.add((role, text))
        cost, letters, digest, faults = brute_repair(marked)
        turns = [t for _, t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, digest)
    return out


TALK = "conv_id long, turn long, role string, text string, dropped int, copy string"


def random_talks(seed: int, conversations: int, longest: int):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", " ", "", None])
            text = rnd.choice(["a.", "b", "", " \n", "c!\n", "d?x", "e. ", None, "f" * rnd.randint(1, 50) + "."])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None]), role, text, 5, "x"))
    return rows


@pytest.mark.parametrize("block", [1, 3, 32])
def test_repair_equals_a_plain_search(spark, monkeypatch, block):
    for name, value in (("BLOCK_ROWS", block), ("WIDTH", 2 * block + 2), ("ORDER_SHIFT", 3 * (2 * block + 2)), ("COST_SHIFT", 3 * (2 * block + 2) + 2)):
        monkeypatch.setattr(repair, name, value)
    rnd = random.Random(block)
    for _ in range(1500):
        rows, seen = [], set()
        for i in range(rnd.choice([0, 3, 8, 12, 70])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "ux", " ", ""])
            text = rnd.choice(["a.", "b", "", " ", "c!\n", f"{i}.", f"{i}"])
            rows.append((role, text, (role, text) in seen))
            seen.add((role, text))
        talk = repair.Conversation()
        for i, (role, text, again) in enumerate(rows):
            talk.add(i, role, text, again)
        got, want = talk.result(), brute_repair(rows)
        assert got[5:] == want[:3], rows
        assert got[1:4] == tuple(want[3].count(f) for f in repair.FAULTS)


def test_repaired_conversations_equal_brute_force(spark):
    rows = random_talks(7, 300, 12) + [(5000, t, "user" if t % 2 else "assistant", f"line {t}.", 5, "x") for t in range(700)]
    rows += rows[:50]  # repeated rows
    got = {r[0]: tuple(r[1:]) for r in repair.repair_conversations(spark.createDataFrame(rows, TALK)).collect()}
    assert got == brute_conversations([r[:4] for r in rows])
    assert repair.repair_conversations(spark.createDataFrame([], TALK)).collect() == []


def test_conversation_without_rows_after_the_damage(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_conversations(spark.createDataFrame([(conv, 0, "user", "a.", 0, "")], TALK)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# -- vector codes --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(float(x) * 256)) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            owned = defaultdict(list)
            for _, v, _ in kept:
                owned[nearest(books[p], cut(v, p))[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(owned[e]) for c in zip(*owned[e])) if e in owned else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = []
    for i, v, label in kept:
        hits = [nearest(books[p], cut(v, p)) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in hits), sum(d for d, _ in hits), label))
    by_label = defaultdict(int)
    for _, _, error, label in found:
        by_label[label] += error
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in found), key=str)


def codes_of(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], VECTORS)
    return sorted(map(tuple, vectorcodes.compress(frame, **how).collect()), key=str)


def test_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", 400)
    monkeypatch.setattr(vectorcodes, "LEAF_POINTS", 12)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(10, 64))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 10] * 0.3 + rnd.normal(size=64) * 0.05)], None if i % 7 == 0 else int(i % 5)) for i in rnd.permutation(1500)]
    rows += rows[:40] + [(None, rows[0][1], 1), (2000, [0.25] * 64, 2), (2001, [0.25] * 64, 2)]
    assert codes_of(spark, rows) == brute_codes(rows)


def test_unusable_vectors_few_vectors_and_large_components(spark):
    good = [(3, [1.0] * 16, 1), (1, [0.0, -0.001] * 8, None), (2, [0.0, -0.001] * 8, None)]
    bad = [(0, None, 1), (4, [1.0] * 15 + [None], 1), (5, [1.0] * 15 + [float("nan")], 1), (6, [1.0] * 15 + [float("-inf")], 1), (7, [], 1), (8, [1.0] * 32, 1)]
    assert codes_of(spark, good + bad) == brute_codes(good)
    assert codes_of(spark, bad[:4]) == [] and codes_of(spark, []) == []
    large = [(i, [float(np.float32(1e6 * (i % 4) + i))] * 16, 1) for i in range(20)]
    assert codes_of(spark, large, entries=8) == brute_codes(large, entries=8)


def test_trees_hold_every_point_once_and_owned_balls_are_exact():
    rnd = np.random.default_rng(0)
    points = np.floor(rnd.normal(size=(3000, 4)) * 100).astype(np.int64)
    points[::3] = points[0]  # a hot point
    tree = vectorcodes.BallTree(points).packed()
    assert sorted(tree["rows"].tolist()) == list(range(3000))
    assert tree["count"][-1] == 3000 and (tree["total"][-1] == points.sum(0)).all()
    book = points[rnd.integers(0, 3000, 64)]
    owner, owned = np.full(3000, -1), 0
    for rows, entry, node in vectorcodes.assign(tree, points, book):
        where = vectorcodes._points_below(tree, node) if rows is None else rows
        owned += len(where) if rows is None else 0
        assert (owner[where] == -1).all()
        owner[where] = entry
    assert (owner == ((points[:, None] - book[None]) ** 2).sum(-1).argmin(1)).all()
    assert owned >= 1000  # the hot point at least is settled by its ball


def test_new_queries_cover_their_tables(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    run = entry.queries()
    docs, talks, vectors = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "conversations", "embeddings"))
    assert run["op11_streaming_bpe"](spark, sf).count() == docs.count()
    assert bpe.disagreements(docs, VOCABULARY).count() == 0
    got = {r[0]: tuple(r[1:]) for r in run["op12_conversation_repair"](spark, sf).collect()}
    assert got == brute_conversations([(r.conv_id, r.turn, r.role, r.text) for r in talks.collect()])
    codes = sorted(map(tuple, run["op13_vector_codes"](spark, sf).collect()), key=str)
    assert codes == brute_codes([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
