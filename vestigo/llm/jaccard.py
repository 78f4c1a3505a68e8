"""Exact Jaccard self-join on word n-grams by partitioning the universe of n-grams.

Sets are banded by size; sets that can link fall into the same or neighbouring bands and differ in at
most H n-grams, H being fixed for the band. A hash deals all n-grams to segments. Level 1 segments are
indexed whole, level 2 segments also with any one n-gram left out. By the pigeonhole principle, sets
that differ in at most H places agree on some level 1 segment, or up to one n-gram on some level 2
segment, once the levels sum to more than H. Each set may also leave out its smallest level 1
segments, which would meet many strangers; twice that allowance is added to the levels.

Sets are compared once per class of equal sets. Sets that share an index key first meet the key's
smallest document only; only where that leaves a key's sets in several components do
the remaining pairs meet, in blocks, behind a bit-parity filter that cannot lose a link. All pairs that
come through are verified on the n-grams themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from vestigo.llm.components import components
from vestigo.llm.joins import small_side
from vestigo.session import stash

#: Share of level 1 segments a set may leave out, as a divisor.
LEFT_OUT = 20
#: An expected stranger costs as much as so many index keys when levels are chosen; sets expected in a band.
STRANGER, BAND_SETS = 4.0, 1e6
#: Sets of one key that meet in one task, squared at most.
BLOCK = 2_048
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def ngrams(words: list[bytes], n: int) -> set[bytes]:
    """Distinct n-grams; a shorter non-empty sequence is one n-gram as a whole."""
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def _mixed(x: np.ndarray, factor: np.uint64 = _M1) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * factor
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the n-grams."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(h))], dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mixed(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Bands:
    """Size bands and segment levels for links at a similarity of num/den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def largest(self, band: int) -> int:
        while len(self.edges) < band + 2:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return self.edges[band + 1] - 1

    def differences(self, a: int, b: int) -> int:
        """How many n-grams sets of these sizes may differ in and still link."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    @lru_cache(maxsize=None)
    def levels(self, band: int) -> tuple[int, int, int]:
        """(level 1 segments, level 2 segments, segments a set may leave out), the cheapest by cost.

        A key costs 1. Strangers meet on a segment with a chance that falls with its n-grams.
        """
        size = self.largest(band)
        need = self.differences(size, size) + 1
        best = None
        for doubled in sorted({0, need // 4, need // 2}):
            single = need - 2 * doubled
            spare = single // LEFT_OUT
            single += 2 * spare
            segments = single + doubled
            per = size / segments
            chance = single * np.exp(-2.0 * per) + doubled * (per + 1) * np.exp(-2.0 * max(per - 1, 0.1))
            cost = single - spare + doubled * (per + 1) + STRANGER * np.log1p(BAND_SETS * chance)
            if best is None or cost < best[0]:
                best = (cost, (single, doubled, spare))
        return best[1]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Index keys of a set under its own band's scheme and the next larger one."""
        band = self.band(len(grams))
        out = [self._scheme(grams, band)]
        if len(grams) * self.den >= self.num * (self.largest(band) + 1):
            out.append(self._scheme(grams, band + 1))
        return np.unique(np.concatenate(out))

    def _scheme(self, grams: np.ndarray, band: int) -> np.ndarray:
        single, doubled, spare = self.levels(band)
        segments = single + doubled
        at = (_mixed(grams, _M3) % np.uint64(segments)).astype(np.int64)
        content = _mixed(grams)
        order = np.argsort(at, kind="stable")
        sums = np.zeros(segments, dtype=np.uint64)
        sizes = np.bincount(at, minlength=segments)
        filled = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
        sums[filled] = np.add.reduceat(content[order], starts)
        tag = _mixed(np.arange(segments, dtype=np.uint64) + np.uint64(band << 32))
        kept = np.argsort(sizes[:single], kind="stable")[spare:]
        keys = [_mixed(sums[kept] + tag[kept]), _mixed(sums[single:] + tag[single:])]
        if doubled:
            inside = at >= single
            keys.append(_mixed(sums[at[inside]] - content[inside] + tag[at[inside]]))
        return np.concatenate(keys)

    def parity(self, grams: np.ndarray) -> np.ndarray:
        """Bits that flip with each n-gram: sets differ in at least as many n-grams as bits."""
        need = 8 * self.differences(self.largest(self.band(len(grams))), len(grams))
        bits = 256
        while bits < need:
            bits *= 2
        counts = np.bincount((_mixed(grams, _M2) % np.uint64(bits)).astype(np.int64), minlength=bits)
        return np.packbits((counts & 1).astype(np.uint8))

    def may_link(self, n: int, m: np.ndarray, bits: np.ndarray, others: np.ndarray) -> np.ndarray:
        limit = (n + m) * (self.den - self.num) // (self.den + self.num)
        apart = np.bitwise_count(others ^ bits).sum(axis=-1)
        sized = np.minimum(n, m) * self.den >= np.maximum(n, m) * self.num
        return sized & (apart <= limit)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bits over fewer places; distances only shrink."""
    while len(bits) > width:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _sets(n: int, num: int, den: int):
    bands = Bands(num, den)

    @arrow_udf("struct<n: long, s1: long, s2: long, parity: binary, keys: array<long>>")
    def sets(texts: pa.Array) -> pa.Array:
        sizes, s1, s2, parity, keys = [], [], [], [], []
        for t in pc.fill_null(texts, "").cast(pa.binary()).to_pylist():
            grams = gram_hashes(words_of(t), n)
            sizes.append(len(grams))
            s1.append(int(_mixed(grams).sum(dtype=np.uint64).astype(np.int64)))
            s2.append(int(_mixed(grams, _M3).sum(dtype=np.uint64).astype(np.int64)))
            parity.append(bands.parity(grams).tobytes() if len(grams) else b"")
            keys.append(bands.keys(grams).astype(np.int64) if len(grams) else np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(parity, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
            ],
            names=["n", "s1", "s2", "parity", "keys"],
        )

    return sets


def _prefilter(num: int, den: int):
    bands = Bands(num, den)

    @arrow_udf("boolean")
    def near(n: pa.Array, bits: pa.Array, m: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for a, x, b, y in zip(n.to_pylist(), bits.to_pylist(), m.to_pylist(), others.to_pylist()):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            width = min(len(x), len(y))
            out.append(bool(bands.may_link(a, np.int64(b), fold(x, width), fold(y, width))))
        return pa.array(out, pa.bool_())

    return near


def _verified(n: int, num: int, den: int):
    @arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        grams = lru_cache(maxsize=16)(lambda t: ngrams(words_of(t), n))
        out = []
        for x, y in zip(left.cast(pa.binary()).to_pylist(), right.cast(pa.binary()).to_pylist()):
            a, b = grams(x), grams(y)
            both = len(a & b)
            out.append(both > 0 and den * both >= num * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return linked


def _meet(num: int, den: int):
    bands = Bands(num, den)

    def meet(group: pa.Table) -> pa.Table:
        """Pairs of one key's block that are not in one component yet and may link, each under its
        smallest common key only."""
        key = group.column("key")[0].as_py()
        ids, comps = (group.column(c).to_numpy() for c in ("id", "comp"))
        sizes, side = group.column("n").to_numpy(), group.column("side").to_numpy()
        raw = [np.frombuffer(x, np.uint8) for x in group.column("parity").to_pylist()]
        lists = group.column("shared").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        ends = ends - ends[0]
        width = min(map(len, raw))
        bits = np.stack([fold(x, width) for x in raw])
        bits = bits.view(np.uint64)
        out_a, out_b = [], []
        crossing = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        place = np.arange(len(ids))
        for i in np.flatnonzero(side == 0) if crossing else place:
            later = side == 1 if crossing else place > i
            other = np.flatnonzero(later & (comps != comps[i]) & (ids != ids[i]))
            if not len(other):
                continue
            near = other[bands.may_link(int(sizes[i]), sizes[other], bits[i], bits[other])]
            for j in near:
                mine, yours = (flat[ends[k] : ends[k + 1]] for k in (i, j))
                if np.intersect1d(mine, yours, assume_unique=True)[0] == key:
                    out_a.append(min(ids[i], ids[j])), out_b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return meet


def links_and_classes(
    docs: DataFrame, words: int, similarity: tuple[int, int], doc_id: str, text: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with id, n, class_id; links between class documents that join all components; components)."""
    num, den = similarity
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), _sets(words, num, den)(F.col(text)).alias("_s"))
    rows = stash(rows.select("id", "_s.*"), "join-sets")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    # one document for each class of equal sets
    linkable = rows.where("n > 0 and id is not null").select("id", "n", "s1", "s2")
    first = linkable.groupBy("s1", "s2").agg(F.min("id").alias("class_id"))
    first = first.select(F.expr("~s1").alias("k1"), F.expr("~s2").alias("k2"), "class_id")
    member = linkable.join(first, (F.expr("~s1") == F.col("k1")) & (F.expr("~s2") == F.col("k2"))).select("id", "n", "class_id")
    member = stash(member, "join-members")
    # an id whose rows have several sets stays if it stands for one of them
    copies = member.groupBy("id").agg(F.max(F.col("id") == F.col("class_id")).alias("head")).where("not head").select("id")
    heads = rows.where("n > 0 and id is not null").join(small_side(stash(copies, "join-copies")), "id", "left_anti")

    # index keys that several sets share; two sets are a pair as they are, more are listed
    indexed = heads.select("id", F.explode("keys").alias("key"))
    shared = indexed.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("id").alias("low"), F.max("id").alias("high"))
    shared = stash(shared.where("low <> high"), "join-shared")
    crowded = shared.where("sets > 2").select(F.expr("~key").alias("k"), "low", "sets")
    listed = small_side(stash(crowded.select("k"), "join-crowded"))
    placed = indexed.join(listed, F.expr("~key") == F.col("k"), "left_semi")
    placed = stash(placed.join(crowded, F.expr("~key") == F.col("k")).select("key", "id", "low", "sets"), "join-placed")
    stars = placed.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    stars = stars.union(shared.where("sets = 2").select("low", "high")).distinct()
    slim = heads.select("id", "n", "parity")
    links = stash(_verify(_near(stars, slim, num, den), texts, words, num, den), "join-links")
    comps = stash(components(links), "join-components")

    # the pairs a star leaves open, where a key's sets are still apart
    open_sets = placed.where("id <> low").join(comps, F.col("id") == F.col("node"), "left")
    open_sets = open_sets.select("key", "id", F.coalesce("component", "id").alias("comp"))
    apart = open_sets.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("sets")).where("x <> y")
    apart = apart.select(F.expr("~key").alias("k"), "sets")
    open_sets = open_sets.join(apart, F.expr("~key") == F.col("k")).select("key", "id", "comp", "sets")
    open_sets = stash(open_sets, "join-open")
    shared = open_sets.groupBy("id").agg(F.collect_set("key").alias("shared"))
    cards = stash(slim.join(shared, "id"), "join-cards")
    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        open_sets.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "id", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        )
    )
    met = dealt.join(cards, "id").groupBy("key", "i", "j").applyInArrow(_meet(num, den), "a long, b long").distinct()
    more = _verify(met, texts, words, num, den)
    return rows, member, stash(links.union(more), "join-all-links")


def _near(pairs: DataFrame, slim: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that size and parity bits leave possible."""
    left = slim.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("p_a"))
    right = slim.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("p_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_prefilter(num, den)("n_a", "p_a", "n_b", "p_b")).select("a", "b").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs whose texts reach the similarity."""
    pairs = stash(pairs, "join-pairs")
    wanted = stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "join-wanted")
    fetched = stash(texts.join(small_side(wanted), "id", "left_semi"), "join-texts")
    both = pairs.join(fetched.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(fetched.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.where(_verified(words, num, den)("x", "y")).select("a", "b").distinct()


def jaccard_components(
    docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach. A null, empty or blank text and a row with
    null doc_id link with nothing (the null id has a null component). Rows that share a doc_id
    count as one document which has the links of all of them. An empty table gives an empty result.
    """
    rows, member, links = links_and_classes(docs, words, similarity, doc_id, text)
    several = member.groupBy("id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b")
    several = member.join(several.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("class_id").alias("b"))
    comps = stash(components(links.union(several)), "join-components")
    linked = member.join(comps, F.col("class_id") == F.col("node"), "left")
    linked = linked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"))
    alone = rows.where("n = 0 or id is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.union(alone)
