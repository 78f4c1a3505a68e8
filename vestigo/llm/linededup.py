"""Removal of repeated passages by winnowing over words.

A window is a run of `min_words` words. Its fingerprint is the smallest hash of the word k-grams in it (the
last of equals), so a window has the same one at the same word of it wherever it stands. Neighbouring windows
mostly share their minimum: a selection is one such minimum with the stretch of words that its windows
cover, and only selections are written. Places with the same fingerprint meet; stretches equal as
a whole are settled at once, and where stretches of a fingerprint differ, one of each kind is compared
window by window, so matches reach word by word as far both ways as the passages agree. All but
the first occurrence of each window are deleted, wherever in a line they begin or end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from vestigo.llm.joins import is_small, small_side
from vestigo.session import release, stash, stashed

#: A repeated passage goes if it has so many words.
MIN_WORDS = 50
#: Odd multipliers of the two rolling hashes, and their inverses.
_BASES = [0x9E3779B97F4A7C15 ^ 0x6, 0xC2B2AE3D27D4EB4F ^ 0x4]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
#: Bytes of text whose words are hashed together; a longer text stands alone.
_SLICE = 1 << 18
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LENGTH, _LAST, _LOW = np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _kept_powers(family: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(family, _SLICE)


def _powers(family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of a rolling hash's multiplier and of its inverse."""
    powers, back = np.full(n, _BASES[family], np.uint64), np.full(n, _INVERSES[family], np.uint64)
    powers[:1] = back[:1] = 1
    return np.cumprod(powers), np.cumprod(back)


def _edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in bytes with white space at both ends."""
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return edges[::2], edges[1::2]


class Words:
    """Words (runs without ASCII white space) of one or several texts, numbered through, with 2 x 64-bit hashes
    of any runs of them. `first` has each text's first word and the number of all words."""

    def __init__(self, texts: bytes | list[bytes], min_words: int):
        texts = [texts] if isinstance(texts, bytes) else texts
        data = b"\n".join([b"", *texts, b" " * 8])
        starts, stops = _edges(data)
        self.n = len(starts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.first = np.searchsorted(starts, np.concatenate([[0], ends]))
        if self.n < min_words:
            return
        # up to 8 bytes are a number, up to 16 two that may overlap
        length = stops - starts
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        own = _mix((eight[starts] & _MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * _LENGTH)
        more = np.flatnonzero(length > 8)
        own[more] = _mix(own[more] + eight[stops[more] - 8] * _LAST)
        for i in np.flatnonzero(length > 16).tolist():
            own[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]])
        self._own = own
        self._kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _running(self, family: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of one rolling hash and the inverse powers that shift them, derived when first asked for."""
        if family not in self._kept:
            powers, back = _kept_powers(family) if self.n <= _SLICE else _powers(family, self.n)
            own = self._own
            for _ in range(family + 1):
                own = _mix(own)
            self._kept[family] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers[: self.n])]), back
        return self._kept[family]

    def hashes(self, start: np.ndarray, stop: np.ndarray, family: int) -> np.ndarray:
        """Of words start to stop - 1."""
        length = (stop - start).astype(np.uint64)
        sums, back = self._running(family)
        return _mix((sums[stop] - sums[start]) * back[start] + length).view(np.int64)

    def texts_of(self, words: np.ndarray) -> np.ndarray:
        """Number of the text that each word is in."""
        return np.searchsorted(self.first, words, side="right") - 1

    def selections(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first window, number of windows) of every selected minimum; windows by first word."""
        if self.n < min_words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = max(1, min_words // 5)
        sums, back = self._running(0)
        grams = _mix((sums[k:] - sums[:-k]) * back[: self.n - k + 1] + np.uint64(k))
        # the upper half of a hash and, so that the last of equals is the lowest, its place counted from behind
        lowest = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
        reach, width = 1, min_words - k + 1
        while reach < width:  # the lowest among twice as many, at each place
            step = min(reach, width - reach)
            lowest = np.minimum(lowest[:-step], lowest[step:])
            reach += step
        changes = np.concatenate([[True], lowest[1:] != lowest[:-1]])
        # no window reaches into the next text
        begin, end = self.first[:-1], self.first[1:] - (min_words - 1)
        some = begin < end
        changes[begin[some]] = True
        end = end[some]
        changes[end[end < len(changes)]] = True
        first = np.flatnonzero(changes)
        n = np.diff(first, append=len(lowest))
        inside = first + min_words <= self.first[self.texts_of(first) + 1]
        first, n = first[inside], n[inside]
        return grams[(_LOW - (lowest[first] & _LOW)).astype(np.int64)].view(np.int64), first, n


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts to look at together, from one number to another."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _SLICE:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def _lists(counts: list[np.ndarray], parts: list[list[np.ndarray]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Lists of structs with so many elements each."""
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts])).astype(np.int32)
    columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *p]), pa.int64()).cast(t) for p, (_, t) in zip(parts, fields)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=[f for f, _ in fields]))


def _winnowed(min_words: int):
    fields = [("fp", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("whole", pa.int64())]

    @arrow_udf("array<struct<fp: long, start: int, n: int, whole: long>>")
    def winnowed(texts: pa.Array) -> pa.Array:
        counts, parts = [], [[] for _ in fields]
        raw = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
        for i, j in _slices(raw):
            words = Words(raw[i:j], min_words)
            fp, first, n = words.selections(min_words)
            if not len(fp):
                counts.append(np.zeros(j - i, np.int64))
                continue
            text = words.texts_of(first)
            whole = words.hashes(first, first + n + (min_words - 1), 0)
            for part, values in zip(parts, (fp, first - words.first[text], n, whole)):
                part.append(values)
            counts.append(np.bincount(text, minlength=j - i))
        return _lists(counts, parts, fields)

    return winnowed


def _windows(min_words: int):
    fields = [("start", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())]

    @arrow_udf("array<struct<start: int, w1: long, w2: long>>")
    def windows(texts: pa.Array, stretches: pa.Array) -> pa.Array:
        """All windows of the stretches."""
        counts, parts = [], [[] for _ in fields]
        raw = texts.cast(pa.binary()).to_pylist()
        starts, ns = (stretches.flatten().field(f).to_numpy().astype(np.int64) for f in ("start", "n"))
        ends = np.cumsum(np.concatenate([[0], pc.list_value_length(stretches).to_numpy()]))
        for i, j in _slices(raw):
            words = Words(raw[i:j], min_words)
            own = slice(ends[i], ends[j])
            n = ns[own]
            begin = starts[own] + np.repeat(words.first[:-1], np.diff(ends[i : j + 1]))
            start = np.unique(np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            text = words.texts_of(start)
            for part, values in zip(parts, (start - words.first[text], *(words.hashes(start, start + min_words, f) for f in (0, 1)))):
                part.append(values)
            counts.append(np.bincount(text, minlength=j - i))
        return _lists(counts, parts, fields)

    return windows


def _runs(lists: pa.Array) -> list[list[tuple[int, int]]]:
    """Each text's spans in order, those that share a word as one."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    text = np.repeat(np.arange(len(counts)), counts)
    start, stop = (lists.flatten().field(f).to_numpy().astype(np.int64) + (text << 32) for f in ("start", "stop"))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] >= reach[:-1]]) if len(start) else np.zeros(0, bool))
    last = np.append(fresh[1:], len(start)) - 1
    text = text[fresh]  # the order is by text first
    spans = list(zip((start[fresh] - (text << 32)).tolist(), (reach[last] - (text << 32)).tolist()))
    ends = np.searchsorted(text, np.arange(len(counts) + 1)).tolist()
    return [spans[i:j] for i, j in zip(ends, ends[1:])]


def without_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without words start to stop - 1 of each span, and from how many lines words went.

    A line whose words all go vanishes, as do blank lines inside a span. A line that keeps words loses
    the white space before each word that goes; all else stays byte for byte.
    """
    runs: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if runs and start < runs[-1][1]:
            runs[-1] = runs[-1][0], max(stop, runs[-1][1])
        else:
            runs.append((start, stop))
    return _without_runs(text, runs)


def _without_runs(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """`without_words` for spans in order that share no word."""
    kept, touched, first, at = [], 0, 0, 0
    for line in text.split(b"\n"):
        last = first + len(line.split())
        while at < len(runs) and runs[at][1] <= first:
            at += 1
        start, stop = runs[at] if at < len(runs) else (last, last)
        if first == last:
            if not start < first < stop:
                kept.append(line)
        elif start >= last:
            kept.append(line)
        else:
            touched += 1
            if start > first or stop < last:
                cuts, k = [], at
                while k < len(runs) and runs[k][0] < last:
                    start, stop = max(runs[k][0], first) - first, min(runs[k][1], last) - first
                    if cuts and cuts[-1][1] == start:
                        cuts[-1] = cuts[-1][0], stop
                    else:
                        cuts.append((start, stop))
                    k += 1
                if cuts != [(0, last - first)]:
                    kept.append(_shortened(line, cuts))
        first = last
    return b"\n".join(kept), touched


def _shortened(line: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """A line without words start to stop - 1 of each cut; between cuts there are words."""
    starts, stops = (x - 1 for x in _edges(b" %b " % line))
    out, at = [], 0
    for start, stop in [*cuts, (len(starts), len(starts))]:
        if start > at:
            begin = 0 if not at else stops[at - 1] if out else starts[at]
            out.append(line[begin : stops[start - 1] if start < len(starts) else len(line)])
        at = stop
    return b"".join(out)


def _without():
    @arrow_udf("struct<text: string, lines: long>")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out, lines = [], []
        for t, runs in zip(texts.cast(pa.binary()).to_pylist(), _runs(spans)):
            short, touched = (t, 0) if t is None or not runs else _without_runs(t, runs)
            out.append(short)
            lines.append(touched)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64())], names=["text", "lines"])

    return without


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(text)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, start, stop): spans of words that occur earlier, by doc_id and word. th is the
    text's hash, which tells documents apart that share a doc_id."""
    id_, th = _keyed(docs, doc_id, text)
    texts = docs.where(F.col(text).isNotNull()).select(id_.alias("id"), th.alias("th"), F.col(text).alias("text"))
    rows = texts.select("id", "th", F.explode(_winnowed(min_words)(F.col("text"))).alias("_w"))
    rows = stash(rows.select("id", "th", "_w.*"), "line-selections")
    repeated = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("places"), F.min("whole").alias("x"), F.max("whole").alias("y"))
    repeated = repeated.where("places > 1").select(F.expr("~fp").alias("k"), F.expr("x <> y").alias("mixed"))
    met = stash(rows.join(repeated, F.expr("~fp") == F.col("k")).drop("k"), "line-met")
    # kinds of equal stretches (their words' two hashes); the first occurrence combines before the shuffle
    place = F.struct("id", "th", "start")
    kinds = met.groupBy("fp", "whole").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("places"), F.min("n").alias("n"), F.max("mixed").alias("mixed")
    )
    kinds = stash(kinds, "line-kinds")
    again = kinds.where("places > 1").select(F.expr("~fp").alias("k1"), F.expr("~whole").alias("k2"), "first")
    later = met.join(again, (F.expr("~fp") == F.col("k1")) & (F.expr("~whole") == F.col("k2"))).where(place != F.col("first"))
    later = later.select("id", "th", "start", (F.col("start") + F.col("n") + (min_words - 1)).alias("stop"))
    # a fingerprint with several kinds: their first occurrences are compared window by window
    mixed = kinds.where("mixed").select("first.*", "n").groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("_open"))
    mixed = stash(mixed, "line-open")
    texts = texts.join(small_side(stash(mixed.select("id").distinct(), "line-open-ids")), "id", "left_semi")
    windows = texts.join(mixed.hint("merge"), ["id", "th"])
    windows = windows.select("id", "th", F.explode(_windows(min_words)(F.col("text"), F.col("_open"))).alias("_w"))
    windows = stash(windows.select("id", "th", "_w.*"), "line-windows")
    lowest = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    lowest = lowest.select(F.expr("~w1").alias("k1"), F.expr("~w2").alias("k2"), "first")
    single = windows.join(lowest, (F.expr("~w1") == F.col("k1")) & (F.expr("~w2") == F.col("k2"))).where(place != F.col("first"))
    return later.union(single.select("id", "th", "start", (F.col("start") + min_words).alias("stop")))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", cut: str = "_cut") -> DataFrame:
    """The documents' own columns with later occurrences of repeated passages cut from the text, and
    `cut` (number of lines that words were cut from), a name the documents must not have.

    A passage is a run of at least `min_words` words (compared without the white space between them),
    wherever in a line it begins or ends. The first occurrence by doc_id (null last), text hash and word
    stays, so no passage vanishes from the corpus; one that repeats in itself keeps its first turn.
    Rows equal in doc_id and text count as one occurrence and are cut alike. A null text stays null, an
    empty one empty; a text that is cut altogether becomes empty. Nothing shorter is touched.
    """
    if cut in docs.columns:
        raise ValueError(f"the documents have a column {cut}; name another one")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    id_, th = _keyed(packed, f"_row.{doc_id}", f"_row.{text}")
    packed = packed.withColumn("_id", id_).withColumn("_th", th)
    before = set(stashed(docs.sparkSession))
    spans = repeated_spans(docs, min_words, doc_id, text)
    scratch = [p for p in stashed(docs.sparkSession) if p not in before]
    cuts = spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    cuts = cuts.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "_spans")
    cuts = stash(cuts, "line-cuts")
    release(docs.sparkSession, scratch)  # nothing reads it any more
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    cut_ids = stash(cuts.select("_id").distinct(), "line-cut-ids")
    untouched = None
    some = packed
    if is_small(cut_ids):  # documents without a cut, most of them, aren't moved
        some = packed.join(F.broadcast(cut_ids), "_id", "left_semi")
        untouched = packed.join(F.broadcast(cut_ids), "_id", "left_anti").select(*own, F.lit(0).cast("long").alias(cut))
    joined = some.join(cuts.hint("merge"), ["_id", "_th"], "left")
    joined = joined.select("_row", _without()(F.col(f"_row.`{text}`"), F.col("_spans")).alias("_short"))
    columns = [F.col("_short.text").alias(text) if c == text else column for c, column in zip(docs.columns, own)]
    short = joined.select(*columns, F.col("_short.lines").alias(cut))
    return short if untouched is None else short.unionByName(untouched)
