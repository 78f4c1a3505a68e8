"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to three bytes, counted on a bounded sample. A byte
is coded in the longest context that the language knows; a byte never seen there costs an escape
(method C: as likely as the number of different bytes seen) and is coded one byte shorter, without
the bytes already ruled out; at last all remaining byte values are equally likely. The statistics
are frozen, so each context's exact code lengths are worked out once and a text costs one look-up a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

ORDER = 3
#: Bounds of the model: sampled documents of each language (distinct texts, by hash),
#: contexts of three bytes (most frequent first; the rest use shorter ones).
SAMPLED_DOCUMENTS = 1_500
MAX_CONTEXTS = 8_192
UNDETERMINED = "und"
_PAD = b"\n" * ORDER
_SLICE = 1 << 18


@dataclass
class ContextTrees:
    """Frozen statistics of all languages. `states` are the contexts, longest first in `state_of`."""

    languages: list[str]
    symbol_of: np.ndarray  # byte -> symbol; 0: never seen
    contexts: list[np.ndarray]  # by order 0 to 3: codes of the known contexts
    bits: np.ndarray  # language, state * symbols + symbol
    _state_of: np.ndarray | None = field(default=None, repr=False)

    @property
    def symbols(self) -> int:
        return int(self.symbol_of.max(initial=0)) + 1

    @property
    def state_of(self) -> np.ndarray:
        """State for every three symbols: the longest known end of them."""
        if self._state_of is None:
            a = self.symbols
            table = np.zeros(a**ORDER, dtype=np.int32)
            first = 0
            for order, codes in enumerate(self.contexts):
                ends = np.arange(first, first + len(codes), dtype=np.int32)
                table.reshape(-1, a**order)[:, codes] = ends
                first += len(codes)
            self._state_of = table
        return self._state_of

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact bits of each text under each language: documents x languages."""
        out = np.zeros((len(texts), len(self.languages)))
        group, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), _SLICE):
                lead = t[max(0, at - ORDER) : at]
                group.append((i, (_PAD + lead)[-ORDER:] + t[at : at + _SLICE]))
                size += len(group[-1][1])
                if size >= _SLICE:
                    self._add(group, out)
                    group, size = [], 0
        if group:
            self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, bytes]], out: np.ndarray) -> None:
        a = self.symbols
        sym = self.symbol_of.astype(np.int32)[np.frombuffer(b"".join(t for _, t in group), dtype=np.uint8)]
        state = self.state_of[(sym[:-3] * a + sym[1:-2]) * a + sym[2:-1]]
        cell = state * a + sym[3:]
        ends = np.cumsum([len(t) for _, t in group])
        starts = np.concatenate([[0], ends[:-1]])
        spans = np.stack([starts, ends - ORDER], axis=1).ravel()
        rows = np.array([i for i, _ in group])
        for k in range(len(self.languages)):
            cost = np.append(self.bits[k][cell], np.float32(0))
            np.add.at(out[:, k], rows, np.add.reduceat(cost, spans, dtype=np.float64)[::2])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four bytes in a row (context and next byte) by language, summed within the batch."""
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for language in sorted(set(languages)):
            joined = [np.frombuffer(_PAD + t, dtype=np.uint8) for t, l in zip(texts, languages) if l == language and t]
            if not joined:
                continue
            codes = []
            for b in joined:
                w = b.astype(np.int64)
                codes.append(((w[:-3] * 256 + w[1:-2]) * 256 + w[2:-1]) * 256 + w[3:])
            grams, counts = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.record_batch(
                [pa.array([language] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())],
                names=["lang", "gram", "n"],
            )


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sampled_documents: int = SAMPLED_DOCUMENTS,
    max_contexts: int = MAX_CONTEXTS,
) -> ContextTrees:
    """Learn every language from rows whose language and text are not null. Only the summed statistics of the bounded
    sample come to the driver. Without any labelled row the model knows no language."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null and text <> ''")
    # each distinct text of a language counts once, so hot copies neither fill the sample nor tilt the statistics
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.select("lang", "h").distinct().groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return ContextTrees([], np.zeros(256, np.int64), [np.zeros(1, np.int64)], np.zeros((0, 1), np.float32))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sampled_documents / r["count"])))])
    luck = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(luck < share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    grams = sample.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return _build(grams.toArrow().to_pandas(), max_contexts)


def _build(grams, max_contexts: int) -> ContextTrees:
    languages = sorted(grams["lang"].unique())
    code = grams["gram"].to_numpy()
    parts = [(code >> 8 * k) & 255 for k in (3, 2, 1, 0)]
    seen = np.unique(np.concatenate([*parts, [10]]))
    symbol_of = np.zeros(256, dtype=np.int64)
    symbol_of[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 1
    s = [symbol_of[p] for p in parts]
    n = grams["n"].to_numpy().astype(np.float64)
    full = (s[0] * a + s[1]) * a + s[2]
    context_codes = [np.zeros(len(n), np.int64), s[2], s[1] * a + s[2], full]
    codes, total = np.unique(full, return_inverse=True)
    weight = np.bincount(total, weights=n)
    chosen = np.sort(codes[np.lexsort((codes, -weight))[:max_contexts]])
    contexts = [np.zeros(1, np.int64), np.unique(s[2]), np.unique(context_codes[2]), chosen]
    orders = np.concatenate([np.full(len(c), k) for k, c in enumerate(contexts)])
    states = np.concatenate(contexts)
    bits = np.empty((len(languages), len(states) * a), dtype=np.float32)
    for k, language in enumerate(languages):
        own = (grams["lang"] == language).to_numpy()
        counts = []
        for order in range(ORDER + 1):
            place = np.searchsorted(contexts[order], context_codes[order][own])
            place = np.minimum(place, len(contexts[order]) - 1)
            hit = contexts[order][place] == context_codes[order][own]
            table = np.zeros((len(contexts[order]), a))
            np.add.at(table, (place[hit], s[3][own][hit]), n[own][hit])
            counts.append(table)
        for at in range(0, len(states), 4096):
            part = slice(at, at + 4096)
            bits[k].reshape(-1, a)[part] = _lengths(orders[part], states[part], contexts, counts, a)
    return ContextTrees(languages, symbol_of, contexts, bits)


def _lengths(orders: np.ndarray, states: np.ndarray, contexts: list[np.ndarray], counts: list[np.ndarray], a: int) -> np.ndarray:
    """Code lengths of every symbol in each state, escaping order by order with exclusion."""
    rows = len(states)
    bits, spent = np.zeros((rows, a)), np.zeros(rows)
    coded = np.zeros((rows, a), dtype=bool)
    for order in range(ORDER, -1, -1):
        short = states % a**order
        place = np.minimum(np.searchsorted(contexts[order], short), len(contexts[order]) - 1)
        known = (orders >= order) & (contexts[order][place] == short)
        left = np.where(known[:, None] & ~coded, counts[order][place], 0)
        total, kinds = left.sum(axis=1), (left > 0).sum(axis=1)
        some = total > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = spent[:, None] + np.log2((total + kinds)[:, None] / left)
            escape = np.log2((total + kinds) / kinds)
        bits = np.where(left > 0, cost, bits)
        spent = np.where(some, spent + np.where(some, escape, 0), spent)
        coded |= left > 0
    rest = spent + np.log2(np.maximum(1, 256 - coded.sum(axis=1)))
    return np.where(coded, bits, rest[:, None])


def identify(docs: DataFrame, model: ContextTrees, text: str = "text") -> Column:
    """Struct (lang_pred, score, bits_per_byte) of a text.

    lang_pred is the language of the shortest code, the first by name on a tie; score is its share when
    languages are weighed by two to the minus bits. A null text, one without a letter, and any text
    under a model without languages is `und` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred: string, score: double, bits_per_byte: double>")
    def predict(texts: pa.Array) -> pa.Array:
        trees = shared.value
        strings = pc.fill_null(texts, "").to_pylist()
        lettered = [any(map(str.isalpha, t)) for t in strings] if trees.languages else [False] * len(strings)
        raw = [t.encode() if ok else b"" for t, ok in zip(strings, lettered)]
        names, scores, rates = [], [], []
        for bits, ok, t in zip(trees.code_lengths(raw), lettered, raw):
            if not ok:
                names.append(UNDETERMINED), scores.append(0.0), rates.append(None)
                continue
            best = int(bits.argmin())
            names.append(trees.languages[best])
            scores.append(float(1 / np.exp2(np.minimum(0, bits[best] - bits)).sum()))
            rates.append(float(bits[best]) / len(t))
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
            names=["lang_pred", "score", "bits_per_byte"],
        )

    return predict(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of the documents, by checksum of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predicted_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_byte; learnt from the rest.

    Repeated rows get equal results. An empty table gives an empty result.
    """
    model = fit(docs.where(~held_out(doc_id)), text, lang)
    return docs.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), identify(docs, model, text).alias("_p")
    ).select("doc_id", "held_out", "_p.*")
