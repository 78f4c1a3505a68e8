"""Encoding and decoding with merge-type SentencePiece vocabularies by a score-ordered agenda.

Adjacent symbols that together form a vocabulary piece wait in a heap; the pair with the best
score (then the leftmost) merges first and offers its new neighbours. A text falls into chunks
at places no piece spans, so each chunk is merged alone and frequent ones are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

SPACE = "▁"
#: Chunks up to this length are remembered, in two generations of so many per Python worker.
REMEMBERED_CHARS = 48
REMEMBERED_CHUNKS = 120_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceCodec:
    """One vocabulary. Serves models of the merge type with identity normalisation and byte fallback,
    whose spaces stand in front of words; others are refused with ValueError."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self._refuse_others(proto)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.surface: list[str | int] = []
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.surface.append(p.piece.replace(SPACE, " "))
            elif p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(value)
            else:
                self.surface.append("" if p.type == CONTROL else " ⁇ ")
        self.chunks = self._chunk_pattern()
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def _refuse_others(proto) -> None:
        norm, train = proto.normalizer_spec, proto.trainer_spec
        plain = norm.name == "identity" and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if train.model_type != 2 or not plain or not norm.add_dummy_prefix or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("needs a merge-type model with identity normalisation, a dummy prefix and byte fallback")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")

    def _chunk_pattern(self) -> re.Pattern | None:
        """Cuts in front of a space after a word, and around line ends, if no piece spans such a place."""
        inner = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in inner):
            return None
        return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by the agenda: a plain list of scores for a word, a heap for a longer run."""
        symbols = self._merged_by_list(chunk) if len(chunk) <= REMEMBERED_CHARS else self._merged_by_heap(chunk)
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            out.extend([i] if i is not None else [self.byte_ids[b] for b in s.encode()])
        return out

    def _merged_by_list(self, chunk: str) -> list[str]:
        symbols, score_of, never = list(chunk), self.scores.get, float("-inf")
        agenda = [score_of(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) > never:
            i = agenda.index(best)
            pair = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = score_of(symbols[i - 1] + pair, never)
            if i < len(agenda):
                agenda[i] = score_of(pair + symbols[i + 1], never)
        return symbols

    def _merged_by_heap(self, chunk: str) -> list[str]:
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        score_of, push, pop = self.scores.get, heapq.heappush, heapq.heappop
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            score = score_of(pair)
            if score is not None:
                agenda.append((-score, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = pop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or a + b != pair:
                continue
            symbols[left], symbols[right] = pair, None
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                joined = pair + symbols[far]
                score = score_of(joined)
                if score is not None:
                    push(agenda, (-score, left, far, joined))
            near = before[left]
            if near >= 0:
                joined = symbols[near] + pair
                score = score_of(joined)
                if score is not None:
                    push(agenda, (-score, near, left, joined))
        return [s for s in symbols if s is not None]

    def _part(self, chunk: str) -> tuple[int, str, str]:
        """A chunk that the younger generation lacks; what is asked for again moves up to it."""
        part = self.older.get(chunk)
        if part is None:
            ids = self.merge(chunk)
            part = (len(ids), ",".join(map(str, ids)), self.surface_of(ids))
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED_CHUNKS:
                self.older, self.known = self.known, {}
            self.known[chunk] = part
        return part

    def _parts(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each chunk in order."""
        if not text:
            return []
        escaped = (SPACE + text).replace(" ", SPACE)
        chunks = self.chunks.findall(escaped) if self.chunks else [escaped]
        known = self.known.get
        return [known(chunk) or self._part(chunk) for chunk in chunks]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._parts(text) for i in ids.split(",")]

    def surface_of(self, ids: list[int]) -> str:
        """Text of ids; runs of byte pieces are read as UTF-8, a bad byte giving U+FFFD."""
        try:
            return "".join([self.surface[i] for i in ids])
        except TypeError:  # some are bytes
            pass
        out: list[str] = []
        run = bytearray()
        for i in ids:
            s = self.surface[i]
            if isinstance(s, int):
                run.append(s)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(s)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids without the space that encoding puts in front."""
        return self._unprefixed(self.surface_of(ids))

    @staticmethod
    def _unprefixed(text: str) -> str:
        return text[1:] if text.startswith(" ") else text

    def summary(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids joined by commas, digest of the decoded text."""
        counts, ids, surfaces = zip(*parts) if (parts := self._parts(text)) else ((), (), ())
        decoded = self._unprefixed("".join(surfaces))
        return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


class _Model:
    """A vocabulary's bytes, and its codec once a worker asks. Spark drops a broadcast in a worker whose next task
    doesn't use it, and the codec with its remembered chunks goes too, so later stages have that memory."""

    def __init__(self, model: bytes):
        self.model = model
        self._codec: PieceCodec | None = None

    @property
    def codec(self) -> PieceCodec:
        if self._codec is None:
            self._codec = PieceCodec(self.model)
        return self._codec


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(_Model(f.read()))


def encoded(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text (null counts as empty: no ids)."""
    model = _model(docs, path)

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec = model.value.codec
        return pa.array([codec.encode(t) for t in pc.fill_null(texts, "").to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids (null for null)."""
    model = _model(docs, path)

    @arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        codec = model.value.codec
        return pa.array([None if x is None else codec.decode(x) for x in lists.to_pylist()], pa.string())

    return docs.withColumn(out, texts(F.col(ids)))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids never leave the task.

    Null and empty texts have no ids. Repeated rows give repeated results, a null doc_id stays null.
    """
    model = _model(docs, path)

    @arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def summary(texts: pa.Array) -> pa.Array:
        codec = model.value.codec
        rows = [codec.summary(t) for t in pc.fill_null(texts, "").to_pylist()]
        n, ids, back = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.select(F.col(doc_id).alias("doc_id"), summary(F.col(text)).alias("_s")).select("doc_id", "_s.*")


def disagreements(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose ids or decoded text differ from the sentencepiece library's; empty when all agree."""
    model = _model(docs, path)

    @arrow_udf("boolean")
    def differs(texts: pa.Array) -> pa.Array:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model.value.model)
        codec = model.value.codec
        out = []
        for t in pc.fill_null(texts, "").to_pylist():
            ids = codec.encode(t)
            out.append(ids != library.encode(t) or codec.decode(ids) != library.decode(ids))
        return pa.array(out, pa.bool_())

    return docs.where(differs(F.col(text))).select(F.col(doc_id).alias("doc_id"))
