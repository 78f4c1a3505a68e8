"""Encoding and decoding with byte-level BPE vocabularies by a streaming transducer.

A token's lookahead is the number of bytes behind it that can still change it. For a merge (a, b)
of rank r, `a` waits for b and for whatever `b` waits for under ranks below r; the new token waits
for what `b` waits for at that moment, as merges inside it can only be upset across its right end.
One pass over the merge list in rank order gives every token's sufficient lookahead. The transducer
holds one window: a token of the merged window is stable, and leaves, once its lookahead lies
inside the window; then the window moves on. Words shorter than the window end before anything leaves
it, so new ones are merged side by side in arrays, and remembered. Decoding feeds token bytes to an incremental UTF-8
state machine, which holds at most three bytes.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

#: Characters of a text that are cut into words at a time.
SLICE = 1 << 16
#: No alternative of the word pattern looks further than this to tell that a word has ended.
WORD_LOOKAHEAD = 3
#: Words up to this length are remembered, in two generations of so many per Python worker.
REMEMBERED_CHARS = 32
REMEMBERED_WORDS = 400_000
#: Characters of neighbouring texts whose new words are merged together.
GROUP_CHARS = 1 << 20

# Fixed value: the published word pattern of byte-level BPE, {L}, {N} and {S} its letters, numbers and signs.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{S}+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """Character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@functools.cache
def class_differences() -> str:
    """Letters and numbers of the `regex` module that the tokenizers library, which follows another
    edition of Unicode, counts as neither. Asked once, on the driver, of the library's word splitter."""
    from tokenizers import pre_tokenizers

    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    asked, odd = regex.findall(r"[\p{L}\p{N}]", every), []
    for at in range(0, len(asked), 256):
        some = asked[at : at + 256]
        starts = {span[0] for _, span in splitter.pre_tokenize_str("".join([f"a{c}1 " for c in some]))}
        # between a letter and a digit a letter or number joins one of them, anything else stands alone
        odd += [c for i, c in enumerate(some) if {4 * i + 1, 4 * i + 2} <= starts]
    return "".join(odd)


def ranges(characters: str) -> list[tuple[str, str]]:
    """First and last of each run of neighbouring characters, which are given in order."""
    found: list[tuple[str, str]] = []
    for c in characters:
        if found and ord(found[-1][1]) + 1 == ord(c):
            found[-1] = (found[-1][0], c)
        else:
            found.append((c, c))
    return found


#: Tokens of a stretch of text: their ids as little-endian unsigned 32-bit words, their bytes.
Part = tuple[bytes, bytes]


class ByteBpe:
    """One vocabulary. Serves byte-level BPE files whose merges are listed after what they join, without
    normaliser, prefix space or other processing; others are refused with ValueError."""

    def __init__(self, file: bytes, not_words: str = ""):
        spec = json.loads(file)
        self._refuse_others(spec)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        if missing := [c for c in self.alphabet if c not in self.ids]:
            raise ValueError(f"the vocabulary lacks bytes: {missing}")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.ahead = self._lookaheads(merges)
        self.lookahead = max(self.ahead.values())
        self.window = 2 * (max(map(len, self.ahead)) + self.lookahead)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = {i: bytes(self.byte_of[c] for c in t) for t, i in self.ids.items()}
        self.surface |= {i: t.encode() for t, i in self.added.items()}
        self.token_part = {t: (i.to_bytes(4, "little"), self.surface[i]) for t, i in self.ids.items()}
        self.space = self.alphabet[0x20]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.words = regex.compile(WORDS.format(L=r"\p{L}", N=r"\p{N}", S=r"[^\s\p{L}\p{N}]"))
        self.odd = frozenset(not_words)
        if not_words:
            listed = "".join(f"{a}-{b}" for a, b in ranges(not_words))
            own = [rf"[\p{{{k}}}--[{listed}]]" for k in "LN"]
            signs = rf"[[^\s\p{{L}}\p{{N}}]||[{listed}]]"
            self.careful_words = regex.compile(WORDS.format(L=own[0], N=own[1], S=signs), regex.V1)
        self.known: dict[str, Part] = {}
        self.older: dict[str, Part] = {}
        self._array_tables(merges)

    @staticmethod
    def _refuse_others(spec: dict) -> None:
        model, words, back = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        bytewise = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and back.get("type") == "ByteLevel"
        if not plain or not bytewise or spec["normalizer"]:
            raise ValueError("needs a byte-level BPE file without normaliser, prefix space or subword marks")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be matched as they are written")

    def _lookaheads(self, merges: list[tuple[str, str]]) -> dict[str, int]:
        """Sufficient lookahead in bytes of every token, once no merge is left to come."""
        ahead = dict.fromkeys(self.alphabet, 0)
        for a, b in merges:
            if a not in ahead or b not in ahead or a + b in ahead:
                raise ValueError(f"merge {a!r} {b!r} is not listed once, after what it joins")
            beyond = ahead[b]
            ahead[a + b] = beyond
            ahead[a] = max(ahead[a], len(b) + beyond)
        return ahead

    def merged(self, window: str) -> list[str]:
        """Tokens of a stretch (in the byte alphabet) that stands alone: best rank first, then leftmost."""
        return self._merged_short(window) if len(window) <= 2 * REMEMBERED_CHARS else self._merged_long(window)

    def _merged_short(self, window: str) -> list[str]:
        tokens, rank_of, never = list(window), self.rank.get, len(self.rank)
        ranks = [rank_of(pair, never) for pair in zip(tokens, tokens[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((tokens[i - 1], tokens[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((tokens[i], tokens[i + 1]), never)
        return tokens

    def _merged_long(self, window: str) -> list[str]:
        tokens, size = list(window), len(window)
        left, right = [i - 1 for i in range(size)], [i + 1 for i in range(size)]
        rank_of = self.rank.get
        waiting = [(r, i, window[i], window[i + 1]) for i in range(size - 1) if (r := rank_of((window[i], window[i + 1]))) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = right[i]
            if tokens[i] != a or j >= size or tokens[j] != b:
                continue
            tokens[i], tokens[j] = a + b, ""
            right[i] = k = right[j]
            if k < size:
                left[k] = i
                if (r := rank_of((a + b, tokens[k]))) is not None:
                    heapq.heappush(waiting, (r, i, a + b, tokens[k]))
            if (h := left[i]) >= 0 and (r := rank_of((tokens[h], a + b))) is not None:
                heapq.heappush(waiting, (r, h, tokens[h], a + b))
        return [t for t in tokens if t]

    def _array_tables(self, merges: list[tuple[str, str]]) -> None:
        """Merges as sorted pair keys with their ranks, results by rank, and the token of each byte."""
        ids = self.ids
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self._joined = np.array([ids[a + b] for a, b in merges], np.int64)
        self._byte_ids = np.array([ids[c] for c in self.alphabet], np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of merges where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (right >= 0), self._ranks[at], len(self._keys))

    def merged_side_by_side(self, words: list[bytes]) -> np.ndarray:
        """Ids of words of equal length in bytes, a row each with -1 behind them, as `merged` gives them
        one by one: in every round each word joins its pair of best rank, the leftmost of equals."""
        size, none = len(words[0]), len(self._keys)
        tokens = np.full((len(words), size + 1), -1, np.int64)
        tokens[:, :size] = self._byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)]
        ranks = np.full((len(words), size + 1), none, np.int64)
        if size > 1:
            ranks[:, : size - 1] = self._rank_of(tokens[:, : size - 1], tokens[:, 1:size])
        row, columns, out = np.arange(len(words)), np.arange(size + 1), np.empty_like(tokens)
        while len(row):
            place = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), place]
            live = best < none
            if not live.all():
                out[row[~live]] = tokens[~live]
                row, tokens, ranks, place, best = row[live], tokens[live], ranks[live], place[live], best[live]
            every, here = np.arange(len(row)), place[:, None]
            tokens[every, place] = self._joined[best]
            tokens = np.take_along_axis(tokens, np.minimum(columns + (columns > here), size), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= here), size), axis=1)
            ranks[every, place] = self._rank_of(tokens[every, place], tokens[every, np.minimum(place + 1, size)])
            before = np.flatnonzero(place)
            at = place[before]
            ranks[before, at - 1] = self._rank_of(tokens[before, at - 1], tokens[before, at])
        return out

    def part(self, tokens: list[str]) -> Part:
        ids, surface = zip(*[self.token_part[t] for t in tokens])
        return b"".join(ids), b"".join(surface)

    def _learn(self, found: list[list[str]]) -> None:
        """Sees to it that all these words are known; what the younger generation lacks moves up to it."""
        if len(self.known) >= REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        lacking = set().union(*found).difference(self.known)
        by_size: dict[int, list[str]] = {}
        for word in lacking:
            part = self.older.get(word)
            if part is not None:
                self.known[word] = part
            elif len(word) > REMEMBERED_CHARS:
                machine = Transducer(self)
                self.known[word] = self.part(machine.feed(word) + machine.close())
            else:
                by_size.setdefault(len(word) if word.isascii() else len(word.encode()), []).append(word)
        for size, words in by_size.items():
            rows = self.merged_side_by_side([w.encode() for w in words])
            flat, ends = rows[rows >= 0], np.cumsum((rows >= 0).sum(axis=1) * 4).tolist()
            ids = flat.astype("<u4").tobytes()
            surface = b"".join([self.surface[i] for i in flat.tolist()])  # every word has as many bytes
            start = 0
            for k, (word, end) in enumerate(zip(words, ends)):
                self.known[word] = ids[start:end], surface[k * size : (k + 1) * size]
                start = end

    def _forget(self, found: list[list[str]]) -> None:
        """Long words aren't kept."""
        for word in {w for words in found for w in words if len(w) > REMEMBERED_CHARS}:
            self.known.pop(word, None)

    def grouped_parts(self, texts: Iterable[str]) -> Iterator[Iterator[list[Part]]]:
        """The tokens of each text, a bounded stretch at a time; must be read text by text. New words of
        neighbouring texts are merged together."""
        group: list[list[tuple[bool, str, list[str]]]] = []
        chars = 0
        for text in texts:
            # cutting short texts into words here, long ones while they are read
            group.append([(special, s, self._pattern(text).findall(s) if not special and len(s) <= SLICE else []) for special, s in self._segments(text)])
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[tuple[bool, str, list[str]]]]) -> Iterator[Iterator[list[Part]]]:
        found = [words for text in group for _, _, words in text if words]
        if found:
            self._learn(found)
        parts = {w: self.known[w] for words in found for w in words if len(w) > REMEMBERED_CHARS}
        self._forget(found)
        # long texts learn words of their own meanwhile, so the group's words stay at hand
        known = self.known
        for text in group:
            yield self._text_parts(text, known, parts)

    def _text_parts(self, text: list[tuple[bool, str, list[str]]], known: dict[str, Part], long: dict[str, Part]) -> Iterator[list[Part]]:
        for special, segment, words in text:
            if special:
                token = self.added[segment]
                yield [(token.to_bytes(4, "little"), self.surface[token])]
            elif words:
                yield [known[w] if w in known else long[w] for w in words] if long else [known[w] for w in words]
            elif segment:
                yield from self._long_parts(segment, self._pattern(segment))

    def _pattern(self, text: str) -> regex.Pattern:
        return self.words if text.isascii() or self.odd.isdisjoint(text) else self.careful_words

    def _segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """Stretches of a text that are added tokens, and those between."""
        pieces = self.specials.split(text) if self.specials else [text]
        return ((i % 2 == 1, piece) for i, piece in enumerate(pieces))

    def _long_parts(self, segment: str, words: regex.Pattern) -> Iterator[list[Part]]:
        start, size = 0, len(segment)
        while start < size:
            piece = segment[start : start + SLICE]
            found = words.findall(piece)
            used = len(piece)
            if start + used < size:  # the last words may go on behind the slice
                while found and used > len(piece) - WORD_LOOKAHEAD:
                    used -= len(found.pop())
            if found:
                self._learn([found])
                parts = [self.known[w] for w in found]
                self._forget([found])
                yield parts
                start += used
            else:  # one word fills the slice
                end = words.match(segment, start).end()
                stretches = (segment[a : min(a + SLICE, end)] for a in range(start, end, SLICE))
                for tokens in Transducer(self).run(stretches):
                    yield [self.part(tokens)]
                start = end

    def encode_all(self, texts: Iterable[str]) -> list[list[int]]:
        out = []
        for text in self.grouped_parts(texts):
            out.append(np.frombuffer(b"".join([ids for parts in text for ids, _ in parts]), "<u4").tolist())
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, a bad byte sequence giving U+FFFD; an id outside the vocabulary gives nothing."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        surface = self.surface.get
        return "".join([machine.decode(surface(i, b"")) for i in ids]) + machine.decode(b"", True)

    def summaries(self, texts: Iterable[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids, digest of the decoded text of each text; holds one stretch at a time."""
        out = []
        for text in self.grouped_parts(texts):
            count, ids, back = 0, hashlib.sha256(), hashlib.sha256()
            machine = codecs.getincrementaldecoder("utf-8")("replace")
            for parts in text:
                words, surfaces = zip(*parts)
                tokens = b"".join(words)
                count += len(tokens) // 4
                ids.update(tokens)
                back.update(machine.decode(b"".join(surfaces)).encode())
            back.update(machine.decode(b"", True).encode())
            out.append((count, ids.hexdigest(), back.hexdigest()))
        return out


class Transducer:
    """Reads one word in stretches and emits its tokens as they become stable; holds one window."""

    def __init__(self, codec: ByteBpe):
        self.codec = codec
        self.held = ""

    def feed(self, stretch: str) -> list[str]:
        """Takes more of the word; returns the tokens that nothing behind can change any more."""
        codec = self.codec
        if stretch.isascii() and stretch.isprintable():  # all but the space stand for themselves
            data = stretch.replace(" ", codec.space)
        else:
            data = "".join([codec.alphabet[b] for b in stretch.encode()])
        if len(self.held) + len(data) <= codec.window:
            self.held += data
            return []
        stable: list[str] = []
        at = 0
        while len(self.held) + len(data) - at > codec.window:
            take = codec.window - len(self.held)
            window = self.held + data[at : at + take]
            at += take
            end = 0
            for token in codec.merged(window):
                if end + len(token) + codec.ahead[token] > len(window):
                    break
                stable.append(token)
                end += len(token)
            self.held = window[end:]
        self.held += data[at:]
        return stable

    def close(self) -> list[str]:
        """Tokens of what is held when the word ends."""
        rest, self.held = self.held, ""
        return self.codec.merged(rest) if rest else []

    def run(self, stretches: Iterable[str]) -> Iterator[list[str]]:
        for stretch in stretches:
            if stable := self.feed(stretch):
                yield stable
        if rest := self.close():
            yield rest


_CODECS: dict[str, ByteBpe] = {}


def _codec(model) -> ByteBpe:
    file, not_words = model.value
    key = hashlib.sha256(file).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = ByteBpe(file, not_words)
    return _CODECS[key]


def _model(docs: DataFrame, path: str):
    """The vocabulary file (a few MB whatever the documents) for the workers."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), class_differences()))


def encoded(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text (null counts as empty: no ids)."""
    model = _model(docs, path)

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec = _codec(model)
        return pa.array(codec.encode_all(pc.fill_null(texts, "").to_pylist()), pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids (null for null; bytes that are no UTF-8 give U+FFFD)."""
    model = _model(docs, path)

    @arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        codec = _codec(model)
        return pa.array([None if x is None else codec.decode(x) for x in lists.to_pylist()], pa.string())

    return docs.withColumn(out, texts(F.col(ids)))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids never leave the task.

    Null and empty texts have no ids. Repeated rows give repeated results, a null doc_id stays null,
    other columns are not read. A text of any length is read slice by slice.
    """
    model = _model(docs, path)

    @arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def summary(texts: pa.Array) -> pa.Array:
        codec = _codec(model)
        rows = codec.summaries(pc.fill_null(texts, "").to_pylist())
        n, ids, back = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.select(F.col(doc_id).alias("doc_id"), summary(F.col(text)).alias("_s")).select("doc_id", "_s.*")


def disagreements(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose ids or decoded text differ from the tokenizers library's; empty when all agree."""
    model = _model(docs, path)

    @arrow_udf("boolean")
    def differs(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        library = Tokenizer.from_buffer(model.value[0])
        codec = _codec(model)
        out = []
        for t in pc.fill_null(texts, "").to_pylist():
            ids = codec.encode(t)
            theirs = library.encode(t, add_special_tokens=False).ids
            out.append(ids != theirs or codec.decode(ids) != library.decode(theirs, skip_special_tokens=False))
        return pa.array(out, pa.bool_())

    return docs.where(differs(F.col(text))).select(F.col(doc_id).alias("doc_id"))
