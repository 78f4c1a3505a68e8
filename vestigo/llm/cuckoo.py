"""Exact duplicates through an index of cuckoo filters that supports insertion and deletion.

Digests are dealt to index shards. A shard holds a cuckoo filter (two candidate buckets of four
16-bit fingerprints a key) and, bucket for bucket, the stored keys. A filter hit is only a hint: it
counts when a stored full digest in that bucket equals the key. A shard that overflows
doubles its buckets and is filled again from its stored keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from vestigo.session import stash

SLOTS = 4
MAX_KICKS = 200
#: ASCII white space that is deleted before texts are compared.
BLANKS = b" \t\n\x0b\x0c\r"
STORED, DELETE, INSERT = 0, 1, 2
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class CuckooIndex:
    """Live digests of one shard. A key is a digest of 16 bytes or more; a value goes with each."""

    def __init__(self, buckets: int = 64):
        self.size = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = np.zeros(buckets * SLOTS, dtype=np.uint16)
        self.entries: list[tuple | None] = [None] * (buckets * SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * _MIX & _MASK) >> 32 & (self.buckets - 1))

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.entries[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self._slot(key)
        return None if slot < 0 else self.entries[slot][1]

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.entries[slot] = 0, None
        self.size -= 1
        return True

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not live."""
        entry = (key, value)
        while not self._settle(entry):
            entry = self._unsettled
            self._resize()
        self.size += 1

    def _settle(self, entry: tuple) -> bool:
        mark, first, second = self._places(entry[0])
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            entry, self.entries[slot] = self.entries[slot], entry
            mark, self.prints[slot] = int(self.prints[slot]), mark
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        self._unsettled = entry
        return False

    def _resize(self) -> None:
        """Twice the buckets, filled from the stored keys."""
        live, buckets = [e for e in self.entries if e], self.buckets * 2
        while True:
            self._empty(buckets)
            if all(self._settle(e) for e in live):
                return
            buckets *= 2

    def items(self) -> Iterator[tuple]:
        return (e for e in self.entries if e)


def _digest():
    @arrow_udf("struct<digest: binary, n_chars: long>")
    def digest(texts: pa.Array) -> pa.Array:
        """SHA-256 of the text without white space, and code points of the text itself; null counts as empty."""
        raw = pc.fill_null(texts, "")
        found = [hashlib.sha256(t.translate(None, BLANKS)).digest() for t in raw.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.binary()), pc.utf8_length(raw).cast(pa.int64())], names=["digest", "n_chars"]
        )

    return digest


def _rank(n_chars: int, doc_id: int | None) -> tuple:
    """Larger is better: most code points, then smallest doc_id, null ids last."""
    return (n_chars, doc_id is not None, -(doc_id or 0))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs stored, deleted and inserted rows of one shard, in this order, through its index."""
    index = CuckooIndex()
    for batch in batches:
        for action, digest, n_chars, doc_id, rows in zip(*(batch.column(i).to_pylist() for i in range(5))):
            live = index.get(digest)
            if action == DELETE:
                if live is not None:
                    left = live[2] - rows
                    index.delete(digest)
                    if left > 0:
                        index.insert(digest, (live[0], live[1], left))
            elif live is None:
                index.insert(digest, (n_chars, doc_id, rows))
            else:
                better = (n_chars, doc_id) if _rank(n_chars, doc_id) > _rank(live[0], live[1]) else live[:2]
                index.delete(digest)
                index.insert(digest, (*better, live[2] + rows))
    out: dict[str, list] = {"digest": [], "n_chars": [], "doc_id": [], "rows": []}
    for digest, (n_chars, doc_id, rows) in index.items():
        for name, value in zip(out, (digest, n_chars, doc_id, rows)):
            out[name].append(value)
        if len(out["digest"]) == 20_000:
            yield _batch(out)
            out = {name: [] for name in out}
    if out["digest"]:
        yield _batch(out)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def live_rows(live: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The rows (digest, n_chars, doc_id) left of `live` after deleting, then inserting; to be kept beside the index."""
    columns = ["digest", "n_chars", "doc_id"]
    return live.select(*columns).exceptAll(deletes.select(*columns)).union(inserts.select(*columns))


def apply_changes(
    inserts: DataFrame,
    stored: DataFrame | None = None,
    deletes: DataFrame | None = None,
    keys_per_shard: int = 250_000,
    live: DataFrame | None = None,
) -> DataFrame:
    """The index after deleting and inserting rows (digest, n_chars, doc_id): one row per live digest
    with the document that stays (most code points, then smallest doc_id) and its number of rows.

    A delete takes one row off its digest; the digest goes when none is left. With `live`, the rows behind
    `stored`, the best of the rows that remain of a digest stays; without it the document that stays keeps its
    place, so pass it wherever that one may be deleted.
    Equal rows are summed before the shuffle, so a digest that a third of all rows have is cheap.
    """
    parts = [(INSERT, inserts)] + ([(DELETE, deletes)] if deletes is not None else [])
    changes = None
    for action, rows in parts:
        summed = rows.groupBy("digest", "n_chars").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
        summed = summed.select(F.lit(action).alias("action"), "digest", "n_chars", "doc_id", "rows")
        changes = summed if changes is None else changes.union(summed)
    if stored is not None:
        changes = stored.select(F.lit(STORED).alias("action"), "digest", "n_chars", "doc_id", "rows").union(changes)
    keys = inserts.count() + (stored.count() if stored is not None else 0)
    shards = max(int(inserts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // keys_per_shard))
    dealt = changes.repartition(shards, "digest").sortWithinPartitions("action")
    index = dealt.mapInArrow(_apply, "digest binary, n_chars long, doc_id long, rows long")
    if deletes is None or live is None:
        return index
    hit = deletes.select("digest").distinct()
    left = live_rows(live, inserts, deletes).join(hit, "digest", "left_semi")
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("best_id"))
    best = left.groupBy("digest").agg(F.min(rank).alias("best")).select(F.col("digest").alias("_key"), "best")
    found = F.col("best").isNotNull()
    return index.join(best, F.col("digest") == F.col("_key"), "left").select(
        "digest",
        F.when(found, -F.col("best.n")).otherwise(F.col("n_chars")).alias("n_chars"),
        F.when(found, F.col("best.best_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        "rows",
    )


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars) of each row, written once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _digest()(F.col(text)).alias("_d"))
    return stash(rows.select("doc_id", "_d.digest", "_d.n_chars"), "exact-digests")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. Rows that repeat a doc_id are all marked kept if
    that id stays, and each counts in group_size. A null doc_id stays only if its group has no other.
    An empty table gives an empty result.
    """
    rows = digests(docs, doc_id, text)
    index = apply_changes(rows).select(
        F.col("digest").alias("_key"), F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size")
    )
    return rows.join(index, F.col("digest") == F.col("_key")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
