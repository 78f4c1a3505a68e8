"""Order MinHash fingerprints of word sequences. Built-in functions only.

Every run of K words gets an occurrence number, so repeats count, and a hash of both. The hash deals it to
one of SKETCHES parts. Of each part the TUPLE smallest are selected, filled up with the smallest of the
following parts where it holds fewer, put back into text order and hashed together: a part of the
fingerprint stays only if the same k-mers stand in the same order. Hashes and
places are packed into one long (40 and 24 bits) so that arrays of plain longs are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.operators.spread import settle

#: Words of a k-mer, k-mers of a tuple, tuples of a fingerprint (a power of two).
K = 3
TUPLE = 2
SKETCHES = 64
#: Places beyond 2^24 - 1 words count as that one.
PLACE_BITS = 24
MAX_PLACE = (1 << PLACE_BITS) - 1
#: Ranges of doc_id in which neighbours are found side by side, at most.
MAX_RANGES = 4_096
_RUN = 64


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of a text column: array of (part << 32 | tuple hash), parts ascending.

    A text of fewer than K words is one k-mer, one without words (or null) has an empty fingerprint.
    Parts that no k-mer falls to are left out; a part with fewer than TUPLE k-mers takes the next ones by
    hash, the last part going on with the first, so only a text of fewer than TUPLE k-mers hashes less.
    """
    high = F.lit(~MAX_PLACE)
    bin_bits = 64 - (SKETCHES.bit_length() - 1)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    rows = settle(rows.withColumn("_w", words), "_w")

    def kmer(i: Column) -> Column:
        parts = F.xxhash64(*[F.element_at("_w", i + (k + 1)) for k in range(K)])
        return parts.bitwiseAND(high).bitwiseOR(F.least(i, F.lit(MAX_PLACE)).cast("long"))

    several = F.transform(F.sequence(F.lit(0), F.size("_w") - K), kmer)
    single = F.array(F.xxhash64(F.concat_ws(" ", "_w")).bitwiseAND(high))
    none = F.array().cast("array<bigint>")
    packed = F.when(F.size("_w") >= K, several).when(F.size("_w") > 0, single).otherwise(none)
    rows = settle(rows.withColumn("_k", F.sort_array(packed)).drop("_w"), "_k")

    def hash_at(i: Column) -> Column:
        return F.shiftright(F.element_at("_k", i), PLACE_BITS)

    places = F.when(F.size("_k") > 0, F.sequence(F.lit(1), F.size("_k"))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 1) | (hash_at(i) != hash_at(F.greatest(i - 1, F.lit(1)))))
    rows = settle(rows.withColumn("_s", starts), "_s")

    def run(first: Column, j: Column) -> Column:
        last = F.coalesce(F.get("_s", j + 1), F.size("_k") + 1) - 1
        return F.when(last == first, F.array(number(first, F.lit(0)))).otherwise(
            F.transform(F.sequence(first, last), lambda i: number(i, i - first))
        )

    def number(i: Column, occurrence: Column) -> Column:
        place = F.element_at("_k", i).bitwiseAND(F.lit(MAX_PLACE))
        return F.xxhash64(hash_at(i), occurrence).bitwiseAND(high).bitwiseOR(place)

    rows = settle(rows.withColumn("_n", F.sort_array(F.flatten(F.transform("_s", run)))).drop("_k", "_s"), "_n")

    def part(x: Column) -> Column:
        return F.shiftrightunsigned(x, bin_bits)

    smallest = F.filter("_n", lambda x, i: (i < TUPLE) | (part(x) != part(F.get("_n", F.greatest(i - TUPLE, F.lit(0))))))
    rows = settle(rows.withColumn("_p", smallest).drop("_n"), "_p")
    own = F.when(F.size("_p") > 0, F.sequence(F.lit(0), F.size("_p") - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(own, lambda i: (i == 0) | (part(F.get("_p", i)) != part(F.get("_p", F.greatest(i - 1, F.lit(0))))))

    def in_order(i: Column) -> Column:
        first = F.get("_p", i)
        taken = F.slice("_p", i + 1, TUPLE)
        wrapped = F.slice("_p", 1, F.least(F.lit(TUPLE), F.size("_p")) - F.size(taken))
        members = F.when(F.size(taken) == TUPLE, taken).otherwise(F.concat(taken, wrapped))
        ordered = F.array_sort(F.transform(members, lambda x: F.struct(x.bitwiseAND(F.lit(MAX_PLACE)).alias("at"), F.shiftright(x, PLACE_BITS).alias("h"))))
        code = F.xxhash64(F.concat_ws(",", F.transform(ordered, lambda s: s["h"].cast("string"))))
        return F.shiftleft(part(first), 32).bitwiseOR(code.bitwiseAND(F.lit(0xFFFFFFFF)))

    return settle(rows.withColumn(out, F.array_sort(F.transform(heads, in_order))).drop("_p"), out)


def likeness(a: str, b: str) -> Column:
    """Share of equal parts among those that either fingerprint has; 1 if both are empty."""
    parts = F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32)))
    equal = F.size(F.array_intersect(F.col(a), F.col(b)))
    return F.when(F.size(parts) == 0, 1.0).otherwise(equal / F.size(parts)).cast("double")


def written(fingerprint: str) -> Column:
    """Ten hexadecimal digits a part."""
    return F.concat_ws("", F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")))


def _range_of(doc_id: Column, cuts: list[float]) -> Column:
    """Number of cuts above the id, so ranges ascend as ids descend; null ids come last."""
    if not cuts:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    falling = sorted({int(c) for c in cuts}, reverse=True)
    runs = [falling[i : i + _RUN] for i in range(0, len(falling), _RUN)]
    table = F.array(*[F.array(*[F.lit(c) for c in r]) for r in runs])
    lasts = F.array(*[F.lit(r[-1]) for r in runs])
    full = F.size(F.filter(lasts, lambda c: c > doc_id))
    rest = F.coalesce(F.size(F.filter(F.get(table, full), lambda c: c > doc_id)), F.lit(0))
    rest = F.when(full < len(runs), rest).otherwise(0)
    return F.when(doc_id.isNull(), len(falling) + 1).otherwise(F.least(full * _RUN, F.lit(len(falling))) + rest)


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and fingerprint fp with next_text and next_fp, those of the next row by descending
    doc_id (equal ids by text hash, null ids last), the first row following the last.

    Rows are dealt to ranges of ids, so neighbours meet in one shuffle; only a range's first row,
    at most MAX_RANGES of them, is sent to the range before.
    """
    n = min(MAX_RANGES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    ranged = docs.withColumn("_range", _range_of(F.col("doc_id"), cuts).cast("int")).withColumn("_tie", F.xxhash64("text"))
    ids = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    ring = Window.orderBy("_range")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_range").over(ring), F.max("_range").over(whole))
    tops = F.broadcast(ids.select(F.col("_range").alias("_r"), "_top", before.alias("_after")))  # a row for each range
    top = ranged.join(tops, (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    once = Window.partitionBy("_range").orderBy("_tie")
    firsts = with_fingerprint(top.withColumn("_n", F.row_number().over(once)).where("_n = 1"), "text", "fp")
    firsts = firsts.select(F.col("_after").alias("_range"), F.col("text").alias("_first_text"), F.col("fp").alias("_first_fp"))
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), "_tie")
    following = (
        with_fingerprint(ranged, "text", "fp")
        .withColumn("_more", F.lead(F.lit(True), 1, False).over(order))
        .withColumn("_text", F.lead("text").over(order))
        .withColumn("_fp", F.lead("fp").over(order))
    )
    both = following.join(firsts, "_range", "left")
    return both.withColumn("next_text", F.when(F.col("_more"), F.col("_text")).otherwise(F.col("_first_text"))).withColumn(
        "next_fp", F.when(F.col("_more"), F.col("_fp")).otherwise(F.col("_first_fp"))
    )


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text keeps the first half of the code points (the longer one) and takes the rest from the
    start of the next document. Null counts as empty. The only document is its own next one. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 2)))"))
    paired = next_documents(rows).select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    paired = paired.withColumn("edited_sha256", F.sha2("edited", 256))
    paired = with_fingerprint(paired, "edited", "edited_fp")
    return paired.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("fp").alias("fingerprint"),
        written("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
