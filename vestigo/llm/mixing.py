"""Mixing sources to target weights by hash-threshold histograms. Built-in functions only.

Every row gets a 60-bit hash. A source's words are summed by hash prefix; the prefix in which the
running sum passes the source's budget is the boundary, and only its rows are summed again by the
next twelve bits. After five levels the threshold is a full hash. Rows below it are taken, so a larger
budget always takes a superset of a smaller one, and no row is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vestigo.llm.joins import small_side
from vestigo.session import stash

#: Bits of the hash that one level of the histogram resolves, and levels.
LEVEL_BITS = 12
LEVELS = 5
#: A source is repeated at most so often.
MAX_REPEATS = 3


def word_count(text: str) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _prefix(level: int) -> Column:
    """The leading bits of the hash that levels 1 to `level` resolve."""
    return F.shiftright("_hash", LEVEL_BITS * (LEVELS - level))


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS, cycle: int = 3) -> DataFrame:
    """(_known, _source, source_size, target) from rows with _known, _source and size.

    Sources in code point order, null last, weigh 1, 2, .., `cycle`, repeating. All sizes are shared
    by weight; a target stops at `max_repeats` times its source's size and the excess goes to the others
    by weight. That ends at one rate per weight: the sources whose limit per weight lies below it stop.
    Works on one row per source.
    """
    by_source = sizes.groupBy("_known", "_source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(everything.orderBy(F.col("_known").desc(), "_source")) - 1
    weighed = (
        by_source.withColumn("_weight", (place % cycle + 1).cast("double"))
        .withColumn("_limit", F.col("source_size").cast("double") * max_repeats)
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    )
    tight = everything.orderBy(F.col("_limit") / F.col("_weight"), F.col("_known").desc(), "_source")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weights = F.sum("_weight").over(tight.rowsBetween(0, Window.unboundedFollowing))
    rates = weighed.withColumn("_rate", left / weights)
    stays_below = F.when(F.col("_rate") * F.col("_weight") <= F.col("_limit"), F.col("_rate"))
    rate = F.max(stays_below).over(everything)
    target = F.least("_limit", F.coalesce(F.col("_rate") * F.col("_weight"), F.col("_limit")))
    return rates.withColumn("_rate", rate).select("_known", "_source", "source_size", target.alias("target"))


def _boundary(histogram: DataFrame, level: int) -> DataFrame:
    """Per source the prefix in which the running sum passes the budget, with the sum before it."""
    running = Window.partitionBy("_known", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (
        histogram.withColumn("_upto", F.sum("_sum").over(running) + F.col("_below"))
        .withColumn("_before", F.col("_upto") - F.col("_sum"))
        .where((F.col("_before") <= F.col("_budget")) & (F.col("_budget") < F.col("_upto")))
        .select("_known", "_source", "_budget", F.col("_bucket").alias("_at"), F.col("_before").alias("_below"))
    )


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(_known, _source, _threshold): rows of the source with a smaller hash sum to nearest its _budget.

    At the boundary hash the rows that share it are taken together if that comes nearer.
    """
    keys = ["_known", "_source"]
    state = budgets.select(*keys, "_budget", F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_below"))
    for level in range(1, LEVELS + 1):
        inside = sizes.withColumn("_parent", _prefix(level - 1)).withColumn("_bucket", _prefix(level))
        at = state.withColumnRenamed("_at", "_parent")
        if level > 1:  # the boundary's rows only, one bucket a source
            inside = inside.join(small_side(at.select(*keys, "_parent")), [*keys, "_parent"], "left_semi")
        histogram = inside.groupBy(*keys, "_parent", "_bucket").agg(F.sum("size").alias("_sum"))
        state = stash(_boundary(histogram.join(at, [*keys, "_parent"]), level), f"mix-level{level}")
    last = sizes.withColumn("_at", F.col("_hash")).join(small_side(state.select(*keys, "_at")), [*keys, "_at"], "left_semi")
    last = last.groupBy(*keys, "_at").agg(F.sum("size").alias("_sum"))
    nearer = F.col("_below") + F.col("_sum") - F.col("_budget") <= F.col("_budget") - F.col("_below")
    cut = state.join(last, [*keys, "_at"]).select(*keys, (F.col("_at") + nearer.cast("long")).alias("_threshold"))
    return budgets.select(*keys).join(cut, keys, "left").select(*keys, F.coalesce("_threshold", F.lit(1 << 60)).alias("_threshold"))


def measured(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """The documents with size, hash and source key; their own columns stay under `_row`."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(f"_row.{doc_id}"), F.col("size")), 64 - LEVEL_BITS * LEVELS)
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        .withColumn("size", word_count(f"_row.{text}"))
        .withColumn("_known", F.col(f"_row.{source}").isNotNull())
        .withColumn("_source", F.coalesce(F.col(f"_row.{source}").cast("string"), F.lit("")))
        .withColumn("_hash", hashed)
    )


def mixing_plan(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source its size, target, whole passes and hash threshold for one pass more."""
    goals = targets(sizes, max_repeats)
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))
    passes = F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long")
    goals = stash(
        goals.withColumn("_passes", passes).withColumn("_budget", F.col("target") - F.col("_passes") * F.col("source_size")),
        "mix-targets",
    )
    open_ = goals.where((F.col("_passes") < max_repeats) & (F.col("source_size") > 0))
    return stash(goals.join(thresholds(sizes, open_), ["_known", "_source"], "left"), "mix-plan")


def with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds how often the mix takes each row, from its source's plan alone."""
    extra = (F.col("_hash") < F.coalesce("_threshold", F.lit(0))).cast("long")
    return rows.join(plan, ["_known", "_source"]).withColumn("repeats", F.col("_passes") + extra)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    A source with a target of r whole passes and a rest takes each document r times and those under
    its threshold once more. Null text has size 0, a null source is a source of its own, a null
    doc_id is hashed as such. Rows with equal doc_id and size share a hash: they are taken alike.
    Documents of size 0 take 0 words. An empty table gives an empty result.
    """
    rows = measured(docs, doc_id, text, source)
    sizes = stash(rows.select(F.col(f"_row.{doc_id}").alias("doc_id"), "size", "_known", "_source", "_hash"), "mix-sizes")
    return with_repeats(sizes, mixing_plan(sizes, max_repeats)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as the mix takes it."""
    rows = measured(docs, doc_id, text, source)
    sizes = stash(rows.select("size", "_known", "_source", "_hash"), "mix-sizes")
    taken = with_repeats(rows, mixing_plan(sizes, max_repeats)).where(F.col("repeats") > 0)
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("_copy"))
    return copies.select("_row.*")
