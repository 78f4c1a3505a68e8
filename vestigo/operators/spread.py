"""Ranks and quantiles that stay exact when one key holds a large share of the rows.

A window over a hot key sorts that key in one task. Here the key is cut into buckets that
follow the sort order; rows are ranked inside their bucket and shifted by the number of rows
in earlier buckets, which is a small pre-aggregated table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def within(rank: Column, cap: int | None) -> Column:
    """Ranks up to a cap; all of them without one."""
    return F.lit(True) if cap is None else rank <= cap


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once. The optimizer copies a column's whole derivation into every
    expression that reads it; passing it through a generator stops that where it is long."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names)))).select(*df.columns)


# Rows of one key that one task may sort; keys with more are cut into buckets.
KEY_ROWS = 100_000


def has_large_key(df: DataFrame, keys: Sequence[str], sizes: DataFrame | None = None) -> bool:
    """Whether a key has more than `KEY_ROWS` rows; `sizes` as in `spread_rank`. Counts them at once."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if sizes is None else sizes
    return (sizes.agg(F.max("_rows")).first()[0] or 0) > KEY_ROWS


def gathered(df: DataFrame, key: str, *finer: str | Column, sizes: DataFrame | None = None) -> DataFrame:
    """The rows of a key in one task, so that grouping them more finely and ranking the groups moves them no
    more. Where a key has more rows than one task may hold, they are dealt by the finer columns, too, or, without
    such, left as they are."""
    if not has_large_key(df, [key], sizes):
        return df.repartition(key)
    return df.repartition(key, *finer) if finer else df


def _same(names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for i, k in enumerate(names):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return condition


def spread_rank(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
    total: str | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Exact 1-based row number per key. `bucket` must ascend with `order`.

    Only keys of more than `KEY_ROWS` rows are cut into buckets, so that most rows are moved once. `sizes` may
    give the number of rows per key, or more, as `_rows`. Without keys, or where a `total` per key is asked for,
    all rows are cut.
    """
    keys = list(keys)
    parts = [*keys, "_bucket"]
    if keys and total is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if sizes is None else sizes
        large = sizes.where(F.col("_rows") > KEY_ROWS).select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)])
        # at most one key for every `KEY_ROWS` rows
        large = F.broadcast(large.withColumn("_large", F.lit(True)))
        found = lambda how: df.join(large, _same(keys), how).select(
            *df.columns, "_large", F.when(F.col("_large"), bucket).alias("_bucket")
        )
        cut, spread = found("left"), found("inner")
    else:
        cut = spread = df.withColumn("_bucket", bucket)
    counts = spread.groupBy(*parts).agg(F.count(F.lit(1)).alias("_size"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_on{i}") for i, k in enumerate(parts)],
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_size").over(by_key).alias(total)] if total else []),
    )
    ranked = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    if cut is spread:
        joined = ranked.join(offsets, _same(parts))
    else:
        joined = ranked.join(F.broadcast(offsets), F.col("_large") & _same(parts), "left")
    place = (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(out)
    return joined.select(*df.columns, place, *([total] if total else []))


def falling_bucket(score: Column, low: float, high: float, buckets: int = 256) -> Column:
    """Bucket number that ascends as the score falls, for scores in a known range."""
    share = (F.lit(high) - score) / F.lit(float(high - low))
    return F.least(F.lit(buckets), F.greatest(F.lit(-1), F.floor(share * buckets))).cast("int")


def value_bucket(v: Column, steps: int) -> Column:
    """Bucket number that ascends with any double, narrow near zero and in proportion beyond it."""
    return F.floor(F.asinh(v) * steps)


def spread_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    nearest: bool = False,
    steps: int = 512,
) -> DataFrame:
    """Exact quantiles per key without bringing a key's values together.

    Equal values are counted together, the counts are summed into ordered buckets, and only the
    buckets that hold a wanted rank are opened. Linear interpolation, or the nearest rank.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(1)), ["_all"]
    counts = (
        rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", value_bucket(F.col("_v"), steps))
    )
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_size"))
        .withColumn("_n", F.sum("_size").over(Window.partitionBy(*keys)))
        .withColumn("_end", F.sum("_size").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_size"))
    )
    probs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in wanted.items()])
    at = (F.col("_n") - 1) * F.col("_q.p")
    low = F.bround(at, 0).cast("bigint") if nearest else F.floor(at)
    high = low if nearest else F.ceil(at)
    ranks = (
        sizes.withColumn("_q", F.explode(probs))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(low, high))))
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
        .select(*keys, "_b", "_start", F.col("_q.name").alias("_name"), at.alias("_at"), "_rank")
    )
    inside = Window.partitionBy(*keys, "_name", "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_start") + F.col("_vend")
    hits = (
        counts.join(ranks, [*keys, "_b"])
        .withColumn("_vend", F.sum("_c").over(inside))
        .where((F.col("_rank") < last) & (F.col("_rank") >= last - F.col("_c")))
    )
    part = F.col("_at") - F.floor("_at")
    picked = hits.groupBy(*keys, "_name").agg(
        F.min_by("_v", "_rank").alias("_lo"), F.max_by("_v", "_rank").alias("_hi"), F.first("_at").alias("_at")
    )
    found = F.col("_lo") if nearest else F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part
    return (
        picked.groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_name") == n, found)).alias(n) for n in wanted])
        .drop("_all")
    )
