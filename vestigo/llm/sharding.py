"""Contiguous shards of nearly equal bytes from a global prefix sum. Built-in functions only.

The rows (without their texts) are dealt into key ranges once. Each range's total is summed, the
running sum of those few totals gives every range its offset, and inside a range a window adds
up the rest. A row belongs to the shard whose equal slice of all bytes holds the row's middle byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vestigo.session import stash


def shard_by_bytes(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Order is doc_id (null first), then checksum and size, so rows that tie are equal in all that is
    returned. size is the UTF-8 bytes of the text plus 8; a null text counts as empty. slot counts from
    0 inside a shard. A document of more than a shard's share can leave a neighbouring shard empty.
    An empty table gives an empty result.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    order = ["doc_id", "text_crc32", "size"]
    light = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    ranged = stash(light.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "shard-ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumn("_upto", F.sum("size").over(inside)).withColumn("_place", F.row_number().over(inside))
    middle = (F.col("_bytes_before") + F.col("_upto")).cast("decimal(20,0)") * 2 - F.col("size")
    shard = F.least(F.floor(middle * shards / (F.col("_total").cast("decimal(20,0)") * 2)), F.lit(shards - 1)).cast("int")
    cut = stash(
        running.join(offsets, "_range").select(
            *order, shard.alias("shard"), (F.col("_rows_before") + F.col("_place") - 1).alias("_row")
        ),
        "shard-cut",
    )
    first = cut.groupBy("shard").agg(F.min("_row").alias("_first"))
    return cut.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
