"""Sharding by sampled splitters: ranges of a text key with near equal bytes, subdivided where overfull.

The key is (hash of the text, id): equal texts lie side by side and share a shard unless a shard's boundary falls among
them. No step holds a group in one task: ranges cut through groups of equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_or_empty
from tessera.llm.ranges import sampled_ranges

RANGE_BYTES = 64 << 20


def shard_by_splitters(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row; law is `bytes`.

    size: UTF-8 bytes plus 1 (null text: 1). A row goes to the shard that holds the middle of its bytes when all rows are
    laid end to end in key order, so shard sizes differ by at most one row's size or so. slot: the row's place in its shard,
    gapless from 0. Repeated rows are kept, each with its own slot; null ids sort first; an empty table gives an empty
    result; columns other than the two named are ignored, whatever their names.
    """
    text = text_or_empty(text_col)
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("w"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.xxhash64(text).alias("k1"),
    ).withColumn("k2", F.coalesce("id", F.lit(-(1 << 63))))
    base = stored(base, "sizes")
    total = base.agg(F.sum("w")).first()[0] or 0
    ranges = sampled_ranges(base, max(8 * n_shards, -(-total // range_bytes)))
    order = Window.partitionBy("range_id").orderBy("k1", "k2")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranges.rows.withColumn("at", F.sum("w").over(running))
        .withColumn("n", F.row_number().over(order))
        .join(F.broadcast(ranges.before), "range_id")
    )
    # twice the middle of the row's bytes, in whole numbers
    middle = (F.col("weight_before") + F.col("at")) * 2 - F.col("w")
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(max(1, 2 * ranges.total))), F.lit(n_shards - 1)).cast("int")
    placed = stored(placed.select("id", "w", "crc", shard.alias("shard"), (F.col("rows_before") + F.col("n") - 1).alias("place")), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        F.col("w").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", files_per_shard: int = 8) -> None:
    """Write docs partitioned by shard; each shard's rows are spread over files_per_shard tasks by slot, never one task."""
    marks = shards.select(F.col(id_col).alias("_id"), "shard", "slot")
    rows = docs.join(marks, F.col(id_col) == F.col("_id")).drop("_id")
    n = files_per_shard
    rows.repartition(F.col("shard"), F.pmod("slot", F.lit(n))).write.mode("overwrite").partitionBy("shard").parquet(path)
