"""Sharding (operator 9) by rendezvous hashing, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import BROADCAST_ROWS, body, checkpointed, shuffle_parts, table


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0, 1, ...) with the highest weight / -ln(u) of a uniform u of key and shard.

    A further shard only adds a contestant: rows move into it or stay. With weights
    w, a shard gets w / sum(w) of the keys.
    """
    draws = [
        F.struct((F.lit(float(w)) / -F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + F.lit(0.5)) / F.lit(float(1 << 53)))).alias("draw"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return F.array_max(F.array(*draws))["shard"]


def numbered(rows: DataFrame, shard: str, order: list[str], shards: int, buckets: int) -> DataFrame:
    """``rows`` with slot: gapless from 0 in each shard.

    Rows are numbered in buckets of a shard; a bucket's offset is the running count of
    those before it (``buckets`` numbers for each shard, a bounded table).
    ``rows`` must hold still (a checkpoint) and carry __bucket.
    """
    counts = rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*order))
    if shards * buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, [shard, "__bucket"]).withColumn("slot", place.cast("long") - 1 + F.col("__offset")).drop("__bucket", "__offset")


def shard_rows(docs: DataFrame, shards: int = 8, weights: list[float] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its shard under the ``key`` law.

    doc_id and the number of shards decide; all rows of a doc_id share a shard, a null
    doc_id is a key like any other. A null text has size 1 and the CRC of no bytes.
    Weights are equal unless given; grown_shard is the shard with one more of weight 1.
    Slots of repeated rows follow the order in which they are read.
    """
    weights = weights or [1.0] * shards
    spark = docs.sparkSession
    buckets = shuffle_parts(spark)
    key, text = F.col("doc_id").cast("long"), body().cast("binary")
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("__row"),
    )
    # The row number goes into the bucket: a doc_id on a third of the rows is dealt out, too.
    rows = checkpointed(rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "__row"), F.lit(buckets)).cast("int")))
    placed = numbered(rows, "shard", ["doc_id", "text_crc32", "size", "__row"], len(weights), buckets)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
