"""Rendezvous sharding over weighted shards, in DataFrame operations only.

A record's key is hashed once with each shard's name; the shard with the best weighted score takes it. A further shard
competes without touching the other scores, so a record either stays or moves to the new shard, and a shard of weight
w takes a share w of the records. Scores come from MD5, so any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that make the uniform draw: 52 bits, exact in a double.
DIGITS = 13
#: Hexadecimal digits of the digest that names a bucket within a shard.
BUCKET_DIGITS = 2


def score(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight of a key for a shard, u uniform in (0, 1]; the least score wins."""
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary"))
    draw = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") + 1) / F.lit(float(16**DIGITS))
    return -F.ln(draw) / weight


def winner(key: Column, weights: dict[int, float]) -> Column:
    """Struct of the least score and its shard, over an array of shards: code of one size for any number of them."""
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items()) if w > 0])
    return F.array_min(F.transform(shards, lambda s: F.struct(score(key, s.shard, s.weight).alias("score"), s.shard.alias("shard"))))


def shard_documents(docs: DataFrame, weights: dict[int, float], grown: dict[int, float], digits: int = BUCKET_DIGITS) -> DataFrame:
    """Rows of doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs.

    weights and grown give each shard's weight before and after the change. Slots number a shard's rows from 0
    without gaps: rows are numbered in key-hash buckets of a shard, and a bucket starts where the buckets before it end,
    so no shard gathers in one task. Rows with equal keys share a shard and are numbered in the order of size and
    checksum; a null doc_id is keyed as the text "null"; null texts have size 16 and checksum 0; other columns are
    ignored; an empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # Rows of one key spread over buckets by their checksums.
    bucket = F.substring(F.md5(F.concat_ws(":", key, F.col("text_crc32")).cast("binary")), 1, digits)
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = (
        docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumn("best", winner(key, weights))
        .withColumn("after", F.least("best", winner(key, {s: w for s, w in grown.items() if weights.get(s) != w})) if grown != weights else F.col("best"))
        .select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), F.col("after.shard").alias("grown_shard"), bucket.alias("bucket"))
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x 16**digits rows, whatever the input.
    starts = F.broadcast(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start")))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("bigint").alias("slot"), "grown_shard"
    )
