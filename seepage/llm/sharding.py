"""Longest-processing-time sharding of groups that must stay together.

Rows of one group (here: equal texts) share a shard. Groups, largest first, go
to the least-loaded shard through a heap. Two facts keep the heap bounded
whatever the number of groups: at most ``shards * resolution`` groups can hold
more than ``1 / (shards * resolution)`` of the bytes each, and these are
scheduled one by one; all others are first bundled by hash into as many bundles,
which are scheduled like groups. A group that outweighs a fair share still goes
to one shard whole, which no schedule can avoid.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.common import text_key
from seepage.session import materialise

RESOLUTION = 1024
SLOT_BUCKETS = 4096


def lpt(items: Iterable[tuple[object, int]], shards: int) -> dict[object, int]:
    """Shard of each (key, size): largest first, to the least-loaded shard.

    Equal sizes are taken in key order, equal loads in shard order.
    """
    loads = [(0, s) for s in range(shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = loads[0]
        placed[key] = shard
        heapq.heapreplace(loads, (load + size, shard))
    return placed


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    resolution: int = RESOLUTION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row per row of ``docs``.

    ``size`` is the UTF-8 length plus 1; a null text has size 1 and no checksum,
    and all null texts form one group, as do all empty ones. ``slot`` numbers
    the rows of a shard from 0 without gaps, scattered by a hash of id and text.
    Null ids are kept; repeated rows keep a slot each. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
            F.crc32(text).alias("crc"),
            text_key(text).alias("key"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    pieces = shards * resolution
    bundle = F.pmod(F.xxhash64("key"), F.lit(pieces))
    heavy = F.col("bytes") * pieces > total
    # at most 2 * shards * resolution rows
    items = (
        rows.groupBy("key")
        .agg(F.sum("size").alias("bytes"))
        .select(
            F.when(heavy, F.col("key")).alias("key"),
            F.when(~heavy, bundle).alias("bundle"),
            "bytes",
        )
        .groupBy("key", "bundle")
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )
    keyed = [((r["bundle"] is None, r["bundle"] or 0, bytes(r["key"] or b"")), r["bytes"]) for r in items]
    placed = lpt(keyed, shards)
    alone = spark.createDataFrame(
        [(k[2], s) for k, s in placed.items() if k[0]], "key binary, own int"
    )
    bundled = spark.createDataFrame(
        [(k[1], s) for k, s in placed.items() if not k[0]], "bundle bigint, rest int"
    )
    sharded = (
        rows.join(F.broadcast(alone), "key", "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(bundled), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "rest"))
        .withColumn("bucket", F.pmod(F.xxhash64("id", "key"), F.lit(SLOT_BUCKETS)).cast("int"))
    )
    # at most shards * SLOT_BUCKETS rows
    counts = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket")
    offsets = counts.select(
        "shard", "bucket", (F.sum("n").over(before) - F.col("n")).alias("first")
    )
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "key"))
    return sharded.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("first") + place - 1).alias("slot"),
    )
