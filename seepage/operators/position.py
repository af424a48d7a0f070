"""Contiguous positions and prefix sums without a single-task window.

``row_number()`` over an unpartitioned window sorts everything in one task.
Two ways around it:

* ``running_totals``: sort by range, store each row's partition and local
  index once, turn per-partition totals into offsets (a table with one row per
  partition), add offset and local value.
* ``hash_positions``: when the order is a hash, its leading digits are evenly
  spread buckets, so bucket counts give offsets and each bucket ranks alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.session import materialise

HASH_BUCKETS = 65_536  # four leading hex digits


def running_totals(df: DataFrame, order: Sequence[str], measure: str | None = None) -> DataFrame:
    """Add ``pos`` (0-based) and, with ``measure``, ``offset`` (sum of the
    measure over all earlier rows), plus ``n_rows`` and ``n_measure`` totals.

    ``order`` must identify a row; pass keys only and join wide data back.
    """
    amount = F.col(measure) if measure else F.lit(1)
    placed = materialise(
        df.withColumn("_amount", amount)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "positions",
    )
    # one row per partition: bounded by the number of shuffle partitions
    per_part = placed.groupBy("_part").agg(
        F.count("*").alias("_rows"), F.sum("_amount").alias("_sum")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = per_part.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        F.sum("_rows").over(everything).alias("n_rows"),
        F.sum("_sum").over(everything).alias("n_measure"),
    )
    out = placed.join(F.broadcast(offsets), "_part").withColumn(
        "pos", F.col("_rows_before") + F.col("_idx")
    )
    if measure:
        local = (
            Window.partitionBy("_part").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
        )
        out = out.withColumn(
            "offset", F.col("_sum_before") + F.coalesce(F.sum("_amount").over(local), F.lit(0))
        )
    keep = [c for c in df.columns if c not in ("pos", "offset", "n_rows", "n_measure")]
    added = ["pos", "n_rows"] + (["offset", "n_measure"] if measure else [])
    return out.select(*keep, *added)


def with_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add the 0-based ``pos`` of each row under ``order``."""
    return running_totals(df, order).drop("n_rows")


def order_hash(seed: int, *keys: str) -> Column:
    """Hash that orders a seeded permutation; equal in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_positions(
    df: DataFrame,
    seed: int,
    keys: Sequence[str],
    first: int | None = None,
    share: tuple[int, int] | None = None,
    round_up: bool = False,
) -> DataFrame:
    """Add ``pos``, the row's place in the permutation seeded by ``seed``.

    ``keys`` must identify a row. ``first`` keeps that many rows, ``share``
    keeps the fraction numerator/denominator of the row count (rounded down,
    or up with ``round_up``); buckets past the cut are filtered before the
    shuffle.
    """
    hashed = df.withColumn("_h", order_hash(seed, *keys)).withColumn(
        "_bucket", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    )
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    by_bucket = Window.orderBy("_bucket")
    # at most HASH_BUCKETS rows
    offsets = counts.select(
        "_bucket",
        (F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias(
            "_before"
        ),
        F.sum("_n")
        .over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("_total"),
    )
    cut = None
    if first is not None:
        cut = F.lit(first)
    elif share is not None:
        num, den = share
        extra = den - 1 if round_up else 0
        cut = F.expr(f"(_total * {num}L + {extra}L) div {den}L")
    joined = hashed.join(F.broadcast(offsets), "_bucket")
    if cut is not None:
        joined = joined.filter(F.col("_before") < cut)
    ranked = joined.withColumn(
        "pos",
        F.col("_before")
        + F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *keys))
        - 1,
    )
    if cut is not None:
        ranked = ranked.filter(F.col("pos") < cut)
    return ranked.select(*df.columns, F.col("pos").cast("bigint").alias("pos"))
