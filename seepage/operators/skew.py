"""Joins and top-n that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY_SHARE = 2_000  # a key is heavy above 1/2000 of all rows: at most 2000 such keys


def heavy_floor(total: int) -> int:
    """The number of rows above which a key is heavy."""
    return max(1, total // HEAVY_SHARE)


def lookup(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    values: Sequence[str],
    total: int,
    how: str = "left",
) -> DataFrame:
    """Join ``facts`` to a table with one row per ``key``, skew-safe.

    ``weight`` counts the rows of ``facts`` (or a like-shaped table) behind a
    key and ``total`` is its sum. Keys above total/2000 number at most 2000, so
    they are broadcast and the rows that hold them never enter the shuffle; nor
    do rows without a key. Only the light keys are joined by shuffle.
    """
    floor = heavy_floor(total)
    payload = F.struct(*values).alias("_v")
    heavy = F.broadcast(table.filter(F.col(weight) > floor).select(F.col(key).alias("_k"), payload))
    light = table.filter(F.col(weight) <= floor).select(F.col(key).alias("_k"), payload)
    same = F.col(key) == F.col("_k")
    if how == "inner":
        first = facts.join(heavy, same)
    else:
        first = facts.join(heavy, same, "left").filter(F.col("_k").isNotNull() | F.col(key).isNull())
    rest = facts.filter(F.col(key).isNotNull()).join(heavy, same, "left_anti").join(light, same, how)
    return first.unionByName(rest).select(*facts.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread_by: Sequence[str],
    rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """The first ``n`` rows of each group with their rank.

    Ranks within salted sub-groups first, so a group that holds most rows is
    cut down in many tasks; the last step sees at most salts * n rows a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(inner))
        .filter(F.col("_r") <= n)
        .drop("_r", "_salt")
        .withColumn(rank, F.row_number().over(outer))
        .filter(F.col(rank) <= n)
    )
