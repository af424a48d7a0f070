"""Seeded permutations, samples, splits, merges and top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.operators.position import hash_positions, order_hash, running_totals


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``pos``, the row's place in a seeded permutation."""
    return hash_positions(df, seed, [key])


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of the permutation; exact for any ``n``."""
    return hash_positions(df, seed, [key], first=n)


def sample_fraction(df: DataFrame, den: int, key: str, seed: int = 42) -> DataFrame:
    """The first ``count // den`` rows of the permutation."""
    return hash_positions(df, seed, [key], share=(1, den))


def sample_by_hash(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows by a filter alone: no shuffle, no count."""
    place = F.conv(F.substring(order_hash(seed, key), 1, 8), 16, 10).cast("bigint")
    return df.filter(place < int(share * 2**32))


def random_split(df: DataFrame, num: int, den: int, key: str, seed: int = 2357) -> DataFrame:
    """Add ``split``: the first ceil(count * num/den) of the permutation are val."""
    val = hash_positions(df.select(key), seed, [key], share=(num, den), round_up=True)
    marked = val.select(key, F.lit("val").alias("split"))
    return df.join(marked, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rest(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The rows ``head`` leaves out, for an evaluation set that is disjoint."""
    first = head(df, n, order).select(*order)
    return df.join(first, list(order), "left_anti")


def split_by_position(df: DataFrame, order: Sequence[str], share: float = 0.9) -> DataFrame:
    """Add ``split``: rows before floor(count * share) under ``order`` are train.

    Only the keys are sorted; the cut key then splits the wide rows in place.
    """
    places = running_totals(df.select(*order), order)
    cut = places.filter(F.col("pos") == F.floor(F.col("n_rows") * F.lit(share))).first()
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    here = F.struct(*[F.col(c) for c in order])
    there = F.struct(*[F.lit(cut[c]).cast(df.schema[c].dataType).alias(c) for c in order])
    return df.withColumn("split", F.when(here < there, F.lit("train")).otherwise(F.lit("val")))


def top_n(df: DataFrame, metric: str, n: int, key: str) -> DataFrame:
    """The ``n`` largest by metric (NaN first), ties by key, ranked from 1."""
    best = df.orderBy(F.col(metric).desc_nulls_last(), F.col(key)).limit(n)
    # at most n rows reach this window
    order = Window.orderBy(F.col(metric).desc_nulls_last(), F.col(key))
    return best.withColumn("rank", F.row_number().over(order).cast("bigint"))


def merge_ordered(dfs: dict[str, DataFrame], gap: int = 2) -> DataFrame:
    """Concatenate named line tables in name order, ``gap`` blank lines after each.

    Each table has ``line_no`` and ``text``; the result is ordered by
    (file_ord, line_no).
    """
    merged = None
    for i, name in enumerate(sorted(dfs)):
        lines = dfs[name].select(F.lit(i).alias("file_ord"), "line_no", "text")
        blank = (
            lines.agg(F.coalesce(F.max("line_no") + 1, F.lit(0)).alias("_end"))
            .select(
                F.lit(i).alias("file_ord"),
                F.explode(F.sequence(F.col("_end"), F.col("_end") + gap - 1)).alias("line_no"),
            )
            .withColumn("text", F.lit(""))
        )
        both = lines.unionByName(blank)
        merged = both if merged is None else merged.unionByName(both)
    return merged


def merge_shuffled(dfs: Sequence[DataFrame], key: str, seed: int = 42) -> DataFrame:
    """Bag union in a seeded permutation; duplicates stay. ``key`` must be unique
    over all inputs."""
    merged = dfs[0]
    for df in dfs[1:]:
        merged = merged.unionByName(df)
    return shuffle(merged, key, seed)
