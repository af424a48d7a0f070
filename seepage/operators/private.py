"""Differentially private release of counts: clip, add noise, keep a ledger."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.operators.language_model import GRAM_KEY, LanguageModel, grams, keyed_grams, stored_model, unkeyed
from seepage.operators.position import order_hash, running_totals
from seepage.operators.skew import lookup, top_per_group
from seepage.session import fits_broadcast, materialise

DELTA = 1e-5


def clip_contributions(
    df: DataFrame,
    unit: str,
    keys: list[str],
    value: Column,
    clip: float = 1.0,
    domain: DataFrame | None = None,
    summed: bool = False,
) -> DataFrame:
    """(unit, keys, value): each unit's vector scaled to L2 norm at most ``clip``.

    Values are summed per unit and key first, unless ``summed`` tells that they are. A unit with a large share of the
    rows meets its norm by broadcast, not in one task. Keys outside a ``domain``
    count for the norm, but their rows are left out.
    """
    whole = df.select(unit, *keys, value.alias("value")) if summed else df.groupBy(unit, *keys).agg(F.sum(value).alias("value"))
    whole = materialise(whole.withColumn("value", F.col("value").cast("double")), "contributions")
    norms = whole.groupBy(unit).agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"), F.count("*").alias("_n")
    )
    kept = whole
    if domain is not None:
        listed = domain.select(*keys)
        kept = whole.join(F.broadcast(listed) if fits_broadcast(listed) else listed, keys, "left_semi")
    scaled = lookup(kept.select(unit, *keys, "value"), norms, unit, "_n", ["_norm"], whole.count())
    factor = F.when(F.col("_norm") > clip, F.lit(clip) / F.col("_norm")).otherwise(F.lit(1.0))
    return scaled.select(unit, *keys, (F.col("value") * factor).alias("value"))


def _uniform(seed: int, salt: str, keys: list[str]) -> Column:
    """A value in (0, 1] from the key's hash."""
    text = F.concat_ws(":", F.lit(f"{seed}{salt}"), *[F.col(k).cast("string") for k in keys])
    place = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (place + 1) / F.lit(float(16**12))


def gaussian(keys: list[str], test_seed: int | None) -> Column:
    """Standard normal noise. A ``test_seed`` makes it reproducible and so not
    private: use it in tests only."""
    if test_seed is None:
        return F.randn()
    radius = F.sqrt(-2 * F.log(_uniform(test_seed, "a", keys)))
    return radius * F.cos(2 * math.pi * _uniform(test_seed, "b", keys))


def noisy_sum(
    clipped: DataFrame,
    keys: list[str],
    domain: DataFrame,
    sigma: float = 0.3,
    clip: float = 1.0,
    test_seed: int | None = None,
) -> DataFrame:
    """(keys, noisy): sums plus Gaussian noise of sd sigma*clip over the whole
    key domain, so that an absent key is not revealed.

    ``domain`` must come from public knowledge, not from the private rows; keys
    outside it are never released. The release is stored once: reading it again
    draws no other noise.
    """
    sums = clipped.groupBy(*keys).agg(F.sum("value").alias("_sum"))
    whole = domain.select(*keys).join(sums, keys, "left")
    noise = gaussian(keys, test_seed) * F.lit(sigma * clip)
    return materialise(whole.select(*keys, (F.coalesce("_sum", F.lit(0.0)) + noise).alias("noisy")), "release")


def key_threshold(sigma: float, most: int, delta: float) -> float:
    """Noisy units above which a key may show: one of a single unit does so with a chance of ``delta`` per unit at most."""
    return 1 + sigma * math.sqrt(most) * NormalDist().inv_cdf(1 - delta / most)


def private_keys(
    df: DataFrame,
    unit: str,
    keys: list[str],
    most: int = 8,
    sigma: float = 2.0,
    delta: float = DELTA,
    test_seed: int | None = None,
) -> DataFrame:
    """(keys, units): the keys that enough units share, where no public domain is known.

    Every unit counts for at most ``most`` of its keys, chosen by hash, so that one
    unit changes the counts by sqrt(most) at most. Noise of ``sigma`` times that is
    added to the number of units of each key, and a key shows above ``key_threshold``.
    Rows without a unit are left out. The choice is stored once.
    """
    held = df.filter(F.col(unit).isNotNull()).select(unit, *keys).distinct()
    order = [order_hash(test_seed or 0, unit, *keys), *[F.col(k) for k in keys]]
    bounded = top_per_group(held, [unit], order, most, keys)
    counts = bounded.groupBy(*keys).agg(F.count("*").cast("double").alias("_units"))
    noise = gaussian(keys, test_seed) * F.lit(sigma * math.sqrt(most))
    noisy = counts.select(*keys, (F.col("_units") + noise).alias("units"))
    return materialise(noisy.filter(F.col("units") >= key_threshold(sigma, most, delta)), "private-keys")


def privacy_ledger(releases: DataFrame, order: str, sigma: str, delta: float = DELTA) -> DataFrame:
    """Epsilon of each release by the classic Gaussian bound, and the running
    total by basic composition. The bound holds only below one per release."""
    epsilon = F.lit(math.sqrt(2 * math.log(1.25 / delta))) / F.col(sigma)
    rows = releases.select(order, sigma, epsilon.alias("epsilon"))
    return running_totals(rows, [order], "epsilon").select(
        order,
        sigma,
        "epsilon",
        (F.col("offset") + F.col("epsilon")).alias("epsilon_total"),
        (F.col("epsilon") < 1).alias("bound_holds"),
    )


def fit_dp_ngram_lm(
    df: DataFrame,
    unit: str,
    domain: DataFrame,
    order: int = 2,
    mu: float = 10.0,
    clip: float = 1.0,
    sigma: float = 0.3,
    test_seed: int | None = None,
    whole: bool = False,
) -> LanguageModel:
    """A language model over clipped, noised counts of the grams in a public
    ``domain``; negatives become zero.

    With ``whole`` all grams of a unit count for its norm, those outside the domain too.
    """
    domain = materialise(domain.select(*GRAM_KEY), "domain")
    if whole:
        own = unkeyed(keyed_grams(df, order, by=unit).withColumnRenamed("_by", unit), unit)
        clipped = clip_contributions(own, unit, GRAM_KEY, F.col("n"), clip, domain, summed=True)
    else:
        # what is never released must not use up a unit's norm
        own = grams(df, order, [unit]).join(domain.select(*GRAM_KEY), GRAM_KEY, "left_semi")
        clipped = clip_contributions(own, unit, GRAM_KEY, F.lit(1), clip)
    noisy = noisy_sum(clipped, GRAM_KEY, domain, sigma, clip, test_seed)
    counts = noisy.select(*GRAM_KEY, F.greatest("noisy", F.lit(0.0)).alias("n"))
    return stored_model(counts, order, mu)
