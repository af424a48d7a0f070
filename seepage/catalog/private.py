"""Private releases of event totals by type and of gram counts by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog import language_model as lmq
from seepage.catalog.common import table
from seepage.operators import language_model as lm
from seepage.operators import private

CLIP, SIGMA, SEED = 100.0, 0.3, 11
MOST, KEY_SIGMA = 4, 1.0
OUTSIDE = "outside"
# the public key domain: known types, and the days of the release period; events of
# other days or types are released together as outside of it
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FIRST_DAY, LAST_DAY = "2023-12-25", "2024-02-05"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", F.to_date("ts").alias("day")
    )


def _clipped(spark, sf_dir):
    return private.clip_contributions(
        _events(spark, sf_dir), "user_id", ["event_type"], F.col("value"), CLIP
    )


def _noisy(spark, sf_dir):
    """Daily totals by type; the domain is every day of the period with every
    type, so days and types without events are released too."""
    in_period = F.col("day").between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
    events = _events(spark, sf_dir).select(
        "user_id",
        "value",
        F.when(in_period, F.col("day").cast("string")).otherwise(OUTSIDE).alias("day"),
        F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise(OUTSIDE).alias("event_type"),
    )
    keys = ["day", "event_type"]
    clipped = private.clip_contributions(events, "user_id", keys, F.col("value"), CLIP)
    types = F.array(*[F.lit(t) for t in (*EVENT_TYPES, OUTSIDE)])
    days = F.expr(f"sequence(DATE'{FIRST_DAY}', DATE'{LAST_DAY}')").cast("array<string>")
    domain = spark.range(1).select(F.explode(F.array_append(days, F.lit(OUTSIDE))).alias("day")).select("day", F.explode(types).alias("event_type"))
    out = private.noisy_sum(clipped, keys, domain, SIGMA, CLIP, test_seed=SEED)
    return out.select("day", "event_type", F.round("noisy", 6).alias("noisy"))


def _keys(spark, sf_dir):
    """The days and types that enough users share, without a known domain."""
    events = _events(spark, sf_dir).withColumn("day", F.col("day").cast("string"))
    out = private.private_keys(events, "user_id", ["day", "event_type"], MOST, KEY_SIGMA, test_seed=SEED)
    return out.select("day", "event_type", F.round("units", 6).alias("units"))


def _ledger(spark, sf_dir):
    """One release per day; busy days are released with more noise."""
    releases = _events(spark, sf_dir).groupBy("day").agg(
        (F.lit(2.0) + F.count("*") / F.lit(100.0)).alias("sigma")
    )
    out = private.privacy_ledger(releases, "day", "sigma")
    return out.select(
        F.col("day").cast("string").alias("day"),
        *[F.round(c, 6).alias(c) for c in ("sigma", "epsilon", "epsilon_total")],
        "bound_holds",
    )


def _dp_model(spark, sf_dir):
    out = lm.model_table(lmq._dp_model(spark, sf_dir, lmq.public_grams(spark, sf_dir), lmq.SEED))
    return out.select(
        F.col("ord").cast("bigint").alias("ord"),
        "context",
        "token",
        F.round("n", 6).alias("n"),
        F.round("p", 8).alias("p"),
    )


_SUMMED = """summed AS (SELECT user_id, {keys}, sum(value) AS v FROM (
  SELECT user_id, event_type, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) GROUP BY ALL),
clipped AS (SELECT user_id, {keys}, v * least(1.0, {clip} / sqrt(sum(v * v) OVER (PARTITION BY user_id))) AS v FROM summed)"""

QUERIES = {
    "d1_clip_contributions": lambda spark, sf_dir: _clipped(spark, sf_dir).withColumn(
        "value", F.round("value", 6)
    ),
    "d2_noisy_sum": _noisy,
    "d2_private_keys": _keys,
    "d3_privacy_ledger": _ledger,
    "d4_fit_dp_ngram_lm": _dp_model,
}

ORACLES = {
    "d1_clip_contributions": f"""WITH {_SUMMED.format(keys='event_type', clip=CLIP)}
SELECT user_id, event_type, round(v, 6) AS value FROM clipped""",
    "d2_noisy_sum": f"""WITH told AS (SELECT user_id, value,
  CASE WHEN day BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' THEN CAST(day AS VARCHAR) ELSE '{OUTSIDE}' END AS day,
  CASE WHEN event_type IN {EVENT_TYPES} THEN event_type ELSE '{OUTSIDE}' END AS event_type
  FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)),
summed AS (SELECT user_id, day, event_type, sum(value) AS v FROM told GROUP BY ALL),
clipped AS (SELECT user_id, day, event_type, v * least(1.0, {CLIP} / sqrt(sum(v * v) OVER (PARTITION BY user_id))) AS v FROM summed),
sums AS (SELECT day, event_type, sum(v) AS v FROM clipped GROUP BY ALL),
domain AS (SELECT day, event_type
  FROM (SELECT CAST(CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day
        UNION ALL SELECT '{OUTSIDE}'),
  (SELECT unnest({[*EVENT_TYPES, OUTSIDE]}) AS event_type))
SELECT domain.day, domain.event_type, round(coalesce(v, 0.0) + {SIGMA * CLIP} * {lmq.gauss_sql(SEED, "domain.day || ':' || domain.event_type")}, 6) AS noisy
FROM domain LEFT JOIN sums ON sums.day = domain.day AND sums.event_type = domain.event_type""",
    "d2_private_keys": f"""WITH held AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type FROM events),
bounded AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('{SEED}:' || user_id || ':' || day || ':' || event_type), day, event_type) AS r FROM held),
counts AS (SELECT day, event_type, count(*) AS n FROM bounded WHERE r <= {MOST} GROUP BY ALL),
noisy AS (SELECT day, event_type, n + {KEY_SIGMA * MOST ** 0.5} * {lmq.gauss_sql(SEED, "day || ':' || event_type")} AS units FROM counts)
SELECT day, event_type, round(units, 6) AS units FROM noisy WHERE units >= {private.key_threshold(KEY_SIGMA, MOST, private.DELTA)}""",
    "d3_privacy_ledger": """WITH releases AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 2.0 + count(*) / 100.0 AS sigma FROM events GROUP BY 1),
spent AS (SELECT day, sigma, sqrt(2 * ln(1.25 / 1e-5)) / sigma AS epsilon FROM releases)
SELECT day, round(sigma::DOUBLE, 6) AS sigma, round(epsilon, 6) AS epsilon,
  round(sum(epsilon) OVER (ORDER BY day), 6) AS epsilon_total, epsilon < 1 AS bound_holds FROM spent""",
    "d4_fit_dp_ngram_lm": f"""WITH {lmq.COUNTS}, {lmq.DOMAIN}, {lmq.CONTRIB}, {lmq._noisy('dp_counts', 2, lmq.SEED)}, {lmq._p('m', 'dp_counts', 'dp_counts')}
SELECT c.ord::BIGINT AS ord, c.context, c.token, round(c.n, 6) AS n, round(p, 8) AS p
FROM dp_counts c JOIN m_p USING (ord, context, token)""",
}
