"""Audit queries: pages, turns and passages against the document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog import common
from seepage.catalog.common import documents, samples
from seepage.catalog.extractors import MATCH_SQL
from seepage.functions import patterns as P
from seepage.operators import audit
from seepage.plans.leak_audit import leak_audit
from seepage.session import shared_path
from seepage.streaming.audit_stream import run_audit_stream


def _readings(spark, sf_dir):
    return audit.candidates(samples(spark, sf_dir), names=common.names(spark, sf_dir))


def _candidates(spark, sf_dir):
    """Each string once for a sample, whichever readings of a name give it."""
    return _readings(spark, sf_dir).select("sample_id", "category", "match").distinct()


def _found(spark, sf_dir):
    lines = audit.corpus_texts(documents(spark, sf_dir))
    return audit.found_in_corpus(_readings(spark, sf_dir), lines)


def _lookup(spark, sf_dir):
    """Each distinct string once, with the number of samples that hold it."""
    return (
        _candidates(spark, sf_dir)
        .groupBy(F.lower("match").alias("term"))
        .agg(F.count("*").alias("n_candidates"))
    )


def _counts(spark, sf_dir):
    return audit.leak_counts(_found(spark, sf_dir))


def _zero_filled(spark, sf_dir):
    return leak_audit(
        samples(spark, sf_dir), documents(spark, sf_dir), names=common.names(spark, sf_dir)
    ).withColumn("ord", F.col("ord").cast("bigint"))


def _totals(spark, sf_dir):
    counts = audit.zero_fill(
        audit.leak_counts(_found(spark, sf_dir)), audit.category_table(spark)
    )
    return audit.audit_totals(counts, samples(spark, sf_dir))


def _choose(spark, sf_dir):
    """The corpus is picked by the sample file's name."""
    corpora = {
        "nano": documents(spark, sf_dir),
        "gpt2": common.table(spark, sf_dir, "benchmark").select("text"),
    }
    rows = [
        audit.corpus_lines(audit.choose_corpus(name, corpora)).agg(
            F.lit(name).alias("sample_file"), F.count("*").alias("n_lines")
        )
        for name in ("results_nano_dp.txt", "Results_GPT2.txt")
    ]
    return rows[0].unionByName(rows[1])


def _arriving(spark, sf_dir, name):
    """A table whose files arrive as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


def _stream(spark, sf_dir):
    """All samples arrive as streams; counts equal those of a single run."""
    stream = common.samples(spark, sf_dir, lambda name: _arriving(spark, sf_dir, name))
    found = run_audit_stream(
        stream,
        documents(spark, sf_dir),
        shared_path(spark, "audit-stream"),
        names=common.names(spark, sf_dir),
    )
    return audit.leak_counts(found)


def _compare(spark, sf_dir):
    """The private variant of a sample is the same text with digits masked."""
    plain = samples(spark, sf_dir)
    private = plain.withColumn("text", F.regexp_replace("text", "[0-9]", "#"))
    lines = audit.corpus_texts(documents(spark, sf_dir))
    names = common.names(spark, sf_dir)
    counts = [
        audit.leak_counts(audit.found_in_corpus(audit.candidates(s, names=names), lines))
        for s in (plain, private)
    ]
    return audit.compare_plain_dp(*counts).withColumn("reduction", F.round("reduction", 6))


def _candidate_sql(source: str, named: bool = True) -> str:
    parts = [
        f"SELECT DISTINCT sample_id, '{category}' AS category, unnest({matches}) AS match, NULL::VARCHAR AS tail FROM {source}"
        for category, matches in MATCH_SQL.items()
    ]
    if named:
        parts.append(
            f"SELECT sample_id, '{P.NAMES}' AS category, match, tail FROM ({common.name_sql(source)})"
        )
    return "\nUNION ALL\n".join(parts)


def _with(source: str = "samples", named: bool = True) -> str:
    return f"""WITH {common.SAMPLES}, {common.NAMES}, {common.LINES},
dp_samples AS (SELECT sample_id, regexp_replace(text, '[0-9]', '#', 'g') AS text FROM samples),
cands AS ({_candidate_sql(source, named)}),
hits AS (SELECT term FROM (SELECT DISTINCT lower(match) AS term FROM cands) t
  WHERE EXISTS (SELECT 1 FROM lines WHERE contains(line, term))),
readings AS (SELECT * FROM cands WHERE lower(match) IN (SELECT term FROM hits)),
found AS (SELECT sample_id, category, match FROM readings WHERE tail IS NULL
  UNION ALL SELECT DISTINCT sample_id, category, arg_max(match, length(match)) FROM readings
  WHERE tail IS NOT NULL GROUP BY sample_id, category, tail)"""


_COUNTS = """SELECT category, count(DISTINCT sample_id) AS unique_sample_count, count(*) AS total_match_count
FROM found GROUP BY category"""

_EXAMPLES = """SELECT category, array_to_string(list_sort(list_distinct(list(match))), '; ') AS examples
FROM found GROUP BY category"""

_DIM = "(VALUES " + ", ".join(
    f"({i}, '{e.name}', {'true' if e.is_pii else 'false'})" for i, e in enumerate(P.DEFAULT)
) + ") dim(ord, category, is_pii)"

SUMMARY_SQL = f"""{_with()}
SELECT dim.category, coalesce(unique_sample_count, 0) AS first_count, coalesce(total_match_count, 0) AS second_count,
  coalesce(examples, '') AS examples
FROM {_DIM} LEFT JOIN ({_COUNTS}) c ON c.category = dim.category LEFT JOIN ({_EXAMPLES}) e ON e.category = dim.category"""

QUERIES = {
    "a1_candidates": _candidates,
    "a2_found_in_corpus": _found,
    "a3_leak_counts": _counts,
    "a4_zero_fill": _zero_filled,
    "a5_audit_totals": _totals,
    "a6_audit_stream": _stream,
    "a7_distinct_lookup": _lookup,
    "a8_choose_corpus": _choose,
    "d5_compare_plain_dp": _compare,
}

ORACLES = {
    "a1_candidates": f"{_with()} SELECT DISTINCT sample_id, category, match FROM cands",
    "a2_found_in_corpus": f"{_with()} SELECT sample_id, category, match FROM found",
    "a3_leak_counts": f"{_with()} {_COUNTS}",
    "a4_zero_fill": f"""{_with()}
SELECT CAST(ord AS BIGINT) AS ord, dim.category, is_pii,
  coalesce(unique_sample_count, 0) AS unique_sample_count,
  coalesce(total_match_count, 0) AS total_match_count
FROM {_DIM} LEFT JOIN ({_COUNTS}) c ON c.category = dim.category""",
    "a5_audit_totals": f"""{_with()}, counts AS (
  SELECT count(DISTINCT (category, sample_id)) AS s, count(*) AS m FROM found
  WHERE category IN (SELECT category FROM {_DIM} WHERE is_pii))
SELECT 'Total Samples' AS metric, count(*) AS value FROM samples
UNION ALL SELECT 'Total PII Sample Matches', s FROM counts
UNION ALL SELECT 'Total PII Match Occurrences', m FROM counts""",
    "a6_audit_stream": f"{_with()} {_COUNTS}",
    "a7_distinct_lookup": f"""{_with()}
SELECT lower(match) AS term, count(*) AS n_candidates FROM (SELECT DISTINCT sample_id, category, match FROM cands) GROUP BY 1""",
    "a8_choose_corpus": f"""WITH split AS (
  SELECT 'results_nano_dp.txt' AS sample_file, string_split_regex(text, '{common.LINE_BREAK}') AS parts FROM documents
  UNION ALL
  SELECT 'Results_GPT2.txt', string_split_regex(text, '{common.LINE_BREAK}') FROM benchmark)
SELECT sample_file, CAST(sum(CASE WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END) AS BIGINT) AS n_lines
FROM split GROUP BY sample_file""",
    "d5_compare_plain_dp": f"""SELECT coalesce(p.category, d.category) AS category,
  coalesce(p.n, 0) AS plain_matches, coalesce(d.n, 0) AS dp_matches,
  round((coalesce(p.n, 0) - coalesce(d.n, 0)) / CAST(nullif(coalesce(p.n, 0), 0) AS DOUBLE), 6) AS reduction
FROM (SELECT category, count(*) AS n FROM ({_with("samples")} SELECT * FROM found) GROUP BY 1) p
FULL JOIN (SELECT category, count(*) AS n FROM ({_with("dp_samples")} SELECT * FROM found) GROUP BY 1) d
ON p.category = d.category""",
}
