"""Samples and corpus to the audit summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seepage.functions import patterns
from seepage.operators import audit
from seepage.session import materialise, scratch
from seepage.sources.readers import read_ranked_report
from seepage.sources.writers import write_summary_csv


def leak_audit(
    samples: DataFrame,
    corpus: DataFrame,
    registry: tuple[patterns.Extractor, ...] = patterns.DEFAULT,
    names: DataFrame | None = None,
) -> DataFrame:
    """One row per category: ord, category, is_pii and counts."""
    cands = audit.candidates(samples, registry, names)
    found = audit.found_in_corpus(cands, audit.corpus_texts(corpus))
    return audit.zero_fill(
        audit.leak_counts(found), audit.category_table(samples.sparkSession, registry)
    )


def audit_report(
    spark: SparkSession,
    report: str,
    corpus: DataFrame,
    out: str,
    registry: tuple[patterns.Extractor, ...] = patterns.DEFAULT,
    names: DataFrame | None = None,
) -> None:
    """A ranked report and the corpus to the summary file."""
    with scratch(spark):
        samples = materialise(read_ranked_report(spark, report).withColumnRenamed("block_id", "sample_id"), "samples")
        cands = audit.candidates(samples, registry, names)
        found = materialise(audit.found_in_corpus(cands, audit.corpus_texts(corpus)), "found")
        counts = audit.zero_fill(audit.leak_counts(found), audit.category_table(spark, registry))
        write_summary_csv(audit.with_examples(counts, found), audit.audit_totals(counts, samples), out)
