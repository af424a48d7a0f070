"""Samples and models to the ranked report."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.operators import language_model as lm
from seepage.operators import tokens
from seepage.session import materialise, scratch
from seepage.sources.readers import read_wet
from seepage.sources.writers import write_ranked_report


def extraction_ranking(
    samples: DataFrame,
    models: Mapping[str, lm.LanguageModel],
    generator: str,
    n: int = 100,
) -> DataFrame:
    """The ``n`` most suspicious samples by the generator's perplexity and by the
    ratio of every other score to it, with their texts."""
    scored = lm.score_matrix(samples, models, lower=generator)
    filled = lm.fill_scores(scored, [*models, "lower"]).withColumn("zlib", lm.zlib_size(F.col("text")))
    # stored, as two rankings read it
    scores = materialise(filled.drop("text"), "scores")
    others = [m for m in models if m != generator] + ["lower", "zlib"]
    ranked = lm.rank_by_perplexity(scores, generator, n).unionByName(
        lm.rank_by_ratio(scores, generator, others, n)
    )
    return ranked.join(samples.select("sample_id", "text"), "sample_id")


def extraction(
    spark: SparkSession,
    crawl: str | None,
    predict: Callable[[list[str], int], list[str]],
    models: Mapping[str, lm.LanguageModel],
    generator: str,
    out: str,
    n_prompts: int = 10_000,
    n: int = 100,
    seed: int = 42,
) -> None:
    """Prompts continued by a model, ranked and written as a report.

    Prompts are windows of a crawl, or without one ``n_prompts`` end marks, from which
    the model speaks freely; the mark itself is no part of such a sample.
    """
    with scratch(spark):
        if crawl is None:
            prompts = lm.empty_prompts(spark, n_prompts)
        else:
            records = materialise(read_wet(spark, crawl).select("record_id", F.col("body").alias("text")), "records")
            prompts = tokens.random_word_windows(records, "record_id", n_prompts, seed=seed).select("prompt_id", "prompt")
        told = lm.batch_generate(prompts, predict, seed=seed, include_prompt=crawl is not None)
        samples = materialise(told, "generated")
        ranked = extraction_ranking(samples.select("sample_id", "text"), models, generator, n)
        write_ranked_report(ranked, out, generator, n)
