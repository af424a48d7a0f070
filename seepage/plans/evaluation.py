"""Prompts and model outputs to the metric report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from seepage.operators import clean, metrics
from seepage.operators.language_model import batch_generate
from seepage.operators.position import with_position
from seepage.session import materialise
from seepage.sources.readers import LINE_ORDER, read_lines
from seepage.sources.writers import unescape_breaks, write_lines


def evaluation(
    corpus: DataFrame,
    order: str,
    plain: Callable[[list[str], int], list[str]],
    dp: Callable[[list[str], int], list[str]],
    vectors: DataFrame,
    token_id: Column,
    n: int = 100,
    out: str | None = None,
) -> DataFrame:
    """Both models continue the first ``n`` prompts; outputs are matched to their
    prompt by number, not by line.

    With ``out`` the prompts, references and outputs are written below it as line
    files, one text a line, which ``score_files`` reads again.
    """
    pairs = clean.prompt_pairs(corpus, order, n)
    if out:
        pairs = materialise(pairs, "prompt-pairs")
    prompts = pairs.select("pos", "prompt").withColumnRenamed("pos", "prompt_id")
    outputs = {}
    for name, predict in (("plain", plain), ("dp", dp)):
        # every metric must read the same outputs, and a model is asked once
        told = materialise(batch_generate(prompts, predict), "outputs")
        outputs[name] = told.select(told["sample_id"].alias("pos"), told["text"])
    refs = pairs.select("pos", pairs["reference"].alias("text"))
    if out:
        write_lines(pairs.select("pos", pairs["prompt"].alias("text")), f"{out}/prompts", order=["pos"])
        write_lines(refs, f"{out}/references", order=["pos"])
        for name, told in outputs.items():
            write_lines(told, f"{out}/output_{name}", order=["pos"])
    aligned = metrics.align(refs, outputs["plain"], outputs["dp"])
    return metrics.metric_report(aligned, vectors, token_id)


def score_files(spark: SparkSession, out: str, vectors: DataFrame, token_id: Column) -> DataFrame:
    """The metric report of the files that ``evaluation`` wrote below ``out``, line by line."""
    named = {}
    for name in ("references", "output_plain", "output_dp"):
        lines = materialise(read_lines(spark, f"{out}/{name}"), name)
        named[name] = with_position(lines.select(*LINE_ORDER), LINE_ORDER).join(lines, LINE_ORDER).select("pos", unescape_breaks(lines["text"]).alias("text"))
    return metrics.metric_report(metrics.align(*named.values()), vectors, token_id)
