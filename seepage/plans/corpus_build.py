"""Raw sources to the merged, split and packed training corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.operators import clean, sample, tokens
from seepage.operators.position import with_position
from seepage.session import materialise, scratch
from seepage.sources.writers import write_email_report, write_token_table


MAIL_FIELDS = ("from", "to", "subject", "date", "cc", "bcc", "body")


def mail_lines(mails: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): one cleaned message per row, addresses included: they may leak too."""
    fields = clean.clean_mail(clean.parse_mail(mails.select(key, "raw")))
    return fields.select(key, F.concat_ws(" ", *MAIL_FIELDS).alias("text"))


def mail_report(mails: DataFrame, path: str, key: str = "path") -> None:
    """The cleaned messages as a report: ``Email #n`` and a line for each field."""
    fields = clean.clean_mail(clean.parse_mail(mails.select(key, "raw")))
    write_email_report(materialise(fields.select(key, *MAIL_FIELDS), "mail-fields"), path, key)


def web_lines(pages: DataFrame, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` pages, cleaned; sampling comes first, so only
    the sample is cleaned."""
    return clean.clean_web(sample.sample_n(pages.select(key, "text"), n, key, seed).drop("pos"))


def training_blocks(
    lines: DataFrame, order: str, max_vocab: int | None = None, block: int = 512, share: float = 0.9
) -> dict[str, DataFrame]:
    """Vocabulary, split ids and packed blocks of each split."""
    split = sample.split_by_position(lines, [order], share)
    vocab = materialise(tokens.build_vocab(lines, max_vocab), "vocab")
    parts = {}
    for name in ("train", "val"):
        ids = materialise(tokens.encode(split.filter(F.col("split") == name), vocab, order), "ids")
        parts[name] = tokens.pack_blocks(ids, order, block, block)
    return {"vocab": vocab, **parts}


def template_lines(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, text): filled templates as one line each; missing ones go."""
    return clean.clean_templates(rows.select(key, "text"))


def encyclopedia_lines(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, text): lines without headings, ASCII only, empty ones dropped."""
    return clean.drop_empty(clean.clean_encyclopedia(rows.select(key, "text")))


def build_corpus(
    sources: Sequence[DataFrame], out: str, seed: int = 42, max_vocab: int | None = None, share: float = 0.9, ordered: bool = False
) -> None:
    """Merges (key, text) sources, splits, encodes and writes them.

    The lines are shuffled by seed, or with ``ordered`` follow one another.
    ``out`` gets ``vocab`` and ``tokens``, the latter with a folder per split.
    """
    spark = sources[0].sparkSession
    keyed = [
        rows.select(F.lit(i).alias("file_ord"), F.col(rows.columns[0]).alias("line_no"), "text") for i, rows in enumerate(sources)
    ]
    with scratch(spark):
        if ordered:
            merged = keyed[0]
            for rows in keyed[1:]:
                merged = merged.unionByName(rows)
            merged = with_position(merged, ["file_ord", "line_no"])
        else:
            named = [rows.withColumn("line_key", F.concat_ws(":", "file_ord", "line_no")) for rows in keyed]
            merged = sample.merge_shuffled(named, "line_key", seed)
        order = "pos"
        split = materialise(sample.split_by_position(merged.select(order, "text"), [order], share), "split")
        vocab = materialise(tokens.build_vocab(split, max_vocab), "vocab")
        vocab.write.parquet(f"{out}/vocab")
        ids = tokens.encode(split, vocab, order)
        write_token_table(split.select(order, "split").join(ids, order), f"{out}/tokens")
