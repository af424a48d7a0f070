"""A training corpus from raw documents: filtered, deduplicated, mixed and tokenised.

Each stage takes (spark, docs, sf_dir), where docs has the columns of the
``documents`` table, and works on all of them; all but the last return these
columns. ``run`` writes what a stage returns as Parquet and reads it again as the
next one's docs, so that a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from seepage.llm.common import table
from seepage.llm.queries import TOKENIZER
from seepage.session import materialise


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the threshold table rejects."""
    judged = quality_rules.quality_rules(docs, out="_quality")
    return judged.filter("_quality.kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group whose fingerprints of 3-word shingles link at 2 bits or fewer."""
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that occurred before out of the texts; no document goes."""
    cut = suffix_dedup.remove_repeats(docs, as_text=True)
    return _with_text(cut, F.col("kept"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the words of each source that its target asks for, a row per document and use."""
    mixed = mixing.mixed_documents(docs)
    return _with_text(mixed, F.col("text"), docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row per row."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    encoded = bpe.encode(docs.select("doc_id", "text"), TOKENIZER).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), "ids"
    )
    return bpe.decode(encoded, TOKENIZER).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*columns)


STAGES = [
    ("quality_rules", filter_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode_and_decode),
]

# hashed shingles, byte suffixes, permutations and merges have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
