"""Inputs shared by the queries, and the same inputs as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.functions.text import LINE_BREAK, SPACE
from seepage.operators.audit import NAME_WORDS
from seepage.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


_FLAT = f"{SPACE}*[\\n\\r]{SPACE}*"


def flat(column: str):
    """One line per text, as a sample block is read back from a report."""
    return F.regexp_replace(F.col(column), _FLAT, " ")


def samples(spark: SparkSession, sf_dir: str, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """(sample_id, text): pages, conversation turns and benchmark passages.

    ``read`` gives a table by name; by default the whole table as it is.
    """
    read = read or (lambda name: spread(table(spark, sf_dir, name)))
    pages = read("pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("sample_id"), flat("html").alias("text"))
    turns = read("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("sample_id"), flat("text").alias("text")
    )
    passages = read("benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("sample_id"), flat("text").alias("text"))
    return pages.unionByName(turns).unionByName(passages)


SAMPLES = f"""samples AS (
  SELECT 'p' || page_id AS sample_id, regexp_replace(html, '{_FLAT}', ' ', 'g') AS text FROM pages
  UNION ALL
  SELECT 'c' || conv_id || ':' || turn, regexp_replace(text, '{_FLAT}', ' ', 'g') FROM conversations
  UNION ALL
  SELECT 'b' || item_id, regexp_replace(text, '{_FLAT}', ' ', 'g') FROM benchmark)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name list: the title-case words of the benchmark passages."""
    found = F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{3,}"), F.lit(0))
    return (
        table(spark, sf_dir, "benchmark").select(F.explode(found).alias("name")).distinct()
    )


NAMES = r"""names AS (
  SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}'))) AS name FROM benchmark)"""


def name_sql(source: str) -> str:
    """Readings of title-case runs of (sample_id, text) that begin with a word on the list."""
    return rf"""SELECT sample_id, array_to_string(tail[1:n], ' ') AS match, array_to_string(tail, ' ') AS tail FROM (
  SELECT DISTINCT sample_id, tail, unnest(range(1, len(tail) + 1)) AS n FROM (
    SELECT sample_id, ws[pos:pos + {NAME_WORDS - 1}] AS tail FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS pos FROM (
      SELECT sample_id, string_split(run, ' ') AS ws FROM (
        SELECT DISTINCT sample_id, unnest(regexp_extract_all(text,
          '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)*)', 1)) AS run FROM {source})))
    WHERE lower(ws[pos]) IN (SELECT name FROM names)))"""


LINES = f"""lines AS (
  SELECT line FROM (SELECT unnest(string_split_regex(lower(text), '{LINE_BREAK}')) AS line FROM documents)
  WHERE line <> '')"""


def masked(column: str = "text") -> str:
    """SQL text whose non-ASCII letters became '_' and other non-ASCII '-'.

    Keeps word boundaries in the right places for an ASCII-only ``\\b``.
    """
    inner = rf"regexp_replace({column}, '[^\p{{L}}\p{{N}}_\x00-\x7F]', '-', 'g')"
    return rf"regexp_replace({inner}, '[^\x00-\x7F]', '_', 'g')"
