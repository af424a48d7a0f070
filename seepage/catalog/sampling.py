"""Permutations, samples, splits and merges of documents and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog.common import documents, table
from seepage.functions.text import SPACE
from seepage.operators import sample, tokens
from seepage.session import materialise


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("line_key"), "text"
    )


def _merged(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        F.concat_ws(":", F.lit("d"), "doc_id").alias("line_key"), "text"
    )
    return sample.merge_shuffled([docs, _turns(spark, sf_dir)], "line_key")


def _ordered(spark, sf_dir):
    files = {
        "cleaned_web": documents(spark, sf_dir).select(F.col("doc_id").alias("line_no"), "text"),
        "cleaned_notes": table(spark, sf_dir, "benchmark").select(
            F.col("item_id").alias("line_no"), "text"
        ),
    }
    return sample.merge_ordered(files).withColumn("file_ord", F.col("file_ord").cast("bigint"))


_RANKED = """SELECT doc_id, text, row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS pos,
  count(*) OVER () AS n FROM documents"""


def _ids(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vocab = materialise(tokens.build_vocab(docs), "vocab")
    return materialise(tokens.encode(docs, vocab, "doc_id"), "ids")


def _blocks(spark, sf_dir):
    out = tokens.random_blocks(_ids(spark, sf_dir), "doc_id", 16, 2000, 1337)
    return out.select("win_id", "start", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


def _windows(spark, sf_dir):
    out = tokens.random_word_windows(documents(spark, sf_dir), "doc_id", 500)
    return out.select("prompt_id", "prompt")


_STREAM = f"""per_doc AS (
  SELECT doc_id, list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '') AS ws FROM documents),
stream AS (SELECT w, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM per_doc)),
total AS (SELECT count(*) AS n FROM stream)"""


def _starts(count: int, seed: int, span: str) -> str:
    return f"""starts AS (SELECT i AS win_id, CAST(floor(
  CAST(CAST('0x' || substr(md5('{seed}:' || i), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0
  * CAST({span} AS DOUBLE)) AS BIGINT) AS start FROM range({count}) r(i), total)"""


QUERIES = {
    "t1_shuffle": lambda spark, sf_dir: sample.shuffle(documents(spark, sf_dir), "doc_id"),
    "t2_sample_n": lambda spark, sf_dir: sample.sample_n(documents(spark, sf_dir), 300, "doc_id"),
    "t3_sample_fraction": lambda spark, sf_dir: sample.sample_fraction(
        documents(spark, sf_dir), 20, "doc_id"
    ),
    "t3_sample_by_hash": lambda spark, sf_dir: sample.sample_by_hash(
        documents(spark, sf_dir), 0.05, "doc_id"
    ),
    "t4_head": lambda spark, sf_dir: sample.head(documents(spark, sf_dir), 100, ["doc_id"]),
    "t4_rest": lambda spark, sf_dir: sample.rest(documents(spark, sf_dir), 100, ["doc_id"]),
    "t5_split_by_position": lambda spark, sf_dir: sample.split_by_position(
        documents(spark, sf_dir), ["doc_id"]
    ),
    "t6_random_word_windows": _windows,
    "t7_random_blocks": _blocks,
    "t8_top_n": lambda spark, sf_dir: sample.top_n(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 100, "doc_id"
    ),
    "t9_random_split": lambda spark, sf_dir: sample.random_split(
        documents(spark, sf_dir), 5, 10_000, "doc_id"
    ),
    "u1_merge_ordered": _ordered,
    "u2_merge_shuffled": _merged,
}

ORACLES = {
    "t1_shuffle": f"SELECT doc_id, text, pos FROM ({_RANKED.format(seed=42)})",
    "t2_sample_n": f"SELECT doc_id, text, pos FROM ({_RANKED.format(seed=42)}) WHERE pos < 300",
    "t3_sample_fraction": f"SELECT doc_id, text, pos FROM ({_RANKED.format(seed=42)}) WHERE pos < n // 20",
    "t3_sample_by_hash": f"""SELECT doc_id, text FROM documents
WHERE CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) < {int(0.05 * 2**32)}""",
    "t4_head": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100",
    "t4_rest": "SELECT doc_id, text FROM documents ORDER BY doc_id OFFSET 100",
    "t5_split_by_position": """SELECT doc_id, text, CASE WHEN pos < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split
FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)""",
    "t6_random_word_windows": f"""WITH {_STREAM}, {_starts(1000, 42, 'n - 11')}
SELECT win_id AS prompt_id, string_agg(w, ' ' ORDER BY pos) AS prompt
FROM starts JOIN stream ON pos >= start AND pos < start + 10
GROUP BY win_id HAVING count(*) = 10 ORDER BY win_id LIMIT 500""",
    "t7_random_blocks": f"""WITH {_STREAM}, {_starts(2000, 1337, 'n - 16')}
SELECT win_id, start,
  string_agg(token_id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE pos < start + 16) AS x,
  string_agg(token_id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE pos > start) AS y
FROM starts JOIN stream ON pos >= start AND pos < start + 17
JOIN (SELECT w AS token, row_number() OVER (ORDER BY count(*) DESC, w) + 1 AS token_id FROM stream GROUP BY w) v ON v.token = w
GROUP BY win_id, start""",
    "t8_top_n": """SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank
FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100""",
    "t9_random_split": f"""SELECT doc_id, text, CASE WHEN pos < ceil(n * 5 / 10000.0) THEN 'val' ELSE 'train' END AS split
FROM ({_RANKED.format(seed=2357)})""",
    "u1_merge_ordered": """WITH files AS (
  SELECT 1 AS file_ord, doc_id AS line_no, text FROM documents
  UNION ALL SELECT 0, item_id, text FROM benchmark)
SELECT file_ord::BIGINT AS file_ord, line_no, text FROM files
UNION ALL SELECT file_ord::BIGINT, max(line_no) + 1, '' FROM files GROUP BY file_ord
UNION ALL SELECT file_ord::BIGINT, max(line_no) + 2, '' FROM files GROUP BY file_ord""",
    "u2_merge_shuffled": """WITH merged AS (
  SELECT 'd:' || doc_id AS line_key, text FROM documents
  UNION ALL SELECT 'c:' || conv_id || ':' || turn, text FROM conversations)
SELECT line_key, text, row_number() OVER (ORDER BY md5('42:' || line_key), line_key) - 1 AS pos FROM merged""",
}
