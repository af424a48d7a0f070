"""Token preparation over the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog.common import documents, table
from seepage.functions.text import SPACE
from seepage.operators import sample, tokens
from seepage.session import materialise, shared_path


def _vocab(spark, sf_dir):
    return materialise(tokens.build_vocab(documents(spark, sf_dir)), "vocab")


def _encoded(spark, sf_dir):
    return tokens.encode(documents(spark, sf_dir), _vocab(spark, sf_dir), "doc_id")


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def _vocab_query(spark, sf_dir):
    return tokens.build_vocab(documents(spark, sf_dir)).withColumn(
        "token_id", F.col("token_id").cast("bigint")
    )


def _decoded(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    ids = materialise(tokens.encode(documents(spark, sf_dir), vocab, "doc_id"), "ids")
    return tokens.decode(ids, vocab, "doc_id")


def _unknown(spark, sf_dir):
    """Turns under the 1000 most frequent document words; others are unknown."""
    vocab = materialise(tokens.build_vocab(documents(spark, sf_dir), 1000), "vocab")
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("turn_key"), "text"
    )
    return _joined(tokens.encode(turns, vocab, "turn_key"), "ids")


def _truncated(spark, sf_dir):
    ids = _encoded(spark, sf_dir)
    return ids.select("doc_id", F.array_join(tokens.truncate(F.col("ids"), 512), ",").alias("ids"))


def _padded(left):
    def query(spark, sf_dir):
        out = tokens.pad_fixed(_encoded(spark, sf_dir), 512, left=left)
        return _joined(out, "input_ids", "attention_mask")

    return query


def _collated(spark, sf_dir):
    out = tokens.collate(materialise(_encoded(spark, sf_dir), "ids"), "doc_id")
    return _joined(out, "input_ids", "attention_mask", "labels")


def _packed(block, stride):
    def query(spark, sf_dir):
        out = tokens.pack_blocks(materialise(_encoded(spark, sf_dir), "ids"), "doc_id", block, stride)
        return _joined(out, "x", "y")

    return query


def _stats(spark, sf_dir):
    split = sample.split_by_position(documents(spark, sf_dir), ["doc_id"])
    return tokens.corpus_stats(
        split.select("split", tokens.token_words(F.col("text")).alias("ids"))
    )


def _ended(spark, sf_dir):
    out = tokens.append_end(_encoded(spark, sf_dir))
    return _joined(out, "ids").withColumn("len", F.col("len").cast("bigint"))


def _concatenated(spark, sf_dir):
    out = tokens.concat_stream(materialise(_encoded(spark, sf_dir), "ids"), "doc_id", 64)
    return out.groupBy("shard").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("ids")).cast("bigint").alias("n_tokens"),
        F.min("offset").alias("start"),
    )


def _sharded(spark, sf_dir):
    """What the manifest tells of the files, and what the files hold."""
    path = shared_path(spark, "shards")
    ids = materialise(_encoded(spark, sf_dir), "ids")
    manifest = tokens.write_shards(ids, "doc_id", path, 64)
    held = tokens.read_shards(spark, path).groupBy("shard").agg(
        F.md5(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ids"))), lambda r: r["ids"])), ",")).alias("ids_md5")
    )
    return manifest.select("shard", "start", "n_rows", "n_tokens").join(held, "shard")


WORDS = f"""per_doc AS (
  SELECT doc_id, list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS i FROM per_doc),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS token_id, count(*) AS n
  FROM words GROUP BY token),
coded AS (SELECT doc_id, i, token_id FROM words JOIN vocab USING (token)),
encoded AS (SELECT d.doc_id, coalesce(list(token_id ORDER BY i) FILTER (WHERE token_id IS NOT NULL), []) AS ids
  FROM documents d LEFT JOIN coded c ON c.doc_id = d.doc_id GROUP BY d.doc_id)"""

_STREAM = "stream AS (SELECT token_id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM coded), total AS (SELECT count(*) AS n FROM stream)"


def _csv(x: str) -> str:
    return f"array_to_string({x}, ',')"


def _packed_sql(block: int, stride: int) -> str:
    return f"""WITH {WORDS}, {_STREAM},
blocks AS (SELECT unnest(range(greatest(0, CAST(floor((n - {block} - 1) / {stride}) AS BIGINT)))) AS block_id FROM total)
SELECT block_id,
  string_agg(token_id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE pos < block_id * {stride} + {block}) AS x,
  string_agg(token_id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE pos > block_id * {stride}) AS y
FROM blocks JOIN stream ON pos >= block_id * {stride} AND pos <= block_id * {stride} + {block}
GROUP BY block_id"""


def _padded_sql(left: bool) -> str:
    fill = "list_transform(range(512 - len(ids)), lambda k: {v})"
    ones = "list_transform(ids, lambda k: 1)"
    pair = "list_concat({b}, {a})" if left else "list_concat({a}, {b})"
    ids = pair.format(a="ids", b=fill.format(v=1))
    mask = pair.format(a=ones, b=fill.format(v=0))
    return f"""WITH {WORDS}, cut AS (SELECT doc_id, ids[1:512] AS ids FROM encoded)
SELECT doc_id, {_csv(ids)} AS input_ids, {_csv(mask)} AS attention_mask FROM cut"""


_FILL = "list_transform(range(longest - len(ids)), lambda k: {v})"
_BATCH_IDS = _csv(f"list_concat(ids, {_FILL.format(v=1)})")
_BATCH_MASK = _csv(f"list_concat(list_transform(ids, lambda k: 1), {_FILL.format(v=0)})")

QUERIES = {
    "k1_build_vocab": _vocab_query,
    "k1_vocab_stats": lambda spark, sf_dir: tokens.vocab_stats(
        tokens.build_vocab(documents(spark, sf_dir))
    ),
    "k2_encode": lambda spark, sf_dir: _joined(_encoded(spark, sf_dir), "ids"),
    "k2_encode_unknown": _unknown,
    "k3_decode": _decoded,
    "k4_truncate": _truncated,
    "k5_pad_fixed": _padded(False),
    "k5_pad_left": _padded(True),
    "k6_collate": _collated,
    "k7_pack_blocks": _packed(512, 512),
    "k7_pack_blocks_overlapping": _packed(64, 32),
    "k8_corpus_stats": _stats,
    "k9_append_eot": _ended,
    "k10_concat_stream": _concatenated,
    "k10_write_shards": _sharded,
}

_DEALT = """placed AS (
  SELECT doc_id, ids, len(ids) AS size, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n,
    coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM encoded),
dealt AS (SELECT *, CASE WHEN pos < (n % 64) * (n // 64 + 1) THEN pos // (n // 64 + 1)
  ELSE (n % 64) + (pos - (n % 64) * (n // 64 + 1)) // greatest(n // 64, 1) END AS shard FROM placed)"""

ORACLES = {
    "k1_build_vocab": f"WITH {WORDS} SELECT token, token_id, n FROM vocab",
    "k1_vocab_stats": f"WITH {WORDS} SELECT count(*) + 2 AS vocab_size, 'counted-words' AS encoder FROM vocab",
    "k2_encode": f"WITH {WORDS} SELECT doc_id, {_csv('ids')} AS ids FROM encoded",
    "k2_encode_unknown": f"""WITH {WORDS}, turns AS (SELECT conv_id || ':' || turn AS turn_key,
  list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '') AS ws FROM conversations),
turn_words AS (SELECT turn_key, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS i FROM turns)
SELECT turn_key, string_agg(coalesce(token_id, 0)::VARCHAR, ',' ORDER BY i) AS ids
FROM turn_words LEFT JOIN (SELECT * FROM vocab WHERE token_id < 1002) v USING (token) GROUP BY turn_key""",
    "k3_decode": f"WITH {WORDS} SELECT doc_id, array_to_string(ws, ' ') AS text FROM per_doc",
    "k4_truncate": f"WITH {WORDS} SELECT doc_id, {_csv('ids[1:512]')} AS ids FROM encoded",
    "k5_pad_fixed": _padded_sql(False),
    "k5_pad_left": _padded_sql(True),
    "k6_collate": f"""WITH {WORDS}, cut AS (
  SELECT doc_id, ids[1:512] AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM encoded),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM cut)
SELECT doc_id, batch_id, {_BATCH_IDS} AS input_ids, {_BATCH_MASK} AS attention_mask, {_BATCH_IDS} AS labels FROM sized""",
    "k7_pack_blocks": _packed_sql(512, 512),
    "k7_pack_blocks_overlapping": _packed_sql(64, 32),
    "k8_corpus_stats": f"""WITH {WORDS}, placed AS (
  SELECT len(ws) AS size, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM per_doc),
totals AS (SELECT CASE WHEN pos < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split, sum(size)::BIGINT AS tokens
  FROM placed GROUP BY 1),
counted AS (SELECT *, greatest(0, CAST(floor((tokens - 513) / 512.0) AS BIGINT)) AS examples FROM totals)
SELECT split, tokens, examples, CAST(ceil(examples / 16.0) AS BIGINT) AS batches_per_epoch,
  CAST(8192 AS BIGINT) AS tokens_per_step FROM counted""",
    "k9_append_eot": f"WITH {WORDS} SELECT doc_id, {_csv('list_append(ids, 1)')} AS ids, len(ids) + 1 AS len FROM encoded",
    "k10_write_shards": f"""WITH {WORDS}, {_DEALT}
SELECT shard, min(start)::BIGINT AS start, count(*) AS n_rows, sum(size)::BIGINT AS n_tokens,
  md5(array_to_string(flatten(list(ids ORDER BY pos)), ',')) AS ids_md5 FROM dealt GROUP BY shard""",
    "k10_concat_stream": f"""WITH {WORDS}, placed AS (
  SELECT len(ids) AS size, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n,
    coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM encoded),
dealt AS (SELECT *, CASE WHEN pos < (n % 64) * (n // 64 + 1) THEN pos // (n // 64 + 1)
  ELSE (n % 64) + (pos - (n % 64) * (n // 64 + 1)) // greatest(n // 64, 1) END AS shard FROM placed)
SELECT shard, count(*) AS n_docs, sum(size)::BIGINT AS n_tokens, min(start)::BIGINT AS start FROM dealt GROUP BY shard""",
}
