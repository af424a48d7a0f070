"""Each assistant turn against the user turn before it."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog.common import spread, table
from seepage.functions.stem import stem_sql
from seepage.functions.text import SPACE
from seepage.operators import metrics


def _side(spark, sf_dir, role):
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == role)
    return turns.select("conv_id", "turn", "text")


def _pairs(spark, sf_dir):
    """pos is (conversation, turn of the question) as one string."""
    asked = _side(spark, sf_dir, "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("pos"), F.col("text").alias("reference")
    )
    told = _side(spark, sf_dir, "assistant").select(
        F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("pos"),
        F.col("text").alias("plain"),
        F.lower("text").alias("dp"),
    )
    return spread(asked).join(told, "pos")


def _aligned(spark, sf_dir):
    """Questions, answers and lower-cased answers paired by place in their lists."""
    asked = _side(spark, sf_dir, "user")
    told = _side(spark, sf_dir, "assistant")
    lowered = told.withColumn("text", F.lower("text"))
    return metrics.align(asked, told, lowered, ["conv_id", "turn"])


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def _vector_id(spark, sf_dir):
    """A word's vector is picked by its hash."""
    count = table(spark, sf_dir, "embeddings").count()
    return F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint") % count


def _rouge(n, stemmed):
    return lambda spark, sf_dir: metrics.rouge_n(
        _pairs(spark, sf_dir), "plain", "reference", n, stemmed=stemmed
    ).withColumn(f"rouge{n}", F.round(f"rouge{n}", 6))


def _rouge_l(spark, sf_dir):
    out = metrics.rouge_l(_pairs(spark, sf_dir), "plain", "reference", stemmed=False)
    return out.withColumn("rougeL", F.round("rougeL", 6))


def _bleu(variant):
    return lambda spark, sf_dir: metrics.corpus_bleu(
        _pairs(spark, sf_dir), variant, "reference"
    ).withColumn("bleu", F.round("bleu", 8))


def _stems(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select(
        F.explode(metrics.rouge_words(F.col("text"))).alias("token")
    )
    return metrics.stem_tokens(tokens).groupBy("token", "stem").agg(F.count("*").alias("n"))


def _match(spark, sf_dir):
    out = metrics.greedy_cosine_match(
        _pairs(spark, sf_dir), "plain", "reference", _vectors(spark, sf_dir), _vector_id(spark, sf_dir)
    )
    return out.withColumns({c: F.round(c, 5) for c in ("precision", "recall", "f1")})


def _report(stemmed):
    def query(spark, sf_dir):
        out = metrics.metric_report(_pairs(spark, sf_dir), _vectors(spark, sf_dir), _vector_id(spark, sf_dir), stemmed=stemmed)
        return out.withColumns({c: F.round(c, 4) for c in ("plain", "dp")})

    return query


_PAIRS = """pairs AS (SELECT u.conv_id || ':' || u.turn AS pos, u.text AS reference, a.text AS plain, lower(a.text) AS dp
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def _grams(side: str, ns: str) -> str:
    return f"""{side}_grams AS (SELECT pos, n, array_to_string({side}[i:i + n - 1], ' ') AS gram, count(*) AS c
  FROM (SELECT pos, {side}, n, unnest(range(1, len({side}) - n + 2)) AS i FROM listed, (SELECT unnest({ns}) AS n)) GROUP BY ALL)"""


def _overlap(hyp: str, ns: str, words) -> str:
    return f"""WITH {_PAIRS}, listed AS (SELECT pos, {words(hyp)} AS hyp, {words('reference')} AS ref FROM pairs),
{_grams('hyp', ns)}, {_grams('ref', ns)},
overlap AS (SELECT pos, n, sum(least(h.c, r.c)) AS n_both FROM hyp_grams h JOIN ref_grams r USING (pos, n, gram) GROUP BY ALL)"""


def _spaced(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def _plain_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


# every distinct word of the turns with its stem
STEMS = f"""stems AS (SELECT token, {stem_sql('token')} AS stem
  FROM (SELECT DISTINCT unnest({_plain_words('text')}) AS token FROM conversations))"""


def _stemmed_sql(sql: str, names: tuple[str, ...] = ("reference", "plain", "dp")) -> str:
    """A query over ``pairs`` as one over pairs of stemmed texts."""
    cells = ", ".join(
        f"(SELECT string_agg(stem, ' ' ORDER BY place) FROM (SELECT unnest(ws) AS token, unnest(range(len(ws))) AS place FROM (SELECT {_plain_words(n)} AS ws)) JOIN stems USING (token)) AS {n}"
        for n in names
    )
    stemmed = f"{_PAIRS.replace('pairs AS', 'raw_pairs AS')}, {STEMS}, pairs AS (SELECT pos, {', '.join(f"coalesce({n}, '') AS {n}" for n in names)} FROM (SELECT pos, {cells} FROM raw_pairs))"
    assert _PAIRS in sql
    return sql.replace(_PAIRS, stemmed)


def _bleu_sql(hyp: str) -> str:
    terms = " + ".join(
        ["ln((SELECT sum(n_both) FROM overlap WHERE n = 1) / sum(greatest(len(hyp), 1)))"]
        + [
            f"ln(((SELECT coalesce(sum(n_both), 0) FROM overlap WHERE n = {n}) + 1) / (sum(greatest(len(hyp) - {n - 1}, 1)) + 1))"
            for n in (2, 3, 4)
        ]
    )
    return f"""{_overlap(hyp, '[1, 2, 3, 4]', _spaced)}
SELECT round(CASE WHEN sum(len(hyp)) > sum(len(ref)) THEN 1.0 ELSE exp(1 - sum(len(ref)) / sum(len(hyp))) END
  * exp(({terms}) / 4), 8) AS bleu FROM listed"""


def _rouge_sql(n: int) -> str:
    return f"""{_overlap('plain', f'[{n}]', _plain_words)}
SELECT listed.pos, round(CASE WHEN coalesce(n_both, 0) = 0 THEN 0.0 ELSE 2.0 * n_both /
  (greatest(len(hyp) - {n - 1}, 0) + greatest(len(ref) - {n - 1}, 0)) END, 6) AS rouge{n}
FROM listed LEFT JOIN overlap ON overlap.pos = listed.pos"""


_HASH = "CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)"

QUERIES = {
    "m1_align": _aligned,
    "m2_corpus_bleu": _bleu("plain"),
    "m2_corpus_bleu_dp": _bleu("dp"),
    "m3_rouge_1": _rouge(1, False),
    "m3_rouge_2": _rouge(2, False),
    "m3_rouge_1_stemmed": _rouge(1, True),
    "m4_rouge_l": _rouge_l,
    "m5_stem_tokens": _stems,
    "m6_greedy_cosine_match": _match,
    "m7_metric_report": _report(True),
    "m7_metric_report_unstemmed": _report(False),
}

def _lcs_sql(hyp: str) -> str:
    """(pos, hyp, ref, rouge_l): the longest common subsequence by dynamic programming, a row per word."""
    return f"""WITH RECURSIVE {_PAIRS}, listed AS (SELECT pos, {_plain_words(hyp)} AS hyp, {_plain_words('reference')} AS ref FROM pairs),
lcs AS (SELECT pos, 0 AS i, list_transform(range(len(hyp) + 1), lambda k: 0::BIGINT) AS row FROM listed
  UNION ALL SELECT lcs.pos, i + 1, list_reduce(range(1, len(hyp) + 1), lambda acc, j: list_append(acc,
    CASE WHEN hyp[j] = ref[i + 1] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0]::BIGINT[])
  FROM lcs JOIN listed ON listed.pos = lcs.pos WHERE i < len(ref)),
whole AS (SELECT listed.pos, hyp, ref, row[len(hyp) + 1] AS n FROM lcs JOIN listed ON listed.pos = lcs.pos WHERE i = len(ref))
SELECT pos, CASE WHEN n > 0 THEN 2.0 * n / (len(hyp) + len(ref)) ELSE 0.0 END AS rouge_l FROM whole"""


def _report_sql(stemmed: bool = False) -> str:
    rows = []
    told = _stemmed_sql if stemmed else lambda sql: sql
    for variant in ("plain", "dp"):
        swap = lambda sql: sql.replace(_spaced("plain"), _spaced(variant)).replace(_plain_words("plain"), _plain_words(variant))
        match = swap(ORACLES["m6_greedy_cosine_match"])
        values = {
            "bleu": f"SELECT bleu * 100 FROM ({_bleu_sql(variant)})",
            "rouge1": f"SELECT avg(rouge1) FROM ({told(swap(_rouge_sql(1)))})",
            "rouge2": f"SELECT avg(rouge2) FROM ({told(swap(_rouge_sql(2)))})",
            "rougeL": f"SELECT avg(rouge_l) FROM ({told(_lcs_sql(variant))})",
            **{c: f"SELECT avg({c}) FROM ({match})" for c in ("precision", "recall", "f1")},
        }
        rows.append(values)
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, round(({rows[0][name]}), 4) AS plain, round(({rows[1][name]}), 4) AS dp" for name in rows[0]
    )


ORACLES = {
    "m1_align": """WITH asked AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations WHERE role = 'user'),
told AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations WHERE role = 'assistant')
SELECT pos, asked.text AS reference, told.text AS plain, lower(told.text) AS dp FROM asked JOIN told USING (pos)""",
    "m2_corpus_bleu": _bleu_sql("plain"),
    "m2_corpus_bleu_dp": _bleu_sql("dp"),
    "m3_rouge_1": _rouge_sql(1),
    "m3_rouge_2": _rouge_sql(2),
    "m6_greedy_cosine_match": f"""WITH {_PAIRS}, vectors AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
toks AS (SELECT pos, 'h' AS side, unnest({_spaced('plain')}) AS token FROM pairs
  UNION ALL SELECT pos, 'r', unnest({_spaced('reference')}) FROM pairs),
counted AS (SELECT pos, side, {_HASH} AS vec_id, count(*) AS c FROM toks GROUP BY ALL),
used AS (SELECT DISTINCT vec_id FROM counted),
sims AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.v, b.v) AS s FROM vectors a, vectors b
  WHERE a.vec_id IN (SELECT vec_id FROM used) AND b.vec_id IN (SELECT vec_id FROM used)),
best AS (SELECT a.pos, a.side, a.vec_id, a.c, max(s) AS s FROM counted a JOIN counted b ON a.pos = b.pos AND a.side <> b.side
  JOIN sims ON x = a.vec_id AND y = b.vec_id GROUP BY ALL),
scored AS (SELECT pos, sum(s * c) FILTER (WHERE side = 'h') / sum(c) FILTER (WHERE side = 'h') AS p,
  sum(s * c) FILTER (WHERE side = 'r') / sum(c) FILTER (WHERE side = 'r') AS r FROM best GROUP BY pos)
SELECT pairs.pos, round(coalesce(p, 0), 5) AS precision, round(coalesce(r, 0), 5) AS recall,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 5) AS f1 FROM pairs LEFT JOIN scored ON scored.pos = pairs.pos""",
}
ORACLES["m4_rouge_l"] = f"SELECT pos, round(rouge_l, 6) AS rougeL FROM ({_lcs_sql('plain')})"
ORACLES["m7_metric_report_unstemmed"] = _report_sql()
ORACLES["m7_metric_report"] = _report_sql(stemmed=True)
ORACLES["m3_rouge_1_stemmed"] = _stemmed_sql(_rouge_sql(1))
ORACLES["m5_stem_tokens"] = f"""WITH {STEMS}, toks AS (SELECT unnest({_plain_words('text')}) AS token FROM conversations)
SELECT token, stem, count(*) AS n FROM toks JOIN stems USING (token) GROUP BY token, stem"""
