"""Models counted on documents; conversation turns are the scored samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog.common import documents, spread, table
from seepage.catalog.sampling import ORACLES as SAMPLING
from seepage.functions.text import SPACE
from seepage.operators import language_model as lm
from seepage.operators import private, sample, tokens
from seepage.operators.language_model import GRAM_KEY
from seepage.session import materialise

CLIP, SIGMA, SEED, SMALL_SEED = 50.0, 0.01, 7, 8


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("sample_id"), "text"
    )


def _model(spark, sf_dir, order=2):
    return lm.fit_ngram_lm(documents(spark, sf_dir), order)


def public_grams(spark, sf_dir, order=2):
    """The grams of the public passages: what a private release may speak of."""
    return lm.grams(table(spark, sf_dir, "benchmark"), order).select(*GRAM_KEY).distinct()


def _dp_model(spark, sf_dir, domain, seed, order=2):
    """Each source is one unit whose whole contribution is bounded."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    return private.fit_dp_ngram_lm(
        docs, "source", domain, order, clip=CLIP, sigma=SIGMA, test_seed=seed, whole=True
    )


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _fit(order):
    def query(spark, sf_dir):
        out = lm.model_table(_model(spark, sf_dir, order))
        return _rounded(out.withColumn("ord", F.col("ord").cast("bigint")), "p", digits=10)

    return query


def _models(spark, sf_dir):
    """Small and large, plain and private: orders one and two, with and without
    noise of their own."""
    large = _model(spark, sf_dir, 2)
    large_dp = _dp_model(spark, sf_dir, public_grams(spark, sf_dir, 2), SEED, 2)
    small_dp = _dp_model(spark, sf_dir, public_grams(spark, sf_dir, 1), SMALL_SEED, 1)
    small = large.small()
    return {"nano": small, "nano_dp": small_dp, "gpt2": large, "gpt2_dp": large_dp}


def _scores(spark, sf_dir):
    samples = turns(spark, sf_dir).withColumn("zlib", lm.zlib_size(F.col("text")))
    models = _models(spark, sf_dir)
    return lm.score_matrix(samples, models, lower="gpt2_dp").drop("text")


def _matrix(spark, sf_dir):
    scored = lm.score_matrix(turns(spark, sf_dir), _models(spark, sf_dir)).drop("text")
    return _rounded(scored, "nano", "nano_dp", "gpt2", "gpt2_dp", digits=4)


def _plain_scores(spark, sf_dir):
    """Two plain models and the length, for rankings that SQL can repeat."""
    large = _model(spark, sf_dir, 2)
    small = large.small()
    scored = lm.score_matrix(turns(spark, sf_dir), {"nano": small, "gpt2": large})
    return scored.withColumn("size", F.length("text")).drop("text")


def _filled(spark, sf_dir):
    scored = _plain_scores(spark, sf_dir).withColumn(
        "nano", F.when(F.col("size") < 100, F.lit(float("inf"))).otherwise(F.col("nano"))
    )
    out = lm.fill_scores(scored, ["nano", "gpt2"])
    return _rounded(out.withColumn("size", F.col("size").cast("bigint")), "nano", "gpt2", digits=4)


def _by_perplexity(spark, sf_dir):
    filled = lm.fill_scores(_plain_scores(spark, sf_dir), ["nano", "gpt2"])
    out = lm.rank_by_perplexity(filled, "gpt2", 100).withColumn("rank", F.col("rank").cast("bigint"))
    return _rounded(out.drop("score2"), "score1", "value", digits=4)


def _by_ratio(spark, sf_dir):
    filled = lm.fill_scores(_plain_scores(spark, sf_dir), ["nano", "gpt2"])
    out = lm.rank_by_ratio(filled, "gpt2", ["nano", "size"], 100)
    return _rounded(out.withColumn("rank", F.col("rank").cast("bigint")), "score1", "score2", "value", digits=4)


def _six_rankings(spark, sf_dir):
    """The whole report: perplexity and five ratios, zlib among them."""
    # stored, as two rankings read it
    filled = materialise(lm.fill_scores(_scores(spark, sf_dir), ["nano", "nano_dp", "gpt2", "gpt2_dp", "lower"]), "scores")
    best = lm.rank_by_perplexity(filled, "gpt2_dp")
    ratios = lm.rank_by_ratio(filled, "gpt2_dp", ["nano", "nano_dp", "gpt2", "lower", "zlib"])
    return best.unionByName(ratios)


def _five_rankings(spark, sf_dir):
    """The report without compressed size, which SQL can't compute."""
    names = ["nano", "nano_dp", "gpt2", "gpt2_dp", "lower"]
    samples, models = turns(spark, sf_dir), _models(spark, sf_dir)
    scored = lm.score_matrix(samples, models, lower="gpt2_dp").drop("text")
    # rounded before they rank, so that engines agree on ties
    filled = materialise(_rounded(lm.fill_scores(scored, names), *names, digits=4), "scores")
    best = lm.rank_by_perplexity(filled, "gpt2_dp")
    ratios = lm.rank_by_ratio(filled, "gpt2_dp", [n for n in names if n != "gpt2_dp"])
    out = best.unionByName(ratios).withColumn("rank", F.col("rank").cast("bigint"))
    return _rounded(out, "value").select("metric", "rank", "sample_id", "score1", "score2", "value")


def _heldout(spark, sf_dir):
    split = sample.split_by_position(documents(spark, sf_dir), ["doc_id"])
    model = lm.fit_ngram_lm(split.filter("split = 'train'"), 2)
    return _rounded(lm.heldout_loss(split, model, "doc_id"), "loss")


def _topk(spark, sf_dir):
    out = lm.next_token_topk(_model(spark, sf_dir), 5, 0.8)
    return _rounded(out.withColumn("rank", F.col("rank").cast("bigint")), "prob")


def _generated(spark, sf_dir):
    """A model that answers with the prompt's words in reverse order."""

    def reverse(prompts: list[str], seed: int) -> list[str]:
        return [" ".join(reversed(p.split(" "))) for p in prompts]

    prompts = tokens.random_word_windows(documents(spark, sf_dir), "doc_id", 500)
    return lm.batch_generate(prompts.repartition("prompt_id"), reverse)


WS = f"list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '')"
TURNS = "turns AS (SELECT conv_id || ':' || turn AS sample_id, text FROM conversations)"


def _listed(name: str, source: str, key: str) -> str:
    """Grams of orders one and two of a source, as CTE ``name``."""
    return f"""{name}_words AS (SELECT {key}, {WS} AS ws FROM {source}),
{name}_at AS (SELECT {key}, ws, unnest(range(1, len(ws) + 1)) AS place FROM {name}_words),
{name} AS (SELECT {key}, place, 1 AS ord, '' AS context, ws[place] AS token FROM {name}_at
  UNION ALL SELECT {key}, place, 2, ws[place - 1], ws[place] FROM {name}_at WHERE place > 1)"""


COUNTS = (
    _listed("corpus", "documents", "source")
    + ", counts AS (SELECT ord, context, token, count(*) AS n FROM corpus GROUP BY ALL)"
)

HEX = "CAST(CAST('0x' || substr(md5({t}), 1, 12) AS BIGINT) AS DOUBLE)"


def gauss_sql(seed: int, key: str) -> str:
    """The reproducible normal noise of a key."""
    u = HEX.format(t=f"'{seed}a:' || {key}")
    v = HEX.format(t=f"'{seed}b:' || {key}")
    return f"(sqrt(-2 * ln(({u} + 1) / 281474976710656.0)) * cos(2 * pi() * (({v} + 1) / 281474976710656.0)))"


def _noisy(name: str, order: int, seed: int) -> str:
    """CTEs that end in ``name``: clipped by source, summed, noised over the domain, floored."""
    noise = gauss_sql(seed, "ord || ':' || context || ':' || token")
    return f"""{name}_clipped AS (SELECT ord, context, token,
  v * least(1.0, {CLIP} / sqrt(sum(v * v) OVER (PARTITION BY source))) AS v FROM contrib WHERE ord <= {order}),
{name}_sums AS (SELECT ord, context, token, sum(v) AS v FROM {name}_clipped GROUP BY ALL),
{name} AS (SELECT ord, context, token, greatest(0.0, coalesce(v, 0.0) + {SIGMA * CLIP} * {noise}) AS n
  FROM domain LEFT JOIN {name}_sums USING (ord, context, token) WHERE ord <= {order})"""


DOMAIN = _listed("public", "benchmark", "item_id") + ", domain AS (SELECT DISTINCT ord, context, token FROM public)"


CONTRIB = "contrib AS (SELECT source, ord, context, token, CAST(count(*) AS DOUBLE) AS v FROM corpus GROUP BY ALL)"
DP_COUNTS = f"{DOMAIN}, {CONTRIB}, {_noisy('dp_counts', 2, SEED)}, {_noisy('small_dp', 1, SMALL_SEED)}"


def _p(name: str, counts: str, wanted: str, order: int = 2) -> str:
    """CTEs that end in ``name``_p (ord, context, token, p) for the wanted grams."""
    base = f"""{name}_size AS (SELECT CAST(sum(n) AS DOUBLE) AS words, count(*) AS types FROM {counts} WHERE ord = 1),
{name}_p1 AS (SELECT w.ord, w.context, w.token, (coalesce(c.n, 0) + 1) / (words + types + 1) AS p
  FROM {wanted} w LEFT JOIN {counts} c ON c.ord = 1 AND c.token = w.token, {name}_size WHERE w.ord = 1)"""
    if order == 1:
        return base + f", {name}_p AS (SELECT * FROM {name}_p1)"
    return base + f""",
{name}_tot AS (SELECT context, sum(n) AS total FROM {counts} WHERE ord = 2 GROUP BY context),
{name}_p AS (SELECT * FROM {name}_p1 UNION ALL
  SELECT w.ord, w.context, w.token, (coalesce(c.n, 0) + 10.0 * b.p) / (coalesce(t.total, 0) + 10.0)
  FROM {wanted} w JOIN {name}_p1 b ON b.token = w.token
  LEFT JOIN {counts} c ON c.ord = 2 AND c.context = w.context AND c.token = w.token
  LEFT JOIN {name}_tot t ON t.context = w.context WHERE w.ord = 2)"""


def _loss(name: str, own: str, key: str, order: int = 2) -> str:
    return f"""{name}_loss AS (SELECT {key}, sum(-ln(p)) AS nll, count(*) AS predicted
  FROM {own} g JOIN {name}_p p ON p.ord = g.ord AND p.context = g.context AND p.token = g.token
  WHERE place > 1 AND g.ord = least(place, {order}) GROUP BY {key})"""


_OWN = _listed("own", "turns", "sample_id") + ", wanted AS (SELECT DISTINCT ord, context, token FROM own)"


def _score(name: str, counts: str, order: int = 2) -> str:
    return f"{_p(name, counts, 'wanted', order)}, {_loss(name, 'own', 'sample_id', order)}"


def _column(name: str) -> str:
    return f"exp({name}_loss.nll / {name}_loss.predicted)"


def _wide(names: list[str]) -> str:
    joins = " ".join(f"LEFT JOIN {n}_loss ON {n}_loss.sample_id = turns.sample_id" for n in names)
    return f"FROM turns {joins}"


_PLAIN = f"""WITH {TURNS}, {COUNTS}, {_OWN}, {_score('gpt2', 'counts')}, {_score('nano', 'counts', 1)},
scores AS (SELECT turns.sample_id, {_column('nano')} AS nano, {_column('gpt2')} AS gpt2, length(text) AS size {_wide(['nano', 'gpt2'])})"""

_FILLED = """filled AS (SELECT sample_id, coalesce(nano, 1e9) AS nano, coalesce(gpt2, 1e9) AS gpt2, size FROM scores)"""


def _ratio_sql(other: str) -> str:
    return f"""SELECT 'ratio of {other} to gpt2 perplexity' AS metric, sample_id, gpt2 AS score1,
  CAST({other} AS DOUBLE) AS score2, ln({other}) / ln(gpt2) AS value FROM filled"""


def _five_sql() -> str:
    names = ["nano", "nano_dp", "gpt2", "gpt2_dp", "lower"]
    filled = ", ".join(f"coalesce(round({_column(n)}, 4), 1e9) AS {n}" for n in names)
    ratios = " ".join(
        f"UNION ALL SELECT 'ratio of {n} to gpt2_dp perplexity', sample_id, gpt2_dp, {n}, ln({n}) / ln(gpt2_dp) FROM filled"
        for n in names
        if n != "gpt2_dp"
    )
    lowered = _listed("low", "lower_turns", "sample_id")
    return f"""WITH {TURNS}, {COUNTS}, {DP_COUNTS}, {_OWN}, {_score('nano', 'counts', 1)},
{_score('nano_dp', 'small_dp', 1)}, {_score('gpt2', 'counts')}, {_score('gpt2_dp', 'dp_counts')},
lower_turns AS (SELECT sample_id, lower(text) AS text FROM turns), {lowered},
low_wanted AS (SELECT DISTINCT ord, context, token FROM low),
{_p('lower', 'dp_counts', 'low_wanted')}, {_loss('lower', 'low', 'sample_id')},
filled AS (SELECT turns.sample_id, {filled} {_wide(names)}),
long AS (SELECT 'gpt2_dp perplexity' AS metric, sample_id, gpt2_dp AS score1, NULL::DOUBLE AS score2, -ln(gpt2_dp) AS value FROM filled
  {ratios}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, sample_id) AS rank FROM long)
SELECT metric, rank, sample_id, score1, score2, round(value, 6) AS value FROM ranked WHERE rank <= 100"""


QUERIES = {
    "l1_fit_ngram_lm": _fit(2),
    "l1_fit_unigram_lm": _fit(1),
    "l2_perplexity": lambda spark, sf_dir: _rounded(
        lm.perplexity(turns(spark, sf_dir), _model(spark, sf_dir)), "perplexity", digits=4
    ),
    "l3_score_matrix": _matrix,
    "l4_lower_perplexity": lambda spark, sf_dir: _rounded(
        lm.lower_perplexity(turns(spark, sf_dir), _model(spark, sf_dir)), "lower", digits=4
    ),
    "l5_zlib_size": lambda spark, sf_dir: documents(spark, sf_dir).select(
        "doc_id", lm.zlib_size(F.col("text")).alias("zlib")
    ),
    "l6_fill_scores": _filled,
    "l7_rank_by_perplexity": _by_perplexity,
    "l8_rank_by_ratio": _by_ratio,
    "l8_five_rankings": _five_rankings,
    "l8_six_rankings": _six_rankings,
    "l9_heldout_loss": _heldout,
    "l10_next_token_topk": _topk,
    "l11_batch_generate": _generated,
    "l12_sample_entropy": lambda spark, sf_dir: _rounded(
        lm.sample_entropy(documents(spark, sf_dir), "doc_id"), "entropy"
    ),
}

ORACLES = {
    "l1_fit_ngram_lm": f"""WITH {COUNTS}, {_p('m', 'counts', 'counts')}
SELECT c.ord::BIGINT AS ord, c.context, c.token, c.n, round(p, 10) AS p FROM counts c JOIN m_p USING (ord, context, token)""",
    "l1_fit_unigram_lm": f"""WITH {COUNTS}, {_p('m', 'counts', 'counts', 1)}
SELECT c.ord::BIGINT AS ord, c.context, c.token, c.n, round(p, 10) AS p FROM counts c JOIN m_p USING (ord, context, token)""",
    "l2_perplexity": f"""WITH {TURNS}, {COUNTS}, {_OWN}, {_score('gpt2', 'counts')}
SELECT turns.sample_id, round({_column('gpt2')}, 4) AS perplexity {_wide(['gpt2'])}""",
    "l3_score_matrix": f"""WITH {TURNS}, {COUNTS}, {DP_COUNTS}, {_OWN}, {_score('nano', 'counts', 1)},
{_score('nano_dp', 'small_dp', 1)}, {_score('gpt2', 'counts')}, {_score('gpt2_dp', 'dp_counts')}
SELECT turns.sample_id, {", ".join(f"round({_column(n)}, 4) AS {n}" for n in ("nano", "nano_dp", "gpt2", "gpt2_dp"))}
{_wide(["nano", "nano_dp", "gpt2", "gpt2_dp"])}""",
    "l4_lower_perplexity": f"""WITH turns AS (SELECT conv_id || ':' || turn AS sample_id, lower(text) AS text FROM conversations),
{COUNTS}, {_OWN}, {_score('gpt2', 'counts')}
SELECT turns.sample_id, round({_column('gpt2')}, 4) AS lower {_wide(['gpt2'])}""",
    "l6_fill_scores": f"""{_PLAIN} SELECT sample_id, round(CASE WHEN size < 100 THEN 1e9 ELSE coalesce(nano, 1e9) END, 4) AS nano,
  round(coalesce(gpt2, 1e9), 4) AS gpt2, size::BIGINT AS size FROM scores""",
    "l7_rank_by_perplexity": f"""{_PLAIN}, {_FILLED}
SELECT 'gpt2 perplexity' AS metric, sample_id, round(gpt2, 4) AS score1, round(-ln(gpt2), 4) AS value,
  row_number() OVER (ORDER BY -ln(gpt2) DESC, sample_id) AS rank FROM filled ORDER BY -ln(gpt2) DESC, sample_id LIMIT 100""",
    "l8_rank_by_ratio": f"""{_PLAIN}, {_FILLED}, long AS ({_ratio_sql('nano')} UNION ALL {_ratio_sql('size')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, sample_id) AS rank FROM long)
SELECT metric, sample_id, round(score1, 4) AS score1, round(score2, 4) AS score2, round(value, 4) AS value, rank
FROM ranked WHERE rank <= 100""",
    "l8_five_rankings": _five_sql(),
    "l9_heldout_loss": f"""WITH split_docs AS (
  SELECT doc_id, text, CASE WHEN pos < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split
  FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)),
train AS (SELECT * FROM split_docs WHERE split = 'train'),
{_listed('corpus', 'train', 'doc_id')}, counts AS (SELECT ord, context, token, count(*) AS n FROM corpus GROUP BY ALL),
{_listed('own', 'split_docs', 'split')}, wanted AS (SELECT DISTINCT ord, context, token FROM own),
{_p('m', 'counts', 'wanted')}, {_loss('m', 'own', 'split')}
SELECT split, round(nll / predicted, 6) AS loss, predicted FROM m_loss""",
    "l10_next_token_topk": f"""WITH {COUNTS}, {_p('m', 'counts', 'counts')},
ranked AS (SELECT context, token, p, row_number() OVER (PARTITION BY context ORDER BY round(p, 14) DESC, token) AS rank FROM m_p WHERE ord = 2),
best AS (SELECT *, pow(p, 1.25) AS w FROM ranked WHERE rank <= 5)
SELECT context, token, rank, round(w / sum(w) OVER (PARTITION BY context), 6) AS prob FROM best""",
    "l11_batch_generate": f"""SELECT prompt_id AS sample_id, prompt,
  array_to_string(list_reverse(string_split(prompt, ' ')), ' ') AS text FROM ({SAMPLING["t6_random_word_windows"]})""",
    "l12_sample_entropy": f"""WITH counted AS (SELECT doc_id, token, count(*) AS c FROM (
  SELECT doc_id, unnest({WS}) AS token FROM documents) GROUP BY ALL),
shared AS (SELECT doc_id, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY doc_id) AS q FROM counted)
SELECT doc_id, round(coalesce(-sum(q * log2(q)), 0) + 0.0, 6) AS entropy FROM documents LEFT JOIN shared USING (doc_id) GROUP BY doc_id""",
}
