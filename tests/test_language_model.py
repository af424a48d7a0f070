import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seepage.catalog import language_model as lm_queries
from seepage.operators import language_model as lm
from seepage.operators import private

CORPUS = ["a b a c", "b a b", "c", ""]
SAMPLES = [("s0", "a b a"), ("s1", "b zz a c"), ("s2", "a"), ("s3", "")]


def brute_loss(order, mu=10.0):
    """Interpolated n-gram probabilities, straight from the definition."""
    grams, contexts, words = Counter(), Counter(), 0
    for text in CORPUS:
        ws = text.split()
        words += len(ws)
        for k in range(1, order + 1):
            for i in range(k - 1, len(ws)):
                grams[tuple(ws[i - k + 1 : i + 1])] += 1
                contexts[tuple(ws[i - k + 1 : i])] += 1
    types = len({g for g in grams if len(g) == 1})

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (words + types + 1)
        return (grams[gram] + mu * p(gram[1:])) / (contexts[gram[:-1]] + mu)

    def mean(text):
        ws = text.split()
        parts = [-math.log(p(tuple(ws[max(0, i - order + 1) : i + 1]))) for i in range(1, len(ws))]
        return sum(parts) / len(parts) if parts else None

    return mean


@pytest.fixture()
def data(spark):
    corpus = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    return corpus, spark.createDataFrame(SAMPLES, "sample_id string, text string")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_perplexity_equals_the_definition(data, order):
    corpus, samples = data
    got = {r["sample_id"]: r["perplexity"] for r in lm.perplexity(samples, lm.fit_ngram_lm(corpus, order)).collect()}
    mean = brute_loss(order)
    for key, text in SAMPLES:
        want = mean(text)
        assert got[key] == (None if want is None else pytest.approx(math.exp(want)))


def test_next_words_of_a_context_sum_to_one_with_the_unseen(data):
    corpus, _ = data
    model = lm.fit_ngram_lm(corpus, 1)
    seen = lm.model_table(model).agg(F.sum("p")).first()[0]
    assert seen == pytest.approx(1 - 1 / (8 + 3 + 1))
    top = lm.next_token_topk(lm.fit_ngram_lm(corpus, 2), 1).collect()
    assert all(r["prob"] == 1.0 and r["rank"] == 1 for r in top)


def test_matrix_has_a_column_per_model(data):
    corpus, samples = data
    models = {"small": lm.fit_ngram_lm(corpus, 1), "large": lm.fit_ngram_lm(corpus, 2)}
    rows = {r["sample_id"]: r for r in lm.score_matrix(samples, models).collect()}
    assert rows["s0"]["small"] == pytest.approx(math.exp(brute_loss(1)("a b a")))
    assert rows["s0"]["large"] == pytest.approx(math.exp(brute_loss(2)("a b a")))
    assert rows["s2"]["small"] is None


def test_lower_case_differs(spark):
    corpus = spark.createDataFrame([("A b A b",)], "text string")
    model = lm.fit_ngram_lm(corpus, 2)
    samples = spark.createDataFrame([("s", "A b")], "sample_id string, text string")
    upper = lm.perplexity(samples, model).first()["perplexity"]
    assert lm.lower_perplexity(samples, model).first()["lower"] > upper * 0.99


def test_fill_and_rank_with_odd_scores(spark):
    rows = [("a", 1.0, 5.0), ("b", float("nan"), 5.0), ("c", None, 5.0), ("d", math.e, math.e**2), ("e", 1.0, 1.0), ("f", 1.0, 0.5)]
    df = spark.createDataFrame(rows, "sample_id string, m double, o double")
    filled = {r["sample_id"]: r["m"] for r in lm.fill_scores(df, ["m"]).collect()}
    assert filled == {"a": 1.0, "b": 1e9, "c": 1e9, "d": math.e, "e": 1.0, "f": 1.0}
    ranked = lm.rank_by_ratio(lm.fill_scores(df, ["m"]), "m", ["o"], 10).orderBy("rank").collect()
    assert [r["sample_id"] for r in ranked] == ["e", "a", "d", "b", "c", "f"]
    assert math.isnan(ranked[0]["value"]) and ranked[1]["value"] == math.inf and ranked[-1]["value"] == -math.inf
    best = lm.rank_by_perplexity(lm.fill_scores(df, ["m"]), "m", 2).orderBy("rank").collect()
    assert [(r["sample_id"], r["value"]) for r in best] == [("a", 0.0), ("e", 0.0)]


def test_zlib_size(spark):
    texts = ["", "é" * 50, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(lm.zlib_size(F.col("text"))).collect()]
    assert got == [None if t is None else len(zlib.compress(t.encode())) for t in texts]


def test_entropy(spark):
    df = spark.createDataFrame([("x", "a b a b"), ("y", "a a"), ("z", "a b c d"), ("none", " "), ("null", None)], "sample_id string, text string")
    got = {r["sample_id"]: r["entropy"] for r in lm.sample_entropy(df).collect()}
    assert got == {"none": 0.0, "null": 0.0, "x": pytest.approx(1.0), "y": pytest.approx(0.0), "z": pytest.approx(2.0)}


def test_batches_reach_the_model(spark):
    def predict(prompts, seed):
        return [f"n{len(prompts)}" for _ in prompts]

    out = lm.batch_generate(lm.empty_prompts(spark, 25).coalesce(1), predict, batch_size=10, include_prompt=True)
    texts = sorted(r["text"] for r in out.collect())
    assert texts == ["<|endoftext|> n10"] * 20 + ["<|endoftext|> n5"] * 5


def test_batches_do_not_depend_on_partitions(spark):
    def predict(prompts, seed):
        return [f"{seed} {i}" for i, _ in enumerate(prompts)]

    prompts = spark.range(200).selectExpr("id * 3 AS prompt_id", "concat('p', id) AS prompt")
    got = [sorted(lm.batch_generate(prompts.repartition(n), predict).collect()) for n in (1, 8)]
    assert got[0] == got[1]
    assert {r["text"].split()[0] for r in got[0]} == {"42", "43"}


def test_counts_of_all_orders_equal_direct_ones(spark):
    df = spark.createDataFrame([("a b a b c a b",), ("a",), ("",), (None,), ("b c d e",)], "text string")
    for order in (1, 2, 3, 4):
        direct = lm.grams(df, order).groupBy(*lm.GRAM_KEY).agg(F.count("*").alias("n"))
        assert sorted(map(tuple, lm.count_grams(df, order).collect())) == sorted(map(tuple, direct.collect()))


def test_private_grams_never_show(spark):
    df = spark.createDataFrame([("u", "public words secret code"), ("v", "secret code")], "unit string, text string")
    public = spark.createDataFrame([("public words of other texts",)], "text string")
    domain = lm.grams(public, 2).select(*lm.GRAM_KEY).distinct()
    dp = private.fit_dp_ngram_lm(df, "unit", domain)
    assert dp.counts.filter("token IN ('secret', 'code') OR context IN ('secret', 'code')").count() == 0
    assert dp.counts.count() == domain.count()
    assert sorted(dp.counts.collect()) == sorted(dp.counts.collect())  # stored: noise is drawn once


def test_heldout_loss_weighs_by_words(data):
    corpus, samples = data
    split = samples.withColumn("split", F.lit("val"))
    row = lm.heldout_loss(split, lm.fit_ngram_lm(corpus, 2), "sample_id").first()
    mean = brute_loss(2)
    assert row["predicted"] == 5
    assert row["loss"] == pytest.approx((2 * mean("a b a") + 3 * mean("b zz a c")) / 5)


def test_clipped_norms_and_noise_free_sums(spark):
    rows = [("u", "a", 3.0), ("u", "b", 4.0), ("v", "a", 0.1), ("u", "a", 0.0)]
    df = spark.createDataFrame(rows, "unit string, k string, x double")
    clipped = private.clip_contributions(df, "unit", ["k"], F.col("x"), 1.0)
    got = {(r["unit"], r["k"]): r["value"] for r in clipped.collect()}
    assert got == {("u", "a"): pytest.approx(0.6), ("u", "b"): pytest.approx(0.8), ("v", "a"): pytest.approx(0.1)}
    domain = spark.createDataFrame([("a",), ("b",), ("absent",)], "k string")
    exact = {r["k"]: r["noisy"] for r in private.noisy_sum(clipped, ["k"], domain, 0.0).collect()}
    assert exact == {"a": pytest.approx(0.7), "b": pytest.approx(0.8), "absent": 0.0}


def test_noise_is_standard_normal_and_secret_by_default(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    for seed in (5, None):
        row = df.select(private.gaussian(["k"], seed).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
        assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03


def test_ledger_adds_up(spark):
    df = spark.createDataFrame([(i, 4.0 + i) for i in range(10)], "release int, sigma double")
    rows = private.privacy_ledger(df, "release", "sigma").orderBy("release").collect()
    total = 0.0
    for r in rows:
        epsilon = math.sqrt(2 * math.log(1.25 / 1e-5)) / r["sigma"]
        total += epsilon
        assert r["epsilon_total"] == pytest.approx(total) and r["bound_holds"] == (epsilon < 1)


def test_dp_model_without_noise_or_clipping_equals_plain(spark):
    df = spark.createDataFrame([("u", "a b a c"), ("v", "b a b")], "unit string, text string")
    plain = lm.fit_ngram_lm(df)
    dp = private.fit_dp_ngram_lm(df, "unit", plain.counts.select(*lm.GRAM_KEY), clip=1e9, sigma=0.0)
    same = plain.counts.join(dp.counts.withColumnRenamed("n", "m"), lm.GRAM_KEY).filter("abs(n - m) < 1e-9")
    assert same.count() == plain.counts.count() == dp.counts.count()


def test_a_key_of_one_unit_never_shows(spark):
    rows = [(u, "common") for u in range(400)] + [(u, f"own{u}") for u in range(400)] + [(1, "common")] * 500 + [(None, "none")] * 600
    df = spark.createDataFrame(rows, "u int, k string")
    for seed in range(12):
        shown = private.private_keys(df, "u", ["k"], most=4, sigma=1.0, delta=1e-5, test_seed=seed).collect()
        assert [r["k"] for r in shown] == ["common"] and abs(shown[0]["units"] - 400) < 15
    # a unit's own keys are cut to the stated number
    many = spark.createDataFrame([(u, f"k{i}") for u in range(200) for i in range(10)], "u int, k string")
    kept = private.private_keys(many, "u", ["k"], most=2, sigma=0.001, delta=1e-5, test_seed=3)
    assert abs(sum(r["units"] for r in kept.collect()) - 400) < 1
    assert private.key_threshold(1.0, 1, 1e-5) > 5


def test_grams_outside_the_domain_use_up_no_norm(spark):
    df = spark.createDataFrame([("u", "a " * 3 + "b " * 4)], "u string, text string")
    domain = spark.createDataFrame([(1, "", "a")], "ord int, context string, token string")
    model = private.fit_dp_ngram_lm(df, "u", domain, 1, clip=2.0, sigma=0.0, test_seed=1)
    assert [(r["token"], r["n"]) for r in model.counts.collect()] == [("a", 2.0)]


@pytest.mark.parametrize("few", [True, False])
def test_heldout_loss_counts_grams_by_split(spark, data, monkeypatch, few):
    """No text is counted by itself; a key that repeats counts in each of its splits as often as it is there."""
    corpus, _ = data
    rows = [(i, "val" if i % 3 else "train", "a b a") for i in range(30)] + [(1, "train", "b zz a c"), (None, "val", "c c c c")]
    split = spark.createDataFrame(rows, "k int, split string, text string")
    kept, keep = {}, lm.materialise
    monkeypatch.setattr(lm, "materialise", lambda df, label: kept.setdefault(label, keep(df, label)))
    model = lm.fit_ngram_lm(corpus, 2)
    monkeypatch.setattr(lm, "fits_broadcast", lambda *a: few)
    got = {r["split"]: (r["loss"], r["predicted"]) for r in lm.heldout_loss(split, model, "k").collect()}
    assert kept["sample-grams"].count() == 2 * 2 + 2 * 3
    mean = brute_loss(2)
    short, long = 2 * mean("a b a"), 3 * mean("b zz a c")
    # key 1 is twice there, once in each split, with five words in all
    for name, texts in (("train", 10), ("val", 19)):
        assert got[name] == (pytest.approx((texts * short + short + long) / (2 * texts + 5)), 2 * texts + 5)


def test_whole_contributions_count_for_the_norm(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("u", "a " * 3 + "b " * 4)], "u string, text string")
    domain = spark.createDataFrame([(1, "", "a")], "ord int, context string, token string")
    model = private.fit_dp_ngram_lm(df, "u", domain, 1, clip=2.0, sigma=0.0, test_seed=1, whole=True)
    assert [(r["token"], r["n"]) for r in model.counts.collect()] == [("a", pytest.approx(2.0 * 3 / 5))]
    # so do those of the registered models
    spark.createDataFrame([(1, "s", "a " * 30 + "b " * 40)], "doc_id int, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(lm_queries, "SIGMA", 0.0)
    counts = lm_queries._dp_model(spark, str(tmp_path), domain, 1, 1).counts
    assert [r["n"] for r in counts.collect()] == [pytest.approx(30.0)]
    monkeypatch.setattr(lm_queries, "CLIP", 5.0)
    counts = lm_queries._dp_model(spark, str(tmp_path), domain, 1, 1).counts
    assert [r["n"] for r in counts.collect()] == [pytest.approx(3.0)]
    assert "SEMI JOIN" not in lm_queries.CONTRIB


def test_scoring_moves_no_model(spark, data, monkeypatch):
    """Joins of the sample's grams with the stored tables shuffle the sample's side only."""
    corpus, samples = data
    model = lm.fit_ngram_lm(corpus, 2)
    plans = []
    keep = lm.materialise

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, label)

    small = {r["sample_id"]: r["perplexity"] for r in lm.perplexity(samples, model).collect()}
    monkeypatch.setattr(lm, "materialise", noted)
    monkeypatch.setattr(lm, "fits_broadcast", lambda *a: False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["sample_id"]: r["perplexity"] for r in lm.perplexity(samples, model).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == pytest.approx(small)
    lines = next(p for name, p in plans if name == "gram-probabilities").splitlines()
    scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    assert len(scans) >= 3  # both orders and the contexts
    for scan in scans:
        depth = lines[scan].index("FileScan")
        for line in reversed(lines[:scan]):
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                depth = at
                assert "Exchange" not in line
                if "Join" in line:
                    break


def test_texts_are_tokenised_once(spark, tmp_path):
    spark.createDataFrame([("a b",)], "text string").write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts")
    for found in (lm._longest(df, 2, "text"), lm.grams(df, 2)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


@pytest.mark.parametrize("share", [2_000, 2])
def test_grams_of_many_samples_are_looked_up_once(spark, data, monkeypatch, share):
    corpus, _ = data
    samples = spark.createDataFrame([(f"s{i}", "a b a" if i % 2 else f"b zz{i} a c") for i in range(20)], "sample_id string, text string")
    monkeypatch.setattr("seepage.operators.skew.HEAVY_SHARE", share)
    monkeypatch.setattr(lm, "fits_broadcast", lambda *a: False)
    kept, keep = {}, lm.materialise
    monkeypatch.setattr(lm, "materialise", lambda df, label: kept.setdefault(label, keep(df, label)))
    got = {r["sample_id"]: r["perplexity"] for r in lm.perplexity(samples, lm.fit_ngram_lm(corpus, 2)).collect()}
    mean = brute_loss(2)
    assert got == {r["sample_id"]: pytest.approx(math.exp(mean(r["text"]))) for r in samples.collect()}
    # (a, b), (b, a), (a, c) and two of each zz
    assert kept["wanted-grams"].count() == 3 + 2 * 10
    assert kept["wanted-grams"].agg(F.sum("_n")).first()[0] == 10 * 2 + 10 * 3


def test_rankings_score_once(spark, tmp_path):
    spark.createDataFrame([(1, "s", "a b a c")], "doc_id int, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, "a b"), (1, 2, "b c a"), (2, 1, None)], "conv_id int, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("l8_five_rankings", "l8_six_rankings"):
        out = lm_queries.QUERIES[name](spark, str(tmp_path))
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == 3 * (5 if "five" in name else 6)


def test_keys_outside_a_domain_count_for_the_norm_only(spark):
    df = spark.createDataFrame([("u", "a", 3.0), ("u", "b", 4.0), (None, "a", 1.0)], "unit string, k string, x double")
    domain = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    got = private.clip_contributions(df, "unit", ["k"], F.col("x"), 1.0, domain).collect()
    whole = private.clip_contributions(df, "unit", ["k"], F.col("x"), 1.0).filter("k = 'a'").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, whole), key=str)
    assert {r["unit"]: r["value"] for r in got}["u"] == pytest.approx(0.6)


ODD = ["a b a c", "b\u2003a\x1cb", None, "", "c", "x<|endoftext|>y x", "\u00e9 \u180e z \u00e9 \u180e z", "a b a c"]


def _plain_grams(rows, order):
    """Grams by unit from the definition, each text as often as it counts."""
    found, totals = Counter(), Counter()
    for unit, text, times in rows:
        ws = (text or "").replace("<|endoftext|>", " <|endoftext|> ").split()
        for k in range(1, order + 1):
            for i in range(k - 1, len(ws)):
                found[unit, k, " ".join(ws[i - k + 1 : i]), ws[i]] += times
                totals[unit, k, " ".join(ws[i - k + 1 : i])] += times
    return found, totals


@pytest.mark.parametrize("order", [1, 2, 3])
def test_keyed_grams_equal_the_definition(spark, order):
    rows = [(["u", "v", None][i % 3], text, 1 + i % 2) for i, text in enumerate(ODD * 3)]
    df = spark.createDataFrame(rows, "unit string, text string, times int").repartition(3)
    found, totals = _plain_grams(rows, order)
    told = lm.keyed_grams(df, order, by="unit", times=F.col("times"))
    got = {tuple(r)[:4]: r["n"] for r in lm.unkeyed(told, "_by").collect()}
    assert got == dict(found) and told.count() == len(found)
    held = told.filter("total IS NOT NULL").collect()
    assert {(r["_by"], r["ord"], r["key"]): r["total"] for r in held} == {k: n for k, n in totals.items() if k[1] > 1}
    assert len(held) == len({k for k in totals if k[1] > 1})
    # the part is what scoring computes of the key
    assert told.filter(F.col("part") != lm._part(F.col("key"))).count() == 0
    # words are split as everywhere else
    plain = lm.grams(df.select("text"), order).groupBy(*lm.GRAM_KEY).count()
    assert sorted(map(tuple, lm.unkeyed(lm.keyed_grams(df, order)).collect())) == sorted(map(tuple, plain.collect()))


def test_groups_without_room_in_one_number():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500), rng.integers(0, 3, 500), rng.integers(0, 5, 500)]
    weights = rng.integers(1, 9, 500)
    for use in (None, weights):
        short = lm._grouped([(c, 5) for c in columns], use)
        long = lm._grouped([(c, 1 << 40) for c in columns], use)
        want = Counter()
        for i, row in enumerate(zip(*(c.tolist() for c in columns))):
            want[row] += 1 if use is None else int(weights[i])
        for found, n in (short, long):
            assert dict(zip(zip(*(c.tolist() for c in found)), n.tolist())) == dict(want)


def test_grams_counted_in_several_goes_add_up():
    texts = [("u", t, 1) for t in ODD * 2]
    blobs = {}
    for at in range(0, len(texts), 3):
        part = texts[at : at + 3]
        table = pa.table({"_by": pa.array([u for u, _, _ in part]), "text": pa.array([t for _, t, _ in part], pa.string())})
        for batch in lm._packed(table, 2, 1):
            for p, b in zip(batch.column("part").to_pylist(), batch.column("grams").to_pylist()):
                blobs.setdefault(p, []).append(b)
    got = Counter()
    for p, held in blobs.items():
        for r in lm._merged(p, held).to_pylist():
            got[r["_by"], r["ord"], r["key"] if r["ord"] > 1 else "", r["token"] if r["ord"] > 1 else r["key"]] += r["n"]
    assert got == _plain_grams(texts, 2)[0]


def test_heldout_loss_moves_no_gram_to_its_probability(spark, data, monkeypatch):
    corpus, samples = data
    model = lm.fit_ngram_lm(corpus, 2)
    plans, keep = {}, lm.materialise

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, label)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(lm, "materialise", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        row = lm.heldout_loss(samples.withColumn("split", F.lit("val")), model, "sample_id").first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    mean = brute_loss(2)
    assert row["loss"] == pytest.approx((2 * mean("a b a") + 3 * mean("b zz a c")) / 5)
    for label in ("sample-grams", "context-losses"):
        plan = plans[label]
        assert plan.count("Bucketed: true") == 2 and plan.index("Exchange") < plan.index("Join"), plan
        assert "Exchange" not in plan[plan.index("Join") :]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_texts_of_a_key_that_is_there_once_stay(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "b", "z"), (2, "b", "z"), (None, "a", "w")]
    df = spark.createDataFrame(rows, "k int, split string, text string")
    got = Counter({(r["split"], r["text"], r["_times"]): 0 for r in lm._weighed(df, "k", "split").collect()})
    got.update((r["split"], r["text"], r["_times"]) for r in lm._weighed(df, "k", "split").collect())
    assert got == Counter({("a", "x", 1): 1, ("a", "y", 1): 1, ("b", "y", 2): 1, ("a", "z", 1): 2, ("b", "z", 2): 2})


def test_whole_contributions_move_as_counted(spark, monkeypatch):
    """They equal those that are summed from the grams, also of no unit, and no single gram is shuffled."""
    rows = [("u", "a b a b c"), ("v", "a " * 9), (None, "b c"), ("u", None)]
    df = spark.createDataFrame(rows, "unit string, text string")
    domain = lm.grams(spark.createDataFrame([("a b c d",)], "text string"), 2).select(*lm.GRAM_KEY).distinct()
    plans, keep = {}, private.materialise

    def noted(frame, label):
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return keep(frame, label)

    monkeypatch.setattr(private, "materialise", noted)
    got = private.fit_dp_ngram_lm(df, "unit", domain, 2, clip=2.0, sigma=0.0, test_seed=1, whole=True)
    assert "Aggregate" not in plans["contributions"] and plans["contributions"].count("Exchange") == 1
    clipped = private.clip_contributions(lm.grams(df, 2, ["unit"]), "unit", lm.GRAM_KEY, F.lit(1), 2.0, domain)
    sums = clipped.groupBy(*lm.GRAM_KEY).agg(F.sum("value").alias("v"))
    want = {tuple(r)[:3]: r["v"] for r in domain.join(sums, lm.GRAM_KEY, "left").fillna(0.0).collect()}
    assert {tuple(r)[:3]: r["n"] for r in got.counts.collect()} == pytest.approx(want)
    # the stored model scores as the plain one does
    assert {r["token"]: r["n"] for r in got.of_order(1).collect()} == pytest.approx({k[2]: v for k, v in want.items() if k[0] == 1})
