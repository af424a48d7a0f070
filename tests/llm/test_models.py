"""Top-k search, quality model, source mixing, the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import frame, rows
from pyspark.sql import functions as F

from seepage.llm import mixing, pivot_search, quality_model, queries

SF = "/root/testdata/sf0.001"


def plain_top(data, k, every=5):
    valid = {}
    for i, v in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * x) for x in v]
            valid[i] = max(valid.get(i, q), q)
    width = max(map(len, valid.values()), default=0)
    padded = {i: np.array(v + [0] * (width - len(v)), object) for i, v in valid.items()}
    out = set()
    for q in padded:
        if q % every == 0:
            scored = sorted((-int(padded[q] @ padded[i]), i) for i in padded if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block", [8192, 16])
def test_top_k_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_search, "BLOCK", block)
    monkeypatch.setattr(pivot_search, "SAMPLE", 40)
    monkeypatch.setattr(pivot_search, "QUERIES", 7)
    rnd = random.Random(3)
    data = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    data += [(200 + i, [0.25] * 6) for i in range(40)]  # ties
    data += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [1.0, 2.0]), (305, [1.0] * 6), (305, [2.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id bigint, embedding array<double>, label int, block string")
    got = pivot_search.top_k(df, F.col("vec_id") % 5 == 0, k=20)
    assert {(r.query_id, r["rank"], r["id"], r.score) for r in got.collect()} == plain_top(data, 20)


def test_top_k_of_few_large_or_no_vectors(spark):
    shape = "vec_id bigint, embedding array<double>"
    few = [(0, [1e7 + 1, 2e7]), (5, [-3e7, 1e7]), (7, [1e7, 1e7 + 3])]  # products beyond 2**53
    got = pivot_search.top_k(spark.createDataFrame(few, shape), F.col("vec_id") % 5 == 0)
    assert {(r.query_id, r["rank"], r["id"], r.score) for r in got.collect()} == plain_top(few, 20)
    assert pivot_search.top_k(spark.createDataFrame([], shape), F.col("vec_id") % 5 == 0).count() == 0
    assert pivot_search.top_k(spark.createDataFrame([(0, [1.0])], shape), F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_never_fall_short():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-40, 40, (300, 16))
    pivots = pivot_search.spread_pivots(x[:100], 8)
    d, norm = pivot_search.to_pivots(x, pivots), (x.astype(float) ** 2).sum(axis=1)
    assert (pivot_search.bounds(norm, d, norm, d, d) >= x @ x.T).all()
    assert len({tuple(p) for p in pivots}) == 8


def test_quality_model_on_held_out_rows(spark):
    scored = queries.QUERIES["op7_quality_model"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = scored.filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_quality_model_takes_any_rows(spark):
    model = quality_model.train(frame(spark), spark.createDataFrame([], "doc_id bigint, quality int"))
    got = quality_model.score(frame(spark), model).collect()
    assert len(got) == len(rows()) and all(r.score == 0.5 for r in got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (999, 0)], "doc_id bigint, quality int")
    got = quality_model.score(frame(spark), quality_model.train(frame(spark), labels)).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.score(frame(spark, []), model).count() == 0


def test_pairs_are_learned():
    rnd = np.random.default_rng(2)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_scores_equal_plain_lookups():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(800, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = quality_model.fit(x, y)
    rows = np.concatenate([x[:50], rnd.normal(size=(20, 4)) * 100])
    for row, got in zip(rows, model.score(rows), strict=True):
        total = model.base
        for j, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            total += table[sum(e <= row[j] for e in edges)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(e <= row[a] for e in model.pair_edges[a]), sum(e <= row[b] for e in model.pair_edges[b])]
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over


def test_mix_meets_its_targets(spark):
    data = rows(n=300)
    got = mixing.mixed_words(frame(spark, data), block=8).collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in data)
    size_of = Counter()
    for d in data:
        size_of[d[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    targets = plain_targets(size_of)
    source_of = {d[0]: d[3] for d in data}
    taken, seen = Counter(), defaultdict(set)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        if r.doc_id is not None:
            source = source_of[r.doc_id]
            assert r.source_size == size_of[source] and math.isclose(r.target, targets[source])
            seen[source].add(r.target)
            taken[source] += r.taken
    taken["src0"] += sum(r.taken for r in got if r.doc_id is None and r.source_size == size_of["src0"])
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 16, source
    again = mixing.mixed_words(frame(spark, data).repartition(7), block=8).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 1000):
        got = [r.x for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x")).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_mix_of_nothing(spark):
    assert mixing.mixed_words(frame(spark, [])).count() == 0
    blank = [(1, None, "en", "a", 0, *[None] * 7), (2, " ", "en", None, 0, *[None] * 7)]
    assert [(r["size"], r.target, r.taken) for r in mixing.mixed_words(frame(spark, blank)).collect()] == [(0, 0.0, 0)] * 2


def test_mixed_texts_are_the_words_taken(spark):
    data = rows(n=120)
    words = Counter()
    for r in mixing.mixed_documents(frame(spark, data), block=8).collect():
        words[r.doc_id, r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = Counter()
    source_of = {d[0]: d[3] for d in data}
    for r in mixing.mixed_words(frame(spark, data), block=8).collect():
        if r.taken:
            want[r.doc_id, source_of[r.doc_id] if r.doc_id is not None else "src0"] += r.taken
    assert words == want


def test_columns_of_any_name_pass_through(spark):
    clash = "_size _row _id _nth _source _words _parts size source_ id digest doc copy parts nth".split()
    data = [(d[0], d[1], d[3]) for d in rows(n=40)]
    df = spark.createDataFrame([(*d, *["mine"] * len(clash)) for d in data], "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in clash))
    got = mixing.mixed_documents(df, block=8)
    assert got.columns == df.columns
    plain = mixing.mixed_documents(df.select("doc_id", "text", "source"), block=8)
    found = got.collect()
    assert all(r[c] == "mine" for r in found for c in clash)
    assert sorted((repr(r.doc_id), r.text) for r in found) == sorted((repr(r.doc_id), r.text) for r in plain.collect())
    labels = spark.createDataFrame([(d[0], 1) for d in data if d[0] is not None], "doc_id bigint, quality int")
    assert quality_model.train(df.withColumn("_label", F.lit("x")), labels) is not None


def test_mix_query_is_native(spark):
    plan = queries.QUERIES["op10_mixing"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        assert after.count() > 0, name
        if name != "bpe_codec":
            assert after.columns == columns
            assert after.filter("n_chars <> char_length(text)").count() == 0
        before = after
    kept = corpus_pipeline.filter_quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    clean = docs.join(labels, "doc_id").filter("n_chars > 200").select("doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    assert corpus_pipeline.run(spark, SF).count() == before.count()


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    for data in (rows(), []):
        docs = frame(spark, data).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
