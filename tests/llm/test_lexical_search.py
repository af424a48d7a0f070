"""Dual-tree search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import frame, rows

from seepage.llm import lexical_search, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    total, n_docs = sum(sum(c.values()) for _, c in counts), sum(bool(c) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        wanted = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(plain_terms(text))}
        scored = []
        for i, c in counts:
            if i is None or not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def items_of(data, seed=3):
    rnd = random.Random(seed)
    texts = [t for _, t in data if t]
    items = [(i, " ".join(rnd.choice(texts).split()[:12]) + " Élan WORD") for i in range(30)]
    return [*items, (30, None), (31, ""), (32, "..!"), (33, "nowhere"), (34, "the the THE"), (34, "of"), (35, items[0][1]), (None, "the")]


@pytest.mark.parametrize(("block", "seed_docs", "item_bytes"), [(4096, 20_000, 8 << 20), (40, 10, 8 << 20), (40, 20_000, 2000)])
def test_search_equals_plain_scores(spark, monkeypatch, block, seed_docs, item_bytes):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "SEED_DOCS", seed_docs)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", item_bytes)
    data = rows(n=200)
    pairs = [(d[0], d[1]) for d in data]
    items = items_of(pairs)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, doc_id string, score int")
    got = lexical_search.search(frame(spark, data), table)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_search(pairs, items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    assert lexical_search.search(frame(spark, []), items).count() == 0
    assert lexical_search.search(frame(spark), items.limit(0)).count() == 0
    assert lexical_search.search(frame(spark, [(1, "...", "en", "s", 3, *[None] * 7)]), items).count() == 0


def test_terms_of_bytes():
    for text in ("a_b-C9 É x y Ünï日本 0;A\x00b\x7fc~d", "", "İı ſ"):
        assert [t.decode() for t in lexical_search.terms(text.encode())] == plain_terms(text)


def test_bounds_prune_batches_and_lose_nothing():
    rnd = np.random.default_rng(4)
    words = [f"w{i}".encode() for i in range(2000)]
    weights = 1 / np.arange(1, 2001)
    weights /= weights.sum()
    docs = [rnd.choice(2000, size=60, p=weights) for _ in range(6000)]
    items = lexical_search.Items([b" ".join(words[t] for t in docs[i][:20]) for i in range(0, 6000, 100)])
    found = [[(items.number[words[t]], n) for t, n in sorted(Counter(d.tolist()).items()) if words[t] in items.number] for d in docs]
    df = Counter(t for f in found for t, _ in f)
    weight = items.weigh(len(docs), df)
    search = lexical_search.Search(items, weight, 10, np.zeros(60, np.int64))
    for at in range(0, 6000, 1500):
        part = [(i, f) for i, f in enumerate(found[at : at + 1500], at) if f]
        start = np.cumsum([0, *(len(f) for _, f in part)])
        term = np.array([t for _, f in part for t, _ in f])
        value = np.array([(10**9 * n) // (1000 * n + 800) for _, f in part for _, n in f])
        search.block(np.array([i for i, _ in part]), start, term, value)
    assert search.scored < 0.5 * search.pairs
    for k, item in enumerate(items.leaves.tolist()):
        wanted = {t for t, _ in found[item * 100]} & {items.number[words[x]] for x in docs[item * 100][:20]}
        plain = sorted((-sum(int(weight[t]) * ((10**9 * n) // (1000 * n + 800)) for t, n in f if t in wanted), i) for i, f in enumerate(found))
        assert [(-s, i) for s, i in plain[:10]] == list(zip(*(x.tolist() for x in search.best[k]), strict=True))


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(db.execute(queries.ORACLES["op13_lexical_search"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["op13_lexical_search"](spark, SF).collect())) == want
