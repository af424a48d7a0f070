"""Order MinHash: against a plain version, and its sense of order."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import frame, rows
from pyspark.sql import functions as F

from seepage.llm import order_minhash, queries

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 33)) * int(order_minhash.SPREAD)) & M64
    x = ((x ^ (x >> 29)) * int(order_minhash.TURN)) & M64
    return x ^ (x >> 32)


def plain_fingerprint(text):
    """Every k-mer one by one: number it, order all by each hash, take two, put them into text order."""
    base, k = int(order_minhash.BASE), order_minhash.KMER
    codes = [ord(c) + 1 for c in text]
    if 0 < len(codes) < k:
        codes += [0] * (k - len(codes))
    seen, grams, numbered = Counter(), [], []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * base + c) & M64
        h = mixed(h)
        grams.append(h)
        numbered.append(mixed((h + seen[h] * base) & M64) >> 32)
        seen[h] += 1
    out = ""
    for factor, mask in zip(order_minhash.FACTORS.tolist(), order_minhash.MASKS.tolist(), strict=True):
        best = sorted(range(len(grams)), key=lambda i: (((numbered[i] ^ mask) * factor) & 0xFFFFFFFF, i))[:2]
        h = 0
        for kmer in [0] * (2 - len(best)) + [grams[i] for i in sorted(best)]:
            h = mixed((h * base + kmer) & M64)
        out += f"{h >> 48:04x}"
    return out


def share(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def plain_rows(data):
    ordered = sorted(data, key=lambda d: (d[0] is None, d[0] or 0, d[2], d[1] is not None, (d[1] or "").encode()))
    texts = [d[1] or "" for d in ordered]
    prints = {t: plain_fingerprint(t) for t in set(texts)}
    out = []
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        a, b = prints[text], plain_fingerprint(new)
        out.append((ordered[i][0], len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, share(a, b), share(a, prints[after])))
    return out


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_edited_fingerprints_equal_plain_ones(spark, parts):
    data = [(d[0], d[1]) for d in rows() if d[1] is None or len(d[1]) < 3000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in data], "doc_id bigint, text string, fingerprint string, part string")
    ties = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.col("text").cast("binary")).alias("h")).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = order_minhash.edited_fingerprints(df.repartition(5))
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        got = sorted(map(tuple, got.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(plain_rows([(i, t, ties[i, t]) for i, t in data]), key=repr)
    assert got == want


def test_few_rows(spark):
    shape = "doc_id bigint, text string"
    assert order_minhash.edited_fingerprints(spark.createDataFrame([], shape)).count() == 0
    [one] = order_minhash.edited_fingerprints(spark.createDataFrame([(4, "abcd")], shape)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and one.near_next == 1.0
    [none] = order_minhash.edited_fingerprints(spark.createDataFrame([(None, None)], shape)).collect()
    assert (none.n_chars, none.near_edited, none.near_next) == (0, 1.0, 1.0)


def test_long_texts_and_lent_stretches(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcd ") for _ in range(9000)) * 2
    new, kept = order_minhash.edited(text, "y" * 20000)
    sketch = order_minhash.Sketch(text)
    lent = order_minhash.Sketch(new, sketch, kept)
    assert lent.hex() == order_minhash.Sketch(new).hex() == plain_fingerprint(new)
    monkeypatch.setattr(order_minhash, "SHORT", 16)
    assert order_minhash.Sketch(text).hex() == sketch.hex()


def test_fingerprints_and_likeness_frames(spark):
    data = rows()
    got = order_minhash.fingerprints(frame(spark, data)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted(
        (d[0] is None, d[0] or 0, order_minhash.Sketch(d[1] or "").hex()) for d in data
    )
    a, b = order_minhash.Sketch("x" * 40 + "some words here and more"), order_minhash.Sketch("some words here and more " * 2)
    row = spark.createDataFrame([(a.hex(), b.hex())], "a string, b string").select(order_minhash.likeness(F.col("a"), F.col("b")).alias("s")).first()
    assert row.s == a.likeness(b) == share(a.hex(), b.hex())


def test_likeness_follows_edits_and_order():
    rnd = random.Random(5)
    base = [rnd.choice("abcdefghijklmnop ") for _ in range(4000)]
    levels = []
    for edits in (0, 10, 40, 160, 1000):
        copy = list(base)
        for at in rnd.sample(range(len(copy)), edits):
            copy[at] = "#"
        levels.append(order_minhash.Sketch("".join(base)).likeness(order_minhash.Sketch("".join(copy))))
    assert levels[0] == 1.0 and all(a > b for a, b in zip(levels, levels[1:], strict=False)) and levels[-1] < 0.1
    # the k-mers of swapped halves are the same ones, but about half of the pairs turn round
    text = "".join(base)
    swapped = text[2000:] + text[:2000]
    assert 0.3 < order_minhash.Sketch(text).likeness(order_minhash.Sketch(swapped)) < 0.7
    # repeats count
    assert order_minhash.Sketch("abcdefgh" * 10).likeness(order_minhash.Sketch("abcdefgh" * 200)) < 0.3


def test_query_returns_every_document(spark):
    out = queries.QUERIES["op11_order_minhash"](spark, SF)
    got = out.collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.mean([r.near_edited for r in got if r.n_chars > 200]) > 0.3
