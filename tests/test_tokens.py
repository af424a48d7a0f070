import random
import re

import pytest
from pyspark.sql import functions as F

from seepage.functions.text import words
from seepage.operators import tokens


def stream(spark, sizes):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((i, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "k int, ids array<int>").repartition(3)


def test_pack_blocks_on_a_small_stream(spark):
    df = stream(spark, [5, 0, 1, 11, 4])
    for stride in (4, 2):
        rows = {r["block_id"]: (r["x"], r["y"]) for r in tokens.pack_blocks(df, "k", 4, stride).collect()}
        count = (21 - 4 - 1) // stride
        assert sorted(rows) == list(range(count))
        for k, (x, y) in rows.items():
            assert x == list(range(k * stride, k * stride + 4))
            assert y == [t + 1 for t in x]


def test_pack_blocks_of_a_short_stream_is_empty(spark):
    assert tokens.pack_blocks(stream(spark, [2, 1]), "k", 4, 4).count() == 0


def test_encode_decode_round_trip(spark):
    texts = ["b a  b", "", "c<|endoftext|>a", "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    vocab = tokens.build_vocab(df.filter("k < 3"))
    assert [(r["token"], r["token_id"], r["n"]) for r in vocab.orderBy("token_id").collect()] == [("a", 2, 2), ("b", 3, 2), ("c", 4, 1)]
    ids = tokens.encode(df, vocab, "k")
    assert {r["k"]: r["ids"] for r in ids.collect()} == {0: [3, 2, 3], 1: [], 2: [4, 1, 2], 3: [0]}
    back = {r["k"]: r["text"] for r in tokens.decode(ids, vocab, "k").collect()}
    assert back == {0: "b a b", 1: "", 2: "c <|endoftext|> a", 3: "<unk>"}
    assert tokens.build_vocab(df, max_size=1).count() == 1
    assert tokens.vocab_stats(vocab).first()["vocab_size"] == 5


def test_encode_by_shuffle_equals_broadcast(spark, monkeypatch):
    texts = ["the " * 50 + f"w{i % 7} x" + "<|endoftext|>" * 30 + " rare" * (i % 2) for i in range(40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    vocab = tokens.build_vocab(df, 2)
    ids = tokens.encode(df, vocab, "k")
    plain = {r["k"]: r["ids"] for r in ids.collect()}
    back = {r["k"]: r["text"] for r in tokens.decode(ids, vocab, "k").collect()}
    assert plain[0].count(tokens.END_ID) == 30 and tokens.UNKNOWN_ID in plain[1] and plain[40] == []
    monkeypatch.setattr(tokens, "VOCAB_BYTES", -1)
    shuffled = tokens.encode(df, vocab, "k")
    assert {r["k"]: r["ids"] for r in shuffled.collect()} == plain
    assert {r["k"]: r["text"] for r in tokens.decode(shuffled, vocab, "k").collect()} == back


def test_only_rare_words_of_a_large_vocabulary_move(spark, monkeypatch):
    """The frequent part is broadcast, rows with equal keys or none stay rows, and the rest is asked once a chunk."""
    texts = [" ".join(f"w{j}" for j in range(30) for _ in range(40)) + f" r{i % 9} r{i % 9} <unk>{tokens.END}" for i in range(60)] + ["", None, "zz"]
    rows = [(None if i % 10 == 0 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, text string").repartition(5)
    vocab = tokens.build_vocab(df.filter("text <> 'zz'")).cache()
    told = lambda x, c: sorted(((r["k"] is None, r["k"] or 0, r[c]) for r in x.collect()))
    whole = tokens.encode(df, vocab, "k")
    ids, back = told(whole, "ids"), told(tokens.decode(whole, vocab, "k"), "text")
    moved, keep = [], tokens.materialise
    monkeypatch.setattr(tokens, "materialise", lambda df, label: moved.append(keep(df, label)) or moved[-1])
    monkeypatch.setattr(tokens, "VOCAB_BYTES", 30 * 19 + 20)
    monkeypatch.setattr(tokens, "CHUNK_ITEMS", 5_000)
    parted = tokens.encode(df, vocab, "k")
    assert told(parted, "ids") == ids
    assert told(tokens.decode(parted, vocab, "k"), "text") == back
    assert [set(m.columns) for m in moved] == [{"_chunk", "token"}, {"_chunk", "token_id"}]
    assert moved[0].filter("token RLIKE '^w[0-9]$'").count() == 0 and moved[0].count() < 300
    vocab.unpersist()


def test_words_leave_no_empty_ones(spark):
    """Nor is a function interpreted for each word."""
    df = spark.createDataFrame([(0, " a  b\t"), (1, ""), (2, None), (3, "   "), (4, "\u00a0a\u2003")], "k int, text string")
    plan = df.select(words(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    assert {r["k"]: r["w"] for r in df.select("k", words(F.col("text")).alias("w")).collect()} == {0: ["a", "b"], 1: [], 2: None, 3: [], 4: ["a"]}


def test_reserved_words_stay_out_of_the_shuffle(spark, monkeypatch):
    """Nine tenths of all words are the end mark, and no shuffle partition gets them by key."""
    monkeypatch.setattr(tokens, "VOCAB_BYTES", -1)
    df = spark.createDataFrame([(i, tokens.END * 90 + f" w{i % 9}" * 10) for i in range(50)], "k int, text string")
    placed = df.select("k", F.posexplode_outer(tokens.token_words(F.col("text"))).alias("_at", "token"))
    coded = tokens._by_lookup(placed, tokens.build_vocab(df), "token", "token_id", [tokens.END, tokens.UNKNOWN])
    assert coded.count() == 5_000 and coded.filter("token_id IS NULL").count() == 4_500


def test_a_rare_word_enters_the_shuffle_once_a_row(spark, monkeypatch):
    """No second copy of the word goes along, and words without a place in the vocabulary, or null, stay rows."""
    monkeypatch.setattr(tokens, "VOCAB_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, w) for i, w in enumerate([f"w{j % 5}" for j in range(20)] + ["zz", None, tokens.END, tokens.UNKNOWN])]
        df = spark.createDataFrame(rows, "_chunk long, token string")
        vocab = tokens.build_vocab(df.select(F.col("token").alias("text")).filter("text <> 'zz'")).cache()
        coded = tokens._by_lookup(df, vocab, "token", "token_id", [tokens.END, tokens.UNKNOWN])
        plan = coded._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [x.split(", ") for x in re.findall(r"Exchange\nInput \[\d+\]: \[(_chunk[^\]]*)\]", plan)]
        assert moved and all(len(columns) == 2 for columns in moved)
        ids = {r["token"]: r["token_id"] for r in vocab.collect()}
        assert sorted(((r["_chunk"], r["token"], r["token_id"]) for r in coded.collect()), key=lambda r: r[0]) == [(i, w, ids.get(w)) for i, w in rows]
        vocab.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_padding_sides_and_masks(spark):
    df = spark.createDataFrame([(1, [7, 8]), (2, [1, 2, 3, 4, 5])], "k int, ids array<int>")
    right = {r["k"]: (r["input_ids"], r["attention_mask"]) for r in tokens.pad_fixed(df, 4, 0).collect()}
    assert right == {1: ([7, 8, 0, 0], [1, 1, 0, 0]), 2: ([1, 2, 3, 4], [1, 1, 1, 1])}
    left = tokens.pad_fixed(df, 4, 0, left=True).filter("k = 1").first()
    assert (left["input_ids"], left["attention_mask"]) == ([0, 0, 7, 8], [0, 0, 1, 1])


def test_collate_pads_to_its_own_batch(spark):
    df = spark.createDataFrame([(i, [1] * (i + 1)) for i in range(5)], "k int, ids array<int>")
    rows = tokens.collate(df, "k", batch=2, pad_id=9).orderBy("k").collect()
    assert [len(r["input_ids"]) for r in rows] == [2, 2, 4, 4, 5]
    assert rows[0]["labels"] == rows[0]["input_ids"] == [1, 9] and rows[0]["attention_mask"] == [1, 0]


def test_windows_equal_slices_of_the_stream(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 3, 40, 2500]) for _ in range(30)]
    df = stream(spark, sizes)
    places = tokens.running_totals(df.select("k", F.size("ids").alias("_size")), ["k"], "_size")
    total = sum(sizes)
    starts = [(i, rng.randrange(total - 50)) for i in range(60)] + [(99, 0)]
    windows = spark.createDataFrame(starts, "win_id long, start long")
    out = {r["win_id"]: r["items"] for r in tokens.gather_windows(df, places, windows, 50, "k", "ids").collect()}
    assert out == {i: list(range(s, s + 50)) for i, s in starts}


def test_random_blocks_shift_by_one(spark):
    rows = tokens.random_blocks(stream(spark, [30, 5, 100]), "k", 8, 20, 1).collect()
    assert len(rows) == 20
    assert all(r["x"] == list(range(r["start"], r["start"] + 8)) and r["y"] == [t + 1 for t in r["x"]] for r in rows)


def test_random_word_windows_have_the_asked_length(spark):
    df = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(200)))], "k int, text string")
    rows = tokens.random_word_windows(df, "k", 15, 10).collect()
    assert len(rows) == 15
    for r in rows:
        first = int(r["words"][0][1:])
        assert r["prompt"] == " ".join(f"w{i}" for i in range(first, first + 10))


def test_stats_and_shards(spark):
    df = stream(spark, [5, 0, 1, 11, 4]).withColumn("split", F.lit("train"))
    row = tokens.corpus_stats(df, block=4, stride=4, batch=3).first()
    assert (row["tokens"], row["examples"], row["batches_per_epoch"], row["tokens_per_step"]) == (21, 4, 2, 12)
    placed = tokens.concat_stream(df, "k", 2).orderBy("k").collect()
    assert [(r["offset"], r["shard"]) for r in placed] == [(0, 0), (5, 0), (5, 0), (6, 1), (17, 1)]
    ended = tokens.append_end(df).orderBy("k").first()
    assert ended["ids"][-1] == tokens.END_ID and ended["len"] == 6


def test_shards_are_one_file_each_and_read_back(spark, tmp_path):
    df = stream(spark, [5, 0, 1, 11, 4, 7, 2])
    path = str(tmp_path / "shards")
    manifest = tokens.write_shards(df, "k", path, 3).orderBy("shard").collect()
    assert [(r["shard"], r["start"], r["n_rows"], r["n_tokens"]) for r in manifest] == [(0, 0, 3, 6), (1, 6, 2, 15), (2, 21, 2, 9)]
    assert len({r["path"] for r in manifest}) == 3
    [data] = (tmp_path / "shards").glob("data-*")
    assert all(len(list(d.glob("part-*"))) == 1 for d in data.glob("shard=*"))
    back = tokens.read_shards(spark, path).orderBy("offset", "pos").collect()
    assert [t for r in back for t in r["ids"]] == list(range(30))
    assert {r["shard"] for r in tokens.read_shards(spark, path, 1, 1).collect()} == {1}
    again = tokens.write_shards(df.repartition(5), "k", path, 3).orderBy("shard").collect()
    assert [r[:5] for r in again] == [r[:5] for r in manifest] and tokens.read_shards(spark, path).count() == 7
    assert tokens.read_shards(spark, path, 9).count() == 0


def test_shards_that_differ_from_their_manifest_are_an_error(spark, tmp_path):
    path = str(tmp_path / "shards")
    tokens.write_shards(stream(spark, [3, 4]), "k", path, 2)
    spark.read.parquet(f"{path}/manifest").withColumn("checksum", F.lit(1).cast("bigint")).write.parquet(f"{path}/other")
    (tmp_path / "shards" / "manifest").rename(tmp_path / "shards" / "old")
    (tmp_path / "shards" / "other").rename(tmp_path / "shards" / "manifest")
    with pytest.raises(ValueError, match="differ"):
        tokens.read_shards(spark, path)
    assert tokens.read_shards(spark, path, check=False).count() == 2


def test_windows_of_a_stored_stream_read_their_pages_only(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 3, 40, 2500]) for _ in range(40)]
    stored = tokens.store_stream(stream(spark, sizes), "k", page=256)
    assert stored.total == sum(sizes) and stored.rows.agg(F.sum(F.size("items"))).first()[0] == sum(sizes)
    starts = [(i, rng.randrange(stored.total - 50)) for i in range(6)] + [(9, 0)]
    windows = spark.createDataFrame(starts, "win_id long, start long")
    out = tokens.stream_windows(stored, windows, 50)
    assert {r["win_id"]: r["items"] for r in out.collect()} == {i: list(range(s, s + 50)) for i, s in starts}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    pages = {p for _, s in starts for p in (s // 256, (s + 49) // 256)}
    assert stored.rows.select("page").distinct().count() == -(-stored.total // 256) > 3 * len(pages)
    blocks = tokens.random_blocks(stored, "k", 8, 10, 1).collect()
    assert sorted(blocks) == sorted(tokens.random_blocks(stream(spark, sizes), "k", 8, 10, 1).collect())


def test_coding_of_batches_with_gaps(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "", "zz a", "b " * 50])], "k int, text string").repartition(2)
    vocab = spark.createDataFrame([("a", 7, 1), ("b", 3, 1)], "token string, token_id int, n long")
    ids = tokens.encode(df, vocab, "k")
    assert {r["k"]: r["ids"] for r in ids.collect()} == {0: [7, 3], 1: [], 2: [], 3: [0, 7], 4: [3] * 50}
    assert {r["k"]: r["text"] for r in tokens.decode(ids, vocab, "k").collect()}[3] == "<unk> a"
    none = vocab.limit(0)
    assert {r["k"]: r["ids"] for r in tokens.encode(df, none, "k").collect()}[0] == [0, 0]
