import hashlib

from pyspark.sql import functions as F

from seepage.operators import sample
from seepage.operators.position import running_totals, with_position
from seepage.operators.skew import lookup, top_per_group


def numbered(spark, n, parts=7):
    return spark.range(n).repartition(parts).select((F.col("id") * 37 % 1009).alias("k"), (F.col("id") % 5).alias("v"))


def test_positions_are_contiguous_in_order(spark):
    rows = with_position(numbered(spark, 500), ["k"]).orderBy("k").collect()
    assert [r["pos"] for r in rows] == list(range(500))


def test_running_totals_are_prefix_sums(spark):
    rows = running_totals(numbered(spark, 300), ["k"], "v").orderBy("k").collect()
    total = 0
    for i, r in enumerate(rows):
        assert (r["pos"], r["offset"], r["n_rows"]) == (i, total, 300)
        total += r["v"]
    assert {r["n_measure"] for r in rows} == {total}


def test_shuffle_is_the_md5_permutation(spark):
    rows = sample.shuffle(numbered(spark, 400), "k").orderBy("pos").collect()
    keys = [r["k"] for r in rows]
    assert [r["pos"] for r in rows] == list(range(400))
    assert keys == sorted(keys, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))


def test_samples_are_exact_prefixes(spark):
    df = numbered(spark, 410)
    order = [r["k"] for r in sample.shuffle(df, "k").orderBy("pos").collect()]
    picked = [r["k"] for r in sample.sample_n(df, 33, "k").orderBy("pos").collect()]
    assert picked == order[:33]
    assert sample.sample_fraction(df, 20, "k").count() == 410 // 20
    split = sample.random_split(df, 5, 10_000, "k", seed=42)
    assert [r["k"] for r in split.filter("split = 'val'").collect()] == order[:1]


def test_split_sizes_add_up(spark):
    split = sample.split_by_position(numbered(spark, 333), ["k"])
    counts = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": int(333 * 0.9), "val": 333 - int(333 * 0.9)}
    last = split.filter("split = 'train'").agg(F.max("k")).first()[0]
    first = split.filter("split = 'val'").agg(F.min("k")).first()[0]
    assert last < first


def test_head_and_rest_are_disjoint(spark):
    df = numbered(spark, 50)
    assert sample.head(df, 10, ["k"]).join(sample.rest(df, 10, ["k"]), "k").count() == 0
    assert sample.rest(df, 10, ["k"]).count() == 40


def test_top_n_puts_nan_first_and_null_last(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 1.0), (5, float("inf"))], "k int, m double")
    assert [r["k"] for r in sample.top_n(df, "m", 5, "k").orderBy("rank").collect()] == [2, 5, 1, 4, 3]


def test_merge_ordered_adds_blank_lines(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "line_no long, text string")
    b = spark.createDataFrame([(0, "z")], "line_no long, text string")
    merged = sample.merge_ordered({"b": b, "a": a}).orderBy("file_ord", "line_no").collect()
    assert [r["text"] for r in merged] == ["x", "y", "", "", "z", "", ""]


def test_lookup_serves_heavy_light_and_missing_keys(spark):
    hot = spark.range(9000).select(F.lit("hot").alias("w"), "id")
    cold = spark.range(100).select(F.concat(F.lit("c"), F.col("id")).alias("w"), "id")
    facts = hot.unionByName(cold).unionByName(spark.createDataFrame([("none", 1), (None, 2)], "w string, id long"))
    table = facts.filter("w != 'none'").groupBy("w").agg(F.count("*").alias("n")).withColumn("v", F.upper("w"))
    out = lookup(facts, table, "w", "n", ["v"], 9102)
    assert out.count() == 9102
    assert out.filter("v = upper(w)").count() == 9100
    assert lookup(facts, table, "w", "n", ["v"], 9102, "inner").count() == 9100


def test_top_per_group_equals_plain_ranking(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 31 % 101).alias("m"))
    out = top_per_group(df, ["g"], [F.desc("m"), F.col("id")], 20, ["id"], salts=5)
    got = {(r["g"], r["rank"]): r["id"] for r in out.collect()}
    rows = [(i % 3, i, i * 31 % 101) for i in range(2000)]
    for g in range(3):
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:20]
        assert [got[g, k + 1] for k in range(20)] == [r[1] for r in best]
