import math
import random
from collections import Counter

import duckdb
import pytest
from plain_stem import stem_word
from pyspark.sql import functions as F

from seepage.functions import stem
from seepage.operators import metrics

RNG = random.Random(9)
PAIRS = [
    ("the cat sat on the mat", "the cat sat on the mat"),
    ("x y z", "a b c"),
    ("mat the on sat cat the", "the cat sat on the mat"),
    ("", "a b"),
    ("a b", ""),
    ("Running runs, the ponies!", "run pony"),
] + [
    (" ".join(RNG.choice("abcde") for _ in range(RNG.randrange(1, 30))), " ".join(RNG.choice("abcde") for _ in range(RNG.randrange(1, 30))))
    for _ in range(20)
]


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(PAIRS)], "pos int, hyp string, ref string")


def grams(ws, n):
    return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))


def test_bleu_equals_the_definition(pairs):
    match, total = [0] * 5, [0] * 5
    for h, r in PAIRS:
        for n in range(1, 5):
            a, b = grams(h.split(), n), grams(r.split(), n)
            match[n] += sum((a & b).values())
            total[n] += max(1, sum(a.values()))
    p = [math.log(match[1] / total[1])] + [math.log((match[n] + 1) / (total[n] + 1)) for n in (2, 3, 4)]
    hyp, ref = (sum(len(x[i].split()) for x in PAIRS) for i in (0, 1))
    brevity = 1.0 if hyp > ref else math.exp(1 - ref / hyp)
    assert metrics.corpus_bleu(pairs, "hyp", "ref").first()["bleu"] == pytest.approx(brevity * math.exp(sum(p) / 4))


def test_bleu_of_disjoint_texts_is_zero(spark):
    df = spark.createDataFrame([(1, "x y", "a b"), (2, "", "a")], "pos int, hyp string, ref string")
    assert metrics.corpus_bleu(df, "hyp", "ref").first()["bleu"] == 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def f_score(both, h, r):
    return 2 * both / (h + r) if both else 0.0


@pytest.mark.parametrize("stemmed", [False, True])
def test_rouge_equals_the_definition(pairs, stemmed):
    def tokens(text):
        return [stem_word(w) if stemmed and len(w) > 3 else w for w in plain_words(text)]

    for n in (1, 2):
        got = {r["pos"]: r[f"rouge{n}"] for r in metrics.rouge_n(pairs, "hyp", "ref", n, stemmed=stemmed).collect()}
        for i, (h, r) in enumerate(PAIRS):
            a, b = grams(tokens(h), n), grams(tokens(r), n)
            assert got[i] == pytest.approx(f_score(sum((a & b).values()), sum(a.values()), sum(b.values())))
    got = {r["pos"]: r["rougeL"] for r in metrics.rouge_l(pairs, "hyp", "ref", stemmed=stemmed).collect()}
    for i, (h, r) in enumerate(PAIRS):
        a, b = tokens(h), tokens(r)
        assert got[i] == pytest.approx(f_score(lcs(a, b), len(a), len(b)))


def test_lcs_equals_dynamic_programme():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 80))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 80))]
        assert metrics.lcs_length(a, b) == lcs(a, b)


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"),
        ("electrical", "electr"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"),
    ],
)
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_stemming_by_shuffle_equals_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([("running",)] * 500 + [(f"word{i}s",) for i in range(40)], "token string")
    plain = sorted(metrics.stem_tokens(df).collect())
    monkeypatch.setattr(metrics, "fits_broadcast", lambda *a: False)
    assert sorted(tuple(r) for r in metrics.stem_tokens(df).select("token", "stem").collect()) == sorted((r["token"], r["stem"]) for r in plain)


@pytest.mark.parametrize("broadcast", [True, False])
def test_greedy_match_equals_brute_force(spark, pairs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(metrics, "VECTOR_BYTES", -1)
    vec = {c: [math.cos(i), math.sin(i), 0.3 * i] for i, c in enumerate("abcde")}
    table = spark.createDataFrame([(ord(c), v) for c, v in vec.items()], "vec_id long, vector array<double>")
    got = {r["pos"]: r for r in metrics.greedy_cosine_match(pairs, "hyp", "ref", table, F.ascii("token").cast("long")).collect()}

    def cos(u, v):
        return sum(x * y for x, y in zip(u, v)) / math.hypot(*u) / math.hypot(*v)

    def vectors(text):
        return [vec[w[0]] for w in text.split() if w[0] in vec]

    for i, (h, r) in enumerate(PAIRS):
        a, b = vectors(h), vectors(r)
        if not a or not b:
            assert (got[i]["precision"], got[i]["recall"], got[i]["f1"]) == (0.0, 0.0, 0.0)
            continue
        p = sum(max(cos(u, v) for v in b) for u in a) / len(a)
        q = sum(max(cos(u, v) for u in a) for v in b) / len(b)
        assert (got[i]["precision"], got[i]["recall"]) == (pytest.approx(p), pytest.approx(q))
        assert got[i]["f1"] == pytest.approx(2 * p * q / (p + q))


def test_align_cuts_to_the_shortest(spark):
    def side(n):
        return spark.createDataFrame([(i * 3, f"t{i}") for i in range(n)], "at int, text string")

    rows = metrics.align(side(5), side(3), side(4), ["at"]).orderBy("pos").collect()
    assert [(r["pos"], r["reference"], r["plain"], r["dp"]) for r in rows] == [(i, f"t{i}", f"t{i}", f"t{i}") for i in range(3)]


def test_report_has_all_metrics(spark, pairs):
    df = pairs.select("pos", F.col("ref").alias("reference"), F.col("hyp").alias("plain"), F.col("ref").alias("dp"))
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "vec_id long, vector array<double>")
    rows = {r["metric"]: r for r in metrics.metric_report(df, table, F.ascii("token").cast("long")).collect()}
    assert sorted(rows) == ["bleu", "f1", "precision", "recall", "rouge1", "rouge2", "rougeL"]
    # an empty hypothesis still counts one gram, so not quite 100
    assert 98 < rows["bleu"]["dp"] < 100 and rows["bleu"]["plain"] < 100


WORDS = (
    "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing "
    "fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli "
    "analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti "
    "triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable "
    "defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize "
    "probate rate cease controll roll yyyyying syyzygy eed ing ed sses ies oooed a1b2ing 2000s yes by"
).split()


def test_rule_table_equals_the_word_by_word_stemmer(spark):
    rng = random.Random(6)
    endings = [r.ending for step in (stem.PLURALS, stem.AGREED, stem.PAST, stem.LAST_Y, stem.STEP2, stem.STEP3, stem.STEP4) for r in step] + ["e", "ll"]
    made = ["".join(rng.choice("aeioubstlyzxwn") for _ in range(rng.randrange(1, 6))) + rng.choice(endings) + rng.choice(["", "", rng.choice(endings)]) for _ in range(3000)]
    words = sorted({*WORDS, *made})
    want = {w: stem_word(w) if len(w) > 3 else w for w in words}
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = {r["token"]: r["s"] for r in df.select("token", stem.stem(F.col("token")).alias("s")).collect()}
    assert {w: (got[w], want[w]) for w in words if got[w] != want[w]} == {}
    listed = duckdb.sql(f"SELECT token, {stem.stem_sql('token')} AS s FROM (SELECT unnest({words}) AS token)").fetchall()
    assert {w: (s, want[w]) for w, s in listed if s != want[w]} == {}
    assert "Python" not in df.select(stem.stem(F.col("token")))._jdf.queryExecution().toString()
