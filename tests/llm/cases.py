"""Awkward rows that every operator must take: nulls, empties, repeats, long texts, extra columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, size string, slot string, key string, run string, kept string"
EMPTY = ("id", "fp", "size", "slot", "key", "run", "kept")


def rows(seed: int = 1, n: int = 60):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "Élan", "x1", "ßtraße", "end.", "日本", "um", "de"] + ["w%d" % i for i in range(40)]

    def text(k):
        return " ".join(rnd.choice(vocabulary) for _ in range(k))

    made = [(i, text(rnd.randint(0, 60)), f"src{rnd.choice([0, 0, 0, 1, 2, 10])}") for i in range(n)]
    passage = text(50)
    made += [(n + i, text(5) + "\n" + passage + "\n" + text(5), "src0") for i in range(12)]
    made += [(n + 20 + i, made[3][1], "src1") for i in range(8)]  # exact copies
    made += [(n + 40, made[5][1] + " more", "src2"), (n + 41, "", "src2"), (n + 42, " \t\n\x0b ", "src2"), (n + 43, None, None)]
    made += [(n + 44, "a" * 5000, None), (n + 45, text(4000), "src0"), (None, text(30), "src0"), (None, None, None)]
    made += [(n + 46, text(40), "src0")] * 2  # a repeated row
    rnd.shuffle(made)
    return [(i, t, "en", s, len(t or ""), *[None] * len(EMPTY)) for i, t, s in made]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
