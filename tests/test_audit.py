import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seepage.functions import patterns as P
from seepage.operators import audit, search
from seepage.plans.leak_audit import leak_audit
from seepage.streaming import audit_stream
from seepage.streaming.audit_stream import run_audit_stream


def samples_of(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "sample_id string, text string")


def corpus_of(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_matches_are_distinct_but_case_sensitive(spark):
    found = audit.candidates(samples_of(spark, "License license license"))
    assert sorted(r["match"] for r in found.collect()) == ["License", "license"]


def test_counts_examples_and_zero_rows(spark):
    samples = samples_of(spark, "License a@b.com", "license 12345678", "nothing", "Copyright")
    corpus = corpus_of(spark, "The LICENSE of A@B.com\nx", "number 12345678!")
    rows = leak_audit(samples, corpus).collect()
    assert [r["category"] for r in rows] == [e.name for e in P.DEFAULT]
    by_name = {r["category"]: (r["unique_sample_count"], r["total_match_count"]) for r in rows}
    assert by_name[P.LICENSE] == (2, 2)
    assert by_name[P.CONTACT] == (2, 2)
    assert by_name[P.NEWS] == (0, 0)
    counts = spark.createDataFrame(rows)
    found = audit.found_in_corpus(audit.candidates(samples), audit.corpus_lines(corpus))
    cells = {r["category"]: r["examples"] for r in audit.with_examples(counts, found).collect()}
    assert cells[P.LICENSE] == "License; license" and cells[P.CONTACT] == "12345678; a@b.com" and cells[P.NEWS] == ""
    totals = {r["metric"]: r["value"] for r in audit.audit_totals(counts, samples).collect()}
    assert totals == {"Total Samples": 4, "Total PII Sample Matches": 2, "Total PII Match Occurrences": 2}


def test_match_over_a_line_break_is_not_found(spark):
    corpus = corpus_of(spark, "all rights\nreserved")
    cands = audit.candidates(samples_of(spark, "All rights reserved"))
    assert audit.found_in_corpus(cands, audit.corpus_lines(corpus)).count() == 0


def random_case(seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("ab é\t") for _ in range(rng.choice([0, 3, 30, 300]))) for _ in range(40)]
    terms = {"".join(rng.choice("ab é") for _ in range(rng.randrange(1, 14))) for _ in range(300)}
    for _ in range(60):
        line = rng.choice(lines)
        if len(line) > 20:
            at = rng.randrange(len(line) - 15)
            terms.add(line[at : at + rng.randrange(1, 15)])
    return sorted(terms), lines


@pytest.mark.parametrize("chars", [10**6, 0])
def test_search_equals_substring_test(spark, chars):
    terms, lines = random_case(5)
    hits = audit.corpus_hits(
        spark.createDataFrame([(t,) for t in terms], "term string"),
        spark.createDataFrame([(line,) for line in lines], "line string").repartition(3),
        chars,
    )
    assert sorted(r["term"] for r in hits.collect()) == [t for t in terms if any(t in line for line in lines)]


@pytest.mark.parametrize("chars", [10**7, 0])
def test_terms_with_one_start_cost_no_more(spark, chars):
    lines = [f"zz www.example-site-{i:06d} and x{i:06d}y" for i in range(0, 40_000, 4)]
    df = spark.createDataFrame([(line,) for line in lines], "line string")

    def seconds(terms):
        listed = spark.createDataFrame([(t,) for t in terms], "term string")
        start = time.perf_counter()
        assert audit.corpus_hits(listed, df, chars).count() == 5_000
        return time.perf_counter() - start

    apart = [f"x{i:06d}y" for i in range(20_000)]
    alike = [f"www.example-site-{i:06d}" for i in range(20_000)]
    seconds(apart)
    assert min(seconds(alike) for _ in range(2)) <= 1.5 * min(seconds(apart) for _ in range(2)) + 1


def test_sketches_merge_and_never_fall_short():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 5_000, 40_000, dtype=np.uint64) * np.uint64(0x9E3779B1)
    parts = []
    for some in np.array_split(grams, 3):
        sketch = search.Sketch.empty()
        sketch.add(1, *np.unique(some, return_counts=True))
        parts.append(sketch.counters)
    merged = search.Sketch(sum(parts))
    values, counts = np.unique(grams, return_counts=True)
    told = merged.estimate(1, values)
    assert (told >= counts).all() and (told == counts).mean() > 0.9 and merged.counters[0].sum() == 0


@pytest.mark.parametrize("size", [4, 8, 16, 32])
def test_grams_of_texts_side_by_side(size):
    texts = ["", "abcé" * 9, None, "x" * size, "short", "é" * 40]
    part = search.Batch(pa.array(texts, pa.string()))
    everything = np.full(search.BITS // 64, np.iinfo(np.uint64).max, np.uint64)
    grams, at = part.places(size, everything)
    want = [g for t in texts for g in search.gram_values(np.frombuffer((t or "").encode(), np.uint8))[size].tolist()]
    assert grams.tolist() == want and len(at) == len(want)


def test_frequent_anchors_grow_or_leave_the_join(spark, monkeypatch):
    monkeypatch.setattr(search, "LIGHT", 20)
    monkeypatch.setattr(search, "LIGHT_SHARE", 10**9)
    lines = [f"http://www.example.org/archive/{i:05d}/page all rights reserved" for i in range(3000)] + ["the rare phrase here"]
    terms = [f"ample.org/archive/{i:05d}/pa" for i in range(0, 6000, 2)] + ["all rights reserved", "rare phrase", "rare phrases", "ghts", "no"]
    df = spark.createDataFrame([("\n".join(lines[i : i + 50]),) for i in range(0, len(lines), 50)], "line string").repartition(5)
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    for chars in (0, 60):
        got = {r["term"] for r in search.by_anchor(listed, df, chars).collect()}
        assert got == {t for t in terms if any(t in line for line in lines)}
    filters, shared = search._grams_of_terms(listed)
    corpus = search.corpus_sketch(df, spark.sparkContext.broadcast(filters))
    chosen = {r["term"]: r for r in search.choose_anchors(listed, corpus, shared, 20).collect()}
    assert chosen["ample.org/archive/00002/pa"]["size"] in (8, 16, 32) and chosen["ample.org/archive/00002/pa"]["places"] <= 20
    assert chosen["all rights reserved"]["places"] >= 3000 and "rare phrases" not in chosen and chosen["no"]["size"] == 0
    # the pieces sent are as short as the terms, not whole texts
    assert chosen["rare phrase"]["at"] + 8 <= len("rare phrase")


def test_a_term_over_a_line_break_is_in_no_text(spark):
    lines = spark.createDataFrame([("ab\ncd ef",)], "line string")
    terms = spark.createDataFrame([("b\ncd",), ("cd e",), ("ab\x85",)], "term string")
    for chars in (10**6, 0):
        assert [r["term"] for r in audit.corpus_hits(terms, lines, chars).collect()] == ["cd e"]


def test_large_sides_take_the_skew_safe_join(spark, monkeypatch):
    samples = samples_of(spark, *["license Ann Lee"] * 50, "copyright Bob", "Eve")
    corpus = corpus_of(spark, "license copyright", "ann lee eve")
    names = spark.createDataFrame([("ann",), ("eve",)], "name string")
    plain = sorted(audit.found_in_corpus(audit.candidates(samples, names=names), audit.corpus_lines(corpus)).collect())
    monkeypatch.setattr(audit, "fits_broadcast", lambda *a: False)
    again = sorted(audit.found_in_corpus(audit.candidates(samples, names=names), audit.corpus_lines(corpus)).collect())
    assert plain == again and len(plain) == 102


def test_names_are_found_anywhere_in_a_run(spark):
    samples = samples_of(
        spark, "met Ann Lee Smith Jones, McAnn and Bob", "Élan Vital", "Yesterday President Ann Smith Met Élan Green. Ann Smith", "no name"
    )
    names = spark.createDataFrame([("Ann",), ("élan",)], "name string")
    found = {(r["sample_id"], r["match"], r["tail"]) for r in audit.name_matches(samples, names).collect()}
    ann = "Ann Smith Met Élan Green"
    assert found == {
        *[("s0", m, "Ann Lee Smith Jones") for m in ("Ann", "Ann Lee", "Ann Lee Smith", "Ann Lee Smith Jones")],
        *[("s1", m, "Élan Vital") for m in ("Élan", "Élan Vital")],
        *[("s2", m, ann) for m in ("Ann", "Ann Smith", "Ann Smith Met", "Ann Smith Met Élan", ann)],
        *[("s2", m, "Élan Green") for m in ("Élan", "Élan Green")],
        *[("s2", m, "Ann Smith") for m in ("Ann", "Ann Smith")],
    }


def test_longest_reading_in_the_corpus_counts(spark):
    names = spark.createDataFrame([("john",), ("Mary  Ann",), ("mary ann poe",), ("",)], "name string")
    samples = samples_of(spark, "we met John Smith Monday Morning", "Dear Mary Ann Poe Yours", "Mary Poe", "John Doe")
    corpus = corpus_of(spark, "mail from john smith today\nmary ann poe", "mary", "john do")
    found = audit.found_in_corpus(audit.candidates(samples, names=names), audit.corpus_texts(corpus))
    assert sorted((r["sample_id"], r["match"]) for r in found.filter(F.col("category") == P.NAMES).collect()) == [
        ("s0", "John Smith"), ("s1", "Mary Ann Poe"), ("s3", "John"),
    ]


def test_readings_are_bounded_in_words(spark):
    samples = samples_of(spark, "Ann " + " ".join(f"W{chr(97 + i)}" for i in range(20)))
    rows = audit.name_matches(samples, spark.createDataFrame([("ann",)], "name string")).collect()
    assert sorted(len(r["match"].split()) for r in rows) == list(range(1, audit.NAME_WORDS + 1))


def test_choose_corpus(spark):
    corpora = {"nano": corpus_of(spark, "n"), "gpt2": corpus_of(spark, "g")}
    assert audit.choose_corpus("Results_GPT2_dp.txt", corpora) is corpora["gpt2"]
    with pytest.raises(ValueError):
        audit.choose_corpus("other.txt", corpora)


def test_compare_reports_reduction(spark):
    plain = spark.createDataFrame([("a", 10), ("b", 0)], "category string, total_match_count long")
    dp = spark.createDataFrame([("a", 1), ("c", 2)], "category string, total_match_count long")
    rows = {r["category"]: (r["plain_matches"], r["dp_matches"], r["reduction"]) for r in audit.compare_plain_dp(plain, dp).collect()}
    assert rows == {"a": (10, 1, 0.9), "b": (0, 0, None), "c": (0, 2, None)}


def test_stream_in_batches_equals_one_run(spark, tmp_path):
    corpus = corpus_of(spark, "license a@b.com", "white house")
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = ["License", "a@b.com; x", "license White House", "copyright"]
    whole = samples_of(spark, *texts)

    def arrive(lo, hi):
        rows = [(f"s{i}", texts[i]) for i in range(lo, hi)]
        spark.createDataFrame(rows, "sample_id string, text string").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("sample_id string, text string").parquet(inbox)
        return run_audit_stream(stream, corpus, out)

    first = arrive(0, 2)
    assert first.count() == 2
    second = arrive(2, 4)
    single = audit.found_in_corpus(audit.candidates(whole), audit.corpus_lines(corpus))
    assert sorted(second.collect()) == sorted(single.collect())
    batches = len(list((tmp_path / "out" / "found").glob("batch=*")))
    stream = spark.readStream.schema("sample_id string, text string").parquet(inbox)
    again = run_audit_stream(stream, corpus, out)
    assert sorted(again.collect()) == sorted(single.collect())
    assert len(list((tmp_path / "out" / "found").glob("batch=*"))) == batches
    looked = spark.read.parquet(f"{out}/lookup")
    assert looked.count() == looked.select("term").distinct().count()


def test_stream_of_many_batches_and_a_changed_corpus(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for i in range(6):
        (inbox / f"{i}.json").write_text(f'{{"sample_id": "s{i}", "text": "License a@b.com {10**7 + i}"}}')
    stream = (
        spark.readStream.schema("sample_id string, text string").option("maxFilesPerTrigger", 1).json(str(inbox))
    )
    first = run_audit_stream(stream, corpus_of(spark, "license 10000003"), out, corpus_id="one")
    assert len({p.name for p in (tmp_path / "out" / "found").glob("batch=*")}) == 6
    assert first.count() == 7
    (inbox / "9.json").write_text('{"sample_id": "s9", "text": "License a@b.com"}')
    again = run_audit_stream(stream, corpus_of(spark, "a@b.com"), out, corpus_id="two")
    assert again.count() == 8  # the earlier misses of the other corpus don't count


def test_files_read_by_a_batch_dont_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit_stream, "BUCKETS", 2)
    monkeypatch.setattr(audit_stream, "MOST_PARTS", 3)
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for i in range(9):
        (inbox / f"{i}.json").write_text("\n".join(f'{{"sample_id": "s{i}-{k}", "text": "License {10**7 + 8 * i + k}"}}' for k in range(8)))
    stream = spark.readStream.schema("sample_id string, text string").option("maxFilesPerTrigger", 1).json(str(inbox))
    read = []
    parts = audit_stream.Lookups.parts
    monkeypatch.setattr(audit_stream.Lookups, "parts", lambda self, *a: read.append(parts(self, *a)) or read[-1])
    found = run_audit_stream(stream, corpus_of(spark, "license 10000003 10000060"), out)
    assert found.filter(F.col("match") != "License").count() == 2 and found.count() == 74
    assert len(read) == 9 and max(len(p) for r in read for p in r.values()) <= 3
    looked = spark.read.parquet(f"{out}/lookup")
    assert looked.count() == looked.select("term").distinct().count() == 73


def test_grown_and_rewritten_corpus_files(spark, tmp_path, monkeypatch):
    inbox, out, lines = tmp_path / "in", str(tmp_path / "out"), tmp_path / "corpus"
    inbox.mkdir()
    lines.mkdir()
    (lines / "a.txt").write_text("license\n")
    searched = []
    hits = audit.corpus_hits
    monkeypatch.setattr(
        audit_stream.audit, "corpus_hits", lambda t, c: searched.append((sorted(r.term for r in t.collect()), sorted(r.line for r in c.collect()))) or hits(t, c)
    )

    def run(n):
        (inbox / f"{n}.json").write_text(f'{{"sample_id": "s{n}", "text": "License a@b.com"}}')
        stream = spark.readStream.schema("sample_id string, text string").json(str(inbox))
        corpus = spark.read.text(str(lines)).withColumnRenamed("value", "text")
        searched.clear()
        return sorted((r.sample_id, r.match) for r in run_audit_stream(stream, corpus, out).collect())

    assert run(0) == [("s0", "License")] and searched == [(["a@b.com", "license"], ["license"])]
    assert run(1) == [("s0", "License"), ("s1", "License")] and searched == []
    (lines / "b.txt").write_text("mail a@b.com\n")
    grown = run(2)
    assert grown[2:] == [("s2", "License"), ("s2", "a@b.com")] and searched == [(["a@b.com"], ["mail a@b.com"])]
    assert run(3)[4:] == [("s3", "License"), ("s3", "a@b.com")] and searched == []
    time.sleep(1.1)
    (lines / "a.txt").write_text("copyright\n")
    assert run(4)[6:] == [("s4", "a@b.com")] and len(searched) == 1 and len(searched[0][0]) == 2


def test_examples_in_long_form(spark):
    found = spark.createDataFrame([("s", "c", "x"), ("t", "c", "x"), ("t", "c", "y")], "sample_id string, category string, match string")
    assert sorted(tuple(r) for r in audit.leak_examples(found).collect()) == [("c", "x"), ("c", "y")]
    assert audit.leak_counts(found).select(F.col("total_match_count")).first()[0] == 3
