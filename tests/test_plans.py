import os

from pyspark.sql import functions as F

from seepage.operators import language_model as lm
from seepage.plans.corpus_build import build_corpus, encyclopedia_lines, mail_lines, mail_report, template_lines, training_blocks, web_lines
from seepage.plans.evaluation import evaluation, score_files
from seepage.plans.extraction_ranking import extraction, extraction_ranking
from seepage.plans.leak_audit import audit_report
from seepage.session import materialise, scratch


def test_ranking_has_a_section_per_score(spark):
    corpus = spark.createDataFrame([("the secret code is here",)] * 3, "text string")
    samples = spark.createDataFrame([("a", "the secret code"), ("b", "zz yy xx"), ("c", "x")], "sample_id string, text string")
    models = {"small": lm.fit_ngram_lm(corpus, 1), "large": lm.fit_ngram_lm(corpus, 2)}
    rows = extraction_ranking(samples, models, "large", 2).collect()
    first = {r["metric"]: r["sample_id"] for r in rows if r["rank"] == 1}
    assert len(first) == 4 and first["large perplexity"] == "a"
    assert all(sum(r["metric"] == m for r in rows) == 2 for m in first)


def test_corpus_build(spark):
    mails = spark.createDataFrame([("p1", "Subject: Big News\n\nthe cat sat")], "path string, raw string")
    assert mail_lines(mails).first()["text"] == "big news  cat sat"
    sent = "From: a@b.com\nTo: c@d.com,\n e@f.com\nSubject: Hi\nCc: g@h.com\nBcc: i@j.com\n\nbody"
    addressed = mail_lines(spark.createDataFrame([("p", sent)], "path string, raw string")).first()["text"]
    assert all(a in addressed for a in ("a@b.com", "c@d.com", "e@f.com", "g@h.com", "i@j.com"))
    pages = spark.createDataFrame([(i, f"<p>Page {i}</p>") for i in range(20)], "doc_id int, text string")
    assert web_lines(pages, 5).count() == 5
    lines = spark.createDataFrame([(i, "a b c d") for i in range(20)], "k int, text string")
    parts = training_blocks(lines, "k", block=4)
    assert parts["vocab"].count() == 4
    assert parts["train"].count() == (72 - 5) // 4 and parts["val"].count() == (8 - 5) // 4


def test_evaluation_matches_by_prompt(spark):
    corpus = spark.createDataFrame([(i, f"Say {i}. Answer a b c {i}. Ok") for i in range(6)], "k int, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "vec_id long, vector array<double>")

    asked = spark.sparkContext.accumulator(0)

    def echo(prompts, seed):
        asked.add(len(prompts))
        return [f"Answer a b c {p.split()[1]} Ok" for p in prompts]

    def silent(prompts, seed):
        return ["nothing" for _ in prompts]

    report = evaluation(corpus, "k", echo, silent, vectors, F.ascii("token").cast("long"), 5)
    rows = {r["metric"]: r for r in report.collect()}
    assert rows["rouge1"]["plain"] == 1.0 and rows["rouge1"]["dp"] == 0.0
    assert asked.value == 5


def test_flows_from_files_to_files(spark, tmp_path):
    crawl = tmp_path / "crawl.wet"
    head = "WARC/1.0\nWARC-Type: conversion\nx\nx\nx\nx\nx\nWARC-Identified-Content-Language: eng\nx\n\n"
    crawl.write_text("".join(f"{head}words of page {i} that go on and on for a while until the end {i}\n\n" for i in range(6)) + head + "last")
    corpus = spark.createDataFrame([("the secret code is a@b.com here",)] * 3, "text string")
    models = {"small": lm.fit_ngram_lm(corpus, 1), "large": lm.fit_ngram_lm(corpus, 2)}

    def predict(prompts, seed):
        return ["the secret code is a@b.com" for _ in prompts]

    report, summary = str(tmp_path / "report"), str(tmp_path / "summary")
    extraction(spark, str(crawl), predict, models, "large", report, n_prompts=20, n=3)
    heads = [r["value"] for r in spark.read.text(report).collect() if "score=" in r["value"]]
    assert len(heads) == 4 * 3
    audit_report(spark, report, corpus, summary)
    rows = {r["Category"]: r for r in spark.read.options(header=True, escape='"').csv(summary).collect()}
    assert rows["Total Samples"]["Unique Sample Count"] == "12"
    assert rows["Contact info (address, email, phone, twitter, etc.)"]["Examples"] == "a@b.com"
    sources = [spark.createDataFrame([(i, f"line {i} of {s}") for i in range(20)], "k int, text string") for s in "ab"]
    for ordered in (False, True):
        out = str(tmp_path / f"corpus-{ordered}")
        build_corpus(sources, out, ordered=ordered)
        tokens = spark.read.parquet(f"{out}/tokens")
        assert tokens.count() == 40 and tokens.filter("split = 'train'").count() == 36
        assert spark.read.parquet(f"{out}/vocab").count() == 20 + 4
    assert template_lines(spark.createDataFrame([(1, "a  b"), (2, None)], "row_id int, text string")).count() == 1
    assert encyclopedia_lines(spark.createDataFrame([(1, "= h ="), (2, "x")], "row_id int, text string")).count() == 1


def test_scratch_is_removed(spark):
    with scratch(spark):
        rows = materialise(spark.range(3), "gone")
        assert rows.count() == 3
        path = rows.inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_evaluation_files_give_the_same_report(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"Say {i}. Answer a b c {i}. Ok") for i in range(6)], "k int, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "vec_id long, vector array<double>")
    token_id = F.ascii("token").cast("long")

    def echo(prompts, seed):
        return [f"Answer a b\nc {p.split()[1]} Ok" for p in prompts]

    def other(prompts, seed):
        return ["Ok b c" for _ in prompts]

    out = str(tmp_path / "files")
    report = sorted(evaluation(corpus, "k", echo, other, vectors, token_id, 5, out).collect())
    assert [r["value"] for r in spark.read.text(f"{out}/prompts").orderBy("value").collect()] == [f"Say {i}." for i in range(5)]
    assert spark.read.text(f"{out}/output_plain").count() == spark.read.text(f"{out}/references").count() == 5
    assert sorted(score_files(spark, out, vectors, token_id).collect()) == report


def test_extraction_without_a_crawl_starts_from_the_end_mark(spark, tmp_path):
    corpus = spark.createDataFrame([("the secret code is a@b.com here",)] * 3, "text string")
    models = {"small": lm.fit_ngram_lm(corpus, 1), "large": lm.fit_ngram_lm(corpus, 2)}

    def predict(prompts, seed):
        assert set(prompts) == {"<|endoftext|>"}
        return [f"the secret code {i}" for i in range(len(prompts))]

    report = str(tmp_path / "report")
    extraction(spark, None, predict, models, "large", report, n_prompts=12, n=3)
    lines = [r["value"] for r in spark.read.text(report).collect()]
    assert sum("score=" in v for v in lines) == 12 and not any("endoftext" in v for v in lines)
    assert sum(v.startswith("the secret code") for v in lines) == 12


def test_mail_report(spark, tmp_path):
    sent = "From: a@b.com\nSubject: Big News\n\nthe cat sat"
    mails = spark.createDataFrame([("p1", sent), ("p2", "Subject: x\n\ny")], "path string, raw string")
    mail_report(mails, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "Email #1" in lines and "Email #2" in lines and "from: a@b.com" in lines and "to: None" in lines and "body: cat sat" in lines
