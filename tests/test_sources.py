import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from seepage.operators import clean
from seepage.sources import readers, writers


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def texts(df, column="text"):
    return [r[column] for r in df.collect()]


def test_maildir_keeps_only_depth_three(spark, tmp_path):
    write(tmp_path / "a" / "inbox" / "1", "Subject: café\r\n\r\nhi", "latin-1")
    write(tmp_path / "a" / "inbox" / "sub" / "2", "too deep")
    write(tmp_path / "a" / "3", "too shallow")
    rows = readers.read_maildir(spark, str(tmp_path)).collect()
    assert [(r["user"], r["folder"], r["raw"]) for r in rows] == [("a", "inbox", "Subject: café\n\nhi")]


def test_maildir_below_an_odd_path(spark, tmp_path):
    root = tmp_path / "o'x a" / "a"
    write(root / "a" / "inbox" / "1", "Subject: s\n\nhi")
    assert [(r["user"], r["folder"]) for r in readers.read_maildir(spark, str(root)).collect()] == [("a", "inbox")]


def test_file_tree_equals_that_of_the_plain_writer(spark, tmp_path):
    names = ["a", "b/c: d", "100%[x]=", "é ü", "", None]
    rows = [(names[i % 6], names[i % 5], None if i == 7 else f"text {i}\nof é") for i in range(60)]
    df = spark.createDataFrame(rows, "u string, f string, text string").repartition(3)
    df.write.option("maxRecordsPerFile", 1).partitionBy("u", "f").text(str(tmp_path / "plain"))
    writers.write_file_tree(df, f"file://{tmp_path}/tree", ["u", "f"])
    told = [sorted((r["user"], r["folder"], r["raw"]) for r in readers.read_maildir(spark, str(tmp_path / x)).collect()) for x in ("plain", "tree")]
    assert told[0] == told[1] and len(told[0]) == 60


def test_maildir_lists_folders_not_files(spark, tmp_path):
    for i in range(300):
        write(tmp_path / "_a" / "_sent" / str(i), "hi")
    write(tmp_path / "_a" / "_sent" / "sub" / "deep", "no")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("maildir", "maildir")
    rows = readers.read_maildir(spark, str(tmp_path))
    assert rows.count() == 300
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [jobs.getStageInfo(s) for j in jobs.getJobIdsForGroup("maildir") for s in jobs.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 100
    assert {(r["user"], r["folder"]) for r in rows.collect()} == {("_a", "_sent")}


def test_the_driver_knows_no_mail_file(spark, tmp_path):
    root = tmp_path / "o x%20#a"
    for name in ("1", "é #%20 b", "_x=1", ".hidden", "_hidden", "x._COPYING_"):
        write(root / "a" / "inbox" / name, f"hi {name}")
    write(root / "a" / "inbox" / "empty", "")
    write(root / ".b" / "sent" / "1", "x" * 3)
    write(root / "a" / "inbox" / "sub" / "deep", "no")
    (root / "a" / "inbox" / "lost").symlink_to(tmp_path / "nowhere")
    (root / "a" / "link").symlink_to(root / "a" / "inbox")
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*/*")
    rows = readers.read_maildir(spark, f"{root}/")
    assert "binaryFile" in plain._jdf.queryExecution().optimizedPlan().toString()
    told = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in told and not rows.inputFiles()
    want = sorted(r["path"] for r in plain.select("path").collect() if not r["path"].endswith("/deep"))
    assert sorted(r["path"] for r in rows.collect()) == want and len(want) == 3 + 3 + 1
    (root / "c").mkdir()
    (root / "c" / "file").touch()
    assert readers.read_maildir(spark, str(root)).count() == 7
    with pytest.raises(AnalysisException):
        readers.read_maildir(spark, str(tmp_path / "none"))


def test_numbering_moves_no_text(spark, tmp_path, monkeypatch):
    write(tmp_path / "1.txt", "b\n\n a \n")
    write(tmp_path / "2.txt", "c\n")
    df = readers.read_nonblank_lines(spark, str(tmp_path))
    assert [(r["pos"], r["text"]) for r in df.orderBy("pos").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    monkeypatch.setattr(readers, "materialise", lambda df, label: df)
    plan = readers.read_nonblank_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    assert all("text" not in line for line in moved)


def test_csv_in_single_line_mode(spark, tmp_path):
    write(tmp_path / "a.csv", "id,Filled Template\n1,x\n2,-1.#IND\n3,\"a,b\"\n")
    got = texts(readers.read_pii_csv(spark, str(tmp_path / "a.csv"), multi_line=False))
    assert got == ["x", None, "a,b"]


def one_task(spark, path):
    """The CSV reader itself, a file a task."""
    rows = spark.read.schema("id string, t string, x string, _corrupt_record string").options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return sorted((tuple(r)[:3] for r in rows.collect() if r["_corrupt_record"] is None), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_csv_cut_at_every_place_equals_one_task(spark, tmp_path, seed):
    rng = random.Random(seed)
    cells = ["a", "", "b c", '"q, ""x"" y"', '"line\none"', '"two\n\nlines, ""q"""', '"x"', '5" pipe', '"\n"', '"a,b\nc"']
    text = "id,t,x\n" + "\n".join(f"{i},{rng.choice(cells)},{rng.choice(cells)}" for i in range(9)) + rng.choice(["", "\n"])
    path = tmp_path / "a.csv"
    write(path, text)
    want = one_task(spark, str(path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (11 + 8 * seed, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, len(text) // size)))
            rows = readers.csv_records(spark, str(path)).filter("(_block > 0 OR rec > 0) AND record <> ''")
            got = rows.select(F.from_csv("record", "id string, t string, x string", {"quote": '"', "escape": '"'}).alias("r")).select("r.*").collect()
            assert sorted(map(tuple, got), key=repr) == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_csv_skips_long_rows_and_pads_short_ones(spark, tmp_path):
    write(tmp_path / "p.csv", 'id,Filled Template,x\n1,"a\nb",y\n2,long,y,z\n3\n4,,y\n5,NA,y\n6,ok,y\n7,empty tail,y,\n')
    rows = texts(readers.read_pii_csv(spark, str(tmp_path)))
    assert sorted(rows, key=str) == [None, None, None, "a\nb", "ok"]
    assert sorted(texts(clean.clean_templates(readers.read_pii_csv(spark, str(tmp_path))))) == ["a b", "ok"]


def test_marked_file_without_marker_is_one_sample(spark, tmp_path):
    write(tmp_path / "one.txt", " line 1\nline 2\n")
    assert texts(readers.read_marked(spark, str(tmp_path / "one.txt"), "<|email|>")) == ["line 1\nline 2"]
    write(tmp_path / "two.txt", "a\n<|email|>\n\n<|email|>\nb")
    assert sorted(texts(readers.read_marked(spark, str(tmp_path / "two.txt"), "<|email|>"))) == ["a", "b"]


def record(lang, body):
    head = ["WARC/1.0", "1", "2", "3", "4", "5", "6", f"WARC-Identified-Content-Language: {lang}", "8", "9"]
    return "\r\n".join(head) + "\r\n" + body


def test_wet_drops_the_last_record(spark, tmp_path):
    text = "preamble\n" + record("eng", "one\ntwo\n") + record("fra", "non\n") + record("eng", "last\n")
    write(tmp_path / "x.wet", text)
    assert texts(readers.read_wet(spark, str(tmp_path)), "body") == ["one\n two\n"]


def test_only_bad_bytes_go(spark):
    cases = [b"good \xef\xbf\xbd mark", b"bad \xff\xfe byte", b"cut \xe2\x82", b"\x1a0 \x1a1 \x1a", b"\xc3\xa9\x1a\xff1 \xef\xbf\xbd"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, raw binary")
    got = {r["i"]: r["t"] for r in df.select("i", readers.valid_text(F.col("raw").cast("string")).alias("t")).collect()}
    assert got == {i: c.decode("utf-8", "ignore") for i, c in enumerate(cases)}


def test_wet_keeps_genuine_replacement_characters(spark, tmp_path):
    (tmp_path / "x.wet").write_bytes((record("eng", "good \ufffd m\n") + record("eng", "last\n")).encode().replace(b"good", b"go\xffod"))
    assert texts(readers.read_wet(spark, str(tmp_path)), "body") == ["good \ufffd m\n"]


def test_ranked_report_keeps_banners_unless_clean(spark, tmp_path):
    report = (
        "======== top 2 samples by a: ========\n1: a=1, score=2\n\nfirst\n  wrapped\n\n2: a=1\n\nsecond\n"
        "======== top 2 samples by b: ========\n1: b=1\n\nsecond\n"
    )
    write(tmp_path / "r.txt", report)
    blocks = readers.read_ranked_report(spark, str(tmp_path)).orderBy("block_id")
    assert texts(blocks) == ["first wrapped", "second ======== top 2 samples by b: ========", "second"]
    assert texts(readers.read_ranked_report(spark, str(tmp_path), clean=True).orderBy("block_id")) == ["first wrapped", "second"]


def test_ranked_report_does_not_leak_over_files(spark, tmp_path):
    write(tmp_path / "a.txt", "1: x\none\n")
    write(tmp_path / "b.txt", "stray\n1: x\ntwo\n")
    assert sorted(texts(readers.read_ranked_report(spark, str(tmp_path)))) == ["one", "two"]


def test_lines_keep_their_order_over_files(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"f{i}.txt", "".join(f"{i}-{k}\n\n" for k in range(50)))
    rows = readers.read_nonblank_lines(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["text"] for r in rows] == [f"{i}-{k}" for i in range(3) for k in range(50)]
    assert [r["pos"] for r in rows] == list(range(150))


def test_token_cache_reads_what_it_saved(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = readers.token_cache(spark, path, lambda: spark.range(3))
    second = readers.token_cache(spark, path, lambda: spark.range(99))
    assert first.count() == second.count() == 3


def test_email_report_prints_none_and_unfolds(spark, tmp_path):
    mails = spark.createDataFrame([(7, "a,\n\tb", None), (9, "c", "s")], "id int, to string, cc string")
    writers.write_email_report(mails, str(tmp_path / "out"), "id")
    rows = readers.read_lines(spark, str(tmp_path / "out")).orderBy(*readers.LINE_ORDER)
    assert texts(rows) == ["Email #1", "to: a, b", "cc: None", "Email #2", "to: c", "cc: s"]


def test_lines_with_breaks_stay_one_line(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, ""), (3, "c")], "id int, text string")
    writers.write_lines(df, str(tmp_path / "out"), order=["id"], skip_empty=True)
    assert texts(readers.read_lines(spark, str(tmp_path / "out")).orderBy(*readers.LINE_ORDER)) == ["a\\nb", "c"]


def test_report_is_cut_to_n(spark, tmp_path):
    rows = [("m perplexity", i, 2.0, None, -0.5, f"t{i}") for i in range(1, 11)]
    df = spark.createDataFrame(rows, "metric string, rank int, score1 double, score2 double, value double, text string")
    writers.write_ranked_report(df, str(tmp_path / "r"), "m", 3)
    assert sum("score=" in t for t in texts(readers.read_lines(spark, str(tmp_path / "r")))) == 3


def test_report_round_trip(spark, tmp_path):
    rows = [("m perplexity", 1, 2.0, None, -0.5, "x y"), ("ratio of z to m perplexity", 1, 2.0, 3.0, 1.5, "p\nq")]
    df = spark.createDataFrame(rows, "metric string, rank int, score1 double, score2 double, value double, text string")
    writers.write_ranked_report(df, str(tmp_path / "r"), "m", 5)
    lines = [t for t in texts(readers.read_lines(spark, str(tmp_path / "r")).orderBy(*readers.LINE_ORDER)) if t]
    assert lines == [
        "======== top 5 samples by m perplexity: ========",
        "1: m=2.000, score=-0.500",
        "x y",
        "======== top 5 samples by ratio of z to m perplexity: ========",
        "1: m=2.000, z=3.000, score=1.500",
        "p\\nq",
    ]
    assert sorted(texts(readers.read_ranked_report(spark, str(tmp_path / "r"), clean=True))) == ["p\\nq", "x y"]


def test_summary_csv_has_blank_row_before_totals(spark, tmp_path):
    summary = spark.createDataFrame(
        [(0, "News", False, 1, 2, 'a; "b"')],
        "ord int, category string, is_pii boolean, unique_sample_count long, total_match_count long, examples string",
    )
    totals = spark.createDataFrame(
        [("Total PII Match Occurrences", 0), ("Total Samples", 5), ("Total PII Sample Matches", 0)], "metric string, value long"
    )
    writers.write_summary_csv(summary, totals, str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == "Category,Unique Sample Count,Total Match Count,Examples"
    assert lines[1] == 'News,1,2,"a; ""b"""'
    assert lines[2].replace(",", "").replace('"', "") == ""
    assert [line.split(",")[0] for line in lines[3:]] == ["Total Samples", "Total PII Sample Matches", "Total PII Match Occurrences"]


def test_corpus_split_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "val")], "doc_id int, text string, split string")
    df.write.partitionBy("split").parquet(str(tmp_path / "c"))
    rows = readers.read_corpus(spark, str(tmp_path / "c"), split="val").select(F.col("text"))
    assert texts(rows) == ["b"]
