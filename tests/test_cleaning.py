import pytest
from pyspark.sql import functions as F

from seepage.functions import text as T
from seepage.operators import clean


def one(spark, change, value):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(change(F.col("text")).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "change, given, expected",
    [
        (T.strip, " \t a b  \n", "a b"),
        (T.strip, " \n ", ""),
        (T.squeeze, "a  \n b ", "a b"),
        (T.strip_disclaimer, "Hi. IF you are not the intended RECIPIENT\nx", "Hi. "),
        (T.strip_disclaimer, "a. Delete this e-mail from your system b", "a. "),
        (T.strip_reply_header, "top\n-----Original Message-----\nFrom: x\n \nquoted\n", "top\nquoted"),
        (T.strip_symbols, "né-a_1 b!\n", "na1 b\n"),
        (T.clean_web, " <b>Hi</b>,  There! ", "hi, there!"),
        (T.ascii_only, "ça va", "a va"),
        (T.join_number_marks, "3 @.@ 5 a @-@ b 1 @,@ 0", "3 . 5 a - b 1 , 0"),
        (T.strip_wiki_markup, "= T = a [[L]] ''i'' <unk>", "a L i"),
        (T.drop_stop_words, "the cat and  hat", "cat hat"),
        (T.normalise, "See HTTPS://x.com/a?b now,\nme@x.com!", "see now mexcom"),
        (lambda t: T.normalise(t, drop_emails=True), "write me@x.com now", "write now"),
        (T.clean_mail, "The cat -- sat.\nIf you are not the intended recipient go", "cat sat"),
        (T.clean_mail, None, ""),
        (T.first_sentence, "Mr. X left. He ran. Ok", "Mr. X left."),
        (T.later_sentences, "Mr. X left. He ran.\n Ok", "He ran. Ok"),
        (T.first_sentence, "no split. here", "no split. here"),
        (T.later_sentences, "no split. here", ""),
    ],
)
def test_text_function(spark, change, given, expected):
    assert one(spark, change, given) == expected


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\r\nb\rc\n\n", "x\x1cy\x0bz w", "\n", "a\u0085b"])
def test_lines_equal_splitlines(spark, value):
    assert one(spark, T.lines, value) == (value.splitlines() or ([] if value == "" else [""]))


def parsed(spark, raw):
    return clean.parse_mail(spark.createDataFrame([(raw,)], "raw string")).first().asDict()


def test_mail_headers_fold_and_match_any_case(spark):
    row = parsed(spark, "from: a@x\nReply-To: no\nTo: b@x,\n\tc@x\nSubject:  s\nTO: later\n\nbody: To: z\n\nend")
    assert row == {
        "from": "a@x", "to": "b@x,\n\tc@x", "subject": "s", "date": None, "cc": None, "bcc": None,
        "body": "body: To: z\n\nend",
    }


def test_mail_without_headers_is_all_body(spark):
    row = parsed(spark, "just a line\n\nmore")
    assert row["body"] == "just a line\n\nmore" and row["from"] is None


def test_multipart_body_is_not_a_string(spark):
    row = parsed(spark, "From: a\nContent-Type: Multipart/mixed; b=x\n\n--x\n")
    assert row["body"] is None
    cleaned = clean.clean_mail(spark.createDataFrame([(None, "A b", "1 May")], "body string, subject string, date string"))
    assert cleaned.first().asDict() == {"body": "", "subject": "b", "date": "1 may"}


def test_headings_go_and_empty_non_ascii_rows_stay(spark):
    rows = [(" = H = ",), ("",), ("a @-@ b",), ("éé",)]
    out = clean.clean_encyclopedia(spark.createDataFrame(rows, "text string"))
    assert [r["text"] for r in out.collect()] == ["a - b", ""]


def test_min_length_is_strict(spark):
    df = spark.createDataFrame([("1234567890 ",), ("12345678901",)], "text string")
    assert clean.min_length(df).count() == 1


def test_prompt_pairs_need_both_parts(spark):
    rows = [(3, "A. B."), (1, "Only one"), (2, " C d. E f. G. "), (5, "X. Y.")]
    out = clean.prompt_pairs(spark.createDataFrame(rows, "id int, text string"), "id", 2).orderBy("pos")
    assert [(r["pos"], r["prompt"], r["reference"]) for r in out.collect()] == [(0, "C d.", "E f. G."), (1, "A.", "B.")]
