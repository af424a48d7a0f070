import re
import time

import pytest
from pyspark.sql import functions as F

from seepage.functions import patterns as P

# texts and the matches that belong to them, by hand
GOLDEN = {
    "find_news": [("the white house said so", ["white house"]), ("WHITE HOUSE", ["WHITE HOUSE"]), ("whitehouse", [])],
    "find_license": [("License LICENSED", ["License", "LICENSE"]), ("All rights reserved.", ["All rights reserved"]), ("lic", [])],
    "find_url": [
        ("see http:foo.com now", ["http:foo.com"]),
        ("https://www.x.com/a", ["www.x.com"]),
        ("www.y.org.", ["www.y.org"]),
        ("httpx foo.com", []),
        ("éwww.z.com", []),
    ],
    "find_promo": [("please subscribe", ["subscribe"]), ("subscribers", [])],
    "find_email": [
        ("a.b+c@x-y.example.com, @x", ["a.b+c@x-y.example.com"]),
        ("a@b no", []),
        ("1@2.com 3@4.org", ["1@2.com", "3@4.org"]),
    ],
    "find_phone": [
        ("call 12345678", ["12345678"]),
        ("+1 (499) 555-6503", ["+1 (499) 555-6503"]),
        ("555 1234", ["555 1234"]),
        ("12-34", []),
    ],
    "find_handle": [("(@ann) a@b @x.", ["@ann"]), ("@josé!", ["@josé"]), ("@toolonghandle12345678", []), ("@a@b", [])],
    "find_address": [
        ("at 12 Main Street,", ["12 Main Street"]),
        ("99999 Old Mill Road", ["99999 Old Mill Road"]),
        ("123456 Big Ave", []),
        ("12 main Street", []),
    ],
    "find_code": [("def f", ["def "]), ("class A </div>", ["class ", "</div>"]), ("function\t x", ["function\t "]), ("<B>", [])],
    "find_config": [("key = value\nno", ["key = value"]), ("[a] x", ["[a]"]), (" b=2", []), ("a=\n", [])],
    "find_faith": [("God's Bible", ["God", "Bible"]), ("Godot", [])],
    "find_quote": [("by Donald Trump: so", ["Donald Trump:"]), ("Donald", [])],
    "find_entropy": [("id " + "A1b2" * 8 + " end", ["A1b2" * 8]), ("A1b2" * 7, [])],
    "find_named_list": [("of Ann,Bob,  Cy and", ["Ann,Bob,  Cy"]), ("Ann, Bob", []), ("ann, bob, cy", [])],
    "find_forum": [("Talk: wiki Wikis FAQ", ["Talk:", "wiki", "FAQ"]), ("User talk:me", ["User talk:"]), ("wikis", [])],
    "find_log": [("x.log IOError", [".log", "Error"]), ("Traceback (most recent call last)", ["Traceback (most recent call last)"])],
    "find_pseudonym": [("aka Bob", ["aka Bob"]), ("also known as  Eve", ["also known as  Eve"]), ("aka bob", [])],
    "find_form": [("<form a>\n</form> x", ["<form a>\n</form>"]), ("<input type=x>", ["input type="]), ("<form></form>", ["<form></form>"]), ("<form>", [])],
    "find_tech": [("a developer conference", ["developer conference"]), ("white house", [])],
    "find_numbers": [("on 1, 2,3 4 x", ["2,3 4"]), ("66 7", ["66 7"]), ("7,,8", []), ("8", [])],
    "find_name_runs": [("Dr President Ann Lee Smith Jones met", ["Dr President Ann Lee Smith Jones"]), ("McAnn", ["Mc"]), ("ann", [])],
}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_extractor_finds_what_belongs_to_it(spark, name):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(GOLDEN[name])], "i int, text string")
    got = {r["i"]: r["m"] for r in df.select("i", getattr(P, name)(F.col("text")).alias("m")).collect()}
    for i, (text, matches) in enumerate(GOLDEN[name]):
        assert got[i] == matches, text


def test_contact_concatenates_in_order(spark):
    df = spark.createDataFrame([("@ann a@b.com 1234567",)], "text string")
    assert df.select(P.find_contact(F.col("text")).alias("m")).first()["m"] == ["a@b.com", "1234567", "@ann"]


def test_long_hopeless_inputs_stay_fast(spark):
    evil = ["https" + "a" * 5000, "a." * 5000, "1" * 20000, "Abc, " * 3000 + "x", "[" * 200, "www" + ".a" * 30000, "12 " + "Abc " * 30000]
    df = spark.createDataFrame([(e,) for e in evil], "text string")
    finders = [P.find_url, P.find_email, P.find_numbers, P.find_named_list, P.find_config, P.find_address]
    row = df.select(*[F.sum(F.size(f(F.col("text")))).alias(str(i)) for i, f in enumerate(finders)]).first()
    assert list(row) == [0, 0, 0, 1, 0, 0]


def test_unclosed_forms_take_linear_time(spark):
    texts = ["<form " * 20_000, "<form a>x</form>" + "<form " * 20_000 + "input type=", "<form</form>" * 3000, "a <form> b </form> <form input type= c", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    start = time.time()
    got = {r["i"]: r["m"] for r in df.select("i", P.find_form(F.col("text")).alias("m")).collect()}
    assert time.time() - start < 10
    plain = re.compile(r"(?s)<form.+?</form>|input type=")
    assert got[0] == [] and got[1] == ["<form a>x</form>", "input type="]
    assert all(got[i] == plain.findall(texts[i]) for i in (2, 3, 4))


def test_register_adds_or_replaces():
    added = P.register(P.DEFAULT, "New", P.find_code)
    assert [e.name for e in added] == [e.name for e in P.DEFAULT] + ["New"]
    replaced = P.register(P.DEFAULT, P.NEWS, P.find_tech, is_pii=True)
    assert len(replaced) == len(P.DEFAULT) and replaced[0].is_pii
