"""Cleaning queries over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog.common import documents, spread, table
from seepage.functions import text as T
from seepage.functions.text import SPACE
from seepage.operators import clean

_REPLY = "\n-----Original Message-----\nFrom: a@b.example\nSubject: re\n \n"
_NOTICE = "\nThis Message contains CONFIDENTIAL information. Please notify the sender immediately.\n"


def _mails(spark, sf_dir):
    """One raw message per document; German ones lack Cc, Spanish are multipart."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(
        "doc_id",
        F.concat(
            F.lit("From: "), F.col("source"), F.lit("@corp.example\r\nTO: x@corp.example,\r\n\ty@corp.example\r\n"),
            F.lit("Subject: the note "), F.col("doc_id"), F.lit(" in "), F.col("lang"), F.lit("\r\n"),
            F.lit("Date: Mon, 14 May 2001 16:39:00 -0700 (PDT)\r\n"),
            F.when(F.col("lang") == "de", F.lit("")).otherwise(F.lit("Cc: z@corp.example\r\n")),
            F.when(F.col("lang") == "es", F.lit("Content-Type: Multipart/mixed\r\n")).otherwise(F.lit("")),
            F.lit("\r\n"), F.col("text"), F.lit(_REPLY), F.col("text"),
            F.when(F.col("lang") == "fr", F.lit(_NOTICE)).otherwise(F.lit("")),
        ).alias("raw"),
    )


_MAILS = rf"""mails AS (SELECT doc_id,
  replace(source || '@corp.example', chr(13), '') AS "from", 'x@corp.example,' || chr(10) || chr(9) || 'y@corp.example' AS "to",
  'the note ' || doc_id || ' in ' || lang AS subject, 'Mon, 14 May 2001 16:39:00 -0700 (PDT)' AS date,
  CASE WHEN lang <> 'de' THEN 'z@corp.example' END AS cc, CAST(NULL AS VARCHAR) AS bcc,
  CASE WHEN lang <> 'es' THEN regexp_replace(text || '{_REPLY}' || text
    || CASE WHEN lang = 'fr' THEN '{_NOTICE}' ELSE '' END, '\r\n?', chr(10), 'g') END AS body FROM documents)"""


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _squeeze_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def _disclaimer_sql(x: str) -> str:
    for phrase in T.DISCLAIMERS:
        x = f"regexp_replace({x}, '(?is){phrase}.*', '')"
    return x


def _reply_sql(x: str) -> str:
    return _strip_sql(rf"regexp_replace({x}, '(?s)-----Original Message-----.*?\n{SPACE}*\n', '', 'g')")


def _symbols_sql(x: str) -> str:
    return rf"regexp_replace({x}, '[^a-zA-Z0-9\t-\r\x1c-\x20\x{{85}}\p{{Z}}]', '', 'g')"


_URL_SQL = r"(?i)\b(?:https?://|ftp://|www\.)[^\t-\r\x1c-\x20\x{85}\p{Z}<>]+"


def _normal_sql(x: str, drop_emails: bool = False) -> str:
    x = f"regexp_replace(lower({x}), '{_URL_SQL}', '', 'g')"
    if drop_emails:
        x = rf"regexp_replace({x}, '[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '', 'g')"
    return _squeeze_sql(rf"regexp_replace({x}, '\p{{P}}', '', 'g')")


def _stop_sql(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return (
        f"array_to_string(list_filter(string_split_regex({x}, '{SPACE}+'), "
        f"lambda w: w <> '' AND w NOT IN ({words})), ' ')"
    )


def _mail_sql(x: str) -> str:
    body = _symbols_sql(_normal_sql(_reply_sql(_disclaimer_sql(x))))
    return f"coalesce({_stop_sql(body)}, '')"


def _web_sql(x: str) -> str:
    return _squeeze_sql(f"regexp_replace(lower({x}), '<[^>]+>', '', 'g')")


def _marks_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '@-@', '-'), '@,@', ','), '@.@', '.')"


def _markup_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '={SPACE}?[^\n]*?{SPACE}?=', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '\[\[|\]\]', '', 'g'), '''''+', '', 'g')"
    return _strip_sql(f"replace({x}, '<unk>', '')")


def _wiki_sql(x: str) -> str:
    return f"coalesce({_stop_sql(_normal_sql(_markup_sql(x), True))}, '')"


_NAMES_SQL = "|".join(T.ABBREVIATIONS)


def _sentences_sql(x: str) -> tuple[str, str]:
    s = rf"regexp_replace({_strip_sql(x)}, '(^|{SPACE}|\()({_NAMES_SQL})\.', '\1\2' || chr(57344), 'g')"
    first = rf"(?s)^(.*?[.!?]){SPACE}+(\p{{Lu}}.*)$"
    head = f"regexp_extract({s}, '{first}', 1)"
    rest = f"regexp_extract({s}, '{first}', 2)"
    one = f"replace(CASE WHEN {head} <> '' THEN {head} ELSE {s} END, chr(57344), '.')"
    more = rf"replace(regexp_replace({rest}, '([.!?]){SPACE}+(\p{{Lu}})', '\1 \2', 'g'), chr(57344), '.')"
    return one, more


def _docs(change):
    return lambda spark, sf_dir: documents(spark, sf_dir).withColumn("text", change(F.col("text")))


def _docs_sql(change: str) -> str:
    return f"SELECT doc_id, {change} AS text FROM documents"


def _marked_up(text):
    """A document dressed with tags, headings, links and number marks."""
    return F.concat(
        F.lit("= Title =\n[[Link]] ''it'' <unk> 3 @.@ 5 see https://www.x.example/p?q=1 or me.too@x.example <b>"),
        text,
        F.lit("</b> 10 @,@ 000 self @-@ made "),
    )


_MARKED = (
    "'= Title =' || chr(10) || '[[Link]] ''''it'''' <unk> 3 @.@ 5 see https://www.x.example/p?q=1 or "
    "me.too@x.example <b>' || text || '</b> 10 @,@ 000 self @-@ made '"
)


def _on_mail_body(change):
    return lambda spark, sf_dir: clean.parse_mail(_mails(spark, sf_dir)).select(
        "doc_id", change(F.col("body")).alias("text")
    )


def _on_mail_body_sql(change: str) -> str:
    return f"WITH {_MAILS} SELECT doc_id, {change} AS text FROM mails"


def _headings(spark, sf_dir):
    """Each line of a document, preceded by a heading for odd documents."""
    texts = documents(spark, sf_dir).select(
        "doc_id",
        F.posexplode(T.lines(F.concat(F.when(F.col("doc_id") % 2 == 1, F.lit(" = Head = \n\n")).otherwise(F.lit("")), F.col("text")))).alias("line_no", "text"),
    )
    return texts.withColumn("line_no", F.col("line_no").cast("bigint"))


_HEADINGS = f"""headings AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS text FROM (
  SELECT doc_id, parts, unnest(range(1, CASE WHEN parts[-1] = '' THEN len(parts) ELSE len(parts) + 1 END)) AS i
  FROM (SELECT doc_id, string_split_regex(CASE WHEN doc_id % 2 = 1 THEN ' = Head = ' || chr(10) || chr(10) ELSE '' END || text,
    '{T.LINE_BREAK}') AS parts FROM documents)))"""


def _prompts(spark, sf_dir):
    return clean.prompt_pairs(documents(spark, sf_dir), "doc_id", 100)


def _sentences(spark, sf_dir):
    text = F.concat(F.lit("Mr. Doe and Dr. Roe met. "), F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", T.first_sentence(text).alias("first"), T.later_sentences(text).alias("rest")
    )


_ONE, _MORE = _sentences_sql("'Mr. Doe and Dr. Roe met. ' || text")
_P_ONE, _P_MORE = _sentences_sql("text")

QUERIES = {
    "p1_parse_email": lambda spark, sf_dir: clean.parse_mail(_mails(spark, sf_dir)),
    "p2_remove_disclaimer": _on_mail_body(T.strip_disclaimer),
    "p3_remove_reply_chain": _on_mail_body(T.strip_reply_header),
    "p4_remove_symbols": _docs(T.strip_symbols),
    "p5_normalise_text": _docs(lambda t: T.normalise(_marked_up(t))),
    "p5_normalise_without_emails": _docs(lambda t: T.normalise(_marked_up(t), drop_emails=True)),
    "p6_remove_stopwords": _docs(T.drop_stop_words),
    "p7_clean_body": lambda spark, sf_dir: clean.clean_mail(clean.parse_mail(_mails(spark, sf_dir))),
    "p8_collapse_ws": _docs(T.squeeze),
    "p9_drop_null_text": lambda spark, sf_dir: clean.drop_null_text(
        table(spark, sf_dir, "documents").select(
            "doc_id", F.when(F.col("lang") != "de", F.col("text")).alias("text")
        )
    ),
    "p10_strip_html": lambda spark, sf_dir: spread(
        table(spark, sf_dir, "pages").select("page_id", "html")
    ).select("page_id", T.strip_tags(F.col("html")).alias("text")),
    "p11_clean_web": lambda spark, sf_dir: clean.clean_web(
        spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))
    ),
    "p12_drop_empty": lambda spark, sf_dir: clean.drop_empty(
        documents(spark, sf_dir).withColumn("text", T.strip(T.strip_symbols(F.regexp_replace("text", "[a-z]", ""))))
    ),
    "p13_drop_headings": lambda spark, sf_dir: clean.drop_headings(_headings(spark, sf_dir)),
    "p14_fix_wiki_artifacts": _docs(lambda t: T.join_number_marks(_marked_up(t))),
    "p15_remove_non_ascii": _docs(T.ascii_only),
    "p15_clean_encyclopedia": lambda spark, sf_dir: clean.clean_encyclopedia(_headings(spark, sf_dir)),
    "p16_clean_wiki_markup": _docs(lambda t: T.strip_wiki_markup(_marked_up(t))),
    "p17_raw_clean_pairs": lambda spark, sf_dir: clean.raw_clean_pairs(documents(spark, sf_dir), "doc_id", 1000),
    "p18_min_length": lambda spark, sf_dir: clean.min_length(documents(spark, sf_dir)),
    "p19_split_first_sentence": _sentences,
    "p20_prompt_pairs": _prompts,
}

_FIELDS = 'doc_id, "from", "to", subject, date, cc, bcc, body'

ORACLES = {
    "p1_parse_email": f"WITH {_MAILS} SELECT {_FIELDS} FROM mails",
    "p2_remove_disclaimer": _on_mail_body_sql(_disclaimer_sql("body")),
    "p3_remove_reply_chain": _on_mail_body_sql(_reply_sql("body")),
    "p4_remove_symbols": _docs_sql(_symbols_sql("text")),
    "p5_normalise_text": _docs_sql(_normal_sql(_MARKED)),
    "p5_normalise_without_emails": _docs_sql(_normal_sql(_MARKED, True)),
    "p6_remove_stopwords": _docs_sql(_stop_sql("text")),
    "p7_clean_body": f"""WITH {_MAILS} SELECT doc_id, "from", "to", {_mail_sql("subject")} AS subject,
  {_mail_sql("date")} AS date, cc, bcc, {_mail_sql("body")} AS body FROM mails""",
    "p8_collapse_ws": _docs_sql(_squeeze_sql("text")),
    "p9_drop_null_text": "SELECT doc_id, text FROM documents WHERE lang <> 'de' AND text IS NOT NULL",
    "p10_strip_html": "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages",
    "p11_clean_web": f"SELECT * FROM (SELECT page_id, {_web_sql('html')} AS text FROM pages) WHERE text <> ''",
    "p12_drop_empty": "SELECT * FROM (" + _docs_sql(_strip_sql(_symbols_sql("regexp_replace(text, '[a-z]', '', 'g')"))) + ") WHERE text <> ''",
    "p13_drop_headings": f"""WITH {_HEADINGS} SELECT doc_id, line_no, text FROM (
  SELECT doc_id, line_no, {_strip_sql("text")} AS text FROM headings) WHERE text <> '' AND text NOT LIKE '=%'""",
    "p14_fix_wiki_artifacts": _docs_sql(_marks_sql(_MARKED)),
    "p15_remove_non_ascii": _docs_sql(r"regexp_replace(text, '[^\x00-\x7F]+', '', 'g')"),
    "p15_clean_encyclopedia": rf"""WITH {_HEADINGS} SELECT doc_id, line_no,
  regexp_replace({_marks_sql("text")}, '[^\x00-\x7F]+', '', 'g') AS text FROM (
  SELECT doc_id, line_no, {_strip_sql("text")} AS text FROM headings) WHERE text <> '' AND text NOT LIKE '=%'""",
    "p16_clean_wiki_markup": _docs_sql(_markup_sql(_MARKED)),
    "p17_raw_clean_pairs": f"""SELECT doc_id, text AS raw_text, {_wiki_sql("text")} AS cleaned_text
FROM documents ORDER BY doc_id LIMIT 1000""",
    "p18_min_length": f"SELECT doc_id, text FROM documents WHERE length({_strip_sql('text')}) > 10",
    "p19_split_first_sentence": f"SELECT doc_id, {_ONE} AS first, {_MORE} AS rest FROM documents",
    "p20_prompt_pairs": f"""SELECT doc_id, prompt, reference, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM (
  SELECT * FROM (SELECT doc_id, {_P_ONE} AS prompt, {_P_MORE} AS reference FROM documents)
  WHERE prompt <> '' AND reference <> '' ORDER BY doc_id LIMIT 100)""",
}
