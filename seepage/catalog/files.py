"""Readers and writers: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog import audit as audit_queries
from seepage.catalog import common
from seepage.catalog.cleaning import ORACLES as CLEANING
from seepage.catalog.cleaning import _mails, _strip_sql
from seepage.catalog.common import documents, spread, table
from seepage.catalog.tokens import WORDS as TOKEN_SQL
from seepage.functions.text import SPACE
from seepage.operators import audit, clean, sample, tokens
from seepage.operators import language_model as lm
from seepage.session import materialise, shared_path
from seepage.sources import readers, writers


def _sourced(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _one_file_per_source(rows, spark, label):
    """Write (source, doc_id, value) with one file per source, in doc order."""
    path = shared_path(spark, label)
    (
        rows.repartition("source")
        .sortWithinPartitions("source", "doc_id")
        .select("source", "value")
        .write.partitionBy("source")
        .text(path)
    )
    return path


def _maildir(spark, sf_dir):
    """One file per document at source/language/file."""
    path = shared_path(spark, "maildir")
    writers.write_file_tree(_sourced(spark, sf_dir), path, ["source", "lang"])
    mails = readers.read_maildir(spark, path)
    # UTF-8 bytes read as latin-1 give the text back through the same bytes
    back = F.decode(F.encode("raw", "ISO-8859-1"), "UTF-8")
    return mails.select("user", "folder", F.md5(back).alias("digest"))


def _csv(spark, sf_dir):
    """Good rows from documents, over-long rows from pages, short rows from passages."""
    path = shared_path(spark, "csv")
    options = dict(header=True, quoteAll=True, escape='"')
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("Filled Template"), F.lit("x").alias("note"))
    docs.write.options(**options).csv(path)
    table(spark, sf_dir, "pages").select("page_id", "url", F.lit("x"), F.lit("")).write.mode("append").options(**options).csv(path)
    table(spark, sf_dir, "benchmark").select("item_id").write.mode("append").options(**options).csv(path)
    columns = ["doc_id", "Filled Template", "note"]
    rows = readers.read_pii_csv(spark, path, "Filled Template", columns)
    return rows.groupBy(F.md5(F.coalesce("text", F.lit("-"))).alias("digest")).agg(F.count("*").alias("n"))


def _written_lines(spark, sf_dir):
    path = shared_path(spark, "lines")
    writers.write_lines(documents(spark, sf_dir), path, order=["doc_id"])
    return path


def _lines(spark, sf_dir):
    rows = readers.read_lines(spark, _written_lines(spark, sf_dir))
    return rows.groupBy("text").agg(F.count("*").alias("n"))


def _corpus(spark, sf_dir):
    path = shared_path(spark, "corpus")
    split = sample.split_by_position(documents(spark, sf_dir), ["doc_id"])
    split.write.partitionBy("split").parquet(path)
    return readers.read_corpus(spark, path, split="val")


def _marked(spark, sf_dir):
    rows = _sourced(spark, sf_dir).withColumn("value", F.concat("text", F.lit("\n <|pii|>")))
    path = _one_file_per_source(rows, spark, "marked")
    return readers.read_marked(spark, path, "<|pii|>").groupBy("text").agg(F.count("*").alias("n"))


_WARC = (
    "WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://x.example/\r\n"
    "WARC-Date: 2021-05-01T00:00:00Z\r\nWARC-Record-ID: <a>\r\nWARC-Refers-To: <b>\r\n"
    "WARC-Block-Digest: sha1:c\r\nWARC-Identified-Content-Language: "
)


def _wet(spark, sf_dir):
    language = F.when(F.col("lang") == "en", F.lit("eng")).otherwise(F.col("lang"))
    rows = _sourced(spark, sf_dir).withColumn(
        "value",
        F.concat(
            F.lit(_WARC), language, F.lit("\r\nContent-Type: text/plain\r\nContent-Length: 1\r\n\r\n"), F.col("text"), F.lit("\r\n")
        ),
    )
    records = readers.read_wet(spark, _one_file_per_source(rows, spark, "wet"))
    return records.groupBy(F.md5("body").alias("digest")).agg(F.count("*").alias("n"))


def _nonblank(spark, sf_dir):
    path = shared_path(spark, "nonblank")
    writers.write_samples(documents(spark, sf_dir), path, order=["doc_id"])
    return readers.read_nonblank_lines(spark, path)


def _report(clean_report):
    def query(spark, sf_dir):
        rows = _sourced(spark, sf_dir).withColumn(
            "value", F.concat(F.lit("======== top 100 samples by x: ========\n"), F.col("doc_id"), F.lit(": x=1.000, score=2.000\n\n"), F.col("text"), F.lit("\n"))
        )
        path = _one_file_per_source(rows, spark, "report")
        return readers.read_ranked_report(spark, path, clean_report).groupBy("text").agg(F.count("*").alias("n"))

    return query


def _cached(spark, sf_dir):
    """The second call reads what the first one saved."""
    path = shared_path(spark, "cache")

    def compute():
        return documents(spark, sf_dir).select("doc_id", F.size(tokens.token_words(F.col("text"))).cast("bigint").alias("n"))

    readers.token_cache(spark, path, compute)
    return readers.token_cache(spark, path, lambda: compute().limit(0))


def _email_report(spark, sf_dir):
    path = shared_path(spark, "email-report")
    writers.write_email_report(clean.clean_mail(clean.parse_mail(_mails(spark, sf_dir))), path, "doc_id")
    lines = readers.read_lines(spark, path)
    return lines.groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n"))


def _ordered_lines(spark, sf_dir):
    """Lines come back in document order."""
    return readers.read_nonblank_lines(spark, _written_lines(spark, sf_dir))


def _samples(spark, sf_dir):
    path = shared_path(spark, "samples")
    writers.write_samples(documents(spark, sf_dir), path, order=["doc_id"])
    rows = readers.read_lines(spark, path)
    return rows.agg(F.count("*").alias("n_lines"), F.sum((F.col("text") == "").cast("bigint")).alias("n_blank"))


def _token_table(spark, sf_dir):
    path = shared_path(spark, "tokens")
    split = sample.split_by_position(documents(spark, sf_dir), ["doc_id"])
    vocab = materialise(tokens.build_vocab(split), "vocab")
    ids = tokens.encode(split, vocab, "doc_id")
    writers.write_token_table(split.select("doc_id", "split").join(ids, "doc_id"), path)
    back = spark.read.parquet(path)
    return back.select("doc_id", "split", F.array_join("ids", ",").alias("ids"))


def _ranking(spark, sf_dir):
    """Documents ranked by length and by length over characters of their source."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), (F.col("n_chars") + 10).alias("model"), (F.length("source") + 2).alias("other"), "text"
    )
    best = lm.rank_by_perplexity(docs, "model").unionByName(lm.rank_by_ratio(docs, "model", ["other"]))
    return best.join(docs.select("sample_id", "text"), "sample_id")


def _ranked_report(spark, sf_dir):
    path = shared_path(spark, "ranked")
    writers.write_ranked_report(_ranking(spark, sf_dir), path, "model")
    lines = readers.read_lines(spark, path).filter(F.col("text") != "")
    return lines.groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n"))


def _summary(spark, sf_dir):
    path = shared_path(spark, "summary")
    found = materialise(audit_queries._found(spark, sf_dir), "found")
    counts = audit.zero_fill(audit.leak_counts(found), audit.category_table(spark))
    totals = audit.audit_totals(counts, common.samples(spark, sf_dir))
    writers.write_summary_csv(audit.with_examples(counts, found), totals, path)
    rows = spark.read.options(header=True, escape='"').csv(path)
    return rows.select(
        F.col("Category").alias("category"),
        F.col("`Unique Sample Count`").cast("bigint").alias("first_count"),
        F.col("`Total Match Count`").cast("bigint").alias("second_count"),
        F.coalesce("Examples", F.lit("")).alias("examples"),
    )


_ESCAPED = r"replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10), '\n')"
_UNIX = r"regexp_replace({x}, '\r\n?', chr(10), 'g')"
_BLOCK = f"""list_filter(list_transform(string_split_regex(text, '\\r\\n?|\\n'), lambda l: {_strip_sql('l')}), lambda l: l <> '')"""


def _report_sql(banner: str, rows: str) -> str:
    return f"""WITH blocks AS (SELECT doc_id, source, array_to_string({_BLOCK}, ' ') AS body,
  lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) IS NOT NULL AS followed FROM documents),
texts AS (SELECT trim(body || CASE WHEN followed THEN '{banner}' ELSE '' END) AS text FROM blocks)
{rows}"""


QUERIES = {
    "s1_read_maildir": _maildir,
    "s2_read_pii_csv": _csv,
    "s3_read_lines": _lines,
    "s4_read_corpus": _corpus,
    "s5_read_marked": _marked,
    "s6_read_wet": _wet,
    "s7_read_nonblank_lines": _nonblank,
    "s8_read_ranked_report": _report(False),
    "s8_read_ranked_report_clean": _report(True),
    "s9_token_cache": _cached,
    "w1_write_email_report": _email_report,
    "w2_write_lines": _ordered_lines,
    "w3_write_samples": _samples,
    "w4_write_token_table": _token_table,
    "w5_write_ranked_report": _ranked_report,
    "w6_write_summary_csv": _summary,
}

_SPLIT = """(SELECT doc_id, text, CASE WHEN pos < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split
  FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents))"""
_WORDS = f"list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> '')"

ORACLES = {
    "s1_read_maildir": f"""SELECT 'source=' || source AS "user", 'lang=' || lang AS folder,
  md5({_UNIX.format(x="text || chr(10)")}) AS digest FROM documents""",
    "s2_read_pii_csv": """SELECT md5(coalesce(text, '-')) AS digest, count(*) AS n FROM (
  SELECT text FROM documents UNION ALL SELECT NULL FROM benchmark) GROUP BY 1""",
    "s3_read_lines": f"SELECT {_ESCAPED} AS text, count(*) AS n FROM documents GROUP BY 1",
    "s4_read_corpus": f"SELECT doc_id, text FROM {_SPLIT} WHERE split = 'val'",
    "s5_read_marked": f"SELECT {_strip_sql('text')} AS text, count(*) AS n FROM documents WHERE {_strip_sql('text')} <> '' GROUP BY 1",
    "s6_read_wet": f"""WITH last AS (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source)
SELECT md5(chr(10) || ' ' || replace({_UNIX.format(x="text")}, chr(10), chr(10) || ' ') || chr(10) || ' ' || chr(10)) AS digest, count(*) AS n
FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM last) GROUP BY 1""",
    "s7_read_nonblank_lines": f"""WITH l AS (SELECT doc_id, unnest({_BLOCK}) AS text, unnest(range(len({_BLOCK}))) AS i FROM documents)
SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, text FROM l""",
    "s8_read_ranked_report": _report_sql(
        " ======== top 100 samples by x: ========", "SELECT text, count(*) AS n FROM texts WHERE text <> '' GROUP BY 1"
    ),
    "s8_read_ranked_report_clean": _report_sql("", "SELECT DISTINCT text, 1 AS n FROM texts WHERE text <> ''"),
    "s9_token_cache": f"SELECT doc_id, len({_WORDS}) AS n FROM documents",
    "w2_write_lines": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, {_strip_sql(_ESCAPED)} AS text
FROM documents WHERE {_strip_sql(_ESCAPED)} <> ''""",
    "w3_write_samples": r"""WITH l AS (SELECT unnest(string_split_regex(text || chr(10), '\r\n?|\n')) AS line FROM documents)
SELECT count(*) AS n_lines, count(*) FILTER (WHERE line = '') AS n_blank FROM l""",
    "w4_write_token_table": f"""WITH {TOKEN_SQL} SELECT doc_id, split, array_to_string(ids, ',') AS ids FROM {_SPLIT} JOIN encoded USING (doc_id)""",
    "w5_write_ranked_report": rf"""WITH scored AS (SELECT doc_id, n_chars + 10.0 AS m, length(source) + 2.0 AS o, {_ESCAPED} AS body FROM documents),
long AS (SELECT 'model perplexity' AS metric, doc_id, -ln(m) AS v, 'model=' || printf('%.3f', m) AS s, body FROM scored
  UNION ALL SELECT 'ratio of other to model perplexity', doc_id, ln(o) / ln(m), 'model=' || printf('%.3f', m) || ', other=' || printf('%.3f', o), body FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, doc_id) AS rank FROM long),
lines AS (SELECT rank || ': ' || s || ', score=' || printf('%.3f', v) AS line FROM ranked WHERE rank <= 100
  UNION ALL SELECT body FROM ranked WHERE rank <= 100
  UNION ALL SELECT '======== top 100 samples by ' || metric || ': ========' FROM ranked WHERE rank = 1)
SELECT line, count(*) AS n FROM lines GROUP BY line""",
    "w6_write_summary_csv": f"""SELECT * FROM ({audit_queries.SUMMARY_SQL})
UNION ALL SELECT metric, value, NULL, '' FROM ({audit_queries.ORACLES["a5_audit_totals"]})
UNION ALL SELECT NULL, NULL, NULL, ''""",
}
P7 = CLEANING["p7_clean_body"]
ORACLES["w1_write_email_report"] = f"""WITH lines AS (SELECT 'Email #' || row_number() OVER (ORDER BY doc_id) AS line FROM documents
  UNION ALL SELECT unnest(['from: ' || "from", 'to: ' || replace("to", chr(10) || chr(9), ' '), 'subject: ' || subject,
    'date: ' || date, 'cc: ' || coalesce(cc, 'None'), 'bcc: None', 'body: ' || body]) FROM ({P7}))
SELECT line, count(*) AS n FROM lines GROUP BY line"""
