"""One query per extractor over documents, pages, turns and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from seepage.catalog import common
from seepage.catalog.common import masked
from seepage.functions import patterns as P
from seepage.functions.text import SPACE, WORD
from seepage.operators import audit


def _texts(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("sample_id"), "text"
    )
    return docs.unionByName(common.samples(spark, sf_dir))


_TEXTS = f"""WITH {common.SAMPLES}, texts AS (
  SELECT 'd' || doc_id AS sample_id, text FROM documents UNION ALL SELECT * FROM samples)"""


def _report(df):
    """Texts with a match. The condition sits inside the row so that matches
    are computed once and not again for a filter."""
    row = F.struct(
        F.size("m").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("m")), " | ").alias("matches"),
    )
    kept = F.filter(F.array(row), lambda r: r["n_matches"] > 0)
    return df.select("sample_id", F.explode(kept).alias("_r")).select(
        "sample_id", "_r.n_matches", "_r.matches"
    )


def _query(find):
    return lambda spark, sf_dir: _report(
        _texts(spark, sf_dir).select("sample_id", find(F.col("text")).alias("m"))
    )


def _sql(matches: str) -> str:
    return f"""{_TEXTS}
SELECT sample_id, CAST(len(m) AS BIGINT) AS n_matches,
       array_to_string(list_sort(list_distinct(m)), ' | ') AS matches
FROM (SELECT sample_id, {matches} AS m FROM texts) WHERE len(m) > 0"""


def _all(pattern: str, group: int = 0, text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{pattern}', {group})"


def _keywords(alternatives: str) -> str:
    return _all(rf"(?i)\b({alternatives})\b", 1, masked())


_EMAIL = _all(r"[\p{L}\p{N}_.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_PHONE = _all(
    rf"(?:\+?\p{{Nd}}{{1,3}}(?:{SPACE}|[.-])?)?(?:\(?\p{{Nd}}{{2,4}}\)?(?:{SPACE}|[.-])?)?"
    rf"\p{{Nd}}{{3,4}}(?:{SPACE}|[.-])?\p{{Nd}}{{4}}"
)
# characters that may follow a handle are doubled so that one can end a match
# and the other can start the next
_HANDLE = _all(
    rf"(?:^|[^\p{{L}}\p{{N}}_])(@{WORD}{{1,15}})(?:$|[^\p{{L}}\p{{N}}_@.])",
    1,
    r"regexp_replace(text, '([^\p{L}\p{N}_@.])', '\1\1', 'g')",
)
_ADDRESS = _all(
    rf"\b\d{{1,5}}\s+(?:[A-Z][a-z]+\s)+(?:{P.STREET_WORDS})\b", 0, masked()
)


def _names_query(spark, sf_dir):
    hits = audit.name_matches(_texts(spark, sf_dir), common.names(spark, sf_dir))
    return hits.groupBy("match").agg(F.count_distinct("sample_id").alias("n_samples"))


_NAMES_SQL = f"""{_TEXTS}, {common.NAMES}
SELECT match, count(DISTINCT sample_id) AS n_samples FROM ({common.name_sql("texts")}) GROUP BY match"""


def _registry_query(spark, sf_dir):
    """A user category next to the built-in ones: words in capitals."""
    shout = F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{6,}(?![\p{L}\p{N}_])")
    registry = P.register(
        P.DEFAULT, "Shouting", lambda text: F.regexp_extract_all(text, shout, F.lit(0))
    )
    return (
        audit.candidates(_texts(spark, sf_dir), registry)
        .filter(F.col("category").isin("Shouting", P.LICENSE))
        .groupBy("category")
        .agg(F.count("*").cast("bigint").alias("n_candidates"))
    )


_REGISTRY_SQL = rf"""{_TEXTS}, found AS (
  SELECT DISTINCT 'Shouting' AS category, sample_id,
    unnest({_all(r"\b[A-Z]{6,}\b", 0, masked())}) AS match FROM texts
  UNION ALL
  SELECT DISTINCT '{P.LICENSE}', sample_id, unnest({_all(f"(?i)({P.LICENSE_WORDS})", 1)}) FROM texts)
SELECT category, count(*) AS n_candidates FROM found GROUP BY category"""

QUERIES = {
    "x0_register_extractor": _registry_query,
    "x1_news": _query(P.find_news),
    "x2_license": _query(P.find_license),
    "x3_urls": _query(P.find_url),
    "x4_names": _names_query,
    "x5_promotional": _query(P.find_promo),
    "x6_contact": _query(P.find_contact),
    "x6a_email": _query(P.find_email),
    "x6b_phone": _query(P.find_phone),
    "x6c_handle": _query(P.find_handle),
    "x6d_address": _query(P.find_address),
    "x7_code": _query(P.find_code),
    "x8_configuration": _query(P.find_config),
    "x9_religious": _query(P.find_faith),
    "x10_quotes": _query(P.find_quote),
    "x11_high_entropy": _query(P.find_entropy),
    "x12_named_lists": _query(P.find_named_list),
    "x13_forum": _query(P.find_forum),
    "x14_logs": _query(P.find_log),
    "x15_pseudonyms": _query(P.find_pseudonym),
    "x16_forms": _query(P.find_form),
    "x17_tech_news": _query(P.find_tech),
    "x18_number_lists": _query(P.find_numbers),
}

# SQL array of matches for each built-in category that needs no table
MATCH_SQL = {
    P.NEWS: _keywords(f"{P.NEWS_WORDS}|{P.TECH_WORDS}"),
    P.LICENSE: _all(f"(?i)({P.LICENSE_WORDS})", 1),
    P.URLS: _all(
        rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])((?:https?|ftp|www)[.:/\\]?{WORD}+(?:[.:/\\]?{WORD}+)*"
        rf"\.(?:{P.TOP_DOMAINS}))",
        1,
    ),
    P.PROMO: _keywords(P.PROMO_WORDS),
    P.CONTACT: f"list_concat(list_concat({_EMAIL}, {_PHONE}), list_concat({_HANDLE}, {_ADDRESS}))",
    P.CODE: _all(rf"def |class |function{SPACE}+|</?[a-z]+>"),
    P.CONFIG: _all(rf"(?m)\[.*?\]|^[a-zA-Z0-9_]+{SPACE}*={SPACE}*.+$"),
    P.FAITH: _keywords(P.FAITH_WORDS),
    P.QUOTES: _all(f"(?i)({P.QUOTE_WORDS})", 1),
}

ORACLES = {
    "x0_register_extractor": _REGISTRY_SQL,
    "x1_news": _sql(MATCH_SQL[P.NEWS]),
    "x2_license": _sql(MATCH_SQL[P.LICENSE]),
    "x3_urls": _sql(MATCH_SQL[P.URLS]),
    "x4_names": _NAMES_SQL,
    "x5_promotional": _sql(MATCH_SQL[P.PROMO]),
    "x6_contact": _sql(MATCH_SQL[P.CONTACT]),
    "x6a_email": _sql(_EMAIL),
    "x6b_phone": _sql(_PHONE),
    "x6c_handle": _sql(_HANDLE),
    "x6d_address": _sql(_ADDRESS),
    "x7_code": _sql(MATCH_SQL[P.CODE]),
    "x8_configuration": _sql(MATCH_SQL[P.CONFIG]),
    "x9_religious": _sql(MATCH_SQL[P.FAITH]),
    "x10_quotes": _sql(MATCH_SQL[P.QUOTES]),
    "x11_high_entropy": _sql(_all("[A-Za-z0-9+/=]{30,}")),
    "x12_named_lists": _sql(_all(rf"(?:[A-Z][a-z]+,{SPACE}*){{2,}}[A-Z][a-z]+")),
    "x13_forum": _sql(
        _all(r"\bUser talk:|\bWikipedia:|\bTalk:|\b[Ww]iki\b|\bFAQ\b", 0, masked())
    ),
    "x14_logs": _sql(
        _all(r"Traceback \(most recent call last\)|Exception|Error|\.log|\.trace")
    ),
    "x15_pseudonyms": _sql(_all(rf"(?:aka|also known as|anno){SPACE}+[A-Z][a-z]+")),
    "x16_forms": _sql(_all(r"(?s)<form.+?</form>|input type=")),
    "x17_tech_news": _sql(_keywords(P.TECH_WORDS)),
    "x18_number_lists": _sql(_all(rf"(?:\p{{Nd}}+(?:{SPACE}|,))+\p{{Nd}}+")),
}
