"""Extractors: what counts as a possible leak, by category.

Each extractor maps a text Column to an array of matches. Patterns are written
so that matching time stays linear in the text: optional separators are folded
out of nested repeats, runs are possessive, and a run is tried once from its
start (or from the end of the previous match, ``\\G``), which finds the same
matches as trying every position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from seepage.functions.text import SPACE, WORD

# Keywords by category.
NEWS_WORDS = (
    "CNN|BBC|Reuters|The New York Times|The Guardian|AP News|Bloomberg|Biden|Trump|"
    "White House|UN|NATO|Ukraine|China|Russia"
)
TECH_WORDS = (
    "TechCrunch|The Verge|Wired|Gizmodo|Ars Technica|Engadget|developer conference|"
    "software release|gadget review|AI|robotics|cloud computing|startup"
)
LICENSE_WORDS = "license|copyright|terms of use|all rights reserved"
PROMO_WORDS = (
    "buy now|limited offer|subscribe|click here|free trial|flash sale|redeem now|% off|"
    "exclusive offer"
)
FAITH_WORDS = "Genesis|Bible|Quran|Torah|Psalm|Jesus|Allah|God|prophet"
QUOTE_WORDS = (
    "Donald Trump:|@realDonaldTrump|Make America Great Again|fake news|donald trump"
)
TOP_DOMAINS = "com|net|org|edu|gov|io|co|info|biz|us|uk|de|jp|kr"
STREET_WORDS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Dr|Drive|Court|Ct"

DIGIT = r"\p{Nd}"


def _find(pattern: str, group: int = 0) -> Callable[[Column], Column]:
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(alternatives: str) -> str:
    """The characters a match can start with: one test rules out most places."""
    return "".join(sorted({w[0].lower() for w in alternatives.split("|")}))


def _keywords(alternatives: str) -> Callable[[Column], Column]:
    """Whole words; a keyword that starts with a symbol must follow a word."""
    plain = "|".join(w for w in alternatives.split("|") if w[0].isalnum())
    marked = "|".join(w for w in alternatives.split("|") if not w[0].isalnum())
    start = rf"(?<!{WORD})(?:{plain})" + (rf"|(?<={WORD})(?:{marked})" if marked else "")
    return _find(rf"(?iu)(?=[{_first(alternatives)}])(?:{start})(?!{WORD})")


_MAIL_CHARS = r"[\p{L}\p{N}_.%+-]"
_find_email = _find(
    rf"(?:(?<!{_MAIL_CHARS})|\G){_MAIL_CHARS}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"
)


def find_email(text: Column) -> Column:
    """E-mail addresses; a text without an at sign is not searched."""
    return F.when(F.contains(text, F.lit("@")), _find_email(text)).otherwise(
        F.array().cast("array<string>")
    )



find_phone = _find(
    rf"(?=[+(\p{{Nd}}])(?:\+?{DIGIT}{{1,3}}(?:{SPACE}|[.-])?)?(?:\(?{DIGIT}{{2,4}}\)?(?:{SPACE}|[.-])?)?"
    rf"{DIGIT}{{3,4}}(?:{SPACE}|[.-])?{DIGIT}{{4}}"
)
find_handle = _find(rf"@(?<!{WORD}@){WORD}{{1,15}}+(?![\p{{L}}\p{{N}}_@.])")
# A long run is first taken whole and then cut at its last fitting place: a
# repeated group that has to give back would recurse once per repeat.
_find_address_runs = _find(
    rf"(?={DIGIT})(?<!{WORD}){DIGIT}{{1,5}}{SPACE}++(?:[A-Z][a-z]++{SPACE})++(?:[A-Z][a-z]++(?!{WORD}))?+"
)


def _cut(runs: Column, pattern: str) -> Column:
    """The leading part of each run that fits, without those that have none."""
    parts = F.transform(runs, lambda r: F.regexp_extract(r, pattern, 1))
    return F.filter(parts, lambda r: r != "")


def find_address(text: Column) -> Column:
    """Number, capitalised words, street word."""
    last = rf"(?s)^({DIGIT}+{SPACE}+[A-Z][a-z]+{SPACE}(?:.*{SPACE})?(?:{STREET_WORDS}))(?!{WORD})"
    return _cut(_find_address_runs(text), last)


def find_contact(text: Column) -> Column:
    return F.concat(find_email(text), find_phone(text), find_handle(text), find_address(text))


find_news = _keywords(f"{NEWS_WORDS}|{TECH_WORDS}")
find_tech = _keywords(TECH_WORDS)
find_license = _find(rf"(?iu)(?=[{_first(LICENSE_WORDS)}])({LICENSE_WORDS})", 1)
_URL_START = r"(?:https?|ftp|www)[.:/\\]?"
_find_url_runs = _find(rf"(?iu)(?=[hfw])(?<!{WORD}){_URL_START}{WORD}++(?:[.:/\\]{WORD}++)*+")


def find_url(text: Column) -> Column:
    """Prefix, at most one separator, word parts, up to the last known domain."""
    return _cut(
        _find_url_runs(text), rf"(?isu)^({_URL_START}{WORD}++.*\.(?:{TOP_DOMAINS}))"
    )


find_promo = _keywords(PROMO_WORDS)
find_code = _find(rf"(?=[dcf<])(?:def |class |function{SPACE}+|</?[a-z]+>)")
find_config = _find(rf"(?md)\[[^\]\n]*+\]|^[a-zA-Z0-9_]++{SPACE}*={SPACE}*.+$")
find_faith = _keywords(FAITH_WORDS)
find_quote = _find(rf"(?iu)(?=[{_first(QUOTE_WORDS)}])({QUOTE_WORDS})", 1)
# The patterns below must find what their public definitions find.
find_entropy = _find(r"[A-Za-z0-9+/=]{30,}")
find_named_list = _find(rf"[A-Z][a-z]++(?:,{SPACE}*+[A-Z][a-z]++){{2,}}+")
find_forum = _find(
    rf"(?=[UWTwF])(?<!{WORD})(?:User talk:|Wikipedia:|Talk:|[Ww]iki(?!{WORD})|FAQ(?!{WORD}))"
)
find_log = _find(r"Traceback \(most recent call last\)|Exception|Error|\.log|\.trace")
find_pseudonym = _find(rf"(?:aka|also known as|anno){SPACE}+[A-Z][a-z]+")
_find_forms = _find(r"(?s)<form.+?</form>|input type=")
_find_inputs = _find("input type=")


def find_form(text: Column) -> Column:
    """Whole forms and input fields; forms are looked for up to the last closing tag only."""
    closed = F.regexp_extract(text, r"(?s)\A(.*</form>)", 1)
    rest = F.substring(text, F.length(closed) + 1, F.length(text))
    return F.concat(_find_forms(closed), _find_inputs(rest))


find_numbers = _find(rf"(?<!{DIGIT}){DIGIT}++(?:(?:{SPACE}|,){DIGIT}++)++")

_NAME = r"\p{Lu}\p{Ll}++"
find_name_runs = _find(rf"(?=\p{{Lu}})(?<!{WORD})({_NAME}(?: {_NAME})*+)", 1)


@dataclass(frozen=True)
class Extractor:
    """One audit category. ``find`` is None when a table join finds it."""

    name: str
    find: Callable[[Column], Column] | None
    is_pii: bool = False


NEWS = "News"
LICENSE = "License, terms of use, copyright notices"
URLS = "Valid URLs"
NAMES = "Named individuals (non-news samples only)"
PROMO = "Promotional content (products, subscriptions, etc.)"
CONTACT = "Contact info (address, email, phone, twitter, etc.)"
CODE = "Code"
CONFIG = "Configuration files"
FAITH = "Religious texts"
QUOTES = "Donald Trump tweets and quotes"

# The category names in report order.
DEFAULT = (
    Extractor(NEWS, find_news),
    Extractor(LICENSE, find_license),
    Extractor(URLS, find_url),
    Extractor(NAMES, None, is_pii=True),
    Extractor(PROMO, find_promo),
    Extractor(CONTACT, find_contact, is_pii=True),
    Extractor(CODE, find_code),
    Extractor(CONFIG, find_config),
    Extractor(FAITH, find_faith),
    Extractor(QUOTES, find_quote),
)
OPTIONAL = (
    Extractor("High entropy (UUIDs, base64 data)", find_entropy),
    Extractor("Lists of named items (games, countries, etc.)", find_named_list),
    Extractor("Forum or Wiki entry", find_forum),
    Extractor("Log files and error reports", find_log),
    Extractor("Pseudonyms", find_pseudonym),
    Extractor("Web forms (menu items, instructions, etc.)", find_form),
    Extractor("Tech News", find_tech),
    Extractor("Lists of numbers (dates, sequences, etc.)", find_numbers),
)


def register(
    registry: tuple[Extractor, ...],
    name: str,
    find: Callable[[Column], Column],
    is_pii: bool = False,
) -> tuple[Extractor, ...]:
    """A registry with one more category, or with ``name`` replaced in place."""
    new = Extractor(name, find, is_pii)
    if any(e.name == name for e in registry):
        return tuple(new if e.name == name else e for e in registry)
    return (*registry, new)
