"""Text cleaning as Column expressions.

Character classes are spelled out instead of ``\\s`` and ``\\w`` because the
expected results follow Unicode rules and the regex engines disagree on what
the short forms cover.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space, word and digit.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# English stop words. Forms with an apostrophe are absent since
# punctuation is gone before the list is applied.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn
needn shan shouldn wasn weren won wouldn
""".split()

# Boilerplate openings; each removes everything after it.
DISCLAIMERS = (
    "this message contains confidential information",
    "if you are not the intended recipient",
    "please notify the sender immediately",
    "delete this e[-]?mail from your system",
)

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St vs etc Inc Ltd Co Corp No Fig".split()

URL = r"(?i)\b(?:https?://|ftp://|www\.)[^\t-\r\x1c-\x20\x{85}\p{Z}<>]+"
EMAIL = r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_ONCE = rf"(?:(?<![\w.%+-])|\G){EMAIL}"


def strip(text: Column) -> Column:
    """Trim all white space, not only spaces."""
    left = F.regexp_replace(text, rf"\A{SPACE}+", "")
    return F.regexp_replace(left, rf"(?<!{SPACE}){SPACE}++\z", "")


def squeeze(text: Column) -> Column:
    """Trim and turn each run of white space into one space."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Words separated by white space; no empty ones."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def lines(text: Column) -> Column:
    """Lines under every Unicode line break, without a trailing empty one."""
    parts = F.split(text, LINE_BREAK)
    tail = F.try_element_at(parts, F.lit(-1))
    return F.when(tail == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def strip_disclaimer(text: Column) -> Column:
    for phrase in DISCLAIMERS:
        text = F.regexp_replace(text, f"(?isu){phrase}.*", "")
    return text


def strip_reply_header(text: Column) -> Column:
    """Drop each quoted header block up to its blank line; the quoted body stays."""
    return strip(
        F.regexp_replace(text, rf"(?s)-----Original Message-----.*?\n{SPACE}*\n", "")
    )


def strip_symbols(text: Column) -> Column:
    """Keep ASCII letters, digits and white space."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9\t-\r\x1c-\x20\x{85}\p{Z}]", "")


def normalise(text: Column, drop_emails: bool = False, url: str = "", email: str = "") -> Column:
    """Lower case, one line, URLs (and e-mails) replaced, punctuation removed."""
    out = F.regexp_replace(F.lower(text), URL, url)
    if drop_emails:
        out = F.regexp_replace(out, EMAIL_ONCE, email)
    return squeeze(F.regexp_replace(out, r"\p{P}", ""))


def drop_stop_words(text: Column, stop_words: list[str] | None = None) -> Column:
    stop = stop_words if stop_words is not None else STOP_WORDS
    return F.array_join(F.filter(words(text), lambda w: ~w.isin(stop)), " ")


def clean_mail(text: Column) -> Column:
    """Mail body, subject or date to bare content words; null becomes empty."""
    body = strip_symbols(normalise(strip_reply_header(strip_disclaimer(text))))
    return F.coalesce(drop_stop_words(body), F.lit(""))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]++>", "")


def clean_web(text: Column) -> Column:
    """Lower case, no tags, white space squeezed; punctuation stays."""
    return squeeze(strip_tags(F.lower(text)))


def is_heading(text: Column) -> Column:
    return text.startswith("=")


def join_number_marks(text: Column) -> Column:
    """Undo the ``@-@`` style separators of tokenised encyclopedia text."""
    for mark in "-,.":
        text = F.replace(text, F.lit(f"@{mark}@"), F.lit(mark))
    return text


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", "")


def strip_wiki_markup(text: Column) -> Column:
    """Drop ``= x =`` runs, link brackets, quote runs and unknown-word marks."""
    text = F.regexp_replace(text, rf"=(?:{SPACE})?[^\n]*?(?:{SPACE})?=", "")
    text = F.regexp_replace(text, r"\[\[|\]\]", "")
    text = F.regexp_replace(text, r"''+", "")
    return strip(F.replace(text, F.lit("<unk>"), F.lit("")))


def clean_wiki(text: Column) -> Column:
    """Markup, URLs, e-mails, punctuation and stop words removed."""
    bare = normalise(strip_wiki_markup(text), drop_emails=True)
    return F.coalesce(drop_stop_words(bare), F.lit(""))


_SHIELD = "\ue000"  # private-use stand-in for a full stop


def _shielded(text: Column) -> Column:
    names = "|".join(ABBREVIATIONS)
    return F.regexp_replace(text, rf"(^|{SPACE}|\()({names})\.", f"$1$2{_SHIELD}")


def _unshielded(text: Column) -> Column:
    return F.replace(text, F.lit(_SHIELD), F.lit("."))


_FIRST = rf"(?s)^(.*?[.!?]){SPACE}+(\p{{Lu}}.*)$"


def first_sentence(text: Column) -> Column:
    """The first sentence; the whole text when there is only one."""
    shielded = _shielded(strip(text))
    head = F.regexp_extract(shielded, _FIRST, 1)
    return _unshielded(F.when(head != "", head).otherwise(shielded))


def later_sentences(text: Column) -> Column:
    """All sentences after the first, one space apart; empty if none."""
    rest = F.regexp_extract(_shielded(strip(text)), _FIRST, 2)
    return _unshielded(F.regexp_replace(rest, rf"([.!?]){SPACE}+(?=\p{{Lu}})", "$1 "))
