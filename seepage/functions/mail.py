"""Mail headers and body from a raw message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The headers kept, in output order.
HEADERS = ("From", "To", "Subject", "Date", "Cc", "Bcc")

_HEAD = r"^((?:[!-9;-~]++:[^\n]*+(?:\n|$)(?:[ \t][^\n]*+(?:\n|$))*+)*+)"


def unix_lines(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\r\n?", "\n")


def head(raw: Column) -> Column:
    """The header lines at the start of a message, with folded lines."""
    return F.regexp_extract(raw, _HEAD, 1)


def header(head_text: Column, name: str) -> Column:
    """First value of a header; folded lines keep their breaks; null if absent."""
    pattern = rf"(?i)(?:^|\n){name}:[ \t]*([^\n]*+(?:\n[ \t][^\n]*+)*+)"
    return F.when(F.regexp_like(head_text, F.lit(pattern)), F.regexp_extract(head_text, pattern, 1))


def body(raw: Column, head_text: Column) -> Column:
    """Text after the headers and their blank line; null for multipart mail."""
    rest = F.substring(raw, F.length(head_text) + 1, F.length(raw))
    rest = F.when(rest.startswith("\n"), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    kind = header(head_text, "Content-Type")
    multipart = F.coalesce(F.lower(F.ltrim(kind)).startswith("multipart/"), F.lit(False))
    return F.when(~multipart, rest)


def mail_fields(raw: Column) -> dict[str, Column]:
    """from, to, subject, date, cc, bcc, body as nullable strings."""
    text = unix_lines(raw)
    top = head(text)
    fields = {name.lower(): header(top, name) for name in HEADERS}
    fields["body"] = body(text, top)
    return fields
