"""English suffix stemming (Porter 1980) as a rule table.

A word goes with its shape, a ``c`` or ``v`` for each of its letters. A rule is an
ending, what takes its place, and conditions on what stands before it. ``stem``
compiles the table into Column expressions and ``stem_sql`` into SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """The first rule of a step whose ending fits decides, also where its conditions fail."""

    ending: str
    put: str = ""
    least: int | None = None  # more runs of vowels and consonants than this stand before
    vowel: bool = False  # a vowel stands before
    after: str = ""  # one of these letters stands right before
    whole: bool = True  # the ending may be the whole word


def _longest_first(rules: Sequence[Rule]) -> tuple[Rule, ...]:
    return tuple(sorted(rules, key=lambda r: -len(r.ending)))


# The rules of the steps.
PLURALS = (Rule("sses", "ss"), Rule("ies", "i"), Rule("ss", "ss"), Rule("s"))
AGREED = (Rule("eed", "ee", least=0),)
PAST = (Rule("ed", vowel=True, whole=False), Rule("ing", vowel=True, whole=False))
RESTORED = ("at", "bl", "iz")
DOUBLES_KEPT = "lsz"
LONG_ENDS = "wxy"
LAST_Y = (Rule("y", "i", vowel=True),)
STEP2 = _longest_first([Rule(a, b, least=0, whole=False) for a, b in dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al",
    entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al",
    iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
).items()])
STEP3 = _longest_first([Rule(a, b, least=0, whole=False) for a, b in dict(
    icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="",
).items()])
STEP4 = _longest_first([
    Rule(e, least=1, after="st" if e == "ion" else "")
    for e in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
])


class _Columns:
    """Expressions as Columns."""

    def let(self, value: Column, body: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def shape(self, word: Column) -> Column:
        def add(done: Column, letter: Column) -> Column:
            vowel = letter.isin(*"aeiou") | ((letter == "y") & F.endswith(done, F.lit("c")))
            return F.concat(done, F.when(vowel, "v").otherwise("c"))

        return F.aggregate(F.filter(F.split(word, ""), lambda x: x != ""), F.lit(""), add)

    def ends(self, word: Column, ending: str) -> Column:
        return F.endswith(word, F.lit(ending))

    def cut(self, word: Column, n: int) -> Column:
        return F.left(word, F.length(word) - n)

    def add(self, word: Column, ending: str) -> Column:
        return F.concat(word, F.lit(ending))

    def longer(self, word: Column, than: int) -> Column:
        return F.length(word) > than

    def shorter(self, word: Column, other: Column) -> Column:
        return F.length(word) < F.length(other)

    def runs(self, shape: Column, more_than: int) -> Column:
        return F.regexp_count(shape, F.lit("v+c+")) > more_than

    def matches(self, word: Column, pattern: str) -> Column:
        return F.regexp_like(word, F.lit(pattern))

    def twin_end(self, word: Column) -> Column:
        return (F.length(word) > 1) & (F.right(word, F.lit(1)) == F.left(F.right(word, F.lit(2)), F.lit(1)))

    def every(self, first: Column, *parts: Column) -> Column:
        for part in parts:
            first = first & part
        return first

    def some(self, first: Column, *parts: Column) -> Column:
        for part in parts:
            first = first | part
        return first

    def no(self, part: Column) -> Column:
        return ~part

    def case(self, ways: Sequence[tuple[Column, Column]], other: Column) -> Column:
        out: Any = F
        for when, value in ways:
            out = out.when(when, value)
        return out.otherwise(other)


class _Sql:
    """The same as SQL text."""

    def __init__(self) -> None:
        self.names = count()

    def let(self, value: str, body: Callable[[str], str]) -> str:
        name = f"x{next(self.names)}"
        return f"list_transform([{value}], lambda {name}: {body(name)})[1]"

    def shape(self, word: str) -> str:
        vowel = "ch IN ('a', 'e', 'i', 'o', 'u') OR (ch = 'y' AND ends_with(done, 'c'))"
        return f"list_reduce(string_split({word}, ''), lambda done, ch: done || CASE WHEN {vowel} THEN 'v' ELSE 'c' END, '')"

    def ends(self, word: str, ending: str) -> str:
        return f"ends_with({word}, '{ending}')"

    def cut(self, word: str, n: int) -> str:
        return f"substr({word}, 1, length({word}) - {n})"

    def add(self, word: str, ending: str) -> str:
        return f"({word} || '{ending}')"

    def longer(self, word: str, than: int) -> str:
        return f"(length({word}) > {than})"

    def shorter(self, word: str, other: str) -> str:
        return f"(length({word}) < length({other}))"

    def runs(self, shape: str, more_than: int) -> str:
        return f"(len(regexp_extract_all({shape}, 'v+c+')) > {more_than})"

    def matches(self, word: str, pattern: str) -> str:
        return f"regexp_matches({word}, '{pattern}')"

    def twin_end(self, word: str) -> str:
        return f"(length({word}) > 1 AND substr({word}, length({word}), 1) = substr({word}, length({word}) - 1, 1))"

    def every(self, *parts: str) -> str:
        return f"({' AND '.join(parts)})"

    def some(self, *parts: str) -> str:
        return f"({' OR '.join(parts)})"

    def no(self, part: str) -> str:
        return f"(NOT {part})"

    def case(self, ways: Sequence[tuple[str, str]], other: str) -> str:
        return f"CASE {' '.join(f'WHEN {a} THEN {b}' for a, b in ways)} ELSE {other} END"


def _step(x: Any, word: Any, rules: Sequence[Rule]) -> Any:
    def apply(shape: Any) -> Any:
        ways = []
        for rule in rules:
            n = len(rule.ending)
            fits = x.ends(word, rule.ending)
            if not rule.whole:
                fits = x.every(fits, x.longer(word, n))
            asked = []
            if rule.least is not None:
                asked.append(x.runs(x.cut(shape, n), rule.least))
            if rule.vowel:
                asked.append(x.matches(x.cut(shape, n), "v"))
            if rule.after:
                asked.append(x.matches(x.cut(word, n), f"[{rule.after}]$"))
            new = x.add(x.cut(word, n), rule.put)
            ways.append((fits, x.case([(x.every(*asked), new)], word) if asked else new))
        return x.case(ways, word)

    return x.let(x.shape(word), apply)


def _short_end(x: Any, word: Any, shape: Any) -> Any:
    """Consonant, vowel, consonant, and the last is no long one."""
    return x.every(x.ends(shape, "cvc"), x.no(x.matches(word, f"[{LONG_ENDS}]$")))


def _one_run(x: Any, shape: Any) -> Any:
    return x.every(x.runs(shape, 0), x.no(x.runs(shape, 1)))


def _past(x: Any, word: Any) -> Any:
    """Without the ending of a past form; then an e comes back or a doubled letter goes."""

    def mended(new: Any) -> Any:
        def apply(shape: Any) -> Any:
            return x.case(
                [
                    (x.some(*[x.ends(new, e) for e in RESTORED]), x.add(new, "e")),
                    (x.every(x.twin_end(new), x.ends(shape, "c")), x.case([(x.matches(new, f"[{DOUBLES_KEPT}]$"), new)], x.cut(new, 1))),
                    (x.every(_one_run(x, shape), _short_end(x, new, shape)), x.add(new, "e")),
                ],
                new,
            )

        return x.case([(x.shorter(new, word), x.let(x.shape(new), apply))], word)

    return x.case([(x.ends(word, AGREED[0].ending), _step(x, word, AGREED))], x.let(_step(x, word, PAST), mended))


def _last_e(x: Any, word: Any) -> Any:
    def apply(shape: Any) -> Any:
        base = x.cut(word, 1)
        goes = x.some(x.runs(shape, 1), x.every(_one_run(x, shape), x.no(_short_end(x, base, shape))))
        return x.case([(x.every(x.ends(word, "e"), goes), base)], word)

    return x.let(x.cut(x.shape(word), 1), apply)


def _last_l(x: Any, word: Any) -> Any:
    return x.let(x.shape(word), lambda shape: x.case([(x.every(x.ends(word, "ll"), x.runs(shape, 1)), x.cut(word, 1))], word))


def _stemmed(x: Any, word: Any) -> Any:
    steps: list[Callable[[Any], Any]] = [
        lambda w: _step(x, w, PLURALS),
        lambda w: _past(x, w),
        lambda w: _step(x, w, LAST_Y),
        lambda w: _step(x, w, STEP2),
        lambda w: _step(x, w, STEP3),
        lambda w: _step(x, w, STEP4),
        lambda w: _last_e(x, w),
        lambda w: _last_l(x, w),
    ]

    def after(w: Any, at: int) -> Any:
        return w if at == len(steps) else x.let(steps[at](w), lambda new: after(new, at + 1))

    return x.case([(x.longer(word, 3), x.let(word, lambda w: after(w, 0)))], word)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of up to three letters stay."""
    return _stemmed(_Columns(), word)


def stem_sql(word: str) -> str:
    """The same as SQL over the column or expression ``word``."""
    return _stemmed(_Sql(), word)
