"""Quality rules: a threshold table compiled into one projection, no user functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.llm.common import BLANKS, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
# frequent function words of four languages, in lower case: fixed values
STOP_WORDS = (
    "the of and to in a is that for it on with as was be by "
    "der die das und ist von zu den im für auf ein eine mit sich des "
    "le la les de et un une est en du que dans pour par sur au "
    "el los las y del se una por con para es al lo como no"
).split()


class Threshold(NamedTuple):
    """A measure that must lie in [low, high]; None leaves a side open."""

    measure: str
    low: float | None
    high: float | None


THRESHOLDS = (
    Threshold("chars_per_word", 1.5, 25.0),
    Threshold("symbols_per_word", None, 0.1),
    Threshold("stop_word_share", 0.02, 0.9),
    Threshold("duplicate_line_share", None, 0.3),
    Threshold("repeated_word_share", None, 0.2),
)


def repeated_words(items: Column) -> Column:
    """Number of words in windows of five words that occur twice or more.

    Windows are compared by 64-bit hashes; texts without a repeat skip the sort.
    """
    keys = F.when(
        F.size(items) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(items) - WINDOW),
            lambda i: F.xxhash64(*[F.get(items, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(at, lambda s: let(F.sort_array(starts(s)), gaps))

    def starts(s: Column) -> Column:
        twice = F.filter(
            s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        )
        return F.transform(twice, lambda x: x["i"])

    def gaps(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(
        keys,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
    )


def measures(text: Column) -> Column:
    """Struct of the counts of one text; a null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def without(characters: str) -> Column:
        return F.char_length(F.translate(whole, characters, ""))

    def stop(word: Column) -> Column:
        return F.lower(F.btrim(word, F.lit(".,;:!?"))).isin(*STOP_WORDS)

    def counts(w: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": without(BLANKS),
            "n_symbols": F.char_length(whole) - without(SYMBOLS),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_lines": F.size(lines),
            "n_repeat_words": repeated_words(w),
            "n_stop_words": F.size(F.filter(w, stop)),
        }
        return F.struct(*[c.cast("bigint").alias(name) for name, c in found.items()])

    return let(words(text), counts)


def failed(m: Column, rules: Sequence[Threshold] = THRESHOLDS) -> Column:
    """True where a measure of the struct ``m`` lies outside its range."""
    n = F.greatest(m["n_words"], F.lit(1))
    ratio = {
        "chars_per_word": m["word_chars"] / n,
        "symbols_per_word": m["n_symbols"] / n,
        "stop_word_share": m["n_stop_words"] / n,
        "duplicate_line_share": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "repeated_word_share": m["n_repeat_words"] / n,
    }
    out = F.lit(False)
    for rule in rules:
        if rule.low is not None:
            out = out | (ratio[rule.measure] < rule.low)
        if rule.high is not None:
            out = out | (ratio[rule.measure] > rule.high)
    return out


def quality_rules(
    docs: DataFrame, rules: Sequence[Threshold] = THRESHOLDS, text_col: str = "text", out: str = "quality"
) -> DataFrame:
    """``docs`` with the struct ``out``: the counts, base_failed and kept.

    Texts of fewer than ten words, or with over a fifth of their words in
    repeated five-word windows, fail the base rule; the table judges the rest.
    Null, empty and blank texts have no word and fail. Rows and their other
    columns are kept as they are, but for an earlier column ``out``.
    """
    m = F.col("__seepage_measures")
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    judged = F.struct(
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        (~base & ~failed(m, rules)).alias("kept"),
    )
    return docs.withColumn("__seepage_measures", measures(F.col(text_col))).withColumn(out, judged).drop("__seepage_measures")
