"""English suffix stemming (Porter 1980) word by word, to compare with."""

import re

# Suffix replacements of the second and third step.
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al",
    entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al",
    iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _shape(word: str) -> str:
    """The word as c/v letters; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace_longest(word: str, table: dict[str, str], least: int) -> str:
    for size in range(min(len(word) - 1, 7), 0, -1):
        ending = word[-size:]
        if ending in table:
            base = word[:-size]
            return base + table[ending] if _measure(base) > least else word
    return word


def stem_word(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        found = re.fullmatch(r"(.+?)(ed|ing)", word)
        if found and "v" in _shape(found[1]):
            word = found[1]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
                word = word if word[-1] in "lsz" else word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(word, STEP2, 0)
    word = _replace_longest(word, STEP3, 0)
    for ending in sorted(STEP4, key=len, reverse=True):
        if word.endswith(ending):
            base = word[: -len(ending)]
            if _measure(base) > 1 and (ending != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
