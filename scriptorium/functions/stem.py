"""English stems by the published suffix-stripping algorithm (Porter 1980), as a function and as SQL text.

A step is a list of rules (suffix, test, replacement, last). Of the rules whose suffix ends the word the first one
whose test the rest of the word passes is applied; a rule marked last ends its step even if the test fails. Words
with other characters than ``a-z``, and those of one or two letters, stay as they are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN = re.compile("[a-z]{3,}")

# A consonant run, a vowel run; y is a vowel after a consonant, and Y stands for a y that begins the word.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
Test = tuple[tuple[str, bool], ...]
ANY: Test = ()
SOME: Test = ((f"^({_C})?{_V}{_C}", True),)
ONE_SHORT: Test = ((f"^({_C})?{_V}{_C}({_V})?$", True), (_CVC, False))
MORE: Test = ((f"^({_C})?{_V}{_C}{_V}{_C}", True),)
VOWEL: Test = ((f"^({_C})?[aeiouy]", True),)
SHORT: Test = ((_CVC, True),)
AFTER_ST: Test = (*MORE, ("[st]$", True))
AFTER_L: Test = (*MORE, ("l$", True))
Rule = tuple[str, Test, str, bool]


def _rules(test: Test, **to: str) -> list[Rule]:
    return [(suffix, test, new, True) for suffix, new in sorted(to.items(), key=lambda x: -len(x[0]))]


# The rules of the algorithm; + marks a word that lost ed or ing and is still to be mended.
STEPS: list[list[Rule]] = [
    [("sses", ANY, "ss", True), ("ies", ANY, "i", True), ("ss", ANY, "ss", True), ("s", ANY, "", True)],
    [("eed", SOME, "ee", True), ("ed", VOWEL, "+", True), ("ing", VOWEL, "+", True)],
    [("at+", ANY, "ate", True), ("bl+", ANY, "ble", True), ("iz+", ANY, "ize", True), *((f"{x}{x}+", ANY, x, True) for x in "bcdfghjkmnpqrtvwx"), ("+", SHORT, "e", False), ("+", ANY, "", True)],
    [("y", VOWEL, "i", True)],
    _rules(SOME, ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log"),
    _rules(SOME, icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness=""),
    [*_rules(MORE, al="", ance="", ence="", er="", ic="", able="", ible="", ant="", ement="", ment="", ent="", ou="", ism="", ate="", iti="", ous="", ive="", ize=""), ("ion", AFTER_ST, "", True)],
    [("e", MORE, "", False), ("e", ONE_SHORT, "", True)],
    [("l", AFTER_L, "", True)],
]


def stem_of(word: str) -> str:
    if not PLAIN.fullmatch(word):
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    for step in STEPS:
        for suffix, test, new, last in step:
            if len(w) > len(suffix) and w.endswith(suffix):
                rest = w[: len(w) - len(suffix)]
                passed = all((re.search(pattern, rest) is not None) == wanted for pattern, wanted in test)
                if passed:
                    w = rest + new
                if passed or last:
                    break
    return w.lower()


def with_stems(df: DataFrame, word: str, stem: str = "lexeme") -> DataFrame:
    """The rows with the stem of ``word``; meant for distinct words, which are few beside the words of the texts."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem_of, na_action="ignore")

    return df.withColumn(stem, stems(word))


def stem_sql(source: str, word: str = "word", stem: str = "lexeme") -> str:
    """A SELECT of the source's columns with the stem of ``word``, for the SQL twins."""
    plain = f"regexp_matches({word}, '^[a-z]{{3,}}$')"
    inner = f"select *, case when {plain} and {word} like 'y%' then 'Y' || {word}[2:] else {word} end as _w from {source}"
    for step in STEPS:
        branches = []
        for suffix, test, new, last in step:
            rest = f"_w[1:length(_w) - {len(suffix)}]"
            passed = " and ".join([f"{'' if wanted else 'not '}regexp_matches({rest}, '{pattern}')" for pattern, wanted in test]) or "true"
            met, made = f"ends_with(_w, '{suffix}') and length(_w) > {len(suffix)}", f"{rest} || '{new}'"
            branches.append(f"when {met} then case when {passed} then {made} else _w end" if last else f"when {met} and {passed} then {made}")
        inner = f"select * replace (case when not {plain} then _w {' '.join(branches)} else _w end as _w) from ({inner})"
    return f"select * exclude (_w), lower(_w) as {stem} from ({inner})"
