"""The stemmer as expressions over a word, generated from rule tables for Spark SQL or DuckDB.

A consonant y is marked as Y first, so that vowels are [aeiouy] and every test of a measure is a short pattern. "#" marks a word that step 1b shortened.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

V, C = "[aeiouy]", "[^aeiouy]"
M1, M2, ONLY1, CVC = f"{V}{C}", f"{V}+{C}+{V}+{C}", f"^{C}*{V}+{C}+$", f"{C}{V}[^aeiouywxY]$"
#: Suffixes and what replaces them, first match wins.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

Dialect = dict[str, Callable[..., str]]
SPARK: Dialect = {"match": lambda x, p: f"({x} rlike '{p}')", "sub": lambda x, p, r: f"regexp_replace({x}, '{p}', '{r.replace('@', '$1')}')"}
DUCKDB: Dialect = {"match": lambda x, p: f"regexp_matches({x}, '{p}')", "sub": lambda x, p, r: f"regexp_replace({x}, '{p}', '{r.replace('@', chr(92) + '1')}', 'g')"}


def steps(d: Dialect) -> list[Callable[[str], str]]:
    """One expression for each step, as a function of the word's name."""
    match = d["match"]
    ends = lambda x, s: f"right({x}, {len(s)}) = '{s}'"
    drop = lambda x, n: f"left({x}, length({x}) - {n})"

    def case(x: str, *rules: tuple[str, str]) -> str:
        return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rules) + f" ELSE {x} END"

    def plurals(x: str) -> str:
        return case(x, (ends(x, "sses"), drop(x, 2)), (ends(x, "ies"), drop(x, 2)), (ends(x, "ss"), x), (ends(x, "s"), drop(x, 1)))

    def past(x: str) -> str:
        cut = lambda n: f"CASE WHEN {match(drop(x, n), V)} THEN {drop(x, n)} || '#' ELSE {x} END"
        return case(x, (ends(x, "eed"), drop(x, 1)), (ends(x, "ed"), cut(2)), (ends(x, "ing"), cut(3)))

    def restore(x: str) -> str:
        b, last = drop(x, 1), f"right(left({x}, length({x}) - 1), 1)"
        twice = f"length({x}) > 2 AND {last} = substring({x}, length({x}) - 2, 1) AND {match(last, C)} AND {last} NOT IN ('l', 's', 'z')"
        return case(x, (f"right({x}, 1) <> '#'", x), (" OR ".join(f"right({x}, 3) = '{s}#'" for s in ("at", "bl", "iz")), f"{b} || 'e'"), (twice, drop(x, 2)), (f"{match(b, ONLY1)} AND {match(b, CVC)}", f"{b} || 'e'"), ("true", b))

    def final_y(x: str) -> str:
        return case(x, (f"right({x}, 1) IN ('y', 'Y') AND {match(drop(x, 1), V)}", f"{drop(x, 1)} || 'i'"))

    def replace(table: tuple) -> Callable[[str], str]:
        return lambda x: case(x, (f"length({x}) <= 2", x), *((ends(x, s), f"{drop(x, len(s))} || '{r}'") for s, r in table))

    def remove(x: str) -> str:
        # of "sion" and "tion" the first letter stays
        rules = [(f"{ends(x, s)} AND {match(drop(x, n), M1)}", drop(x, n)) for s, n in ((s, 3 if s in ("sion", "tion") else len(s)) for s in STEP4)]
        return case(x, (f"length({x}) <= 2", x), *rules)

    def final_e(x: str) -> str:
        b = drop(x, 1)
        return case(x, (f"right({x}, 1) = 'e' AND ({match(b, M2)} OR ({match(b, M1)} AND NOT {match(b, CVC)}))", b))

    def final_l(x: str) -> str:
        return case(x, (f"{ends(x, 'll')} AND {match(drop(x, 1), M2)}", drop(x, 1)))

    def mark(x: str) -> str:
        return d["sub"](d["sub"](x, "^y", "Y"), "([aeiou])y", "@Y")

    return [mark, plurals, past, restore, final_y, replace(STEP2), replace(STEP3), remove, final_e, final_l, lambda x: f"lower({x})"]


def stem_sql(array: str, dialect: Dialect) -> str:
    """SQL for the stems of an array expression of words; words of at most two letters stay. They are carried through the steps behind a "~"."""
    spark = dialect is SPARK
    each = (lambda a, e: f"transform({a}, x -> {e})") if spark else (lambda a, e: f"list_transform({a}, lambda x: {e})")
    out = each(array, "CASE WHEN length(x) <= 2 THEN '~' || x ELSE x END")
    for step in steps(dialect):
        out = each(out, f"CASE WHEN left(x, 1) = '~' THEN x ELSE {step('x')} END")
    return each(out, "CASE WHEN left(x, 1) = '~' THEN substring(x, 2) ELSE x END")


def stem_array(name: str) -> Column:
    """The stems of an array column of words, as one expression without Python."""
    return F.expr(stem_sql(f"`{name}`", SPARK))


class Rules:
    """The same tables over a Python string."""

    def __init__(self) -> None:
        self.m1, self.m2, self.only1, self.cvc, self.vowel = map(re.compile, (M1, M2, ONLY1, CVC, V))
        self.consonant_y = re.compile("(?<=[aeiou])y")

    def __call__(self, word: str) -> str:
        if len(word) <= 2:
            return word
        w = self.consonant_y.sub("Y", "Y" + word[1:] if word[0] == "y" else word)
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        w = self.final_y(self.past(w))
        for table in (STEP2, STEP3):
            if len(w) > 2:
                w = next((w[: -len(s)] + r for s, r in table if w.endswith(s)), w)
        if len(w) > 2:
            cuts = ((s, w[: -3 if s in ("sion", "tion") else -len(s)]) for s in STEP4)
            w = next((b for s, b in cuts if w.endswith(s) and self.m1.search(b)), w)
        b = w[:-1]
        if w.endswith("e") and (self.m2.search(b) or (self.m1.search(b) and not self.cvc.search(b))):
            w = b
        if w.endswith("ll") and self.m2.search(w[:-1]):
            w = w[:-1]
        return w.lower()

    def past(self, w: str) -> str:
        if w.endswith("eed"):
            return w[:-1]
        n = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if not n or not self.vowel.search(w[:-n]):
            return w
        b = w[:-n]
        if b.endswith(("at", "bl", "iz")):
            return b + "e"
        if len(b) > 1 and b[-1] == b[-2] and b[-1] not in "aeiouylsz":
            return b[:-1]
        return b + "e" if self.only1.search(b) and self.cvc.search(b) else b

    def final_y(self, w: str) -> str:
        return w[:-1] + "i" if w[-1:] in ("y", "Y") and self.vowel.search(w[:-1]) else w


def stem_words(words: pa.Array) -> pa.Array:
    """The same tables over an Arrow array, a whole column for each rule."""
    join = lambda a, tail: pc.binary_join_element_wise(a, tail, "")
    has, ends, length = pc.match_substring_regex, pc.ends_with, pc.utf8_length
    cut = lambda a, n: pc.utf8_slice_codeunits(a, 0, -n)

    def case(x: pa.Array, *rules: tuple) -> pa.Array:
        return pc.case_when(pc.make_struct(*(c for c, _ in rules)), *(v for _, v in rules), x)

    x = pc.replace_substring_regex(pc.replace_substring_regex(words, "^y", "Y"), "([aeiou])y", r"\1Y")
    x = case(x, (ends(x, "sses"), cut(x, 2)), (ends(x, "ies"), cut(x, 2)), (ends(x, "ss"), x), (ends(x, "s"), cut(x, 1)))
    shorter = lambda n: pc.if_else(has(cut(x, n), V), join(cut(x, n), "#"), x)
    x = case(x, (ends(x, "eed"), cut(x, 1)), (ends(x, "ed"), shorter(2)), (ends(x, "ing"), shorter(3)))
    b, last = cut(x, 1), pc.utf8_slice_codeunits(x, -2, -1)
    twice = pc.and_(pc.and_(pc.greater(length(x), 2), pc.equal(last, pc.utf8_slice_codeunits(x, -3, -2))), has(last, "^[^aeiouylsz]$"))
    x = case(x, (pc.invert(ends(x, "#")), x), (has(b, "(at|bl|iz)$"), join(b, "e")), (twice, cut(x, 2)), (pc.and_(has(b, ONLY1), has(b, CVC)), join(b, "e")), (ends(x, "#"), b))
    x = case(x, (pc.and_(has(x, "[yY]$"), has(cut(x, 1), V)), join(cut(x, 1), "i")))
    for table in (STEP2, STEP3):
        x = case(x, (pc.less_equal(length(x), 2), x), *((ends(x, s), join(cut(x, len(s)), r)) for s, r in table))
    sizes = ((s, 3 if s in ("sion", "tion") else len(s)) for s in STEP4)
    x = case(x, (pc.less_equal(length(x), 2), x), *((pc.and_(ends(x, s), has(cut(x, n), M1)), cut(x, n)) for s, n in sizes))
    b = cut(x, 1)
    x = case(x, (pc.and_(ends(x, "e"), pc.or_(has(b, M2), pc.and_(has(b, M1), pc.invert(has(b, CVC))))), b))
    x = case(x, (pc.and_(ends(x, "ll"), has(cut(x, 1), M2)), cut(x, 1)))
    return pc.if_else(pc.less_equal(length(words), 2), words, pc.utf8_lower(x))


def stem_series(words: Column) -> Column:
    """The Arrow form over a word column, faster than the expression over a large vocabulary."""

    def stems(batch: pd.Series) -> pd.Series:
        return stem_words(pa.array(batch, pa.string())).to_pandas()

    return F.pandas_udf(stems, "string")(words)
