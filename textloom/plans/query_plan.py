"""Boolean queries: from text to postfix order to a plan over columns. Ill-formed queries never raise."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.stemmer import Rules
from ..functions.text import TOKEN

#: Operators and how tightly they bind; a parenthesis binds least.
BINDS = {"!": 3, "&": 2, "|": 1}
OPERATORS = {*BINDS, "(", ")"}
Stemmer = Callable[[str], str]


def plain(word: str) -> str:
    return word


@lru_cache(maxsize=1)
def porter() -> Stemmer:
    return Rules()


def tokenize(text: str, stemmer: Stemmer = plain) -> list[str]:
    found = (stemmer(t.lower()).rstrip("'") for t in re.findall(TOKEN, text))
    return [t for t in found if t]


def raw_split(query: str) -> list[str]:
    return re.findall(r"[()!&|]|[^ ()!&|]+", query)


def infix(query: str, stemmer: Stemmer = plain) -> list[str]:
    """Operators and terms; an & goes between a term or ")" and a following term, "(" or "!"."""
    out: list[str] = []
    for chunk in raw_split(query):
        for part in [chunk] if chunk in OPERATORS else tokenize(chunk, stemmer):
            ends = out and (out[-1] not in OPERATORS or out[-1] == ")")
            if ends and (part not in OPERATORS or part in ("(", "!")):
                out.append("&")
            out.append(part)
    return out


def postfix(parts: Sequence[str]) -> list[str]:
    """All operators group to the left; a parenthesis without partner stays an operator at the end."""
    out: list[str] = []
    held: list[str] = []
    for p in parts:
        if p == "(":
            held.append(p)
        elif p == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        elif p in BINDS:
            while held and BINDS.get(held[-1], 0) >= BINDS[p]:
                out.append(held.pop())
            held.append(p)
        else:
            out.append(p)
    return out + held[::-1]


def terms_of(parts: Sequence[str]) -> list[str]:
    """Every term, repeated and negated ones too."""
    return [p for p in parts if p not in OPERATORS]


def condition(rpn: Sequence[str], holds: Callable[[str], Column]) -> Column | None:
    """Fold a postfix query into one boolean column; None if nothing is left. An operator without operands is skipped, and an open parenthesis with two eats both."""
    stack: list[Column] = []
    for p in rpn:
        if p == "!":
            if stack:
                stack.append(~stack.pop())
        elif p in OPERATORS:
            if len(stack) >= 2:
                b, a = stack.pop(), stack.pop()
                if p != "(":
                    stack.append(a & b if p == "&" else a | b)
        else:
            stack.append(F.coalesce(holds(p), F.lit(False)))
    return stack[-1] if stack else None


def holds_without_terms(rpn: Sequence[str]) -> bool:
    """Whether a document that has none of the terms is selected."""
    stack: list[bool] = []
    for p in rpn:
        if p == "!":
            if stack:
                stack.append(not stack.pop())
        elif p in OPERATORS:
            if len(stack) >= 2:
                b, a = stack.pop(), stack.pop()
                if p != "(":
                    stack.append(a and b if p == "&" else a or b)
        else:
            stack.append(False)
    return bool(stack and stack[-1])


def choose(key: Column, values: dict[str, Column]) -> Column:
    """The value of a key, null for others."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out
