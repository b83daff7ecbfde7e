"""Numeric features of a code text, all of them built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixweave.functions.pytext import SPACE, count_lines, not_blank

# ---- fixed values: patterns whose presence makes a feature 1
NULL_CHECK = [
    r"\bnull\b", r"\bNone\b",
    rf"=={SPACE}*null", rf"!={SPACE}*null", rf"is{SPACE}+None", rf"is{SPACE}+not{SPACE}+None",
]
IF_STATEMENT = [r"\bif\b"]
TRY_CATCH = [r"\btry\b", r"\bcatch\b", r"\bexcept\b"]
THROW_OR_RAISE = [r"\bthrow\b", r"\braise\b"]
RETURN = [r"\breturn\b"]
LENGTH_CHECK = [r"\.length", rf"\blen{SPACE}*\(", r"\bsize\b", r"\bbyteLength\b"]
REGEX = ["RegExp", rf"\.exec{SPACE}*\(", rf"\.match{SPACE}*\(", r"/[^\n]+/"]

FLAGS = {
    "has_null_check": NULL_CHECK,
    "has_if_statement": IF_STATEMENT,
    "has_try_catch": TRY_CATCH,
    "has_throw_or_raise": THROW_OR_RAISE,
    "has_return": RETURN,
    "has_length_check": LENGTH_CHECK,
    "has_regex": REGEX,
}
# Plain texts of which one must occur for a pattern of the feature to match.
# Looking for them is far cheaper than a Unicode regular expression.
NEEDED = {
    "has_null_check": ["null", "None"],
    "has_if_statement": ["if"],
    "has_try_catch": ["try", "catch", "except"],
    "has_throw_or_raise": ["throw", "raise"],
    "has_return": ["return"],
    "has_length_check": [".length", "len", "size", "byteLength"],
    "has_regex": ["RegExp", ".exec", ".match", "/"],
}
FEATURES = [*FLAGS, "line_count", "char_count"]


def flag(code: Column, patterns: list[str], needed: list[str]) -> Column:
    """1 when any pattern occurs, 0 otherwise and for NULL."""
    possible = reduce(or_, [code.contains(text) for text in needed])
    found = F.when(possible, code.rlike("(?U)" + "|".join(patterns)))
    return F.coalesce(found.cast("int"), F.lit(0))


def line_count(code: Column) -> Column:
    return F.when(not_blank(code), count_lines(code)).otherwise(0)


def char_count(code: Column) -> Column:
    return F.coalesce(F.length(code), F.lit(0))


def feature(name: str, code: Column) -> Column:
    """One feature column by its name."""
    if name == "line_count":
        return line_count(code)
    if name == "char_count":
        return char_count(code)
    return flag(code, FLAGS[name], NEEDED[name])
