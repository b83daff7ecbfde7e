"""Expressions over function names, line spans and code text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixweave.functions.pytext import (
    SPACE, SPACE_CHARS, SPACE_IN_LINE, drop_whitespace, first_line, line_total, not_blank, strip,
)

# ---- fixed values: names that stand for "no name"
PLACEHOLDER_NAMES = ["(anonymous)", "anonymous", "<anonymous>", "unknown"]

# ---- fixed value: distance of spans whose gap cannot be told
FAR = 10**9

# ---- fixed values: patterns of the cleaning rules
# One left-over line in front of a function: a lone closing brace, a rule of
# percent signs, a preprocessor guard, an empty comment line.
_LEFTOVER_LINE = (
    rf"{SPACE_IN_LINE}*(?:"
    rf"\}}[;{SPACE_CHARS}&&[^\n]]*"
    r"|%{3,}"
    rf"|#{SPACE_IN_LINE}*(?:endif|else|if)\b[^\n]*"
    rf"|[/*]+{SPACE_IN_LINE}*"
    r")(?:\n|\z)"
)
_FROM_FIRST_REAL_LINE = rf"(?sU)(?<![^\n])(?!{_LEFTOVER_LINE})(.*)\z"

# Starts of control-flow blocks, which are never function definitions.
_BLOCK_START = (
    rf"(?U)\A\}}?{SPACE}*(?:"
    rf"catch{SPACE}*\("
    rf"|else{SPACE}*[{{:]"
    rf"|else{SPACE}+if{SPACE}*\("
    rf"|elif{SPACE}"
    r"|except\b"
    rf"|finally{SPACE}*[{{:]"
    rf"|case{SPACE}+.+:"
    rf"|default{SPACE}*:"
    r")"
)

_COMMENTS = [r"(?s)/\*.*?\*/", r"//[^\n]*", r"#[^\n]*"]


def valid_method_name(name: Column) -> Column:
    """Not blank, no placeholder, and with two ASCII letters in a row."""
    wanted = ~F.lower(strip(name)).isin(PLACEHOLDER_NAMES) & name.rlike("[a-zA-Z]{2}")
    return F.coalesce(wanted, F.lit(False))


def valid_line_range(start: Column, end: Column) -> Column:
    return F.coalesce((start > 0) & (end >= start), F.lit(False))


def _any_null(*columns: Column) -> Column:
    missing = F.lit(False)
    for column in columns:
        missing = missing | column.isNull()
    return missing


def line_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Number of lines two spans share; 0 when a bound is missing."""
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1
    return (
        F.when(_any_null(a_start, a_end, b_start, b_end), F.lit(0).cast("bigint"))
        .otherwise(F.greatest(shared.cast("bigint"), F.lit(0).cast("bigint")))
    )


def line_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Gap between two spans; 0 when they share lines, ``FAR`` when it cannot be told."""
    return (
        F.when(_any_null(a_start, a_end, b_start, b_end), F.lit(FAR))
        .when(line_overlap(a_start, a_end, b_start, b_end) > 0, F.lit(0))
        .when(a_end < b_start, b_start - a_end)
        .when(b_end < a_start, a_start - b_end)
        .otherwise(F.lit(FAR))
        .cast("bigint")
    )


def block_text(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start..end`` (1-based, end clamped) joined by line feeds, untouched.

    ``lines`` comes from :func:`fixweave.functions.pytext.raw_lines`. NULL when
    the range is invalid or starts past the end.
    """
    total = line_total(lines)
    usable = valid_line_range(start, end) & (start <= total)
    first, last = start.cast("int"), F.least(end, total).cast("int")
    return F.when(usable, F.array_join(F.slice(lines, first, last - first + 1), "\n"))


def clean_code(text: Column) -> Column:
    """Drop left-over lines and then blank lines from the front of ``text``.

    Expects lines joined by ``\\n``; one trailing line feed is dropped. The first
    wanted line is found by one search, however many lines stand before it.
    """
    body = F.regexp_extract(F.regexp_replace(text, r"\n\z", ""), _FROM_FIRST_REAL_LINE, 1)
    return F.regexp_replace(body, rf"(?U)\A{SPACE}*(?:\n|\z)", "")


def clean_block(text: Column) -> Column:
    """Cleaned text of a cut block, NULL when nothing but blanks is left."""
    cleaned = clean_code(text)
    return F.when(not_blank(cleaned), cleaned)


def code_block(lines: Column, start: Column, end: Column) -> Column:
    """Cleaned lines ``start..end``, NULL when nothing but blanks is left."""
    return clean_block(block_text(lines, start, end))


def looks_like_function(code: Column) -> Column:
    """False for blank code and for blocks that open with catch, else, case and so on."""
    line = first_line(code)
    return F.coalesce((line != "") & ~line.rlike(_BLOCK_START), F.lit(False))


def strip_comments(code: Column) -> Column:
    """Remove ``/* */``, then ``//``, then ``#`` comments, wherever these signs stand."""
    for pattern in _COMMENTS:
        code = F.regexp_replace(code, pattern, "")
    return code


def change_reason(vuln: Column, patch: Column) -> Column:
    """Why a pair is no real change: missing / whitespace / comment; NULL if it is one."""
    return (
        F.when(F.coalesce(vuln, F.lit("")) == "", "missing")
        .when(F.coalesce(patch, F.lit("")) == "", "missing")
        .when(drop_whitespace(vuln) == drop_whitespace(patch), "whitespace")
        .when(drop_whitespace(strip_comments(vuln)) == drop_whitespace(strip_comments(patch)), "comment")
    )


def meaningful_change(vuln: Column, patch: Column) -> Column:
    """True when more than blanks and comments differ."""
    return change_reason(vuln, patch).isNull()
