"""Unified-diff expressions.

Counting is done by the bytes that dropping a line start takes away, cutting by
regular expressions anchored at line starts, so a diff is never exploded or turned
into an array of all of its lines: the work stays inside one generated projection
and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixweave.functions.pytext import LINE_BODY, LINE_START, one_byte_breaks

# ---- fixed values: line starts that are diff headers, not content
META_PREFIXES = [
    "diff --git", "index ", "--- ", "+++ ", "@@", "new file mode", "deleted file mode",
    "similarity index", "rename from", "rename to",
]
HUNK_PREFIX = "@@"

# Three signs in a row are header-like and never content.
_ADDED = r"\+(?!\+\+)"
_REMOVED = r"-(?!--)"


def _count(diff: Column, prefix: str) -> Column:
    """Lines that start with ``prefix``: a plain search, as a look-behind at every character is slow."""
    lines, start = F.concat(F.lit("\n"), one_byte_breaks(diff)), "\n" + prefix
    dropped = F.octet_length(lines) - F.octet_length(F.replace(lines, F.lit(start), F.lit("")))
    return F.coalesce((dropped / len(start)).cast("int"), F.lit(0))


def added_lines(diff: Column) -> Column:
    return _count(diff, "+") - _count(diff, "+++")


def removed_lines(diff: Column) -> Column:
    return _count(diff, "-") - _count(diff, "---")


def hunk_count(diff: Column) -> Column:
    return _count(diff, HUNK_PREFIX)


def _contents(diff: Column, sign: str) -> Column:
    found = F.regexp_extract_all(diff, F.lit(f"{LINE_START}{sign}({LINE_BODY})"), 1)
    return F.coalesce(F.array_join(found, "\n"), F.lit(""))


def before_code(diff: Column) -> Column:
    """Contents of the removed lines."""
    return _contents(diff, _REMOVED)


def after_code(diff: Column) -> Column:
    """Contents of the added lines."""
    return _contents(diff, _ADDED)


def diff_only(diff: Column) -> Column:
    """Changed lines in their order, each as ``+ content`` or ``- content``."""
    found = F.regexp_extract_all(diff, F.lit(f"{LINE_START}(?:{_ADDED}|{_REMOVED}){LINE_BODY}"), 0)
    spaced = F.regexp_replace(F.array_join(found, "\n"), r"(?<![^\n])([+-])", "$1 ")
    return F.coalesce(spaced, F.lit(""))


def line_kind(line: Column) -> Column:
    """hunk / meta / added / removed / context for one diff line."""
    meta = F.lit(False)
    for prefix in META_PREFIXES:
        meta = meta | line.startswith(prefix)
    return (
        F.when(line.startswith(HUNK_PREFIX), "hunk")
        .when(meta, "meta")
        .when(line.rlike(r"\A" + _ADDED), "added")
        .when(line.rlike(r"\A" + _REMOVED), "removed")
        .otherwise("context")
    )
