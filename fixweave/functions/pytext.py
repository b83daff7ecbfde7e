"""Text expressions that follow Python's rules for lines, blanks and ``re``.

Java and Python disagree on three points that change results:

* ``str.splitlines`` cuts at more characters than Java's ``^``/``$``/``.`` know;
* Python's ``\\s`` also takes the separators U+001C to U+001F;
* Python patterns are Unicode-aware, Java needs the ``(?U)`` flag for that.

Every pattern of the package is therefore built from the pieces below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters at which str.splitlines cuts (body of a character class).
BREAK_CHARS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE_BREAK = rf"\r\n|[{BREAK_CHARS}]"
OTHER_BREAK = rf"\r\n|[{BREAK_CHARS}&&[^\n]]"
_OTHER_BREAK_CHAR = rf"[{BREAK_CHARS.removeprefix(chr(92) + 'n')}]"
LINE_START = rf"(?<![^{BREAK_CHARS}])"
LINE_BODY = rf"[^{BREAK_CHARS}]*"

# Python's \s and its complement; only right under (?U).
SPACE_CHARS = r"\s\x1c-\x1f"
SPACE = rf"[{SPACE_CHARS}]"
# The same without the line feed, for text whose lines are joined by "\n".
SPACE_IN_LINE = rf"[{SPACE_CHARS}&&[^\n]]"


def not_blank(text: Column) -> Column:
    """``text.strip() != ''``; NULL stays NULL."""
    return text.rlike(rf"(?U)[^{SPACE_CHARS}]")


def strip(text: Column) -> Column:
    """``text.strip()``."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def drop_whitespace(text: Column) -> Column:
    """Remove every whitespace character."""
    return F.regexp_replace(text, rf"(?U){SPACE}+", "")


def plain_breaks(text: Column) -> Column:
    """Turn every line break into a single line feed."""
    return F.regexp_replace(text, OTHER_BREAK, "\n")


def one_byte_breaks(text: Column) -> Column:
    """``text`` with the same line starts, where every break ends in a line feed; mostly the text itself."""
    return F.when(text.rlike(_OTHER_BREAK_CHAR), F.regexp_replace(text, _OTHER_BREAK_CHAR, "\n")).otherwise(text)


def raw_lines(text: Column) -> Column:
    """Lines of ``text``, with one extra ``''`` when it is empty or ends in a break.

    Kept apart from :func:`line_total` so that callers can compute the array once
    and read it several times. Splitting at one plain character needs no regular
    expression, which is why the other breaks are replaced first.
    """
    return F.split(plain_breaks(text), "\n", -1)


def line_total(lines: Column) -> Column:
    """``len(text.splitlines())`` for an array made by :func:`raw_lines`."""
    return F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)


def count_lines(text: Column) -> Column:
    """``len(text.splitlines())`` without building an array in the plan."""
    closed = (text == "") | F.substring(text, -1, 1).rlike(f"[{BREAK_CHARS}]")
    return F.regexp_count(text, F.lit(LINE_BREAK)) + F.when(closed, 0).otherwise(1)


def first_line(text: Column) -> Column:
    """First non-blank line, without leading blanks; ``''`` if there is none."""
    return F.regexp_extract(text, rf"(?U)\A{SPACE}*({LINE_BODY})", 1)
