"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts, and what ends a line, as Java character classes.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c: Column | str) -> Column:
    """Letters and digits only, in their order, without letter case; '' where there are none, null for null.

    Two strings agree exactly when their canonical forms are equal.
    """
    return F.lower(F.upper(F.regexp_replace(col(c), r"[^\p{L}\p{N}]+", "")))


def not_blank(canon: Column | str) -> Column:
    return F.coalesce(F.length(col(canon)) > 0, F.lit(False))


def plain_space(c: Column | str) -> Column:
    """White space of all scripts as U+0020, line ends as U+000A, each CR LF as one.

    ASCII texts without control characters, the common case, are returned as they are;
    the others go through plain replacements, which are cheaper than one pattern.
    """
    text = col(c)
    plain = (F.octet_length(text) == F.length(text)) & ~F.regexp(text, F.lit(r"[\x00-\x09\x0b-\x1f\x7f]"))
    other = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    for end in map(chr, [*range(11, 14), *range(28, 31), 0x85, 0x2028, 0x2029]):
        other = F.replace(other, F.lit(end), F.lit("\n"))
    for space in map(chr, [9, 31, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]):
        other = F.replace(other, F.lit(space), F.lit(" "))
    return F.when(plain, text).otherwise(other)


def strip(c: Column | str) -> Column:
    """Without white space of any script at either end (F.trim takes U+0020 only).

    Most texts end in none once trimmed: only their outermost characters are tested.
    """
    t = F.trim(col(c))
    ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    return F.when(F.regexp(ends, F.lit(rf"[{SPACE}]")), F.regexp_replace(t, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(t)


def lines(c: Column | str) -> Column:
    """Split at line ends; a CR LF counts as one."""
    return F.split(col(c), rf"\r\n|[{LINE_END}]")
