"""Text expressions; white space is Unicode's, as Python's strip and split have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Characters that Python strips beyond what Java's Unicode class calls white space.
_SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), rf"^{_SPACE}+|{_SPACE}+$", "")


def non_blank(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike(r"[^\p{IsWhite_Space}\x1C-\x1F]"), F.lit(False))


def word_count(x: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_c(x), F.lit(r"[^\p{IsWhite_Space}\x1C-\x1F]+"), F.lit(0)))


def content_id(source_id: Column | str, content: Column | str) -> Column:
    """SHA-256 of the content in place of an id of UUID shape (36 characters, 4 of them hyphens)."""
    i = _c(source_id)
    hyphens = F.char_length(i) - F.char_length(F.replace(i, F.lit("-"), F.lit("")))
    return F.when(i.isNull() | ((F.char_length(i) == 36) & (hyphens == 4)), F.sha2(_c(content), 256)).otherwise(i)


def mask(x: Column | str, prefix: int = 4, suffix: int = 4) -> Column:
    """First and last characters of a secret; *** alone where that would show all of it."""
    c = _c(x)
    return F.when(F.char_length(c) <= prefix + suffix, "***").otherwise(F.concat(F.substring(c, 1, prefix), F.lit("***"), F.right(c, F.lit(suffix))))


def question_key(question: Column | str) -> Column:
    return F.lower(strip(question))


def ends_with_question_mark(question: Column | str) -> Column:
    return _c(question).rlike(rf"\?{_SPACE}*$")


def file_suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./\\]+)$", 1))
