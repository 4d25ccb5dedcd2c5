"""Text columns. Lengths and cuts are in code points; a null text stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: ASCII white space.
SPACE = r"[ \t\n\u000B\f\r]+"


def words(text: Column) -> Column:
    """The words of a text; none for an empty one."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def as_query(text: Column) -> Column:
    """The form in which an encoder wants a text."""
    return F.concat(F.lit("query: "), text)


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def shortened(text: Column, n: int) -> Column:
    """At most ``n`` code points, with an ellipsis where some are missing."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def numbered(prefix: str, number: Column, digits: int) -> Column:
    """A file name's stem with a zero-padded number."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), digits, "0"))


def number_of(name: Column) -> Column:
    """The number at the end of such a name, before its extension; null if there is none."""
    found = F.regexp_extract(name, r"(\d+)(?:\.[A-Za-z]+)?$", 1)
    return F.when(found != "", found.cast("long"))
