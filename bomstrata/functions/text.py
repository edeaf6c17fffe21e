"""Text predicates built from JVM-side functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for an absent value, after trimming and lower-casing.
NULL_TOKENS = ("", "noassertion", "none", "n/a", "unknown")

#: White space that trimming removes, as Unicode's White_Space plus the four separators U+001C..U+001F.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks. Null stays null."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_null_token(c: Column) -> Column:
    """True for a text that only stands for "no value"; null for null."""
    return F.lower(strip(c)).isin(*NULL_TOKENS)


def has_value(c: Column) -> Column:
    """True where a text is neither null nor a null token."""
    return c.isNotNull() & ~is_null_token(c)
