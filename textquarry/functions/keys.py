"""Keys as they count in comparisons: white space trimmed, case ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.isspace sees it, for a Java regex class.
WHITESPACE_CLASS = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, f"^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+$", "")


def key(text: Column | str) -> Column:
    """Stripped and in lower case; null stays null."""
    return F.lower(strip(text))
