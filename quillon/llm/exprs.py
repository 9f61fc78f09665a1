"""Column helpers shared by the native operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def count_of(column: Column, characters: str) -> Column:
    """How many characters of ``column`` are in ``characters``."""
    return (F.length(column) - F.length(F.translate(column, characters, ""))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all columns in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
