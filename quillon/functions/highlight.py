"""Terms marked in a text, without regard to case and accents, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import _FROM, _TO, fold_text

#: Stands for a marked character in a mask.
_MARK = "\x01"


def highlight_terms(text: str | None) -> list[str]:
    """Terms of two characters or more of a list with commas, semicolons or lines, the longest first."""
    found = {" ".join(t.split()): None for t in re.split(r"[,;\n]+", text or "")}
    return sorted((t for t in found if len(t) > 1), key=len, reverse=True)


def _mask(folded: Column, term: str) -> Column:
    """``folded`` with every character of the term replaced where no letter or digit adjoins it."""
    return F.regexp_replace(folded, rf"(?<![\p{{L}}\p{{N}}])\Q{term}\E(?![\p{{L}}\p{{N}}])", _MARK * len(term))


def highlight(column: Column, terms: list[str]) -> Column:
    """The pieces of a text column, in order, as array<struct<text, mark>>; terms that overlap are marked as one piece.

    A null or empty text has no pieces. Each term gives a mask as long as the text; what any mask marks is marked.
    """
    text = F.coalesce(column, F.lit(""))
    folded = F.lower(F.translate(text, _FROM, _TO))  # letter by letter, so that places stay
    masks = F.array(folded, *[_mask(folded, fold_text(t)) for t in terms if fold_text(t)])
    place = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    union = F.get(F.transform(F.array(masks), lambda m: F.array_join(F.transform(place, lambda i: F.when(F.exists(m, lambda x: F.substring(x, i, F.lit(1)) == _MARK), _MARK).otherwise("-")), "")), F.lit(0))
    runs = F.regexp_extract_all(F.when(F.length(text) > 0, union).otherwise(""), F.lit(f"{_MARK}+|-+"), F.lit(0))
    start = lambda r, i: F.aggregate(F.slice(r, F.lit(1), i), F.lit(1), lambda n, x: n + F.length(x))
    piece = lambda r: F.transform(r, lambda x, i: F.struct(F.substring(text, start(r, i), F.length(x)).alias("text"), F.startswith(x, F.lit(_MARK)).alias("mark")))
    return F.get(F.transform(F.array(runs), piece), F.lit(0))
