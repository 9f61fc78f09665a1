"""The synonym table as CSV, and its round trip."""

from __future__ import annotations

from quillon.functions.text import fold_text
from quillon.sources.parsers import parse_delimited

# fixed values: names of the first column of a header
HEADS = {"term", "termino", "from", "variant", "variante"}


def synonyms_to_csv(rows: list[tuple[str, str]]) -> str:
    """Lines "term,preferred"; a cell with a comma, quote or line break is quoted."""
    quoted = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in '",\r\n') else s
    return "".join(f"{quoted(a)},{quoted(b)}\r\n" for a, b in [("term", "preferred"), *rows])


def synonyms_from_csv(text: str) -> list[tuple[str, str]]:
    """Pairs of two filled cells; a first row whose first cell names a column is the header."""
    out = []
    for i, row in enumerate(parse_delimited(text.removeprefix("﻿"))):
        a, b = (" ".join(c.split()) for c in (*row, "", "")[:2])
        if a and b and not (i == 0 and fold_text(a) in HEADS):
            out.append((a, b))
    return out
