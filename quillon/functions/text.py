"""Text functions as column expressions, and small Python kernels where Unicode tables are needed.

``fold`` makes strings comparable without case and accents. It stays inside generated code:
combining marks are removed by pattern, precomposed Latin letters by ``translate``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Precomposed Latin letters and their bases, derived from the Unicode tables."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(0x300 <= ord(m) <= 0x36F for m in base[1:]) and base[0].isascii():
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


_FROM, _TO = _accents()


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(F.regexp_replace(c, r"[\x{0300}-\x{036F}]", ""), _FROM, _TO))


def fold_text(s: str) -> str:
    if s and s.isascii():
        return s.lower()
    return "".join(x for x in unicodedata.normalize("NFD", s or "") if not 0x300 <= ord(x) <= 0x36F).lower()


def clean(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))


def norm_title(c: Column) -> Column:
    """A title for comparison: tags removed, folded, everything but letters and digits a space."""
    return F.trim(F.regexp_replace(fold(F.regexp_replace(c, "<[^>]*>", " ")), r"[^\p{L}\p{N}]+", " "))


def norm_doi(c: Column) -> Column:
    """The DOI inside a string, lower case, without trailing punctuation and format suffixes; '' if none."""
    found = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"(10\.\d{4,9}/[^\s\"<>]*(?:<\d[^\s>]*>[^\s\"<>]*)*)", 1)
    bare = F.regexp_replace(found, r"(?:/(?:pdf|full|abstract|epdf|html?))+$", "")
    return F.regexp_replace(bare, r"[.,;:)\]}'\"]+$", "")


def year_of(c: Column) -> Column:
    """The first year from 1500 to 2099 in a string."""
    return F.expr("null").cast("int") if c is None else F.nullif(F.regexp_extract(c, r"(?:^|\D)(1[5-9]\d\d|20\d\d)(?:\D|$)", 1), F.lit("")).cast("int")


def int_of(c: Column) -> Column:
    """The first whole number in a string, thousands separators ignored."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"(?<=\d)[,.](?=\d{3}(?:\D|$))", ""), r"-?\d+", 0), F.lit("")).cast("long")


def pages_of(c: Column) -> Column:
    """first-last with a plain hyphen."""
    return F.regexp_replace(clean(c), r"\s*[-\x{2010}-\x{2015}]+\s*", "-")


def split_list(c: Column, by: str = ";") -> Column:
    """Trimmed parts of a list in a string, blanks left out, the first spelling of equal ones kept."""
    parts = F.filter(F.transform(F.split(c, f"[{by}]"), clean), lambda x: x != "")
    return uniq(F.coalesce(parts, F.array().cast("array<string>")))


def uniq(c: Column) -> Column:
    """An array without values that are equal when folded; the first spelling stays."""
    folded = F.transform(c, fold)
    return F.filter(c, lambda x, i: F.array_position(folded, fold(x)) == i + 1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(c: Column) -> Column:
    """Words of two characters or more that are not all digits; inner hyphens stay."""
    found = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^[\d-]+$"))


def bigrams(words: Column, stop: list[str]) -> Column:
    """Pairs of neighbours, never across a stop word."""
    stops = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    bad = lambda w: F.array_contains(stops, w)
    pairs = F.transform(words, lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b")))
    good = F.filter(pairs, lambda p: p["b"].isNotNull() & ~bad(p["a"]) & ~bad(p["b"]))
    return F.transform(good, lambda p: F.concat_ws(" ", p["a"], p["b"]))


def title_probe(c: Column) -> Column:
    """The first 60 characters of a normalised title, or '' if it is under 20."""
    t = norm_title(c)
    return F.when(F.length(t) >= 20, F.trim(F.substring(t, 1, 60))).otherwise("")


def numbers_of(title: Column) -> Column:
    """Sorted numbers and short roman numerals of a normalised title; titles that differ in them are different works."""
    return F.array_sort(F.regexp_extract_all(title, F.lit(r"\b(?:\d+|[ivx]{1,4})\b"), F.lit(0)))


def title_similarity(a: Column, b: Column, threshold: float) -> Column:
    """1 - distance / longer length; 0 if it is below the threshold. The distance is banded."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - threshold) * longest + 1e-9).cast("int")
    d = F.call_function("levenshtein", a, b, most)  # -1 beyond the band
    return F.when((longest > 0) & (F.abs(F.length(a) - F.length(b)) <= most) & (d >= 0), 1 - d / longest).otherwise(0.0)


def contains_all(row: Column, query: str) -> Column:
    """Every white-space separated term of the query is in the row, without case and accents."""
    out = F.lit(True)
    for term in fold_text(query).split():
        out = out & F.contains(fold(row), F.lit(term))
    return out


def surname_compatible(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a)


#: fixed values: LaTeX accents (command to combining mark) and letters
LATEX_ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
LATEX_LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ"}


def latex_text(s: str) -> str:
    """LaTeX markup to plain text: accents composed, commands and braces gone."""
    import re

    def accent(m):
        letter = {"ı": "i", "ȷ": "j"}.get(m[2], m[2])
        return unicodedata.normalize("NFC", letter + LATEX_ACCENTS[m[1]])

    s = re.sub(r"\\(" + "|".join(sorted(LATEX_LETTERS, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}|\s)?", lambda m: LATEX_LETTERS[m[1]], s)
    s = re.sub(r"\\([`'^~\"=.])\s*\{?\s*([A-Za-zıȷ])\s*\}?", accent, s)
    s = re.sub(r"\\([uvHckrdb])(?:\s*\{\s*([A-Za-zıȷ])\s*\})", accent, s)
    s = re.sub(r"\\([uvHckrdb])\s+([A-Za-zıȷ])", accent, s)
    s = re.sub(r"\\([&%$#_{}])", r"\1", s.replace("~", " ").replace("---", "—").replace("--", "–"))
    s = re.sub(r"\\[A-Za-z]+\*?\s*", "", s)
    return " ".join(s.replace("{", "").replace("}", "").replace("$", "").split())


#: fixed values: frequent English function words
ENGLISH = frozenset("the of and in to for with that is are was were this by from on as an be which we".split())


def english_score(s: str) -> float:
    """The share of frequent English words in a text."""
    words = s.lower().split()
    return sum(w in ENGLISH for w in words) / len(words) if words else 0.0
